"""Token-ID shards with a minimal perfect hash index from document key to offset.

Layout below one folder:

* ``shard-NNNNN.ids``: 16-byte header (``TLID``, version, bytes an id, zeros),
  then the ids of its documents, little-endian, in ascending document order.
  Shards are ranges of document ids, so shard order is document order.
* ``index-NNNNN.mph``: a header (``TLMP``, blocks, keys), the pilots of all
  buckets, then one 32-byte entry for each slot: fingerprint, shard, first id
  in the shard, count, first id in the corpus.

A key's index file, block, bucket and slot follow from its hash and one stored
pilot, so a lookup reads one pilot and one entry, whatever the corpus size; the
64-bit fingerprint tells keys that were never written.  Keys are (doc_id, copy):
rows that repeat a doc_id are numbered 0, 1, ... in text order.

Semantics for odd input: a null or empty text is one end id; a null doc_id is a
key of its own and sorts first; an empty table gives no files; a vocabulary whose
ids don't fit in ``id_bytes`` is refused.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.shared import AtomicFile, cut, new_folder, store
from touchline.llm.text_hash import mix

END_ID = 0
#: About so many documents a shard and so many keys an index file.
DOCS_PER_SHARD = 4096
KEYS_PER_INDEX = 16384
_BLOCK, _BUCKET = 1024, 4
_ENTRY = np.dtype([("mark", "<u8"), ("shard", "<u4"), ("count", "<u4"), ("start", "<u8"), ("corpus", "<u8")])
_U = np.uint64


def key_hash(ids: np.ndarray, nulls: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """64-bit hashes of (doc_id, copy) keys."""
    h = mix(ids.astype(np.int64).view(np.uint64) + _U(0x9E3779B97F4A7C15))
    h = np.where(nulls, _U(0x5851F42D4C957F2D), h)
    return mix(h ^ mix(copies.astype(np.uint64) + _U(0xD1B54A32D192ED03)))


def build_block(h: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(pilot of each bucket, slot of each key) of a minimal perfect hash.

    Buckets go from large to small; each takes the first pilot that sends its
    keys to distinct free slots.  As many slots as keys.
    """
    n = len(h)
    pilots, slots, free = np.zeros(n_buckets, dtype=np.uint32), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    bucket = bucket_of(h, n_buckets)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=n_buckets)
    ends = np.cumsum(sizes)
    for b in np.argsort(-sizes, kind="stable"):
        if not sizes[b]:
            break
        keys = order[ends[b] - sizes[b] : ends[b]]
        base = 0
        while True:
            tried = np.arange(base, base + 128, dtype=np.uint64)
            to = slot_of(h[keys][None, :], tried[:, None], n)
            good = free[to].all(axis=1)
            if sizes[b] > 1:
                ranked = np.sort(to, axis=1)
                good &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            if good.any():
                at = int(np.argmax(good))
                pilots[b], slots[keys] = base + at, to[at]
                free[to[at]] = False
                break
            base += 128
            if base > 1 << 24:
                raise ValueError("two keys of a block have equal 64-bit hashes")
    return pilots, slots


def bucket_of(h: np.ndarray, n) -> np.ndarray:
    return (mix(h ^ _U(0xE7037ED1A0B428DB)) % np.asarray(n, dtype=np.uint64)).astype(np.int64)


def block_of(h: np.ndarray, n: int) -> np.ndarray:
    return (mix(h ^ _U(0x8EBC6AF09C88C6E3)) % _U(n)).astype(np.int64)


def slot_of(h: np.ndarray, pilot: np.ndarray, n) -> np.ndarray:
    return (mix(h ^ mix(pilot + _U(0xA0761D6478BD642F))) % np.uint64(n)).astype(np.int64)


def _blocks(n_keys: int) -> int:
    return max(1, -(-n_keys // _BLOCK))


def write_index(folder: str, number: int, h: np.ndarray, entries: np.ndarray) -> None:
    """One index file; ``entries`` are in the order of ``h``."""
    n_blocks = _blocks(len(h))
    block = block_of(h, n_blocks)
    order = np.argsort(block, kind="stable")
    sizes = np.bincount(block, minlength=n_blocks)
    pilots, table, at = [], [], 0
    for size in sizes:
        own = order[at : at + size]
        at += size
        p, slots = build_block(h[own], max(1, -(-int(size) // _BUCKET)))
        placed = np.zeros(size, dtype=_ENTRY)
        placed[slots] = entries[own]
        pilots.append(p)
        table.append(placed)
    out = AtomicFile(folder, f"index-{number:05d}.mph")
    out.write(struct.pack("<4sIQ", b"TLMP", n_blocks, len(h)))
    out.write(sizes.astype("<u4").tobytes())
    out.write(np.concatenate(pilots).astype("<u4").tobytes())
    out.write(np.concatenate(table).tobytes())
    out.commit()


class Index:
    """One index file, opened; ``find`` looks keys up by their hashes."""

    def __init__(self, folder: str, number: int):
        fs, path = store(folder)
        with fs.open_input_file(f"{path}/index-{number:05d}.mph") as f:
            data = f.read()
        magic, n_blocks, n = struct.unpack_from("<4sIQ", data)
        if magic != b"TLMP":
            raise ValueError(f"not an index: {path}/index-{number:05d}.mph")
        self.sizes = np.frombuffer(data, "<u4", n_blocks, 16).astype(np.int64)
        self.buckets = np.maximum(1, -(-self.sizes // _BUCKET))
        at = 16 + 4 * n_blocks
        self.pilots = np.frombuffer(data, "<u4", int(self.buckets.sum()), at)
        self.table = np.frombuffer(data, _ENTRY, n, at + 4 * len(self.pilots))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries, found): found is false where the fingerprint differs."""
        block = block_of(h, len(self.sizes))
        size = self.sizes[block]
        bucket = bucket_of(h, self.buckets[block])
        pilot = self.pilots[(np.cumsum(self.buckets) - self.buckets)[block] + bucket].astype(np.uint64)
        slot = slot_of(h, pilot, np.maximum(size, 1).astype(np.uint64)) + (np.cumsum(self.sizes) - self.sizes)[block]
        if not len(self.table):
            return np.zeros(len(h), _ENTRY), np.zeros(len(h), bool)
        entries = self.table[np.minimum(slot, len(self.table) - 1)]
        return entries, (size > 0) & (entries["mark"] == mix(h + _U(1)))


class Encoder:
    """Ids of whole texts, as little-endian bytes.

    For a byte-level vocabulary with its usual word pattern, ids never span a
    space that follows a non-space, so a text's ids are those of its words in a
    row.  Words already met come from a bounded cache; new ones are encoded
    together in one string and told apart by the byte lengths of their tokens.
    Texts with other white space before a space or at their end, and other kinds
    of tokenizers, are encoded as they are.
    """

    CACHE = 600_000
    _OTHER = re.compile(r"\s |\s\Z")

    def __init__(self, path: str, id_bytes: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = f"<u{id_bytes}"
        model = self.tokenizer.model
        if hasattr(model, "_resize_cache"):  # words met before don't come back to the library, so its own cache only costs time
            model._resize_cache(0)
            self.tokenizer.model = model
        pre = json.loads(self.tokenizer.to_str())
        pre, normal = pre.get("pre_tokenizer") or {}, pre.get("normalizer")
        self.by_word = normal is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << (8 * id_bytes):
            raise ValueError(f"ids up to {max(vocabulary.values())} don't fit in {id_bytes} bytes: give id_bytes")
        self.lengths = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)  # one character stands for one byte
        self.cache: dict[str, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return np.asarray(ids, dtype=self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if not self.by_word or self._OTHER.search(t)]
        direct = set(whole)
        words = [[] if i in direct else t.split(" ") for i, t in enumerate(texts)]
        firsts = [texts[i] if i in direct else w.pop(0) for i, w in enumerate(words)]
        first_ids = [self._pack(e.ids) for e in self.tokenizer.encode_batch_fast(firsts, add_special_tokens=False)]
        if len(self.cache) > self.CACHE:
            self.cache.clear()
        new = list(set().union(*words).difference(self.cache))
        self._learn([new[i : i + 128] for i in range(0, len(new), 128)])
        known = self.cache.__getitem__
        return [f + b"".join(map(known, w)) for f, w in zip(first_ids, words, strict=True)]

    def _learn(self, lines: list[list[str]]) -> None:
        width = np.dtype(self.dtype).itemsize
        encoded = self.tokenizer.encode_batch_fast([" " + " ".join(words) for words in lines], add_special_tokens=False)
        for words, e in zip(lines, encoded, strict=True):
            ids = np.asarray(e.ids, dtype=np.int64)
            sizes = [len(w.encode()) + 1 for w in words]
            cuts = (np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes)) + 1) * width
            packed, at = ids.astype(self.dtype).tobytes(), 0
            for w, end in zip(words, cuts.tolist(), strict=True):
                self.cache[w] = packed[at:end]
                at = end


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, id_bytes: int) -> Encoder:
    """The encoder of this Python worker; it serves all its tasks."""
    return _ENCODERS.get((path, id_bytes)) or _ENCODERS.setdefault((path, id_bytes), Encoder(path, id_bytes))


def _texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def write_shards(documents: DataFrame, tokenizer_path: str, folder: str, id_bytes: int = 2) -> DataFrame:
    """Encode, append the end id and write; (doc_id, copy, shard, local_start, n_tokens) of each row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_shards = max(1, -(-rows.count() // DOCS_PER_SHARD))
    rows = rows.repartitionByRange(n_shards, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, id_bytes).encode
        end = END_ID.to_bytes(id_bytes, "little")
        shard, out, at, before, copy = TaskContext.get().partitionId(), None, 0, object(), 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), _texts(batch.column(1))
            copies, starts, counts = [], [], []
            if out is None and ids:
                out = AtomicFile(folder, f"shard-{shard:05d}.ids")
                out.write(struct.pack("<4sII4x", b"TLID", 1, id_bytes))
            for i in range(0, len(texts), 256):
                for data in encode(texts[i : i + 256]):
                    out.write(data)
                    out.write(end)
                    n = len(data) // id_bytes + 1
                    starts.append(at)
                    counts.append(n)
                    at += n
            for i in ids:
                copy = copy + 1 if i == before else 0
                before = i
                copies.append(copy)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "copy": pa.array(copies, pa.int64()), "shard": pa.array([shard] * len(ids), pa.int32()), "local_start": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})
        if out is not None:
            out.commit()

    return rows.mapInArrow(write, "doc_id long, copy long, shard int, local_start long, n_tokens long")


def build(documents: DataFrame, tokenizer_path: str, folder: str | None = None, id_bytes: int = 2) -> tuple[str, DataFrame]:
    """Write shards and index of ``documents``; (folder, keys).

    ``keys`` are the written (doc_id, copy, index) with the number of the index file.
    """
    spark = documents.sparkSession
    folder = folder or new_folder(spark, "token-ids")
    written = cut(write_shards(documents, tokenizer_path, folder, id_bytes))
    totals = written.groupBy("shard").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    # One row a shard: the window sees a few thousandths of the documents at most.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    n_index = max(1, -(-written.count() // KEYS_PER_INDEX))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = _hash_batch(b)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((h % _U(n_index)).astype(np.int32))], names=[*b.schema.names, "index"])

    entries = written.join(offsets, "shard").select("doc_id", "copy", "shard", "local_start", "n_tokens", (F.col("base") + F.col("local_start")).alias("corpus_start"))
    entries = cut(entries.mapInArrow(number, entries.schema.simpleString()[7:-1].replace(":", " ") + ", index int"))

    def index(key: tuple, table: pa.Table) -> pa.Table:
        h = _hash_batch(table)
        rows = np.zeros(len(h), dtype=_ENTRY)
        rows["mark"] = mix(h + _U(1))
        for name, column in (("shard", "shard"), ("count", "n_tokens"), ("start", "local_start"), ("corpus", "corpus_start")):
            rows[name] = table.column(column).to_numpy()
        write_index(folder, key[0].as_py(), h, rows)
        return pa.table({"index": pa.array([key[0].as_py()], pa.int32()), "keys": pa.array([len(h)], pa.int64())})

    cut(entries.groupBy("index").applyInArrow(index, "index int, keys long"))
    return folder, entries.select("doc_id", "copy", "index")


def _hash_batch(b: pa.RecordBatch | pa.Table) -> np.ndarray:
    ids = b.column("doc_id")
    return key_hash(ids.fill_null(0).to_numpy(zero_copy_only=False) if isinstance(ids, pa.Array) else ids.fill_null(0).to_numpy(), np.asarray(ids.is_null()), np.asarray(b.column("copy")))


def lookup(keys: DataFrame, folder: str) -> DataFrame:
    """(doc_id, copy, shard, local_start, n_tokens, start) of keys (doc_id, copy, index); unknown keys give none."""

    def find(key: tuple, table: pa.Table) -> pa.Table:
        entries, found = Index(folder, key[0].as_py()).find(_hash_batch(table))
        mask, entries = pa.array(found), entries[found]
        own = table.select(["doc_id", "copy"]).filter(mask)
        for name, column, kind in (("shard", "shard", pa.int32()), ("local_start", "start", pa.int64()), ("n_tokens", "count", pa.int64()), ("start", "corpus", pa.int64())):
            own = own.append_column(name, pa.array(entries[column].astype(np.int64), pa.int64()).cast(kind))
        return own

    return keys.groupBy("index").applyInArrow(find, "doc_id long, copy long, shard int, local_start long, n_tokens long, start long")


def read_payloads(found: DataFrame, folder: str, n_shards: int, window: int = 4 << 20) -> DataFrame:
    """(doc_id, copy, start, n_tokens, ids_crc32, first_id, last_id) read from the shard files.

    Rows are dealt by shard and sorted by offset, so a task reads each file in
    windows from front to back.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, f, data, base, width = None, None, b"", 0, 2
        for b in batches:
            cols = {n: b.column(n).to_numpy(zero_copy_only=False) for n in ("shard", "local_start", "n_tokens")}
            crc, first, last = [], [], []
            for s, start, n in zip(cols["shard"].tolist(), cols["local_start"].tolist(), cols["n_tokens"].tolist(), strict=True):
                if s != shard:
                    if f is not None:
                        f.close()
                    fs, path = store(folder)
                    shard, f = s, fs.open_input_file(f"{path}/shard-{s:05d}.ids")
                    magic, _, width = struct.unpack("<4sII4x", f.read(16))
                    if magic != b"TLID":
                        raise ValueError(f"not a shard: {path}/shard-{s:05d}.ids")
                    data, base = b"", 0
                at, size = 16 + start * width, n * width
                if at < base or at + size > base + len(data):
                    f.seek(at)
                    data, base = f.read(max(size, window)), at
                ids = np.frombuffer(data, f"<u{width}", n, at - base).astype("<u4")
                crc.append(zlib.crc32(ids))
                first.append(int(ids[0]))
                last.append(int(ids[-1]))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "copy": b.column("copy"), "start": b.column("start"), "n_tokens": b.column("n_tokens"), "ids_crc32": pa.array(crc, pa.int64()), "first_id": pa.array(first, pa.int64()), "last_id": pa.array(last, pa.int64())})
        if f is not None:
            f.close()

    dealt = found.repartition(n_shards, "shard").sortWithinPartitions("shard", "local_start")
    return dealt.mapInArrow(read, "doc_id long, copy long, start long, n_tokens long, ids_crc32 long, first_id long, last_id long")


def token_ids(documents: DataFrame, tokenizer_path: str, id_bytes: int = 2) -> DataFrame:
    """Write ``documents`` as shards and index, look every key up and read its ids back."""
    folder, keys = build(documents, tokenizer_path, id_bytes=id_bytes)
    n_shards = max(1, -(-keys.count() // DOCS_PER_SHARD))
    return read_payloads(lookup(keys, folder), folder, n_shards)


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


