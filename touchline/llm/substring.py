"""Substring dedup: suffix automata of reference shards, and documents streamed through them.

A window is ``WINDOW`` consecutive words.  It goes where its word sequence also
starts earlier (by doc_id, then start).  What decides this is the matching
statistics of a passage on the suffix automaton of a reference shard: the longest
suffix that the shard holds, and, for the windows in it, where the shard holds
them first.  Fingerprints only find which passages are to meet which shard:

1. Documents are kept in blocks, in files in shared storage.  Each window has an
   anchor, the least of its ``GRAM``-word shingles by hash, so equal windows have
   equal anchors; windows side by side mostly share one, about one in seven words.
2. Rows of anchors, one for each different surrounding in a block, meet by anchor.
   Equal surroundings (all windows of an anchor at once) point later ones to the
   first.  Anchors with several surroundings send the windows of each, one row for
   each different window of a block, and these meet by window.
3. A shard is a stretch of a block's words; its reference is what others were
   pointed to in it.  Blocks give the passages, each to the shard it was pointed to;
   where a shard is asked for more than ``SLICE`` windows from other blocks, its
   questions are dealt to several tasks, each with the shard's reference.
4. Hits go back to the blocks, which report what is left.

Repeats within a block point to the first of the block, so a passage of any number
of copies is a row for each block at most.  Anchors with a share of all rows that
is large for a task are known by a count first and dealt by surroundings; there
are fewer of them than shuffle partitions.

Semantics for odd input: a null or empty text has no words (nothing removed, the
digest of nothing); fewer words than a window are no window; null ids rank after
all others; rows that repeat a doc_id are compared by start alone, so equal rows
leave each other whole; a very long text is a block of its own; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm import text_hash
from touchline.llm.shared import AtomicFile, cut, new_folder, store

_U = np.uint64
WINDOW, GRAM = 20, 8
#: Bytes of text in a block; words of a block to a shard (as a power of two); windows that others ask one task about.
BLOCK, SHARD, SLICE = 8 << 20, 17, 1 << 17
_LAST = (1 << 63) - 1
#: A place is a block, a word of it and a number of windows (up to 15) in 32, 27 and 4 bits.
_AT, _N = 27, 4
_REPORT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


# --- blocks


def write_blocks(documents: DataFrame, size: int = BLOCK) -> DataFrame:
    """(block, file, part): documents as record batches of about ``size`` bytes in a file for each task."""
    folder = new_folder(documents.sparkSession, "substring")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        name = f"part-{task:06d}-{uuid.uuid4().hex}.arrow"
        out = writer = None
        parts, held, total = 0, [], 0

        def flush() -> None:
            nonlocal out, writer, parts, total
            table = pa.Table.from_batches(held).combine_chunks()
            if writer is None:
                out = AtomicFile(folder, name)
                writer = pa.ipc.new_file(out.out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            writer.write_batch(table.to_batches()[0])
            parts, total = parts + 1, 0
            held.clear()

        for batch in batches:
            lengths = np.asarray(pc.binary_length(batch.column(1)))
            ends = np.cumsum(lengths)
            at = 0
            while at < batch.num_rows:
                room = size - total + (int(ends[at - 1]) if at else 0)
                end = max(at + (not held), int(np.searchsorted(ends, room, side="right")))
                if end > at:
                    held.append(batch.slice(at, end - at))
                    total += int(lengths[at:end].sum())
                if end < batch.num_rows:
                    flush()
                at = end
        if held:
            flush()
        if writer is not None:
            writer.close()
            out.commit()
            if parts > 1 << 12 or task >= 1 << 20:
                raise ValueError("too many blocks to number: take larger ones")
            numbers = (task << 12) + np.arange(parts)
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array([f"{folder}/{name}"] * parts), pa.array(np.arange(parts, dtype=np.int32))], names=["block", "file", "part"])

    return cut(rows.mapInArrow(write, "block long, file string, part int"))


class Block:
    """The documents of a block as word hashes; words are numbered through the block."""

    def __init__(self, number: int, file: str, part: int):
        fs, path = store(file)
        with fs.open_input_file(path) as f:
            rows = pa.ipc.open_file(f).get_batch(part)
        self.number, self.ids, self.texts = number, rows.column(0), rows.column(1)
        self.key = np.asarray(self.ids.fill_null(_LAST))

    def read(self) -> Block:
        """Work out words: hashes, first word of each document, and first and past-last byte of each word in the block's text."""
        h, starts, ends, first, base, words = [], [], [], [0], 0, 0
        for _, data, offsets in text_hash.slices(self.texts):
            hashes, at, start, end = text_hash.words(data, offsets, lower=False)
            h.append(hashes)
            starts.append(start + base)
            ends.append(end + base)
            first += (at[1:] + words).tolist()
            base, words = base + len(data), words + len(hashes)
        if words >= 1 << _AT:
            raise ValueError("a text has too many words to number")
        self.hashes = np.concatenate(h) if h else np.zeros(0, _U)
        self.starts, self.ends = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends))
        self.first = np.array(first, np.int64)
        return self

    def windows(self) -> np.ndarray:
        """Hash of the window at each word (also of such that reach over documents)."""
        half = text_hash.grams(self.hashes, WINDOW // 2)
        return text_hash.mix(half[: -WINDOW // 2] * _U(0x9FB21C651E98DF25) + half[WINDOW // 2 :])

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1

    def data(self) -> np.ndarray:
        column = self.texts.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)
        return np.frombuffer(data, np.uint8)[offsets[column.offset] : offsets[column.offset + len(column)]] if data is not None else np.zeros(0, np.uint8)


def anchors(block: Block) -> dict[str, np.ndarray]:
    """Of each anchor with its windows side by side: ``anchor``, ``around`` (hash of all its windows), ``at`` (first window), ``n``."""
    h = block.hashes
    counts = np.maximum(0, np.diff(block.first) - WINDOW + 1)
    if not counts.any():
        return {k: np.zeros(0, kind) for k, kind in (("anchor", _U), ("around", _U), ("at", np.int64), ("n", np.int64))}
    grams, windows = text_hash.grams(h, GRAM), block.windows()
    at = np.repeat(block.first[:-1] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    least, value = at.copy(), grams[at]
    for k in range(1, WINDOW - GRAM + 1):
        other = grams[at + k]
        less = other < value
        least[less] = at[less] + k
        np.minimum(value, other, out=value)
    doc = np.repeat(np.arange(len(counts)), counts)
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(at)) - 1
    n = hi - lo + 1
    # Fewer windows side by side than words in one: the first and the last hold all their words.
    around = windows[at[lo]] * _U(0x9FB21C651E98DF25) + windows[at[hi]] * _U(0xC2B2AE3D27D4EB4F) + (n * 16 + least[lo] - at[lo]).astype(_U)
    return {"anchor": grams[least[lo]], "around": text_hash.mix(around), "at": at[lo], "n": n}


def firsts(key: np.ndarray, block: Block, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the earliest place with the same key, whether a place is as early as that) by document and start."""
    doc = block.document(at)
    ids, pos = block.key[doc], at - block.first[doc]
    order = np.lexsort((at, pos, ids, key))
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    leader = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    first = np.empty(len(order), np.int64)
    first[order] = leader
    return first, (ids == ids[first]) & (pos == pos[first])


def _place(block: int, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    return ((block << _AT) + at << _N) + n


def _block_of(place):
    return F.shiftright(place, _AT + _N)


def _shard(place: np.ndarray) -> np.ndarray:
    """Block and stretch of SHARD words of places."""
    return ((place >> _AT + _N) << (_AT - SHARD)) + ((place >> _N & ((1 << _AT) - 1)) >> SHARD)


# --- finding what is to meet


def _scan(index: DataFrame, schema: str, make) -> DataFrame:
    """Rows that ``make`` gives of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield make(Block(*block).read())

    return index.mapInArrow(run, schema)


def hot_anchors(index: DataFrame) -> list[int]:
    """Anchors with at least a shuffle partition's share of all surroundings: fewer than there are partitions."""
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(block: Block) -> pa.RecordBatch:
        found = anchors(block)
        _, own = firsts(found["around"], block, found["at"])
        values, n = np.unique(found["anchor"][own], return_counts=True)
        many = n >= max(4, own.sum() / (2 * parts))
        return pa.RecordBatch.from_arrays([pa.array([None, *values[many].view(np.int64).tolist()], pa.int64()), pa.array([int(own.sum()), *n[many].tolist()], pa.int64())], names=["anchor", "n"])

    counts = cut(_scan(index, "anchor long, n long", count).groupBy("anchor").agg(F.sum("n").alias("n")))
    total = counts.filter("anchor is null").first()
    return [] if total is None else sorted(r.anchor for r in counts.filter(F.col("anchor").isNotNull() & (F.col("n") * parts >= total.n)).collect())


def point_anchors(index: DataFrame) -> DataFrame:
    """(place, witness): anchors' windows that another block has earlier, or (witness null) is to be asked window by window."""
    hot = np.array(hot_anchors(index), np.int64).view(_U)

    def rows(block: Block) -> pa.RecordBatch:
        found = anchors(block)
        _, own = firsts(found["around"], block, found["at"])
        anchor, around, at, n = (found[k][own] for k in ("anchor", "around", "at", "n"))
        doc = block.document(at)
        # Even keys are anchors; odd ones are surroundings of hot anchors.
        key = np.where(np.isin(anchor, hot), around | _U(1), anchor & ~_U(1))
        columns = [key.view(np.int64), around.view(np.int64), block.key[doc], (at - block.first[doc]).astype(np.int32), _place(block.number, at, n)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "around", "doc_id", "pos", "place"])

    dealt = _scan(index, "key long, around long, doc_id long, pos int, place long", rows).repartition("key")
    alike = Window.partitionBy("key", "around").orderBy("doc_id", "pos", "place")
    near = Window.partitionBy("key")
    seen = dealt.withColumn("first", F.first(F.struct("doc_id", "pos", "place")).over(alike))
    seen = seen.withColumn("least", F.min("around").over(near)).withColumn("most", F.max("around").over(near))
    later = F.struct("doc_id", "pos") > F.struct("first.doc_id", "first.pos")
    asked = (F.col("least") != F.col("most")) | (F.col("key").bitwiseAND(F.lit(1)) == 1)
    return cut(seen.filter(later | asked).select("place", F.when(later, F.col("first.place")).alias("witness")))


def _each_window(places: np.ndarray) -> np.ndarray:
    """The words at which the windows of places begin."""
    at, n = places >> _N & ((1 << _AT) - 1), places & ((1 << _N) - 1)
    return np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())


def point_windows(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(place, witness) of single windows of the asked places that another block has earlier among them."""

    def rows(block: Block, places: np.ndarray) -> pa.Table:
        at = _each_window(places)
        keys = block.read().windows()[at] if len(at) else np.zeros(0, _U)
        own = firsts(keys, block, at)[1] if len(at) else np.zeros(0, bool)
        at, keys = at[own], keys[own]
        if not len(at):
            return pa.table({k: pa.array([], v) for k, v in (("key", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("place", pa.int64()))})
        doc = block.document(at)
        return pa.table({"key": keys.view(np.int64), "doc_id": block.key[doc], "pos": (at - block.first[doc]).astype(np.int32), "place": _place(block.number, at, 1)})

    dealt = _by_block(index, asked, rows, "key long, doc_id long, pos int, place long").repartition("key")
    alike = Window.partitionBy("key").orderBy("doc_id", "pos", "place")
    seen = dealt.withColumn("first", F.first(F.struct("doc_id", "pos", "place")).over(alike))
    later = F.struct("doc_id", "pos") > F.struct("first.doc_id", "first.pos")
    return cut(seen.filter(later).select("place", F.col("first.place").alias("witness")))


def _by_block(index: DataFrame, places: DataFrame, make, schema: str) -> DataFrame:
    """Rows that ``make`` gives of each block with its places (column ``place``; further columns follow it)."""
    names = places.columns

    def run(own: pa.Table, items: pa.Table) -> pa.Table:
        block = Block(*(own.column(k)[0].as_py() for k in ("block", "file", "part")))
        return make(block, *(items.column(k).to_numpy() for k in names))

    items = places.withColumn("block", _block_of("place"))
    return index.groupBy("block").cogroup(items.groupBy("block")).applyInArrow(run, schema)


# --- passages and automata

_PIECE = "shard long, asks boolean, doc_id long, pos int, place long, passage binary"


def passages(index: DataFrame, pointed: DataFrame, asked: DataFrame) -> DataFrame:
    """Passages by shard: its reference, and what asks it."""
    wanted = pointed.select(F.col("witness").alias("place")).distinct().select("place", F.lit(-2).cast("long").alias("witness"))
    items = pointed.unionByName(asked.select("place", F.lit(-1).cast("long").alias("witness"))).unionByName(wanted)

    def make(block: Block, places: np.ndarray, witness: np.ndarray) -> pa.Table:
        found = anchors(block.read())
        first, own = firsts(found["around"], block, found["at"])
        around = _place(block.number, found["at"], found["n"])
        at = _each_window(places[witness == -1])
        twin, alone = firsts(block.windows()[at] if len(at) else np.zeros(0, _U), block, at)
        single = _place(block.number, at, 1)
        asks = np.concatenate([places[witness >= 0], around[~own], single[~alone]])
        told = np.concatenate([witness[witness >= 0], around[first[~own]], single[twin[~alone]]])
        refs = np.concatenate([places[witness == -2], told[len(asks) - (~own).sum() - (~alone).sum() :]])
        text = block.data()
        return pa.concat_tables([_pieces(block, text, _shard(told), asks, True), _pieces(block, text, _shard(refs), refs, False)])

    return _by_block(index, items, make, _PIECE)


def _pieces(block: Block, text: np.ndarray, shard: np.ndarray, places: np.ndarray, asks: bool) -> pa.Table:
    """Places of one document and shard that overlap are one passage."""
    if not len(places):
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        return pa.table({k.split()[0]: pa.array([], kind) for k, kind in zip(_PIECE.split(", "), kinds, strict=True)})
    at, n = places >> _N & ((1 << _AT) - 1), places & ((1 << _N) - 1)
    end = at + n + WINDOW - 1
    doc = block.document(at)
    order = np.lexsort((at, doc, shard))
    shard, doc, at, end = shard[order], doc[order], at[order], end[order]
    new = np.ones(len(at), bool)
    new[1:] = (shard[1:] != shard[:-1]) | (doc[1:] != doc[:-1])
    # Within a document and shard ends are compared with the furthest so far; group numbers keep groups apart.
    group = np.cumsum(new) - 1
    far = np.maximum.accumulate(end + group * (1 << _AT + 1)) - group * (1 << _AT + 1)
    new[1:] |= at[1:] > far[:-1]
    lo = np.flatnonzero(new)
    last = np.append(lo[1:], len(at)) - 1
    a, b, doc = at[lo], far[last], doc[lo]
    raw = text.tobytes()
    cuts = zip(block.starts[a].tolist(), block.ends[b - 1].tolist(), strict=True)
    return pa.table(
        {
            "shard": shard[lo], "asks": np.full(len(a), asks), "doc_id": block.key[doc], "pos": (a - block.first[doc]).astype(np.int32),
            "place": _place(block.number, a, 0), "passage": pa.array([raw[i:j] for i, j in cuts], pa.binary()),
        }
    )


class Automaton:
    """Suffix automaton of several passages, with the first end of each state; most states have one way on, kept apart from those with more."""

    def __init__(self):
        self.length, self.link, self.first, self.symbol, self.to = [0], [-1], [-1], [-1], [0]
        self.more: dict[int, dict[int, int]] = {}
        self.number: dict[bytes, int] = {}
        self.begin: list[int] = []
        self.where: list[tuple[int, int]] = []
        self.words = 0

    def _next(self, s: int, c: int) -> int:
        if self.symbol[s] == c:
            return self.to[s]
        return self.more[s].get(c, -1) if s in self.more else -1

    def _set(self, s: int, c: int, to: int) -> None:
        if self.symbol[s] in (c, -1):
            self.symbol[s], self.to[s] = c, to
        else:
            self.more.setdefault(s, {})[c] = to

    def _state(self, length: int, link: int, first: int, symbol: int = -1, to: int = 0) -> int:
        for column, value in ((self.length, length), (self.link, link), (self.first, first), (self.symbol, symbol), (self.to, to)):
            column.append(value)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state for what ends in ``p`` and ``c``: ``q``, or a part of it with fewer words."""
        if self.length[p] + 1 == self.length[q]:
            return q
        part = self._state(self.length[p] + 1, self.link[q], self.first[q], self.symbol[q], self.to[q])
        if q in self.more:
            self.more[part] = dict(self.more[q])
        self.link[q] = part
        while p != -1 and self._next(p, c) == q:
            self._set(p, c, part)
            p = self.link[p]
        return part

    def add(self, words: list[bytes], doc_id: int, pos: int) -> None:
        """A passage that begins at word ``pos`` of a document; passages come by document and position."""
        self.begin.append(self.words)
        self.where.append((doc_id, pos))
        last = 0
        for w in words:
            c = self.number.setdefault(w, len(self.number))
            q = self._next(last, c)
            if q != -1:
                last = self._split(last, c, q)
            else:
                new = self._state(self.length[last] + 1, 0, self.words)
                p = last
                while p != -1 and self._next(p, c) == -1:
                    self._set(p, c, new)
                    p = self.link[p]
                if p != -1:
                    self.link[new] = self._split(p, c, self._next(p, c))
                last = new
            self.words += 1

    def earlier(self, words: list[bytes], doc_id: int, pos: int, window: int = WINDOW) -> list[tuple[int, int]]:
        """Maximal spans [first, past last) of the passage's words in windows that a document has earlier."""
        length, link, first, symbol, to, more, number = self.length, self.link, self.first, self.symbol, self.to, self.more, self.number
        spans: list[tuple[int, int]] = []
        v = matched = 0
        for i, w in enumerate(words):
            c = number.get(w, -2)
            while True:
                if symbol[v] == c:
                    v = to[v]
                    matched += 1
                    break
                if v in more and c in more[v]:
                    v = more[v][c]
                    matched += 1
                    break
                if not v:
                    matched = 0
                    break
                v = link[v]
                matched = length[v]
            if matched < window:
                continue
            while length[link[v]] >= window:  # the state that holds the window itself
                v = link[v]
                matched = length[v]
            at = first[v]
            k = bisect_right(self.begin, at) - 1
            of, start = self.where[k]
            if (of, start + at - self.begin[k] - window + 1) < (doc_id, pos + i - window + 1):
                if spans and spans[-1][1] >= i - window + 1:
                    spans[-1] = (spans[-1][0], i + 1)
                else:
                    spans.append((i - window + 1, i + 1))
        return spans


def _add_document(automaton: Automaton, doc_id: int, held: list[tuple[int, list[bytes]]]) -> None:
    """Reference passages (pos, words) of one doc_id; if rows that repeat it overlap, window by window in order of start."""
    if all(a + len(w) <= b for (a, w), (b, _) in zip(held[:-1], held[1:], strict=True)):
        for pos, words in held:
            automaton.add(words, doc_id, pos)
        return
    for pos, window in sorted((pos + k, words[k : k + WINDOW]) for pos, words in held for k in range(len(words) - WINDOW + 1)):
        automaton.add(window, doc_id, pos)


def hits(pieces: DataFrame, hot: DataFrame) -> DataFrame:
    """(block, lo, hi): words of blocks in windows that are earlier elsewhere; ``hot`` has (shard, slices) of shards that one task can't answer."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, automaton, doc, held = None, Automaton(), None, []
        for b in batches:
            found: list[tuple[int, int]] = []
            for shard, part, asks, doc_id, pos, place, passage in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (shard, part) != key:
                    key, automaton, doc, held = (shard, part), Automaton(), doc_id, []
                words = passage.split()
                if not asks and doc_id == doc:
                    held.append((pos, words))
                    continue
                if held:
                    _add_document(automaton, doc, held)
                    held = []
                if not asks:
                    doc, held = doc_id, [(pos, words)]
                else:
                    doc = None
                    at = place >> _N
                    found += [(at + lo, at + hi) for lo, hi in automaton.earlier(words, doc_id, pos)]
            spans = np.array(found, np.int64).reshape(-1, 2)
            lo = spans[:, 0] & ((1 << _AT) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(spans[:, 0] >> _AT), pa.array(lo), pa.array(lo + spans[:, 1] - spans[:, 0])], names=["block", "lo", "hi"])

    slices = F.coalesce("slices", F.lit(1))
    part = F.when(F.col("asks"), F.array(F.pmod(F.xxhash64("place"), slices).cast("int"))).otherwise(F.sequence(F.lit(0), slices - 1))
    dealt = pieces.join(hot, "shard", "left").withColumn("part", F.explode(part)) if hot is not None else pieces.withColumn("part", F.lit(0))
    dealt = dealt.select("shard", "part", "asks", "doc_id", "pos", "place", "passage").repartition("shard", "part").sortWithinPartitions("shard", "part", "asks", "doc_id", "pos", "place")
    return dealt.mapInArrow(stream, "block long, lo long, hi long")


def report(index: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of all documents, given the words that go."""

    def run(own: pa.Table, spans: pa.Table) -> pa.Table:
        block = Block(*(own.column(k)[0].as_py() for k in ("block", "file", "part")))
        texts = [t.as_buffer().to_pybytes().split() for t in block.texts]
        first = np.cumsum([0, *map(len, texts)])
        change = np.zeros(first[-1] + 1, np.int64)
        np.add.at(change, spans.column("lo").to_numpy(), 1)
        np.add.at(change, spans.column("hi").to_numpy(), -1)
        gone = np.cumsum(change[:-1]) > 0
        before = np.concatenate([[0], np.cumsum(gone)])
        removed = before[first[1:]] - before[first[:-1]]
        digests = []
        for words, lo, hi, n in zip(texts, first[:-1].tolist(), first[1:].tolist(), removed.tolist(), strict=True):
            kept = words if not n else [words[i] for i in np.flatnonzero(~gone[lo:hi]).tolist()]
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.table({"doc_id": block.ids, "n_words": np.diff(first), "n_removed": removed, "kept_sha256": digests})

    return index.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, _REPORT)


def remove_repeats(documents: DataFrame, block: int = BLOCK, windows: int = SLICE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document, without the windows that start earlier elsewhere."""
    index = write_blocks(documents, block)
    anchored = point_anchors(index)
    asked = anchored.filter("witness is null").select("place")
    pointed = anchored.filter("witness is not null").unionByName(point_windows(index, asked))
    at = F.shiftright("witness", _N).bitwiseAND(F.lit((1 << _AT) - 1))
    shard = F.shiftleft(_block_of("witness"), _AT - SHARD) + F.shiftright(at, SHARD)
    load = pointed.groupBy(shard.alias("shard")).agg(F.sum(F.col("place").bitwiseAND(F.lit((1 << _N) - 1))).alias("n"))
    hot = cut(load.filter(F.col("n") > windows).select("shard", F.ceil(F.col("n") / windows).cast("int").alias("slices")))
    pieces = passages(index, pointed, asked)
    return report(index, hits(pieces, None if hot.isEmpty() else hot))
