"""Language-model scores by deleted interpolation.

Tokens are lower-cased words and one end for each text.  A token's probability
mixes maximum-likelihood estimates from the two tokens before it (triples) and
from the one before it (pairs) with an add-one unigram estimate:

    a * triple + (1 - a) * (b * pair + (1 - b) * unigram)

The weight a depends on how often the two tokens before were seen, b on how
often the one before was (buckets: 1, 2, 3, then powers of two).  Both are
learned by expectation-maximisation on a fold of the training documents, DEV,
with all three estimates from the counts without that fold.  The model that
scores has the counts of all training documents, for every text.  A training
document vouches for itself in these, so ``score_left_out`` also tells what the
model without the document's own counts says of it; it is the ``score`` where a
document was held out, and compares training with held-out texts.

Counting and looking up are one exchange.  The corpus is read in blocks of
bounded size; each block sends its distinct token, pair and triple keys of 56
bits, packed by key range in about four and a half bytes each, with its own
counts.  For each range the totals are formed, and what the other blocks add to
a block's own counts goes back to it, in the order of its keys.  Each block's
answers are one file in shared storage, which the scoring tasks, reading the
same blocks again, open.  No table of the vocabulary is gathered anywhere, and a
key, however frequent, is one entry for each block.  There are about as many
ranges as blocks, so a range is as large as a block; a block sends a range's
packet only where it has keys in it, so packets are never more than keys.

Blocks are runs of rows of the input's partitions, so the input must give its
partitions the same rows each time, as scans of files do; a block whose keys have
changed (by a checksum of each range's) fails the job rather than give wrong scores.

Semantics for odd input: a null or empty text is one end token; repeated rows
count, and are scored, once for each row; a null doc_id trains as an empty id; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import text_hash
from touchline.llm.shared import AtomicFile, new_folder, store

_U = np.uint64
#: Bytes of text to a block, and to a key range.
BLOCK_BYTES = RANGE_BYTES = 4 << 20
HELD_OUT, DEV, FOLDS = 2, 3, 7
_END, _START = _U(0x6A09E667F3BCC908), _U(0xBB67AE8584CAA73B)
#: Buckets of context counts: none, 1, 2, 3, 4-7, 8-15, ... up to 2 ** 15 and more.
BUCKETS = 18
#: Bins of an estimate's ratio to the unigram's: none, then two to an octave around 1.
BINS, PER_OCTAVE = 256, 2
TOKEN, PAIR, TRIPLE, START = range(4)
_KEYS = "range int, block long, n int, keys binary, train binary, dev binary"


def fold_of(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def _key(h: np.ndarray, kind: int) -> np.ndarray:
    """56 bits of a hash, the last two of which are the kind."""
    return ((h >> _U(8)) & _U(0xFFFFFFFFFFFFFC)) | _U(kind)


class Block:
    """Some documents' tokens, and the sorted distinct keys of tokens, pairs, triples and text starts."""

    def __init__(self, ids: list, texts: list[pa.Array]):
        tokens, docs, row = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for text in texts:
            for _, data, offsets in text_hash.slices(text):
                h, at, _, _ = text_hash.words(data, offsets)
                n = np.diff(at)
                ends = np.cumsum(n + 1) - 1  # one end after each text's words
                out = np.empty(len(h) + len(n), dtype=np.uint64)
                is_word = np.ones(len(out), bool)
                is_word[ends] = False
                out[is_word], out[ends] = h, _END
                tokens.append(out)
                docs.append(np.repeat(np.arange(row, row + len(n)), n + 1))
                row += len(n)
        self.ids, self.folds = ids, np.array([fold_of(i) for i in ids], dtype=np.int64)
        own, self.docs = np.concatenate(tokens), np.concatenate(docs).astype(np.int32)
        del tokens, docs
        self.first = np.ones(len(own), bool)
        self.first[1:] = self.docs[1:] != self.docs[:-1]
        pairs = text_hash.mix(self._before(own, _START) * _U(0x9FB21C651E98DF25) + own)
        triples = text_hash.mix(self._before(pairs, _START) * _U(0xD6E8FEB86659FD93) + own)
        every = np.concatenate([_key(own, TOKEN), _key(pairs, PAIR), _key(triples, TRIPLE), _key(np.array([_START]), START)])
        del own, pairs, triples
        order = np.argsort(every)
        every = every[order]
        new = np.ones(len(every), bool)
        new[1:] = every[1:] != every[:-1]
        self.keys, at, n = every[new], np.empty(len(every), dtype=np.int32), len(self.docs)
        at[order] = np.cumsum(new, dtype=np.int32) - 1
        self.token_at, self.pair_at, self.triple_at, self.start_at = at[:n], at[n : 2 * n], at[2 * n : 3 * n], at[3 * n]

    def _before(self, x: np.ndarray, start) -> np.ndarray:
        """The values one token earlier in the same text."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.first] = start
        return out

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(in all training documents, in those of the fold DEV) for each key; a text start counts its texts."""
        fold, out = self.folds[self.docs], []
        for chosen, texts in ((fold != HELD_OUT, self.folds != HELD_OUT), (fold == DEV, self.folds == DEV)):
            own = np.zeros(len(self.keys), dtype=np.int64)
            for at in (self.token_at, self.pair_at, self.triple_at):
                own += np.bincount(at[chosen], minlength=len(own))
            own[self.start_at] = int(texts.sum())
            out.append(own)
        return out[0], out[1]

    def own_counts(self) -> list[np.ndarray]:
        """For each token, how often its own document counts it, its pair and its triple in training."""
        out, counted = [], (self.folds != HELD_OUT)[self.docs]
        for at in (self.token_at, self.pair_at, self.triple_at):
            _, place, n = np.unique(self.docs.astype(np.int64) * len(self.keys) + at, return_inverse=True, return_counts=True)
            out.append(n[place] * counted)
        return out

    def estimates(self, counts: np.ndarray, tokens: int, kinds: int, deleted: bool = False):
        """For each token, from counts of all keys: (unigram, pair and triple estimate, buckets of the pair's and the triple's context).

        ``deleted``: without the counts of the token's own document.
        """
        c1, c2, c3 = (counts[at] for at in (self.token_at, self.pair_at, self.triple_at))
        starts, total = np.full(len(c1), counts[self.start_at]), np.full(len(c1), tokens + kinds + 1)
        if deleted:
            own1, own2, own3 = self.own_counts()
            c1, c2, c3 = c1 - own1, c2 - own2, c3 - own3
            counted = (self.folds != HELD_OUT).astype(np.int64)
            # of the text's words, those that no other text has are distinct tokens less
            gone = np.bincount(self.docs, (c1 == 0) / np.maximum(own1, 1) * (own1 > 0), len(self.ids)) + np.bincount(self.docs, minlength=len(self.ids))
            starts, total = starts - counted[self.docs], total - np.rint(gone * counted).astype(np.int64)[self.docs]
        before, before2 = self._before(c1, starts[self.first]), self._before(c2, starts[self.first])
        return (c1 + 1) / total, c2 / np.maximum(before, 1), c3 / np.maximum(before2, 1), bucket_of(before), bucket_of(before2)


def bucket_of(counts: np.ndarray) -> np.ndarray:
    """The counts themselves below 4, then a bucket for each power of two."""
    return np.minimum(np.where(counts < 4, counts, 2 + np.log2(np.maximum(counts, 1)).astype(np.int64)), BUCKETS - 1)


def bin_of(ratio: np.ndarray) -> np.ndarray:
    """0 for none, else half-octave bins."""
    some = ratio > 0
    out = np.zeros(len(ratio), dtype=np.int64)
    out[some] = np.clip(np.floor(np.log2(ratio[some]) * PER_OCTAVE).astype(np.int64) + BINS // 2, 1, BINS - 1)
    return out


def ratio_of(bins: np.ndarray) -> np.ndarray:
    return np.where(bins > 0, np.exp2((bins - BINS // 2 + 0.5) / PER_OCTAVE), 0.0)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block]]:
    """(number, block) of runs of rows (doc_id, text) of the running task's partition."""
    part, seq, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
    for b in batches:
        text = b.column(1).cast(pa.large_binary()).fill_null(b"")
        at, lengths = 0, np.cumsum(np.asarray(pa.compute.binary_length(text)))
        done = 0
        while at < len(text):
            end = min(len(text), int(np.searchsorted(lengths, done + BLOCK_BYTES - size)) + 1)
            ids += b.column(0).slice(at, end - at).to_pylist()
            texts.append(text.slice(at, end - at))
            size += int(lengths[end - 1]) - done
            done, at = int(lengths[end - 1]), end
            if size >= BLOCK_BYTES:
                yield (part << 24) + seq, Block(ids, texts)
                seq, ids, texts, size = seq + 1, [], [], 0
    if ids:
        yield (part << 24) + seq, Block(ids, texts)


def block_keys(rows: DataFrame, ranges: int) -> DataFrame:
    """(range, block, n, keys, train, dev): the distinct keys of each block, packed by key range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in blocks(batches):
            keys, (train, dev) = block.keys, block.counts()
            of = ((keys >> _U(24)) * _U(ranges)) >> _U(32)
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(keys)]
            for lo in range(0, len(cuts) - 1, 1024):
                some = list(zip(cuts[lo : lo + 1024], cuts[lo + 1 : lo + 1025], strict=False))
                numbers = [[int(of[a]) for a, _ in some], [number] * len(some), [b - a for a, b in some]]
                packed = [[pack_keys(keys[a:b]) for a, b in some], *([pack(x[a:b]) for a, b in some] for x in (train, dev))]
                kinds = (pa.int32(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(numbers, kinds, strict=True)), *(pa.array(x, pa.binary()) for x in packed)], names=["range", "block", "n", "keys", "train", "dev"])

    return rows.mapInArrow(run, _KEYS)


_WIDTHS = ("<u1", "<u2", "<u4", "<u8")


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers in the least width that holds them, compressed where there are many."""
    width = next(i for i in range(4) if not len(numbers) or int(numbers.max()) < 1 << (8 << i))
    data = numbers.astype(_WIDTHS[width]).tobytes()
    return bytes([width]) + data if len(data) < 64 else bytes([width + 4]) + pa.compress(data, "zstd", asbytes=True)


def unpack(data, n: int) -> np.ndarray:
    data = memoryview(data)
    width = data[0] & 3
    body = pa.decompress(data[1:], n << width, "zstd") if data[0] & 4 else data[1:]
    return np.frombuffer(body, _WIDTHS[width], n).astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys: the first, then steps, as their low 32 bits and, compressed, the rest."""
    steps = np.diff(keys)
    return keys[:1].astype("<u8").tobytes() + (steps & _U(0xFFFFFFFF)).astype("<u4").tobytes() + pack(steps >> _U(32))


def unpack_keys(data, n: int) -> np.ndarray:
    data = memoryview(data)
    out = np.empty(n, dtype=np.uint64)
    out[0] = np.frombuffer(data, "<u8", 1)[0]
    out[1:] = np.frombuffer(data, "<u4", n - 1, 8)
    out[1:] += unpack(data[4 + 4 * n :], n - 1).astype(np.uint64) << _U(32)
    return np.cumsum(out, dtype=np.uint64)


def checksums(keys: np.ndarray, sizes: list[int]) -> np.ndarray:
    """A number for each run of keys, of the given sizes."""
    sums = np.concatenate([[_U(0)], np.cumsum(text_hash.mix(keys), dtype=np.uint64)])
    cuts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return np.diff(sums[cuts]).view(np.int64)


def range_totals(packed: DataFrame) -> DataFrame:
    """(block, range, n, check, train, dev): for each block's keys of a range, what other blocks add to its counts (to dev only where it isn't 0).

    A further row of block -1 has the range's tokens and distinct tokens, in training and without DEV.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        keys = np.concatenate([unpack_keys(x.as_buffer(), n) for x, n in zip(table.column("keys"), sizes, strict=True)])
        checks = checksums(keys, sizes).tolist()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        token = (keys[starts] & _U(3)) == TOKEN
        del keys
        runs, cuts = np.diff(np.append(starts, len(order))), np.cumsum(sizes)[:-1]
        answers, sums = [], []
        for column in ("train", "dev"):
            own = np.concatenate([unpack(x.as_buffer(), n) for x, n in zip(table.column(column), sizes, strict=True)])
            totals = np.add.reduceat(own[order], starts)
            sums.append(totals[token])
            more = np.empty(len(order), dtype=np.int64)
            more[order] = np.repeat(totals, runs)
            more -= own
            if column == "dev":
                more[own == 0] = 0  # only DEV's own tokens ask what DEV has
            answers.append([pack(x) for x in np.split(more, cuts)])
        main = sums[0] - sums[1]
        summary = struct.pack("<QQQQ", int(sums[0].sum()), int((sums[0] > 0).sum()), int(main.sum()), int((main > 0).sum()))
        return pa.table({
            "block": pa.array([*table.column("block").to_pylist(), -1], pa.int64()), "range": pa.array([key[0].as_py()] * (len(sizes) + 1), pa.int32()),
            "n": pa.array([*sizes, 0], pa.int32()), "check": pa.array([*checks, 0], pa.int64()), "train": pa.array([*answers[0], summary], pa.binary()), "dev": pa.array([*answers[1], b""], pa.binary()),
        })

    return packed.groupBy("range").applyInArrow(run, "block long, range int, n int, check long, train binary, dev binary")


def store_totals(answers: DataFrame, folder: str) -> tuple[int, int, int, int]:
    """Write each block's totals to a file of its own; returns tokens and distinct tokens, in training and without DEV."""
    names = ("tokens", "kinds", "main_tokens", "main_kinds")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        number, sums = key[0].as_py() // 1024, np.zeros(4, dtype=np.int64)
        if number < 0:
            for x in table.column("train"):  # summaries
                sums += np.array(struct.unpack("<QQQQ", x.as_py()))
        else:
            table = table.sort_by("range")
            out = AtomicFile(folder, f"totals-{number}")
            out.write(struct.pack("<I", table.num_rows))
            for n, check, *parts in zip(*(table.column(c).to_pylist() for c in ("n", "check", "train", "dev")), strict=True):
                out.write(struct.pack("<IqII", n, check, *map(len, parts)))
                out.write(b"".join(parts))
            out.commit()
        return pa.table({k: pa.array([int(x)], pa.int64()) for k, x in zip(names, sums, strict=True)})

    # the sums of ranges, four numbers each, are dealt over 1024 groups
    group = F.when(F.col("block") >= 0, F.col("block") * 1024).otherwise(F.pmod(F.xxhash64("range"), F.lit(1024)) - 1024)
    done = answers.withColumn("group", group).groupBy("group").applyInArrow(run, ", ".join(f"{k} long" for k in names))
    return tuple(int(x or 0) for x in done.agg(*(F.sum(k) for k in names)).first())


def totals_of(block: Block, number: int, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """(train, dev): corpus totals of a block's keys; of dev only for those in DEV documents of the block."""
    fs, path = store(folder)
    with fs.open_input_file(f"{path}/totals-{number}") as f:
        data = memoryview(f.read())
    (ranges,) = struct.unpack_from("<I", data)
    at, numbers, checks, more = 4, [], [], ([], [])
    for _ in range(ranges):
        n, check, *sizes = struct.unpack_from("<IqII", data, at)
        at += struct.calcsize("<IqII")
        numbers.append(n)
        checks.append(check)
        for out, size in zip(more, sizes, strict=True):
            out.append(unpack(data[at : at + size], n))
            at += size
    if sum(numbers) != len(block.keys) or checksums(block.keys, numbers).tolist() != checks:
        raise ValueError(f"block {number} has other rows than when it was counted")
    train, dev = block.counts()
    return train + np.concatenate(more[0]), dev + np.concatenate(more[1])


def learn_weights(rows: DataFrame, folder: str, tokens: int, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (of triples, of pairs) for each bucket, from the tokens of DEV and the counts without it.

    A token bears on the weights only through its two buckets and the ratios of
    its pair and triple estimates to the unigram's; held-out tokens are counted
    by these (half-octave bins) and expectation-maximisation runs on the counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in blocks(batches):
            dev = block.folds[block.docs] == DEV
            if dev.any():
                train, held = totals_of(block, number, folder)
                unigram, pair, triple, low, high = (x[dev] for x in block.estimates(train - held, tokens, kinds))
                cell = ((high * BUCKETS + low) * BINS + bin_of(triple / unigram)) * BINS + bin_of(pair / unigram)
                cell, n = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])

    cells = rows.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toArrow()  # BUCKETS ** 2 * BINS ** 2 rows at the very most, of which few occur
    cell = cells["cell"].to_numpy()
    rest, pair_bin = np.divmod(cell, BINS)
    rest, triple_bin = np.divmod(rest, BINS)
    high, low = np.divmod(rest, BUCKETS)
    return maximise(cells["n"].to_numpy().astype(float), high, low, ratio_of(triple_bin), ratio_of(pair_bin))


def maximise(n: np.ndarray, high: np.ndarray, low: np.ndarray, triple: np.ndarray, pair: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Weights of triples by bucket ``high`` and of pairs by bucket ``low`` for n tokens of each cell, by expectation-maximisation.

    Contexts never seen (bucket 0) have no estimates, so their weights are 0;
    a bucket without held-out tokens takes the mean weight of the others.
    """
    a, b = (np.where(np.arange(BUCKETS) > 0, 0.5, 0.0) for _ in range(2))
    for _ in range(rounds if len(n) else 0):
        x, y = a[high], b[low]
        parts = np.stack([x * triple, (1 - x) * y * pair, (1 - x) * (1 - y)])
        parts *= n / parts.sum(axis=0)
        a = _share(high, parts[0], n)
        b = _share(low, parts[1], parts[1] + parts[2])
    return a, b


def _share(bucket: np.ndarray, part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    part, whole = np.bincount(bucket, part, BUCKETS), np.bincount(bucket, whole, BUCKETS)
    part[0] = whole[0] = 0
    mean = part.sum() / whole.sum() if whole.sum() else 0.5
    out = np.clip(np.where(whole > 0, part / np.where(whole > 0, whole, 1), mean), 1e-6, 1 - 1e-6)
    out[0] = 0
    return out


def score(rows: DataFrame, folder: str, tokens: int, kinds: int, weights: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, score_left_out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in blocks(batches):
            counts = totals_of(block, number, folder)[0]
            n, seen = len(block.ids), counts[block.token_at]
            base = np.log10((seen + 1) / (tokens + kinds + 1))
            scores = []
            for deleted in (False, True):
                unigram, pair, triple, low, high = block.estimates(counts, tokens, kinds, deleted)
                a, b = weights[0][high], weights[1][low]
                scores.append(np.log10(a * triple + (1 - a) * (b * pair + (1 - b) * unigram)))
            sums = [np.bincount(block.docs, x, n) for x in (np.ones(len(seen)), seen > 0, base, *scores)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.ids, pa.int64()), pa.array(block.folds == HELD_OUT), *(pa.array(x.astype(np.int64)) for x in sums[:2]), pa.array([tokens] * n, pa.int64()), *map(pa.array, sums[2:])],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "score_left_out"],
            )

    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, score_left_out double")


def score_documents(documents: DataFrame) -> DataFrame:
    """Learn from the training folds of ``documents`` and score all of them."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    folder = new_folder(documents.sparkSession, "ngram-totals")
    ranges = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES))
    tokens, kinds, main_tokens, main_kinds = store_totals(range_totals(block_keys(rows, ranges)), folder)
    weights = learn_weights(rows, folder, main_tokens, main_kinds)
    return score(rows, folder, tokens, kinds, weights)
