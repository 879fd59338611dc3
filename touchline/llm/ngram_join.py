"""Exact self-join of documents on the Jaccard similarity of their word n-grams.

1. Each document becomes its set of hashed shingles, and the set a 64-bit mark;
   equal sets are one node from here on.
2. Sets whose similarity reaches the threshold share a token of their prefixes
   (the first quarter in any fixed order of tokens).  The order puts tokens that
   many documents share last: it is only an order, so it changes no result.
3. Within the documents of a prefix token, sorted by size, a run without a gap
   that no link can span is named by its first set, its hub; (hub, set) pairs
   from all tokens, made distinct, are the blocks.  Every link lies in a block.
4. A signature tree of each block's bitmaps, of fixed length, is traversed
   against itself; only sets that keep a possible partner fetch their texts.
   Then a tree with bitmaps to measure joins these sets exactly: hub first, then
   by dual traversal, leaving out what is connected already.  So a block gives
   a spanning forest, not all its pairs.
5. Connected components of these edges name the documents' classes.

A block of more than CELL sets is split: each part is joined with the hub, and
only sets that don't link to the hub go to every part (two sets that do are
connected through it).

Semantics for odd input: a text of fewer words than ``n`` has one shingle, its
whole sequence; a null or empty text, or one of white space, has none and links
with nothing; repeated rows are copies of each other; a null doc_id takes part,
and names a class only if all of it are null; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from touchline.llm import blocks, text_hash
from touchline.llm.components import connected_components
from touchline.llm.shared import cut
from touchline.llm.signature_tree import Forest, Similar, bitmaps, join, partners

_U = np.uint64
WORDS, PERCENT = 5, 75
#: Sets of a block that one task joins.
CELL = 2048
#: Tokens counted together, the count from which a token is reported as common,
#: and the number of common tokens that order prefixes (an order of bounded size).
SEGMENT, COMMON, ORDERED = 4 << 20, 4, 1 << 18
#: Least and most bits of the bitmaps that rule out pairs before texts are fetched: twice to four times a set's size.
LEAST_BITS, MOST_BITS = 512, 1 << 16
_SIZE_STEPS = 12  # size classes for each doubling, kept in a prefix key's last 8 bits


def mark_of(s: np.ndarray) -> int:
    """64-bit mark of a set, as a signed number."""
    total = np.array([len(s)], dtype=np.uint64) + np.add.reduce(text_hash.mix(s ^ _U(0xA24BAED4963EE407)), dtype=np.uint64)
    return int(text_hash.mix(total).view(np.int64)[0])


def bits_of(size: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (2 * size).bit_length()))


def describe(documents: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id, size, mark, text_hash, bits, token, seen): a row for each document, and rows of common tokens with counts.

    ``seen`` is null in the rows of documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0

        def common() -> pa.RecordBatch:
            tokens = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(tokens)), bool), tokens[1:] != tokens[:-1]]))
            seen = np.diff(np.append(starts, len(tokens)))
            keep = seen >= COMMON
            none = pa.nulls(int(keep.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(int(keep.sum()), pa.binary()), pa.array(tokens[starts[keep]].view(np.int64)), pa.array(seen[keep].astype(np.int64))], names=_DESCRIBED)

        for b in batches:
            sizes, marks, bits = [], [], []
            for _, data, offsets in text_hash.slices(b.column(1)):
                sets = text_hash.shingle_sets(data, offsets, n)
                bits += [bitmaps([s], bits_of(len(s)))[0].tobytes() for s in sets]
                for s in sets:
                    sizes.append(len(s))
                    marks.append(mark_of(s))
                    held.append(s)
                    count += len(s)
                if count >= SEGMENT:
                    yield common()
                    held, count = [], 0
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(marks, pa.int64()), b.column(2), pa.array(bits, pa.binary()), none, none], names=_DESCRIBED)
        yield common()

    return _texts(documents).mapInArrow(run, "doc_id long, size long, mark long, text_hash long, bits binary, token long, seen long")


_DESCRIBED = ["doc_id", "size", "mark", "text_hash", "bits", "token", "seen"]


def _texts(documents: DataFrame) -> DataFrame:
    """(doc_id, text, text_hash): an id and a hash name a text also where ids are null or repeated."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))


def token_order(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(common tokens, sorted; their counts): at most ORDERED of them."""
    top = described.filter("seen is not null").groupBy("token").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "token").limit(ORDERED).toArrow()
    tokens, seen = (np.asarray(top.column(c).combine_chunks()) for c in ("token", "seen"))
    order = np.argsort(tokens.view(np.uint64))
    return tokens.view(np.uint64)[order], seen[order]


def prefix_of(s: np.ndarray, tokens: np.ndarray, seen: np.ndarray, percent: int) -> np.ndarray:
    """The tokens of a set's prefix: any set similar enough shares one of them."""
    k = len(s) - -(-percent * len(s) // 100) + 1
    if not len(tokens):
        return s[:k]
    at = np.searchsorted(tokens, s)
    at[at == len(tokens)] = 0
    often = np.where(tokens[at] == s, seen[at], 0)
    rare = s[often == 0]
    if len(rare) >= k:
        return rare[:k]
    rest = often > 0
    common = s[rest][np.argsort(often[rest], kind="stable")]
    return np.concatenate([rare, common])[:k]


def prefix_rows(documents: DataFrame, order: tuple[np.ndarray, np.ndarray], n: int, percent: int) -> DataFrame:
    """(key, mark): a key is 56 bits of a prefix token and 8 of the set's size class."""
    sent = documents.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen = sent.value
        met: set[int] = set()  # copies within a task give their rows once
        for b in batches:
            for _, data, offsets in text_hash.slices(b.column(0)):
                keys, marks, counts = [], [], []
                for s in text_hash.shingle_sets(data, offsets, n):
                    mark = mark_of(s)
                    if len(s) and mark not in met:
                        met.add(mark)
                        p = prefix_of(s, tokens, seen, percent)
                        size_class = _U(min(255, int(_SIZE_STEPS * np.log2(len(s)))))
                        keys.append((p & _U(0xFFFFFFFFFFFFFF00)) | size_class)
                        marks.append(mark)
                        counts.append(len(p))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(marks, dtype=np.int64), counts))], names=["key", "mark"]
                    )

    return documents.select("text").mapInArrow(run, "key long, mark long")


def hub_pairs(prefixes: DataFrame, percent: int) -> DataFrame:
    """Distinct (hub, mark) of blocks with two sets or more; a hub is in its own block."""
    gap = int(np.ceil(_SIZE_STEPS * np.log2(100 / percent))) + 1  # classes apart that no link spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_hub = None
        for b in batches:
            key, mark = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            if not len(key):
                continue
            token, size_class = key >> _U(8), (key & _U(255)).astype(np.int64)
            new = np.ones(len(key), bool)
            new[1:] = (token[1:] != token[:-1]) | (size_class[1:] - size_class[:-1] >= gap)
            if last_key is not None:
                new[0] = int(token[0]) != last_key >> 8 or int(size_class[0]) - (last_key & 255) >= gap
            at = np.flatnonzero(new)
            run_no = np.cumsum(new) - 1
            hub = np.where(run_no >= 0, mark[at][np.maximum(run_no, 0)] if len(at) else 0, last_hub if last_hub is not None else 0)
            last_key, last_hub = int(key[-1]), int(hub[-1])
            other = hub != mark
            pairs = np.unique(np.stack([hub[other], mark[other]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["hub", "mark"])

    dealt = prefixes.withColumn("token", F.expr("shiftrightunsigned(key, 8)"))
    dealt = dealt.repartition("token").sortWithinPartitions("key", "mark").select("key", "mark")
    pairs = cut(dealt.mapInArrow(run, "hub long, mark long").distinct())
    return pairs.unionByName(pairs.select("hub", F.col("hub").alias("mark")).distinct())


def with_partners(rows: DataFrame, percent: int) -> DataFrame:
    """The rows (hub, part, mark, ..., size, bits) whose sets can link with another of their block part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        similar = Similar(percent)
        for own in block_parts(batches):
            keep = can_link([np.frombuffer(x, dtype=np.uint64) for x in own.column("bits").to_pylist()], own.column("size").to_numpy(), similar)
            if keep.any():
                yield from own.filter(pa.array(keep)).drop_columns(["size", "bits"]).to_batches()

    names = ["hub", "part", "parts", "mark", "spread", "doc_id", "text_hash", "size", "bits"]
    dealt = rows.select(*names).repartition("hub", "part").sortWithinPartitions("hub", "part", "mark")
    return dealt.mapInArrow(run, "hub long, part int, parts int, mark long, spread boolean, doc_id long, text_hash long")


def can_link(bits: list[np.ndarray], sizes: np.ndarray, similar: Similar) -> np.ndarray:
    """Which sets of a block can link with another, by bitmaps of several lengths.

    Sizes that can link have bitmaps of the same length or of neighbouring ones;
    for these pairs the longer one is folded in half.
    """
    lengths = np.array([len(b) for b in bits])
    keep = np.zeros(len(bits), dtype=bool)
    for length in np.unique(lengths):
        own, longer = np.flatnonzero(lengths == length), np.flatnonzero(lengths == 2 * length)
        words = np.stack([bits[i] for i in own])
        if len(longer):
            double = np.stack([bits[i] for i in longer])
            words = np.concatenate([words, double[:, :length] | double[:, length:]])
        both = np.concatenate([own, longer])
        if len(both) > 1:
            keep[both] |= partners(words, sizes[both], similar, np.arange(len(both)) < len(own))
    return keep


def block_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal hub and part."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        hub, part = b.column("hub").to_numpy(), b.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero((hub[1:] != hub[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if last is not None and last != (hub[lo], part[lo]):
                yield pa.Table.from_batches(held)
                held = []
            last = (hub[lo], part[lo])
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _streamed(batches: Iterator[pa.RecordBatch], n: int):
    """(hub, part, marks, sets, spread flags) of consecutive rows of a block part."""
    own, marks, sets, spread = None, [], [], []
    for b in batches:
        keys = list(zip(b.column("hub").to_pylist(), b.column("part").to_pylist(), strict=True))
        wanted, spreads = b.column("mark").to_pylist(), b.column("spread").to_pylist()
        row = 0
        for _, data, offsets in text_hash.slices(b.column("text")):
            for s in text_hash.shingle_sets(data, offsets, n):
                if keys[row] != own:
                    if own is not None:
                        yield (*own, marks, sets, spread)
                    own, marks, sets, spread = keys[row], [], [], []
                if mark_of(s) == wanted[row] and (not marks or marks[-1] != wanted[row]):  # rows of equal id and text come once
                    marks.append(wanted[row])
                    sets.append(s)
                    spread.append(spreads[row])
                row += 1
    if own is not None:
        yield (*own, marks, sets, spread)


def join_blocks(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Edges (a, b) of block parts (hub, part, mark, spread, text), and sets apart from their hub as (hub, mark, apart).

    Rows with ``spread`` are compared with all of their part, the others only
    with those and with the hub, if the part has any such rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        similar = Similar(percent)
        for hub, _, marks, sets, spread in _streamed(batches, n):
            a, b, apart = [], [], []
            forest = Forest(len(marks))
            if hub in marks:
                at = marks.index(hub)
                for i, s in enumerate(sets):
                    if i != at:
                        if similar.linked(sets[at], s):
                            forest.union(at, i)
                            a.append(hub)
                            b.append(marks[i])
                            apart.append(False)
                        else:
                            a.append(hub)
                            b.append(marks[i])
                            apart.append(True)
            chosen = np.array(spread, dtype=bool)
            for i, j in join(sets, similar, forest, chosen if chosen.any() else None) if len(sets) > 2 or hub not in marks else ():
                a.append(marks[i])
                b.append(marks[j])
                apart.append(False)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(apart, pa.bool_())], names=["a", "b", "apart"])

    columns = ["hub", "part", "mark", "spread", "text"]
    dealt = rows.select(*columns).repartition("hub", "part").sortWithinPartitions("hub", "part", "mark")
    return dealt.mapInArrow(run, "a long, b long, apart boolean")


def similar_edges(documents: DataFrame, described: DataFrame, n: int, percent: int, cell: int) -> DataFrame:
    """Edges (a, b) between marks that connect them as all links do."""
    pairs = cut(hub_pairs(prefix_rows(documents, token_order(described), n, percent), percent))
    # One document stands for each set; its text is fetched only if its set is in a block.
    one = F.min(F.struct("doc_id", "text_hash"))
    stands = described.filter("seen is null and size > 0").groupBy("mark").agg(one.alias("one"), F.first("size").alias("size"), F.first("bits").alias("bits"))
    stands = stands.select("mark", "one.*", "size", "bits")
    dealt = blocks.deal(pairs, cell).join(stands, "mark")
    # A part of a split block doesn't show all partners of its sets, so these all stay.
    placed = cut(with_partners(dealt.filter("parts = 1"), percent).unionByName(dealt.filter("parts > 1").select("hub", "part", "parts", "mark", "spread", "doc_id", "text_hash")))
    texts = _texts(documents)
    found = cut(join_blocks(_with_text(placed, texts), n, percent))
    edges = found.filter(~F.col("apart")).select("a", "b")
    split = cut(placed.filter("parts > 1"))
    if split.isEmpty():
        return edges
    again = blocks.deal_again(split, found.filter("apart").select(F.col("a").alias("hub"), F.col("b").alias("mark"))).join(stands.select("mark", "doc_id", "text_hash"), "mark")
    more = join_blocks(_with_text(again, texts), n, percent)
    return edges.unionByName(cut(more.filter(~F.col("apart")).select("a", "b")))


def _with_text(placed: DataFrame, texts: DataFrame) -> DataFrame:
    same = placed["doc_id"].eqNullSafe(texts["doc_id"]) & (placed["text_hash"] == texts["text_hash"])
    return placed.select("hub", "part", "mark", "spread", "doc_id", "text_hash").join(texts, same).select("hub", "part", "mark", "spread", "text")


def ngram_components(documents: DataFrame, n: int = WORDS, percent: int = PERCENT, cell: int = CELL) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    ``component_id``: the least doc_id that links reach, the document's own included.
    """
    full, alone = _classes(documents, n, percent, cell)
    return full.select("doc_id", F.col("size").alias("n_shingles"), "component_id").unionByName(alone.select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _classes(documents: DataFrame, n: int, percent: int, cell: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, size, mark, class, component_id) of documents with words, and (doc_id, size) of the others."""
    described = cut(describe(documents, n))
    classes = connected_components(similar_edges(documents, described, n, percent, cell))
    rows = described.filter("seen is null").select("doc_id", "size", "mark")
    full = rows.filter("size > 0").join(classes, rows["mark"] == classes["node"], "left").select("doc_id", "size", "mark", F.coalesce("component", "mark").alias("class"))
    least = full.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return full.join(least, "class"), rows.filter("size = 0").select("doc_id", "size")


def drop_near_copies(documents: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each class with its own columns: that of least doc_id, and of least mark where texts share it.

    Rows without words link with nothing and stay; of rows with equal doc_id
    and text, one stays.
    """
    full, _ = _classes(documents, n, percent, CELL)
    kept = full.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("class", "doc_id").agg(F.min("mark").alias("kept"))
    kept = kept.select(F.col("doc_id").alias("kept_id"), "kept")
    rows = _with_marks(documents, n).withColumn("id", F.col("doc.doc_id").cast("long"))
    rows = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("mark") == F.col("kept")) & F.col("worded"), "left")
    return rows.filter("kept is not null or not worded").dropDuplicates(["id", "worded", "mark"]).select("doc.*")


def _with_marks(documents: DataFrame, n: int) -> DataFrame:
    """(doc, worded, mark): the documents' columns, whether they have words, and a mark of their set, or of the text itself where they have none."""
    rows = documents.select(F.struct("*").alias("doc"))
    column = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, worded, marks = b.column(0).field(column), [], []
            for _, data, offsets in text_hash.slices(texts):
                for s in text_hash.shingle_sets(data, offsets, n):
                    text = None if len(s) else texts[len(marks)].as_py()
                    worded.append(len(s) > 0)
                    marks.append(mark_of(s) if len(s) else -1 if text is None else int.from_bytes(hashlib.blake2b(text.encode(), digest_size=7).digest()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(worded, pa.bool_()), pa.array(marks, pa.int64())], names=["doc", "worded", "mark"])

    schema = StructType([*rows.schema.fields, StructField("worded", BooleanType()), StructField("mark", LongType())])
    return rows.mapInArrow(run, schema)
