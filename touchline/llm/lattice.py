"""Near-duplicate vectors by E8 lattice hashing in several tables.

Vectors of equal label and components are one node from the start.  In each
table a node is projected to one or more sets of eight dimensions, scaled, and
each is decoded to the nearest point of the E8 lattice; the points together are
the node's cell.  A node is stored under its cell and also asks the PROBES cells
nearest to it, of those that change points to lattice neighbours.  What meets in
a cell is a block (named by its first stored node); blocks are verified by cosine
in double precision and give spanning edges, whose components hold all links
found.  The links of each node are then counted within its component, in pairs of
chunks, so no pair of copies or links is ever a row.

The number of points to a cell grows with the logarithm of the largest label, so
that two unrelated nodes rarely meet (OCCUPIED others in a cell at most, where
vectors of a label lie all around); the number of tables then grows with a small
power of it: some 17 at 8,000 nodes, 55 at 10**7, 165 at 10**9.  It follows from
the chance that a pair at the threshold meets in a table, taken by simulation
and lowered by its error, so that at most ``miss`` of such pairs are lost.

Semantics for odd input: null or zero vectors, vectors with a null, NaN or
infinite component, and vectors without a label link with nothing and stand for
themselves; vectors of other lengths are compared only with their like; repeated
rows are linked copies; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import blocks
from touchline.llm.components import connected_components
from touchline.llm.shared import cut
from touchline.llm.signature_tree import Forest
from touchline.llm.text_hash import mix

_U = np.uint64
COSINE = 0.93
PROBES = 4
MISS = 0.001
#: Scales to choose from, the most points to a cell, and the unrelated nodes in a cell that are borne.
SCALES = tuple(1.2 + 0.1 * i for i in range(7))
POINTS, OCCUPIED = 8, 0.06
CELL, CHUNK = 1024, 2048


def _even_nearest(x: np.ndarray) -> np.ndarray:
    """Nearest integer points of even sum: where the rounded sum is odd, the worst coordinate goes the other way."""
    f = np.rint(x)
    off = x - f
    odd = np.flatnonzero(f.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(axis=1)
    f[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return f


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points of rows of eight numbers: even integers' lattice, or its half-shifted coset."""
    whole, half = _even_nearest(x), _even_nearest(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def shortest() -> np.ndarray:
    """The 240 shortest E8 points: all (+-1, +-1, 0...) and the half points of even sign."""
    points = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            points.append(v)
    points += [np.array(v) for v in itertools.product((0.5, -0.5), repeat=8) if sum(c < 0 for c in v) % 2 == 0]
    return np.array(points)


_STEPS = shortest()
_WEIGHTS = mix(np.arange(1, 9, dtype=np.uint64))


def cells(parts: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(home cell, probed cells) of nodes from their projections (points x nodes x 8), as 64-bit names.

    A probed cell has lattice neighbours for some of its points; its cost is how
    much farther from the node they lie, in sum of squares.
    """
    cost = names = home = None
    for x in parts:
        point = decode(x)
        away = (x - point) @ _STEPS.T
        top = np.argpartition(away, -probes, axis=1)[:, -probes:]
        more = np.concatenate([np.zeros((len(x), 1)), 2 - 2 * np.take_along_axis(away, top, axis=1)], axis=1)  # all steps have length 2 ** 0.5
        at = np.concatenate([point[:, None], point[:, None] + _STEPS[top]], axis=1)
        own = mix((np.rint(at * 2).astype(np.int64).view(np.uint64) * _WEIGHTS).sum(axis=-1, dtype=np.uint64))
        if cost is None:
            cost, names, home = more, own, own[:, 0]
            continue
        home = home * _U(0x9FB21C651E98DF25) + own[:, 0]
        cost = (cost[:, :, None] + more[:, None, :]).reshape(len(x), -1)
        names = (names[:, :, None] * _U(0x9FB21C651E98DF25) + own[:, None, :]).reshape(len(x), -1)
        keep = np.argpartition(cost, probes, axis=1)[:, : probes + 1]
        cost, names = np.take_along_axis(cost, keep, axis=1), np.take_along_axis(names, keep, axis=1)
    order = np.argsort(cost, axis=1, kind="stable")  # the home cell costs nothing
    return home, np.take_along_axis(names, order, axis=1)[:, 1:]


def projections(dimension: int, tables: int, points: int, scale: float, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dimension]).normal(size=(tables, points, dimension, 8)) * scale / math.sqrt(8)


def meeting_chance(scale: float, points: int, cosine: float, probes: int, pairs: int = 8000) -> float:
    """Chance that two unit vectors at this cosine meet in one table, less two standard errors of its simulation."""
    chance = meetings(scale, points, cosine, probes, pairs, seed=3) / pairs
    return chance - 2 * math.sqrt(chance * (1 - chance) / pairs)


def meetings(scale: float, points: int, cosine: float, probes: int, pairs: int, seed: int) -> int:
    """How many of so many random pairs at this cosine meet in one table."""
    rng, met = np.random.default_rng(seed), 0
    for lo in range(0, pairs, 4000):
        # In eight projected dimensions the two are correlated normal vectors.
        a, b = rng.normal(size=(2, points, min(4000, pairs - lo), 8)) * scale / math.sqrt(8)
        (home_a, probed_a), (home_b, probed_b) = cells(a, probes), cells(cosine * a + math.sqrt(1 - cosine**2) * b, probes)
        met += int(((home_a == home_b) | (probed_a == home_b[:, None]).any(axis=1) | (probed_b == home_a[:, None]).any(axis=1)).sum())
    return met


@functools.cache
def unrelated_chance(scale: float, nodes: int = 60000) -> float:
    """Chance that two unrelated vectors have the same point."""
    x = np.random.default_rng(9).normal(size=(nodes, 8)) * scale / math.sqrt(8)
    alike = np.unique((np.rint(decode(x) * 2).astype(np.int64).view(np.uint64) * _WEIGHTS).sum(axis=-1, dtype=np.uint64), return_counts=True)[1].astype(float)
    return float((alike * (alike - 1)).sum() / nodes / (nodes - 1))


@functools.cache
def plan(largest: int, cosine: float = COSINE, probes: int = PROBES, miss: float = MISS) -> tuple[float, int, int]:
    """(scale, points to a cell, tables) for the nodes of the largest label: the fewest tables in which cells are sparse enough."""
    found = []
    for points in range(1, POINTS + 1):
        scale = next((s for s in SCALES if largest * unrelated_chance(s) ** points <= OCCUPIED), None)
        if scale is not None:
            chance = meeting_chance(scale, points, cosine, probes)
            found.append((max(2, math.ceil(math.log(miss) / math.log(1 - min(0.999, chance)))), scale, points))
            if len(found) == 2:
                break
    tables, scale, points = min(found)
    return scale, points, tables


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat double components, lengths); null components are NaN."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    return np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan)), lengths


def nodes(embeddings: DataFrame) -> DataFrame:
    """(vec_id, mark, label, vector): mark is null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, lengths = _vectors(b.column(2))
            labels = b.column(1).to_pylist()
            marks, at = [], 0
            for n, label in zip(lengths.tolist(), labels, strict=True):
                v = flat[at : at + n]
                at += n
                ok = label is not None and n and np.isfinite(v).all() and v.any()
                marks.append(_mark(v, label) if ok else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marks, pa.int64()), b.column(1), b.column(2)], names=["vec_id", "mark", "label", "vector"])

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, "vec_id long, mark long, label long, vector array<double>")


def _mark(v: np.ndarray, label: int) -> int:
    bits = mix((v + 0.0).view(np.uint64) + np.arange(1, len(v) + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
    h = np.array([label], dtype=np.int64).view(np.uint64) * _U(0xC2B2AE3D27D4EB4F) + _U(len(v))
    return int(mix(h + np.add.reduce(bits)).view(np.int64)[0])


def cell_rows(distinct: DataFrame, scale: float, points: int, tables: int, probes: int, seed: int) -> DataFrame:
    """(cell, asks, mark): the stored row and the asking rows of each node in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for b in batches:
            flat, lengths = _vectors(b.column(2))
            starts = np.cumsum(lengths) - lengths
            marks, labels = b.column(0).to_numpy(), b.column(1).to_numpy()
            for n in np.unique(lengths).tolist():
                if n not in known:
                    known[n] = projections(n, tables, points, scale, seed)
                of = np.flatnonzero(lengths == n)
                for i in range(0, len(of), 2048):
                    own = of[i : i + 2048]
                    x = _unit(flat[starts[own][:, None] + np.arange(n)])
                    for t in range(tables):
                        base = mix(labels[own].view(np.uint64) * _U(0xC2B2AE3D27D4EB4F) + _U(t * 4099 + n * 7))
                        home, asked = cells(x @ known[n][t], probes)
                        cell = mix(np.concatenate([home ^ base, (asked ^ base[:, None]).ravel()]))
                        mark = np.concatenate([marks[own], np.repeat(marks[own], probes)])
                        asks = np.arange(len(cell)) >= len(own)
                        yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(asks), pa.array(mark)], names=["cell", "asks", "mark"])

    return distinct.select("mark", "label", "vector").mapInArrow(run, "cell long, asks boolean, mark long")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def hub_pairs(rows: DataFrame) -> DataFrame:
    """Distinct (hub, mark) of cells with a stored node and one more; a hub is in its own block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_cell = last_hub = None
        for b in batches:
            cell, asks, mark = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
            if not len(cell):
                continue
            new = np.ones(len(cell), bool)
            new[1:] = cell[1:] != cell[:-1]
            new[0] = last_cell is None or int(cell[0]) != last_cell
            at, run_no = np.flatnonzero(new), np.cumsum(new) - 1
            first = np.where(run_no >= 0, at[np.maximum(run_no, 0)] if len(at) else 0, 0)
            hub = np.where(run_no >= 0, mark[first], last_hub or 0)
            stored = np.where(run_no >= 0, ~asks[first], last_hub is not None)
            last_cell, last_hub = int(cell[-1]), int(hub[-1]) if stored[-1] else None
            keep = stored & (hub != mark)
            pairs = np.unique(np.stack([hub[keep], mark[keep]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["hub", "mark"])

    dealt = rows.repartition("cell").sortWithinPartitions("cell", "asks", "mark")
    pairs = cut(dealt.mapInArrow(run, "hub long, mark long").distinct())
    return pairs.unionByName(pairs.select("hub", F.col("hub").alias("mark")).distinct())


def join_blocks(rows: DataFrame, cosine: float) -> DataFrame:
    """Spanning edges (a, b) of block parts (hub, part, mark, spread, label, vector), and members apart from the hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (hub, _), own in _grouped(batches, ("hub", "part")):
            marks, spread = own["mark"], own["spread"]
            x = _unit(own["vector"])
            forest, a, b, apart = Forest(len(marks)), [], [], []
            at = np.flatnonzero(marks == hub)
            if len(at):
                near = x @ x[at[0]] >= cosine
                for i in range(len(marks)):
                    if i != at[0]:
                        a.append(hub)
                        b.append(int(marks[i]))
                        apart.append(not near[i])
                        if near[i]:
                            forest.union(int(at[0]), i)
            rows_ = np.flatnonzero(spread) if spread.any() else np.arange(len(marks))
            for lo in range(0, len(rows_), 512):
                part = rows_[lo : lo + 512]
                root = np.array([forest.root(i) for i in range(len(marks))])
                i, j = np.nonzero((x[part] @ x.T >= cosine) & (root[part][:, None] != root))
                for p, q in zip(part[i].tolist(), j.tolist(), strict=True):
                    if forest.union(p, q):
                        a.append(int(marks[p]))
                        b.append(int(marks[q]))
                        apart.append(False)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(apart, pa.bool_())], names=["a", "b", "apart"])

    dealt = rows.select("hub", "part", "mark", "spread", "vector").repartition("hub", "part").sortWithinPartitions("hub", "part", "mark")
    return dealt.mapInArrow(run, "a long, b long, apart boolean")


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]):
    """(key, columns as arrays) of consecutive rows with equal keys; vectors of a group have one length."""
    held: list[pa.RecordBatch] = []
    key = None

    def columns() -> dict[str, np.ndarray]:
        table = pa.Table.from_batches(held)
        out = {}
        for name in table.schema.names:
            if name == "vector":
                flat, lengths = _vectors(table.column(name).combine_chunks())
                out[name] = flat.reshape(len(lengths), -1)
            else:
                out[name] = table.column(name).to_numpy()
        return out

    for b in batches:
        if not b.num_rows:
            continue
        names = [np.asarray(b.column(k)) for k in keys]
        new = np.zeros(b.num_rows, bool)
        for x in names:
            new[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own = tuple(x[lo].item() for x in names)
            if own != key:
                if held:
                    yield key, columns()
                key, held = own, []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield key, columns()


def count_links(members: DataFrame, cosine: float, chunk: int) -> DataFrame:
    """(mark, links) from (class, mark, copies, vector): copies of linked nodes, in chunk pairs of each class."""
    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    dealt = members.join(sizes, "class").withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("mark"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("class", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "mark", "copies", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, low, high), rows in _grouped(batches, ("class", "low", "high")):
            x, copies, first = _unit(rows["vector"]), rows["copies"].astype(np.float64), rows["own"] == low
            links = np.zeros(len(x))
            if low == high:
                for lo in range(0, len(x), 512):
                    links[lo : lo + 512] = (x[lo : lo + 512] @ x.T >= cosine) @ copies
                links -= (np.einsum("ij,ij->i", x, x) >= cosine) * copies
            else:
                near = x[first] @ x[~first].T >= cosine
                links[first], links[~first] = near @ copies[~first], copies[first] @ near
            yield pa.RecordBatch.from_arrays([pa.array(rows["mark"]), pa.array(np.rint(links).astype(np.int64))], names=["mark", "links"])

    dealt = dealt.repartition("class", "low", "high").sortWithinPartitions("class", "low", "high")
    return dealt.mapInArrow(run, "mark long, links long").groupBy("mark").agg(F.sum("links").alias("links"))


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, probes: int = PROBES, miss: float = MISS, seed: int = 5, cell: int = CELL, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``embeddings`` (vec_id, embedding, label)."""
    rows = cut(nodes(embeddings))
    linkable = rows.filter("mark is not null")
    distinct = linkable.groupBy("mark").agg(F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    distinct = cut(distinct)
    largest = distinct.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    scale, points, tables = plan(1 << max(0, largest - 1).bit_length(), cosine, probes, miss)
    pairs = hub_pairs(cell_rows(distinct, scale, points, tables, probes, seed))
    placed = cut(blocks.deal(pairs, cell))
    vectors = distinct.select("mark", "vector")
    found = cut(join_blocks(placed.join(vectors, "mark"), cosine))
    edges = found.filter(~F.col("apart")).select("a", "b")
    split = placed.filter("parts > 1")
    if not split.isEmpty():
        apart = found.filter("apart").select(F.col("a").alias("hub"), F.col("b").alias("mark"))
        more = join_blocks(blocks.deal_again(split, apart).join(vectors, "mark"), cosine)
        edges = edges.unionByName(cut(more.filter(~F.col("apart")).select("a", "b")))
    classes = connected_components(edges)
    members = classes.select(F.col("component").alias("class"), F.col("node").alias("mark")).join(distinct, "mark")
    links = count_links(members.select("class", "mark", "copies", "vector"), cosine, chunk)
    about = distinct.select("mark", "copies").join(classes.withColumnRenamed("node", "mark"), "mark", "left").join(links, "mark", "left")
    about = about.select("mark", F.coalesce("component", "mark").alias("class"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    full = linkable.select("vec_id", "mark").join(about, "mark")
    least = full.groupBy("class").agg(F.min("vec_id").alias("component_id"))
    full = full.join(least, "class").select("vec_id", "n_links", "component_id")
    alone = rows.filter("mark is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return full.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
