"""Embedding whitening from exact, bit-sliced scatter.

Entries become integers, ``floor(256 * c)``, and the fit list is each distinct
vector of them once.  A task takes its share of the list in blocks of BLOCK rows,
shifts each dimension by its least entry there, and packs each bit plane of each
dimension across the rows into 64-bit words.  The count of ones in the AND of two
planes, weighted by the planes' powers of two, is a cross-product of two shifted
dimensions without rounding; shifts are put back in Python integers.  A further
dimension of ones makes the sums and the number of vectors part of the same
table.  Tables are added up in limbs of 31 bits, so nothing overflows; a table of
(dimensions + 1) squared numbers reaches the driver, whatever the rows, and
``most`` bounds the dimensions.  There it is centred as integers
(``n * C - S S^T``) before the one division and the eigenvectors.

Semantics for odd input: vectors that are null, empty or hold a null, NaN or
infinite entry are dropped, and so are vectors of other lengths than that which
most distinct vectors have (of ties the longest); entries beyond a long become the nearest long; repeated rows
give rows each, but count once in the fit; null ids are kept.  Components without
variance (up to rounding, 1e-12 of the trace) have a null ``whitened`` and an
``explained`` of 0, and ``identity_error`` is over the others (0 if there are none);
a deviation beyond a long is null.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.shared import new_folder

SCALE, COMPONENTS = 256, 4
#: Rows to a block of planes, bytes of planes compared at once, bits of a limb.
BLOCK, AT_ONCE, LIMB = 4096, 8 << 20, 31
#: Most dimensions; their squared number of sums is what the driver holds.
MOST = 4096
FLAT = 1e-12
_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(embedding: Column, scale: int = SCALE) -> Column:
    """The vector as integers, or null if it is to be dropped."""
    finite = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf))
    return F.when((F.size(embedding) > 0) & finite, F.transform(embedding, lambda c: F.floor(c.cast("double") * scale).cast("long")))


def planes(u: np.ndarray) -> np.ndarray:
    """Bit planes of unsigned rows (n x d) as words across rows: bits x d x words."""
    bits = max(1, int(u.max(initial=0)).bit_length())
    padded = np.zeros((u.shape[1], -(-len(u) // 64) * 64), np.uint64)
    padded[:, : len(u)] = u.T
    packed = [np.packbits((padded >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=1) for b in range(bits)]
    return np.stack(packed).view(np.uint64)


def cross_products(p: np.ndarray) -> np.ndarray:
    """Exact sums of products of all pairs of dimensions (Python integers) from their bit planes."""
    bits, d, words = p.shape
    total = np.zeros((d, d), object)
    step = max(1, AT_ONCE // (8 * d * words))
    for b in range(bits):
        for c in range(b, bits):
            ones = np.concatenate([np.bitwise_count(p[b, lo : lo + step, None] & p[c, None]).sum(axis=2, dtype=np.int64) for lo in range(0, d, step)])
            total += (ones if b == c else ones + ones.T).astype(object) << (b + c)
    return total


def scatter(x: np.ndarray) -> np.ndarray:
    """Exact X^T X of integer rows, by blocks of bit planes over each block's least entries."""
    total = np.zeros((x.shape[1],) * 2, object)
    for lo in range(0, len(x), BLOCK):
        rows = x[lo : lo + BLOCK]
        least = rows.min(axis=0)
        u = rows.view(np.uint64) - least.view(np.uint64)  # right modulo 2**64, so for any two longs
        p = planes(u)
        sums = (np.bitwise_count(p).sum(axis=2, dtype=np.int64).astype(object) << np.arange(len(p))[:, None].astype(object)).sum(axis=0)
        least = least.astype(object)
        shift = np.outer(least, sums)
        total += cross_products(p) + shift + shift.T + len(rows) * np.outer(least, least)
    return total


@dataclass(frozen=True)
class Fit:
    """What whitens a vector: sums and number of the fit list, components (columns) and their variances."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, in longs where they hold it, else in Python integers."""
        bound = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * self.n + max(map(abs, self.sums), default=0)
        if bound < 1 << 62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Rows on the components, over their standard deviation; null components are NaN."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (centred / self.n).astype(float) @ self.components / np.sqrt(self.variances)
        out[:, self.variances <= 0] = np.nan
        return out


def _rows(column: pa.Array, d: int) -> np.ndarray:
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d))


def add_up(vectors: DataFrame, d: int) -> np.ndarray:
    """X^T X of all rows (x array<long>) of ``d`` dimensions and one of ones, in Python integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1), object)
        held: list[np.ndarray] = []

        def take() -> None:
            nonlocal total
            x = np.concatenate(held)
            total = total + scatter(np.hstack([x, np.ones((len(x), 1), np.int64)]))
            held.clear()

        for b in batches:
            held.append(_rows(b.column(0), d))
            if sum(map(len, held)) >= BLOCK:
                take()
        if sum(map(len, held)):
            take()
        if not total[d, d]:
            return
        limbs, rest = [], total
        while len(limbs) == 0 or any(rest.flat):
            last = all(-(1 << 62) < v < 1 << 62 for v in rest.flat)
            limbs.append(rest if last else rest & ((1 << LIMB) - 1))
            rest = np.zeros_like(total) if last else rest >> LIMB
        for k, limb in enumerate(limbs):
            for i in range(d + 1):
                # A limb of up to 62 bits is sent in two, so that sums over tasks stay in a long.
                own = limb[i]
                low = [int(v) & ((1 << LIMB) - 1) for v in own]
                high = [int(v) >> LIMB for v in own]
                for shift, values in ((k, low), (k + 1, high)):
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([shift]), pa.array([values], pa.list_(pa.int64()))], names=["i", "limb", "values"])

    parts = vectors.select("x").mapInArrow(run, "i long, limb long, values array<long>")
    summed = parts.select("i", "limb", F.posexplode("values").alias("j", "v")).groupBy("i", "j", "limb").agg(F.sum("v").alias("v"))
    total = np.zeros((d + 1, d + 1), object)
    for r in summed.collect():  # (d + 1) ** 2 sums in few limbs, whatever the rows
        total[r.i, r.j] += r.v << (LIMB * r.limb)
    return total


def fit(table: np.ndarray, most: int = COMPONENTS) -> Fit:
    """Components from exact sums of products, whose last row holds the sums and the number."""
    d = len(table) - 1
    n, sums = int(table[d, d]), table[d, :d]
    centred = n * table[:d, :d] - np.outer(sums, sums)
    square = n * n
    covariance = np.array([[int(v) / square for v in row] for row in centred])
    variances, vectors = np.linalg.eigh(covariance)
    trace = sum(int(centred[i, i]) for i in range(d)) / square
    order = np.argsort(-variances, kind="stable")[:most]
    e = variances[order]
    e = np.where(e > FLAT * trace, e, 0.0)
    return Fit(n, tuple(int(s) for s in sums), vectors[:, order], e, e / trace if trace else e)


def identity_error(vectors: DataFrame, found: Fit, d: int) -> float:
    """Largest absolute entry of the covariance of whitened fit vectors minus the identity."""
    own = np.flatnonzero(found.variances > 0)
    if not len(own):
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(own) + 1,) * 2)
        for b in batches:
            w = found.whitened(found.centred(_rows(b.column(0), d)))[:, own]
            w = np.hstack([w, np.ones((len(w), 1))])
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["values"])

    parts = vectors.select("x").mapInArrow(run, "values array<double>").select(F.posexplode("values").alias("j", "v"))
    sums = {r.j: r.v for r in parts.groupBy("j").agg(F.sum("v").alias("v")).collect()}
    k = len(own) + 1
    total = np.array([sums[j] for j in range(k * k)]).reshape(k, k) / found.n
    covariance = total[:-1, :-1] - np.outer(total[-1, :-1], total[-1, :-1])
    return float(np.abs(covariance - np.eye(k - 1)).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE, most: int = MOST) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each vector and component."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding"), scale).alias("x")).filter("x is not null")
    path = new_folder(spark, "whitening")
    # Equal vectors shrink to one in each task before they are dealt, so a hot vector is a few rows.
    rows.select("x").groupBy("x").agg(F.lit(1).alias("once")).select("x").write.parquet(path)
    distinct = spark.read.parquet(path)
    lengths = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], _SCHEMA)
    d = lengths.d
    if d > most:
        raise ValueError(f"vectors have {d} dimensions; at most {most} are fitted")
    distinct = distinct.filter(F.size("x") == d)
    found = fit(add_up(distinct, d), components)
    error = identity_error(distinct, found, d)
    k = len(found.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            centred = found.centred(_rows(b.column(1), d))
            if centred.dtype != object and float(np.abs(centred).max()) < math.sqrt(2.0**62 / d):
                deviation = (centred * centred).sum(axis=1).tolist()
            else:
                deviation = [s if (s := sum(int(v) ** 2 for v in r)) < 1 << 63 else None for r in centred]
            w = found.whitened(centred)
            at = np.repeat(np.arange(b.num_rows), k)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)), pa.array(np.full(len(at), found.n)),
                    pa.array(deviation, pa.int64()).take(pa.array(at)), pa.array(w.ravel(), from_pandas=True),
                    pa.array(np.tile(found.explained, b.num_rows)), pa.array(np.full(len(at), error)),
                ],
                names=[x.split()[0] for x in _SCHEMA.split(", ")],
            )

    return rows.filter(F.size("x") == d).mapInArrow(run, _SCHEMA)
