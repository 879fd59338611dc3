"""Quality classifier on supervised subword embeddings.

A document's features are its lower-cased words and word pairs and its character
n-grams, hashed to a table of learned vectors.  Their average goes through a
softmax layer; vectors and layer are trained by stochastic gradient descent in
numpy.  As the document vector is an average and the layer is linear, a trained
model is folded to one number for each table row, and a document is scored by
averaging numbers: whole texts, in one pass, on executors.

The training sample is bounded in rows: of the documents that have a label, the
first ``max_train_rows`` in the order of a hash-random key, whole texts of any
length.  Tasks write their hashed feature counts to files in shared storage, a
record for each document, and training reads the records of a batch at a time, so
the driver holds the model and a batch.  Class shares of the sample are kept.

Semantics for odd input: a null or empty text has one feature of its own, so it
gets a score too; without labelled rows every score is 0.5; rows of one doc_id
with different texts or labels all train, equal rows once; repeated documents get
a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm import text_hash
from touchline.llm.shared import AtomicFile, cut, new_folder, store

_U = np.uint64
#: Steps of the layer and of vectors against that of the bias: a share of a text is small, so vectors take long steps.
LAYER_STEP, VECTOR_STEP = 4, 64
#: Bytes of text whose features are worked out together; each byte takes some 200 in passing.
RUN = 1 << 18


@dataclass(frozen=True)
class Settings:
    table_bits: int = 16
    dimension: int = 8
    char_grams: tuple[int, ...] = (3, 5)
    max_train_rows: int = 4000
    epochs: int = 6
    rate: float = 0.5
    batch: int = 16
    seed: int = 11


def features(data: np.ndarray, offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(table rows of all features, the document of each) of a run of texts."""
    rows = np.arange(len(offsets) - 1)
    h, at, _, _ = text_hash.words(data, offsets)
    ids, docs = [h], [np.repeat(rows, np.diff(at))]
    if len(h) > 1:
        pair = text_hash.grams(h, 2)
        ok = docs[0][1:] == docs[0][:-1]
        ids.append(pair[ok])
        docs.append(docs[0][1:][ok])
    letters, starts = text_hash.characters(data)
    owner = np.repeat(rows, np.diff(offsets))[starts]
    for n in s.char_grams:
        if len(letters) >= n:
            ok = owner[n - 1 :] == owner[: len(owner) - n + 1]
            ids.append(text_hash.grams(letters, n)[ok])
            docs.append(owner[n - 1 :][ok])
    every = np.full(len(rows), 0x9E3779B97F4A7C15, dtype=np.uint64)  # the feature of each text
    ids, docs = np.concatenate([*ids, every]), np.concatenate([*docs, rows])
    return (ids >> _U(64 - s.table_bits)).astype(np.int64), docs


class Samples(Sequence):
    """Labelled documents' (label, table rows, shares of the features), read from files when they are asked for."""

    def __init__(self, records: list[tuple[int, str, int]], s: Settings):
        self.records, self.kind = records, np.uint16 if s.table_bits <= 16 else np.uint32
        self.files: dict[str, pa.ipc.RecordBatchFileReader] = {}

    def __len__(self) -> int:
        return len(self.records)

    def __getitem__(self, i: int) -> tuple[int, np.ndarray, np.ndarray]:
        label, file, part = self.records[i]
        if file not in self.files:
            fs, path = store(file)
            self.files[file] = pa.ipc.open_file(fs.open_input_file(path))
        ids, counts = (unpack(c[0]) for c in self.files[file].get_batch(part).columns)
        return label, ids.astype(self.kind), (counts / counts.sum()).astype(np.float32)


def train(samples: Sequence[tuple[int, np.ndarray, np.ndarray]], s: Settings) -> np.ndarray:
    """Folded model: the score's part of each table row, and the bias last.

    ``samples``: (label, table rows, shares of the features).  Gradients are averaged over small
    batches; the rate falls linearly to zero.
    """
    rng = np.random.default_rng(s.seed)
    size = 1 << s.table_bits
    vectors = rng.uniform(-1, 1, (size, s.dimension)).astype(np.float32) / s.dimension
    layer, bias = np.zeros((s.dimension, 2), np.float32), np.zeros(2, np.float32)
    steps, step = s.epochs * -(-len(samples) // s.batch), 0
    for _ in range(s.epochs):
        order = rng.permutation(len(samples))
        for i in range(0, len(order), s.batch):
            descend(vectors, layer, bias, [samples[j] for j in order[i : i + s.batch]], s.rate * (1 - step / steps))
            step += 1
    folded = vectors @ (layer[:, 1] - layer[:, 0])
    return np.append(folded, bias[1] - bias[0]).astype(np.float32)


def descend(vectors: np.ndarray, layer: np.ndarray, bias: np.ndarray, part: list[tuple[int, np.ndarray, np.ndarray]], rate: float) -> None:
    """One step of gradient descent on a batch of samples, in place."""
    at, w = (np.concatenate([x[k] for x in part]) for k in (1, 2))
    counts = [len(x[2]) for x in part]
    hidden = np.add.reduceat(vectors[at] * w[:, None], np.cumsum([0, *counts[:-1]]), axis=0)
    p = _softmax(hidden @ layer + bias)
    p[np.arange(len(part)), [x[0] for x in part]] -= 1
    back = np.repeat(p @ layer.T, counts, axis=0)
    layer -= rate * LAYER_STEP * (hidden.T @ p) / len(part)
    bias -= rate * p.mean(axis=0)
    np.add.at(vectors, at, -rate * VECTOR_STEP * w[:, None] * back)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", usable: Column | None = None, s: Settings | None = None) -> np.ndarray:
    """A folded model of the labelled documents for which ``usable`` holds, a condition on the column ``id``."""
    s = s or Settings()
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label"))
    known = known.withColumn("key", F.xxhash64("id", F.lit(s.seed)))
    known = known.filter(usable if usable is not None else F.lit(True)).distinct()
    # a row's place in the sample; only rows of labels that have a document take one
    place = ("key", "doc_id", "label", "text_hash")
    texts = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    drawn = texts.join(known, F.col("doc_id") == F.col("id")).select(*place).distinct().orderBy(*place).limit(s.max_train_rows)
    drawn = cut(drawn)  # of bounded size
    rows = texts.join(F.broadcast(drawn), ["doc_id", "text_hash"]).dropDuplicates(place).select("key", "doc_id", "label", "text_hash", "text")
    folder = new_folder(documents.sparkSession, "features")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = writer = None
        name, parts = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.arrow", 0
        places: list[pa.RecordBatch] = []
        for b in batches:
            for i in range(b.num_rows):
                record = pa.record_batch([pa.array([x], pa.binary()) for x in _counted(b.column(4).slice(i, 1), s)], names=["ids", "counts"])
                if writer is None:
                    out = AtomicFile(folder, name)
                    writer = pa.ipc.new_file(out.out, record.schema)
                writer.write_batch(record)
            number = pa.array(np.arange(parts, parts + b.num_rows))
            places.append(pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([f"{folder}/{name}"] * b.num_rows), number], names=[*place, "file", "part"]))
            parts += b.num_rows
        if writer is not None:
            writer.close()
            out.commit()
        yield from places

    written = rows.mapInArrow(write, "key long, doc_id long, label int, text_hash long, file string, part long").orderBy(*place).collect()  # bounded, too
    if not written:
        return np.zeros((1 << s.table_bits) + 1, np.float32)
    return train(Samples([(r.label, r.file, r.part) for r in written], s), s)


def _counted(text: pa.Array, s: Settings) -> tuple[bytes, bytes]:
    """The packed table rows of a text's features and how often each occurs."""
    (_, data, offsets), = text_hash.slices(text, RUN)
    ids, counts = np.unique(features(data, offsets, s)[0], return_counts=True)
    return pack(ids), pack(counts)


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers in four bytes, compressed behind their number."""
    return len(numbers).to_bytes(4, "little") + pa.compress(numbers.astype("<u4").tobytes(), "zstd", asbytes=True)


def unpack(data: pa.Scalar) -> np.ndarray:
    data = data.as_py()
    return np.frombuffer(pa.decompress(data[4:], 4 * int.from_bytes(data[:4], "little"), "zstd"), "<u4")


def score(documents: DataFrame, model: np.ndarray, s: Settings | None = None) -> DataFrame:
    """(doc_id, score) of every document; the model has a fixed size."""
    s = s or Settings()
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = sent.value.astype(np.float64)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(b.column(1), part, s), pa.float64())], names=["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def _scores(texts: pa.Array, part: np.ndarray, s: Settings) -> np.ndarray:
    out = [np.zeros(0)]
    for _, data, offsets in text_hash.slices(texts, RUN):
        ids, docs = features(data, offsets, s)
        n = len(offsets) - 1
        mean = np.bincount(docs, part[ids], n) / np.bincount(docs, minlength=n)
        out.append(1 / (1 + np.exp(-(mean + part[-1]))))
    return np.concatenate(out)


def held_out(column: str = "doc_id", of: int = 5) -> Column:
    """Whether a row is kept out of learning: crc32 of the id as text is a multiple of ``of``."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % of == 0


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, s: Settings | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learned from labelled rows that aren't held out."""
    model = fit(documents, labels, usable=~held_out("id"), s=s)
    scored = score(documents, model, s)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_rejected(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, s: Settings | None = None) -> DataFrame:
    """The documents that are not rejected, with their own columns; each row is judged by its own text."""
    s = s or Settings()
    sent = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, usable=~held_out("id"), s=s))
    text = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = sent.value.astype(np.float64)
        for b in batches:
            yield b.filter(pa.array(~(_scores(b.column(text), part, s) < threshold)))

    return documents.mapInArrow(run, documents.schema)
