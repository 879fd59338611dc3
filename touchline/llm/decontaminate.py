"""Benchmark decontamination with an Aho-Corasick automaton over normalised items.

An item's windows are its runs of ``window`` consecutive words (an item of fewer
words, but not none, is one window).  The automaton holds an anchor of
``(window + 1) // 2`` words from every so many words of an item, so each window
contains one; where an anchor occurs in a document, the document's windows that
contain it are looked up among the items', each once.  So work grows with the
document's words, however often words or anchors repeat in it or in items.  Each
document is normalised to its words joined by spaces and scanned once; word
positions lead back to character offsets of the original text.

Items are cut into segments that overlap by a window less one word, and segments
dealt to blocks of about ``AUTOMATON`` windows.  Each block is a file in shared
storage; a task holds one block's automaton.  Usual benchmarks are one block and
documents go through one scan.  For more, documents are kept once with row
numbers, scanned once for each block, and hits are merged by row.

Semantics for odd input: a null or empty text has no words, hits nothing and is
clean; an item without words has no windows; repeated items count once by
item_id; items without an item_id count as one item together, which ``n_items``
counts and the digest of ids leaves out; repeated documents give a row each; an
empty benchmark leaves all documents clean; other columns are ignored.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.shared import AtomicFile, cut, new_folder, store

#: Lower-cased words: runs without the ASCII characters that aren't digits or letters.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
WINDOW = 13
#: Contaminated: some hit, and SHARE times the hit words at least all words.
SHARE = 20
#: Windows to an automaton (some 300 bytes each, as anchors and windows), and to a segment of an item.
AUTOMATON, SEGMENT = 200_000, 4096
_SPANS = pa.list_(pa.list_(pa.int64()))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.translate(_LOWER)) if text else []


def segments_of(words: list[str], window: int = WINDOW, most: int = SEGMENT) -> list[list[str]]:
    """Runs of words of at most ``most`` windows that hold each window once."""
    return [words[at : at + most + window - 1] for at in range(0, max(1, len(words) - window + 1), most)] if words else []


class Automaton:
    """Segments of benchmark items; ``scan`` finds every occurrence of a window in a document."""

    def __init__(self, segments: list[tuple[int | None, list[str]]], window: int = WINDOW):
        import ahocorasick

        self.window, self.step = window, (window + 1) // 2  # a window holds the whole anchor that begins in its first ``step`` words
        anchors: dict[str, set[int | None]] = {}  # with the items that are no longer than an anchor
        self.items: dict[str, set[int | None]] = {}  # of each window
        for item, words in segments:
            if len(words) < window:
                anchors.setdefault(" ".join(words), set()).add(item)
                continue
            for at in range(0, len(words) - self.step + 1, self.step):
                anchors.setdefault(" ".join(words[at : at + self.step]), set())
            for at in range(len(words) - window + 1):
                self.items.setdefault(" ".join(words[at : at + window]), set()).add(item)
        self.machine = ahocorasick.Automaton()
        for text, whole in anchors.items():
            self.machine.add_word(f" {text} ", (text.count(" ") + 1, whole))
        if anchors:
            self.machine.make_automaton()

    def scan(self, words: list[str]) -> tuple[list[tuple[int, int]], set[int | None]]:
        """Merged runs [first, past last) of hit words, and the items that occur."""
        runs: list[tuple[int, int]] = []
        found: set[str] = set()
        shorts: dict[int, set[int | None]] = {}
        if not len(self.machine) or not words:
            return runs, set()
        line = f" {' '.join(words)} "
        last = passed = looked = 0  # words before character `passed` of the line; windows looked up
        for end, (n, whole) in self.machine.iter(line):
            last += line.count(" ", passed + 1, end + 1)
            passed = end
            if whole:
                runs.append((last - n, last))
                shorts[id(whole)] = whole
            if n == self.step:
                past = min(last - n, len(words) - self.window) + 1
                for at in range(max(looked, last - self.window), past):
                    text = " ".join(words[at : at + self.window])
                    if text in self.items:
                        found.add(text)
                        runs.append((at, at + self.window))
                looked = max(looked, past)
        items = set().union(*(self.items[x] for x in found), *shorts.values())
        return merge(runs), items


def merge(runs: list[tuple]) -> list[tuple]:
    """Sorted runs [first, past last, ...] without overlaps; of a run's further two places the outer ones stay."""
    out: list[tuple] = []
    for run in sorted(runs):
        if out and run[0] <= out[-1][1]:
            if run[1] > out[-1][1]:
                was = out[-1]
                out[-1] = (was[0], run[1]) if len(run) == 2 else (was[0], run[1], was[2], run[3])
        else:
            out.append(tuple(run))
    return out


def write_blocks(benchmark: DataFrame, window: int = WINDOW, most: int = AUTOMATON) -> list[str]:
    """Files of segments, of about ``most`` windows each."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull())

    def cut_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                segments = segments_of(words_of(text.as_py()), window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(segments), pa.int64()), pa.array(map(" ".join, segments), pa.string()), pa.array([max(1, len(s) - window + 1) for s in segments], pa.int64())],
                    names=["item_id", "words", "windows"],
                )

    segments = cut(rows.mapInArrow(cut_items, "item_id long, words string, windows long").dropDuplicates())
    total = segments.agg(F.sum("windows")).first()[0] or 0
    blocks = -(-total // most)
    folder = new_folder(benchmark.sparkSession, "benchmark")

    def write(key: tuple, table: pa.Table) -> pa.Table:
        name = f"block-{key[0].as_py()}"
        out = AtomicFile(folder, name)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, table.schema) as writer:
            writer.write_table(table)
        out.write(sink.getvalue())
        out.commit()
        return pa.table({"file": [posixpath.join(folder, name)]})

    dealt = segments.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), F.lit(max(1, blocks))))
    return sorted(r.file for r in dealt.groupBy("block").applyInArrow(write, "file string").collect())  # a name for each block


_ALIVE: dict[tuple[str, int], Automaton] = {}


def automaton(file: str, window: int) -> Automaton:
    """A block's automaton; a Python worker keeps the last one it used."""
    if (file, window) not in _ALIVE:
        _ALIVE.clear()
        fs, path = store(file)
        with fs.open_input_file(path) as f:
            table = pa.ipc.open_file(f.read()).read_all()
        _ALIVE[file, window] = Automaton([(i, w.split(" ")) for i, w in zip(table["item_id"].to_pylist(), table["words"].to_pylist(), strict=True)], window)
    return _ALIVE[file, window]


def _hits(rows: DataFrame, files: list[str], window: int) -> DataFrame:
    """(row, spans, items) of the rows (row, text) with hits: a scan for each file, merged by row."""

    def scan_with(file: str):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = []
                for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    runs, items = automaton(file, window).scan(words_of(text))
                    if runs:
                        found.append((row, _located(text, runs), list(items)))
                row, spans, items = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.int64()))], names=["row", "spans", "items"])

        return scan

    found = None
    for file in files:
        own = rows.mapInArrow(scan_with(file), "row long, spans array<array<long>>, items array<long>")
        found = own if found is None else found.unionByName(own)
    return found.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def _sorted_ids(items) -> list[int | None]:
    return sorted(items, key=lambda i: (i is not None, i))


def find_benchmark(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = AUTOMATON) -> DataFrame:
    """(doc_id, n_words, spans, items) of every document.

    ``spans``: arrays [first word, past last word, first character, past last
    character] of merged hit runs, in the original text; ``items``: item ids found.
    """
    files = write_blocks(benchmark, window, most)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if len(files) > 1:
        rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
        rows = rows.join(_hits(rows.select("row", "text"), files, window), "row", "left").select("doc_id", "text", "spans", "items")

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans, found = [], [], []
            held = [batch.column(k).to_pylist() for k in (2, 3)] if len(files) > 1 else [[None] * batch.num_rows] * 2
            for text, own, ids in zip(batch.column(1).to_pylist(), *held, strict=True):
                words = words_of(text)
                if len(files) == 1:
                    runs, ids = automaton(files[0], window).scan(words)
                    own = _located(text, runs) if runs else []
                counts.append(len(words))
                spans.append(merge(list(map(tuple, own or ()))))
                found.append(_sorted_ids(ids or ()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(found, pa.list_(pa.int64()))],
                names=["doc_id", "n_words", "spans", "items"],
            )

    return rows.mapInArrow(report, "doc_id long, n_words long, spans array<array<long>>, items array<long>")


def _located(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    at = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
    return [(a, b, at[a][0], at[b - 1][1]) for a, b in runs]


def judge(found: DataFrame, share: int = SHARE) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated to the rows of ``find_benchmark``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "*",
        n_hit.alias("n_hit"),
        F.array_size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = AUTOMATON) -> DataFrame:
    """The documents that aren't contaminated, with their own columns; each row is judged by its own text, as by ``judge``."""
    files = write_blocks(benchmark, window, most)
    if not files:
        return documents
    if len(files) > 1:
        rows = cut(documents.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")))
        texts = rows.select("row", F.col("doc.text").alias("text"))
        n_hit = texts.join(_hits(texts, files, window), "row").select("row", "text", "spans")
        return rows.join(n_hit.mapInArrow(_bad_rows, "row long"), "row", "left_anti").select("doc.*")
    column = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for text in batch.column(column).to_pylist():
                words = words_of(text)
                n_hit = sum(b - a for a, b in automaton(files[0], window).scan(words)[0])
                keep.append(not n_hit or SHARE * n_hit < len(words))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def _bad_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row numbers of rows (row, text, spans) that are contaminated."""
    for b in batches:
        bad = []
        for row, text, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if SHARE * sum(s[1] - s[0] for s in merge(list(map(tuple, spans)))) >= len(words_of(text)):
                bad.append(row)
        yield pa.RecordBatch.from_arrays([pa.array(bad, pa.int64())], names=["row"])
