"""WARC archives, index first.

Writing gives one ``.warc.gz`` file for each task, a gzip member for each record,
and an index row for each record: file, offset, length, URL and digest.  A file
belongs to one attempt of a task and its index rows name it, so a lost or
repeated attempt leaves a file that no row points to; records lie in a fixed
order, so an attempt writes the same bytes again.  Reading takes any selection
of index rows, deals it to tasks by bytes (runs of ``TASK`` bytes of a file),
sorts each task's rows by file and offset and joins neighbouring byte ranges
into large reads.

Records with equal payloads of at least ``min_bytes``: that with the largest
page_id is the response, the others are revisits that refer to it.

Semantics for odd input: a null payload is empty, a null URL is the empty URL; a
null page_id ranks below all others; rows that repeat page_id and payload are
alike (all responses, if theirs is the largest page_id); an empty table gives no
files; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.shared import AtomicFile, cut, new_folder, store

DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_INDEX = "page_id long, file string, offset long, length long, url string, digest string"
#: Ranges at most so far apart are read at once, up to so many bytes.
GAP, READ = 64 << 10, 4 << 20
#: Bytes of records that one task reads back.
TASK = 16 << 20


def _fields(headers: dict[str, str]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode()


def _one_line(url: str | None) -> str:
    return " ".join((url or "").split())


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit (headers only) where ``refers_to`` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": _one_line(url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if page_id is not None:
        headers["X-Page-ID"] = str(page_id)
    if refers_to is not None:
        headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        headers["WARC-Refers-To"] = record_id(refers_to, digest)
        headers["X-Refers-To-Page-ID"] = str(refers_to)
    return b"WARC/1.1\r\n" + _fields(headers) + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(record headers, HTTP headers, payload) of one record."""
    head, rest = data.split(b"\r\n\r\n", 1)
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    headers = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, payload = block.split(b"\r\n\r\n", 1)
    return headers, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write all pages; the index (page_id, file, offset, length, url, digest)."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1("html"))
    # Only the keys of groups are shuffled to find responses; the hot digests' rows are
    # split by the skew join, as the other side has one row for each digest.
    first = rows.groupBy("sha").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    refers = F.when((F.octet_length("html") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id"))
    joined = rows.join(first, "sha", "left").select("page_id", "url", "html", "sha", refers.alias("refers_to"))
    joined = joined.sortWithinPartitions("sha", "page_id", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        for b in batches:
            if out is None and b.num_rows:
                out = AtomicFile(folder, name)
            ids, urls, refs = (b.column(c).to_pylist() for c in ("page_id", "url", "refers_to"))
            offsets, lengths, digests = [], [], []
            for i, url, html, sha, ref in zip(ids, urls, b.column("html"), b.column("sha").to_pylist(), refs, strict=True):
                payload = html.as_buffer().to_pybytes()
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = packer.compress(make_record(i, url, payload, digest, ref)) + packer.flush()
                offsets.append(out.write(data))
                lengths.append(len(data))
                digests.append(digest)
            yield pa.RecordBatch.from_pydict({
                "page_id": pa.array(ids, pa.int64()), "file": pa.array([f"{folder}/{name}"] * len(ids), pa.string()), "offset": pa.array(offsets, pa.int64()),
                "length": pa.array(lengths, pa.int64()), "url": pa.array(urls, pa.string()), "digest": pa.array(digests, pa.string()),
            })
        if out is not None:
            out.commit()

    return cut(joined.mapInArrow(write, _INDEX))


def ranges(offsets: np.ndarray, lengths: np.ndarray, gap: int = GAP, most: int = READ) -> list[tuple[int, int]]:
    """(first, past last) of runs of sorted records that are read at once."""
    out, at = [], 0
    while at < len(offsets):
        end, start = at + 1, offsets[at]
        while end < len(offsets) and offsets[end] - (offsets[end - 1] + lengths[end - 1]) <= gap and offsets[end] + lengths[end] - start <= most:
            end += 1
        out.append((at, end))
        at = end
    return out


def read_records(index: DataFrame) -> DataFrame:
    """Records of any selection of index rows.

    (page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload);
    the payload of a revisit is null.  A response whose payload doesn't have its
    recorded digest or length fails the job.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for b in batches:
            files = b.column("file").to_pylist()
            off, size = (b.column(c).to_numpy(zero_copy_only=False) for c in ("offset", "length"))
            new = [0, *(i for i in range(1, len(files)) if files[i] != files[i - 1]), len(files)]
            for lo, hi in zip(new[:-1], new[1:], strict=True):
                if lo == hi:
                    continue
                if files[lo] != name:
                    if f is not None:
                        f.close()
                    name = files[lo]
                    fs, path = store(name)
                    f = fs.open_input_file(path)
                for i, j in ranges(off[lo:hi], size[lo:hi]):
                    i, j = lo + i, lo + j
                    f.seek(int(off[i]))
                    data = memoryview(f.read(int(off[j - 1] + size[j - 1] - off[i])))
                    rows = []
                    for k in range(i, j):
                        at = int(off[k] - off[i])
                        headers, http, payload = parse_record(zlib.decompress(data[at : at + int(size[k])], 31))
                        revisit = headers["WARC-Type"] == "revisit"
                        digest, n = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
                        if not revisit and (len(payload) != n or base32_sha1(payload) != digest):
                            raise ValueError(f"a payload is damaged: {name} at {off[k]}")
                        refers, page = headers.get("X-Refers-To-Page-ID"), headers.get("X-Page-ID")
                        rows.append((page and int(page), headers["WARC-Target-URI"], headers["WARC-Type"], refers and int(refers), digest, n, None if revisit else payload))
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                        names=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"],
                    )
        if f is not None:
            f.close()

    rows = index.select("file", "offset", "length")
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-(rows.agg(F.sum("length")).first()[0] or 0) // TASK))
    dealt = rows.repartition(tasks, "file", F.floor(F.col("offset") / TASK)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")
