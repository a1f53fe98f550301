"""WARC archives with an index first: one gzip member a record, one index row (offset, length, URL, digest) a record.

Tasks write their rows as archives of their own and return index rows; the index is stored before anything is read.
Reading deals the selected index rows by file and offset, joins neighbouring ranges and reads each joined range once.
A file's name holds the attempt that wrote it, so a task that runs again leaves nothing that the index refers to.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import fresh_path, stored

FILE_BYTES = 1 << 30
GAP_BYTES = 1 << 16
RANGE_BYTES = 8 << 20
SALTS = 32  # tasks over which the rows of one payload are dealt
LEAST_BYTES = 100
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
INDEX = "page_id bigint, url string, file string, offset bigint, length bigint, payload_digest string"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisits: int | None, date: str) -> bytes:
    """One record; a revisit has the payload's length and digest but not the payload."""
    uri = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "about:blank")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if revisits is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if revisits is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisits is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(revisits)}", f"X-Refers-To-Page-ID: {revisits}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """A record's fields and payload (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")).split(": ")[1])
    return {"type": fields["WARC-Type"], "url": fields["WARC-Target-URI"], "digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "refers_to": int(x) if (x := fields.get("X-Refers-To-Page-ID")) else None, "payload": payload if fields["WARC-Type"] == "response" else None, "payload_bytes": full}


def _store(root: str):
    """A file system and the folder in it; local paths and file:// go to the shared mount, others to pyarrow's stores."""
    from pyarrow import fs

    if "://" in root or root.startswith("file:"):
        if root.startswith("file:"):
            return fs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/")
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


def write(pages: DataFrame, root: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z", level: int = 1) -> tuple[DataFrame, str]:
    """Writes one record a row under `root` and returns (stored index, root).

    Of rows with equal payloads of LEAST_BYTES or more, those of the smallest page_id (null last) are responses, the
    others revisit it; null html is an empty payload. Repeated payloads are found from digests and page_ids alone, counted
    by digest and salt first, and marks (digest, salt, first) go back to the rows: broadcast where Spark's own limit on
    their size allows it, else by a join in which the rows of one payload are dealt over SALTS keys.
    """
    spark = pages.sparkSession
    root = root or fresh_path(spark, "warc")
    d = pages.select(F.col(f"`{page_id}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    d = d.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    dealt = d.filter(F.octet_length("html") >= LEAST_BYTES).groupBy("digest", "salt").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    every = Window.partitionBy("digest")  # SALTS rows at most
    marks = dealt.select("digest", "salt", F.min("first").over(every).alias("first"), F.sum("n").over(every).alias("n")).filter("n > 1").drop("n")
    d = d.join(stored(marks, "warc-marks"), ["digest", "salt"], "left")
    d = d.withColumn("revisits", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).select("page_id", "url", "html", "digest", "revisits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _store(root)
        fs.create_dir(folder, recursive=True)
        task = TaskContext.get()
        name, out, size, part = "", None, 0, 0
        try:
            for batch in batches:
                index: dict[str, list] = {k.split()[0]: [] for k in INDEX.split(", ")}
                for lo in range(0, batch.num_rows, 64):
                    rows = batch.slice(lo, 64).to_pydict()
                    for pid, uri, text, digest, back in zip(rows["page_id"], rows["url"], rows["html"], rows["digest"], rows["revisits"]):
                        if out is None or size >= FILE_BYTES:
                            if out:
                                out.close()
                            name, size, part = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{part}.warc.gz", 0, part + 1
                            out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                        raw = gzip.compress(record(pid, uri, text.encode("utf-8", "replace"), digest, back, date), level, mtime=0)
                        out.write(raw)
                        for k, v in zip(index, (pid, uri, name, size, len(raw), digest)):
                            index[k].append(v)
                        size += len(raw)
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string() if k in ("url", "file", "payload_digest") else pa.int64()) for k, v in index.items()})
        finally:
            if out:
                out.close()

    return stored(d.mapInArrow(run, INDEX), "warc-index"), root


def ranges(rows: list[tuple[str, int, int]], gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> list[tuple[str, int, int, list[int]]]:
    """Joined byte ranges (file, start, end, rows) of rows sorted by file and offset."""
    out: list[tuple[str, int, int, list[int]]] = []
    for i, (file, start, length) in enumerate(rows):
        if out and out[-1][0] == file and start - out[-1][2] <= gap and start + length - out[-1][1] <= most:
            f, s, e, own = out[-1]
            own.append(i)
            out[-1] = (f, s, max(e, start + length), own)
        else:
            out.append((file, start, start + length, [i]))
    return out


def read(index: DataFrame, root: str, payloads: bool = False) -> DataFrame:
    """The indexed records: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload).

    A response's digest is computed from the payload that was read and must equal the index's, else the task fails.
    """
    spark = index.sparkSession
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // (64 << 20)))
    d = index.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _store(root)
        for batch in batches:
            rows = batch.to_pydict()
            for file, start, end, own in ranges(list(zip(rows["file"], rows["offset"], rows["length"]))):
                with fs.open_input_file(f"{folder}/{file}") as f:
                    f.seek(start)
                    raw = f.read(end - start)
                out: dict[str, list] = {k.split()[0]: [] for k in schema.split(", ")}
                for i in own:
                    at = rows["offset"][i] - start
                    r = parsed(gzip.decompress(raw[at : at + rows["length"][i]]))
                    digest = hashlib.sha256(r["payload"]).hexdigest() if r["payload"] is not None else r["digest"]
                    if digest != rows["payload_digest"][i]:
                        raise ValueError(f"record at {file}:{rows['offset'][i]} doesn't match its index row")
                    for k, v in zip(out, (rows["page_id"][i], rows["url"][i], r["payload_bytes"], digest, r["type"], r["refers_to"], r["payload"])):
                        out[k].append(v)
                kinds = {"url": pa.string(), "payload_digest": pa.string(), "record_type": pa.string(), "payload": pa.binary()}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    return d.mapInArrow(run, schema)
