"""WARC archives: a deduplicating writer and a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import mark_copies
from tidemark.scratch import Scratch, parallelism

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a split, and of one read.
SPLIT = 8 << 20
CHUNK = 1 << 18
#: Reading tasks are as many as splits, up to so many for each shuffle partition.
TASKS = 32
WRITTEN = "path string, bytes long, records long"
READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def open_store(uri: str):
    """File system and path of ``uri`` (file, hdfs, s3, gs ...)."""
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member.  A revisit has the headers of its response and no payload."""
    name = "" if page_id is None else str(page_id)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}{':revisit' if revisit else ''}>",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url or f'urn:page:{name}')}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"X-Page-Id: {name}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        head[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + deflate.flush()


def write_archives(pages: DataFrame, folder: str, min_payload: int = 0) -> DataFrame:
    """Writes a record a row under ``folder`` and returns (path, bytes, records), one row an archive.

    Of rows with equal html the one with the largest page_id is the response and the others revisit it; payloads under ``min_payload`` bytes
    are all responses.  A null html is an empty payload; of rows that repeat page_id and html one is the response; a null page_id loses to any
    other; a null url becomes ``urn:page:<id>``; an empty table writes nothing.  A task that runs again writes under another name, and only what the successful
    attempt returned is listed, so the list must be kept (written), not computed twice.
    """
    html = F.coalesce("html", F.lit(""))
    plain = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"))
    marked = mark_copies(plain, F.col("html"), "page_id")
    marked = marked.select("page_id", "url", F.encode("html", "UTF-8").alias("html"), F.col("__keep").alias("keep"), ((F.col("__len") < min_payload) | F.col("__kept")).alias("response"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        out, size, n = None, 0, 0
        for frame in frames:
            for page_id, url, html, keep, response in frame.itertuples(index=False):
                data = record(None if pd.isna(page_id) else int(page_id), url, bytes(html), None if pd.isna(keep) else int(keep), not response)
                out = out or store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(data)
                size, n = size + len(data), n + 1
        if out:
            out.close()
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "bytes": [size], "records": [n]})

    return marked.mapInPandas(run, WRITTEN)


class Window:
    """Bytes of a file by position, read in chunks."""

    def __init__(self, file, size: int):
        self.file, self.size, self.base, self.data = file, size, 0, b""

    def at(self, pos: int) -> bytes:
        """Some bytes from ``pos`` on; none at the end."""
        if not self.base <= pos < self.base + len(self.data):
            self.file.seek(pos)
            self.base, self.data = pos, self.file.read(min(CHUNK, self.size - pos)) if pos < self.size else b""
        return self.data[pos - self.base :]


def member(window: Window, pos: int) -> tuple[bytes, int] | None:
    """The record whose gzip member begins at ``pos`` and where it ends; None if no record begins there.

    A candidate counts when what it inflates to begins with a WARC header.
    """
    inflate, parts, begun, first = zlib.decompressobj(31), [], False, pos
    while not inflate.eof:
        data = window.at(pos)
        if not data:
            if begun:
                raise ValueError(f"the record at byte {first} is cut off")
            return None
        try:
            parts.append(inflate.decompress(data))
        except zlib.error:
            if begun:
                raise
            return None
        pos += len(data)
        if not begun and (sum(map(len, parts)) >= 7 or inflate.eof):
            if b"".join(parts)[:7] != b"WARC/1.":
                return None
            begun = True
    return b"".join(parts), pos - len(inflate.unused_data)


def records(window: Window, start: int, end: int) -> Iterator[bytes]:
    """The records that begin in [start, end): gzip magic is looked for, candidates are checked, and a record's end is the next candidate."""
    pos = start
    while pos < end:
        data = window.at(pos)
        if len(data) < len(MAGIC) and pos + len(data) < window.size:
            window.data = b""
            data = window.at(pos)
        if not data:
            return
        found = data.find(MAGIC)
        if found < 0:
            pos += max(1, len(data) - len(MAGIC) + 1)
            continue
        pos += found
        if pos >= end:
            return
        got = member(window, pos)
        if got is None:
            pos += 1
        else:
            yield got[0]
            pos = got[1]


def parse(raw: bytes) -> tuple:
    head, _, body = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = body[: int(fields["Content-Length"])]
    payload = body.partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and base32_sha1(payload) != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    page = fields["X-Page-Id"]
    refers = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get("WARC-Refers-To", ""))
    return int(page) if page else None, fields["WARC-Target-URI"], kind, int(fields["X-Payload-Length"]), digest, int(refers[1]) if refers else None, payload if kind == "response" else None


def read_archives(archives: DataFrame, split_bytes: int = SPLIT, with_payload: bool = True) -> DataFrame:
    """The records of ``archives`` (path, bytes), read in splits of ``split_bytes``; an archive may be of any size.

    Payload digests of responses are checked; a record that is cut off or differs from its digest is an error.  A null page_id or refers_to is read as null, a null html comes back as
    the empty payload it was written as, and a url as it was written; an archive that is listed twice is read twice; an empty list gives no records; other columns are not used.
    A row here stands for a whole split, so the number of tasks follows the splits and not the bytes of these rows.
    """
    last = F.greatest(F.ceil(F.col("bytes") / split_bytes) - 1, F.lit(0)).cast("long")
    total = archives.agg(F.sum(last + 1)).first()[0] or 1
    tasks = min(total, TASKS * parallelism(archives.sparkSession))
    splits = archives.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("split")).repartition(tasks, "path", "split")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in READ.split(", ")]
        for frame in frames:
            for path, size, split in frame.itertuples(index=False):
                store, at = open_store(path)
                with store.open_input_file(at) as file:
                    rows: list[tuple] = []
                    held = 0
                    for raw in records(Window(file, size), split * split_bytes, min(size, (split + 1) * split_bytes)):
                        row = parse(raw)
                        rows.append(row if with_payload else (*row[:-1], None))
                        held += len(raw) if with_payload else 200
                        if held > SPLIT:
                            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows, held = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    return splits.mapInPandas(run, READ)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """Writes the pages as archives in the shared folder and reads them back."""
    scratch = Scratch(spark, "op9")
    archives = scratch.table(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch.path("warc")), "list")
    return read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_CODES = ",".join(f"{i:05b}" for i in range(32))
_NIBBLES = "".join(f"{i:04b}" for i in range(16))
OP9_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, sha1(h) AS x, octet_length(encode(h)) AS n, max(page_id) OVER (PARTITION BY h) AS keep FROM p),
b AS (SELECT *, array_to_string(list_transform(range(40), lambda i:
  substr('{_NIBBLES}', CAST(1 + 4 * (strpos('0123456789abcdef', substr(x, CAST(i + 1 AS INT), 1)) - 1) AS INT), 4)), '') AS bits FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (strpos('{_CODES}', substr(bits, CAST(5 * i + 1 AS INT), 5)) - 1) // 6 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM b
"""
