"""WARC archives: written with an index first, read back by coalesced byte ranges.

Each task writes gzip members, one per record, to archives of bounded size in the shared folder,
and returns one index row per record: archive, offset, length, URL and digest. The index is saved
as a table before anything is read. Reading takes index rows, sorts them by archive and offset,
joins neighbouring ranges into one read, and parses the members.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalquarry.llm.common import materialise, table, text_of, work_path

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 4 << 20
GAP_BYTES = 64 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_DATE = "2024-01-01T00:00:00Z"


def open_store(path: str):
    """File system and inner path of a URI: local, HDFS, S3 or GCS as pyarrow knows them."""
    from pyarrow import fs

    if re.match(r"file:/+", path):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def header_value(v: str | None) -> str:
    """A value that fits one header line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", v or "")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """One gzip member. A revisit holds the HTTP head only, whose Content-Length is the payload's."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_value(url)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        if refers_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {header_value(refers_url)}")
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse_record(member: bytes) -> dict:
    """Headers and payload of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    page = lambda v: int(m[1]) if (m := re.search(r"urn:page:(-?\d+)>", v or "")) else None
    revisit = h["WARC-Type"] == "revisit"
    digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if not revisit and hashlib.sha1(body).hexdigest() != digest:
        raise ValueError(f"payload of {h['WARC-Record-ID']} differs from its digest")
    return {
        "page_id": page(h["WARC-Record-ID"]),
        "url": h.get("WARC-Target-URI"),
        "record_type": h["WARC-Type"],
        "refers_to": page(h.get("WARC-Refers-To")),
        "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]),
        "payload_digest": digest,
        "payload": None if revisit else body,
    }


INDEX_SCHEMA = "archive string, offset long, length long, page_id long, url string, digest string, record_type string"


def write_archives(pages: DataFrame, folder: str, *, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write every row of ``pages`` as a record under ``folder``; returns the saved index.

    Of rows with equal payloads of REVISIT_BYTES or more, that with the largest id is the response
    (rows that repeat this id are responses too, and so are rows with a null id); the others revisit
    it. Null html is an empty payload, a null URL leaves the header out. A task that is run again
    writes archives under new names; index rows name only the archives of the attempt that counted.
    """
    rows = pages.select(pages[id].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), text_of(pages[html]).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("bytes", F.octet_length("html"))
    able = (F.col("bytes") >= REVISIT_BYTES) & F.col("page_id").isNotNull()
    first = rows.where(able).groupBy("digest").agg(F.max("page_id").alias("target"), F.max_by("url", "page_id").alias("target_url"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    # Short and nameless pages revisit nothing, so no join moves them, however many are equal.
    alone = rows.where(~able).withColumns({"target": F.lit(None).cast("long"), "target_url": F.lit(None).cast("string")})
    marked = rows.where(able).join(first, "digest", "left").unionByName(alone)

    def write(batches):
        store, inner = open_store(folder)
        store.create_dir(inner, recursive=True)
        out, at, name = None, 0, ""
        for pdf in batches:
            index = []
            for digest, page_id, u, h, target, target_url in zip(pdf["digest"], pdf["page_id"], pdf["url"], pdf["html"], pdf["target"], pdf["target_url"]):
                page_id = None if pd.isna(page_id) else int(page_id)
                revisit = page_id is not None and not pd.isna(target) and int(target) != page_id
                member = record_bytes(page_id, u, h.encode(), digest, int(target) if revisit else None, target_url)
                if out is None or at + len(member) > ARCHIVE_BYTES and at:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{inner}/{name}", compression=None)
                out.write(member)
                index.append((name, at, len(member), page_id, u, digest, "revisit" if revisit else "response"))
                at += len(member)
            frame = pd.DataFrame(index, columns=["archive", "offset", "length", "page_id", "url", "digest", "record_type"])
            frame["page_id"] = frame["page_id"].astype("Int64")
            yield frame
        if out is not None:
            out.close()

    numbered = marked.select("digest", "page_id", "url", "html", "target", "target_url")
    return materialise(numbered.mapInPandas(write, INDEX_SCHEMA), "warc-index")


def coalesced(rows, *, gap: int = GAP_BYTES, most: int = READ_BYTES):
    """Runs of (archive, offset, length) in order that one read of at most about ``most`` bytes serves."""
    run = []
    for r in rows:
        if run and (r[0] != run[-1][0] or r[1] > run[-1][1] + run[-1][2] + gap or r[1] + r[2] - run[0][1] > most):
            yield run
            run = []
        run.append(r)
    if run:
        yield run


def read_records(index: DataFrame, folder: str, *, payload: bool = True) -> DataFrame:
    """The records that the index rows select; a record that its digest does not fit raises.

    ``payload=False`` checks the payloads but returns them as null.
    """
    n = max(1, -(-int(index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]) // (8 * READ_BYTES)))
    # An archive is small; its 8 MB stretches are dealt out separately.
    stretch = F.floor(F.col("offset") / F.lit(2 * READ_BYTES))
    ordered = index.select("archive", "offset", "length", stretch.alias("stretch")).repartition(n, "archive", "stretch").sortWithinPartitions("archive", "offset")

    def read(batches):
        store, inner = open_store(folder)
        name, f = None, None
        for pdf in batches:
            for run in coalesced(zip(pdf["archive"], pdf["offset"].tolist(), pdf["length"].tolist())):
                if run[0][0] != name:
                    name = run[0][0]
                    f = store.open_input_file(f"{inner}/{name}")
                start = run[0][1]
                data = f.read_at(run[-1][1] + run[-1][2] - start, start)
                found = pd.DataFrame([parse_record(data[o - start : o - start + k]) for _, o, k in run])
                for c in ("page_id", "refers_to"):
                    found[c] = found[c].astype("Int64")
                if not payload:
                    found["payload"] = None
                yield found

    return ordered.mapInPandas(read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back."""
    folder = work_path(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return read_records(index, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS target FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND target <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND target <> page_id THEN target END AS refers_to
FROM g
"""
