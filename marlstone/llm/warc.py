"""WARC archives: deterministic sharded writer and reader.

Records are range-sorted by page and written by one task per range. The ranges follow
from the rows alone, a file is rolled when its compressed size reaches a limit, and
ids, dates and digests of headers follow from the record, so another run or
partitioning of the input writes the same bytes. A task writes under a temporary name and renames; the manifest, written last, names the
files that count, so leftovers of lost tasks are never read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_path, table, tidy, tune
from .ranges import bounds, in_ranges

#: Compressed bytes after which a file is closed; the record at the limit is still in it.
ROLL_BYTES = 32 << 20
#: Payloads below this many bytes are always written whole.
LEAST_REVISIT = 1000
#: Bytes of payloads of one range of pages.
PART_BYTES = 32 << 20
DATE = "2000-01-01T00:00:00Z"


def file_system(uri: str):
    """The file system and path of a shared folder; a bare path is local."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def record(page: int | None, url: str | None, payload: bytes, length: int, digest: str, refers: int | None, original_url: str | None) -> bytes:
    """One WARC record; a revisit has no payload but tells its length."""
    kind = "response" if refers is None else "revisit"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page}:{url}:{digest}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-Id: {'' if page is None else page}",
        f"X-Payload-Length: {length}",
    ]
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {clean(original_url)}", f"X-Refers-To-Page: {refers}"]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha1:{hashlib.sha1(body).hexdigest()}", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def clean(url: str | None) -> str:
    """A target that keeps to one header line."""
    return "".join(c if c.isprintable() and c != " " else "%%%02X" % ord(c) for c in url or "")


def member(data: bytes) -> bytes:
    """A gzip member of its own, the same for the same bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def payloads(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, payload_bytes, payload_digest``; a null html is an empty payload."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha1("html"))


def revisits(rows: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, payload_digest, refers_to, original_url`` of pages that refer to another.

    Of equal payloads of ``least`` bytes or more the one with the largest page_id
    stands, the others refer to it; null ids come last, and of rows that repeat the
    standing id each stands. Payloads travel as digests. Digests with a thousandth of
    the rows each, 1000 at most, are broadcast; the others meet in a shuffle.
    """
    keys = rows.where(F.col("payload_bytes") >= least).select("page_id", "url", "payload_digest")
    twice = keys.groupBy("payload_digest").agg(F.max(F.struct("page_id", "url")).alias("o"), F.count("*").alias("n")).where("n > 1 and o.page_id is not null")
    twice, total = cut(twice, "warc-twice"), rows.count()
    heavy = F.col("n") * 1000 > total
    mixed = keys.select("page_id", "payload_digest").join(F.broadcast(twice.where(heavy)), "payload_digest", "left")
    light = mixed.where("n is null").select("page_id", "payload_digest").join(twice.where(~heavy).hint("shuffle_merge"), "payload_digest")
    met = mixed.where("n is not null").union(light.select(mixed.columns)).where(~F.col("page_id").eqNullSafe(F.col("o.page_id")))
    return met.select("page_id", "payload_digest", F.col("o.page_id").alias("refers_to"), F.col("o.url").alias("original_url")).distinct()


def _writer(root: str, roll: int):
    def run(batches):
        fs, at = file_system(root)
        fs.create_dir(at, recursive=True)
        attempt, part = TaskContext.get().taskAttemptId(), None
        out, n, done, told = None, 0, [], (None, None)

        def close():
            nonlocal out, n
            stream, temp, size, count, crc = out
            stream.close()
            name = f"part-{part:06d}-{n:05d}.warc.gz"
            fs.move(temp, f"{at}/{name}")
            done.append((part, n, name, size, count, crc))
            out, n = None, n + 1

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("part", "page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to", "original_url")]
            for at_part, page, url, html, length, digest, refers, original in zip(*cols, strict=True):
                if at_part != part:
                    if out is not None:
                        close()
                    part, n = at_part, 0
                if html is None:  # what is known of the pages that follow
                    told = (page, digest), (refers, original)
                    continue
                refers, original = told[1] if told[0] == (page, digest) else (None, None)
                data = member(record(page, url, html.encode() if refers is None else b"", length, digest, refers, original))
                if out is None:
                    temp = f"{at}/.part-{part:06d}-{n:05d}-{attempt}.tmp"
                    out = [fs.open_output_stream(temp, compression=None), temp, 0, 0, 0]
                out[0].write(data)
                out[2:] = [out[2] + len(data), out[3] + 1, zlib.crc32(data, out[4])]
                if out[2] >= roll:
                    close()
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["part", "roll", "file", "bytes", "records", "crc32"])

    return run


def write_warc(pages: DataFrame, root: str, roll: int = ROLL_BYTES, least: int = LEAST_REVISIT, part_bytes: int = PART_BYTES) -> str:
    """Write ``pages`` (page_id, url, html) as archives under ``root``; gives the manifest's path.

    Pages without an id come first. An empty table gives a manifest without files.
    Other columns are not read.
    """
    tune(pages.sparkSession)
    rows = payloads(pages)
    digests = cut(rows.drop("html"), "warc-digests")
    known = revisits(digests, least).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), F.lit(None).cast("long").alias("payload_bytes"), "payload_digest", "refers_to", "original_url")
    both = rows.withColumns({"refers_to": F.lit(None).cast("long"), "original_url": F.lit(None).cast("string")}).unionByName(known)
    # a page and what is known of it meet in one range; payloads are shuffled once
    tie = F.xxhash64("payload_digest")
    at = bounds(digests.withColumn("tie", tie), "page_id", "tie", "payload_bytes", part_bytes)
    ordered = in_ranges(both.withColumn("tie", tie), "page_id", "tie", at, "part").sortWithinPartitions("part", "page_id", "tie", "payload_digest", F.col("html").isNotNull(), "url")
    files = ordered.drop("tie").mapInArrow(tidy(_writer(root, roll)), "part long, roll long, file string, bytes long, records long, crc32 long")
    # one row per file; a file holds tens of megabytes
    rows = sorted(files.collect(), key=lambda r: (r.part, r.roll))
    fs, at = file_system(root)
    fs.create_dir(at, recursive=True)
    temp, final = f"{at}/.manifest.tmp", f"{at}/manifest.json"
    with fs.open_output_stream(temp) as f:
        f.write(json.dumps([{k: r[k] for k in ("file", "bytes", "records", "crc32")} for r in rows]).encode())
    fs.move(temp, final)
    return final


def records(stream):
    """Headers and block of each record of a stream of gzip members, one at a time."""
    pending, z, data = b"", zlib.decompressobj(31), []
    while chunk := pending or stream.read(1 << 20):
        pending = b""
        data.append(z.decompress(chunk))
        if z.eof:
            head, _, rest = b"".join(data).partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            body = rest[: int(fields["Content-Length"])]
            if hashlib.sha1(body).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha1:"):
                raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
            yield fields, body
            pending, z, data = z.unused_data, zlib.decompressobj(31), []
    if any(data):
        raise ValueError("archive ends within a record")


def read_warc(spark: SparkSession, root: str) -> DataFrame:
    """``page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload`` of the manifest's files.

    A response's length and digest are taken from its payload again; a revisit's
    are those of its header, and its payload is null.
    """
    fs, at = file_system(root)
    with fs.open_input_stream(f"{at}/manifest.json") as f:
        files = json.loads(f.read())
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"

    def run(batches):
        fs, at = file_system(root)
        for b in batches:
            for name in b.column("file").to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{at}/{name}", compression=None) as stream:
                    for head, body in records(stream):
                        payload = body.partition(b"\r\n\r\n")[2]
                        own = head["WARC-Type"] == "response"
                        rows.append((
                            int(head["X-Page-Id"]) if head["X-Page-Id"] else None,
                            head["WARC-Target-URI"],
                            head["WARC-Type"],
                            len(payload) if own else int(head["X-Payload-Length"]),
                            hashlib.sha1(payload).hexdigest() if own else head["WARC-Payload-Digest"].removeprefix("sha1:"),
                            None if own else int(head["X-Refers-To-Page"]),
                            payload if own else None,
                        ))
                        size += len(payload)
                        if size >= 4 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    listed = spark.createDataFrame([(f["file"],) for f in files], "file string").repartition(max(1, len(files)))
    return listed.mapInArrow(tidy(run), schema)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives hold of every page.

    A null html is an empty payload; very long ones are records of their own file. Of equal
    payloads the largest id responds, the others revisit it; a null id is less than
    any. Repeated ids keep a record each. An empty table gives no rows.
    """
    root = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), root)
    return read_warc(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
    CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
"""

QUERIES = {"op8_warc": op8_warc}
ORACLES = {"op8_warc": SQL}
