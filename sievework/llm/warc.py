"""WARC archives as a chunked record table.

An archive is a table of rows ``(record_id, chunk_no, data, running_bytes, running_sha256)``. Chunk 0 is
the WARC header block, the middle chunks are pieces of the payload of at most ``CHUNK_BYTES``, the last
chunk is the record's closing CRLF CRLF. Written in the order of (record_id, chunk_no), the chunks' bytes
are a WARC/1.1 file. Every payload chunk carries the count and SHA-256 of the payload up to and including
it, so a reader can check a record piece by piece and never holds a whole one.

Payloads are not shuffled to be written. A first scan keeps the size and digest of each record; the digests that occur
twice, with the record that is their response, meet the second scan in a join (broadcast up to a counted bound, beyond
which it has to shuffle), and chunks are cut where the payload was read. A payload is digested and cut in place: Spark holds a
string as UTF-8, so its bytes are the string's own, and no second copy of a whole record is made.

Defined cases: a null payload is empty; payloads below ``MIN_DEDUP_BYTES`` are always responses; of equal
longer ones the first by page_id (nulls last), then url (nulls first), is the response, the others are revisits, also
where they share its page_id (a revisit keeps its payload chunks out of the archive and carries its length and digest
in its header); rows equal in page_id, url and payload are the same in this too; repeated page_ids give records of their own (a record's id is ``page_id/serial``, the serial being
unique in its archive); extra columns are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators.bounded import at_most
from sievework.session import bound_batches, new_path, stored, table, written

CHUNK_BYTES = 64 * 1024
MIN_DEDUP_BYTES = 100
#: Up to this many repeated digests are broadcast (about 150 bytes each), more are joined by a shuffle.
BROADCAST_DIGESTS = 200_000
CRLF = b"\r\n"

CHUNKS = "record_id string, chunk_no long, data binary, running_bytes long, running_sha256 string"


def classify(pages: DataFrame) -> DataFrame:
    """Adds payload, its size and digest, and what the record is: response or revisit of which page."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    p = pages.select("page_id", "url", payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")
    )
    order = F.struct(F.col("page_id").isNull().alias("last"), F.col("page_id").alias("id"), F.col("url").alias("url"))
    known = p.where(F.col("payload_bytes") >= MIN_DEDUP_BYTES)
    first = known.groupBy("payload_digest", "payload_bytes").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = stored(first, "repeated")
    side = F.broadcast(first) if at_most(first, BROADCAST_DIGESTS) else first
    joined = p.join(side, ["payload_digest", "payload_bytes"], "left")
    own = F.col("page_id").eqNullSafe(F.col("first.id")) & F.col("url").eqNullSafe(F.col("first.url"))
    revisit = F.col("first").isNotNull() & ~own
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first.id")).alias("refers_to"),
    )


def _header(c: dict[str, Column]) -> Column:
    """The header block as bytes; line breaks in a URL would end a header, so they are percent-encoded."""
    url = F.replace(F.replace(F.coalesce(c["url"], F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), c["record_type"]),
        F.concat(F.lit("WARC-Record-ID: <urn:sievework:page:"), c["key"], F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), c["payload_digest"]),
        F.concat(F.lit("WARC-Payload-Length: "), c["payload_bytes"].cast("string")),
        F.concat(F.lit("WARC-Refers-To: <urn:sievework:page:"), c["refers_to"].cast("string"), F.lit(">")),
        F.lit("Content-Type: application/octet-stream"),
        F.concat(F.lit("Content-Length: "), F.when(c["record_type"] == "revisit", F.lit("0")).otherwise(c["payload_bytes"].cast("string"))),
        F.lit("\r\n"),
    ]
    return F.encode(F.concat_ws("\r\n", *lines), "UTF-8")


def to_chunks(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows, cut by the JVM before any Python sees them; running digests are added in one pass."""
    key = F.concat_ws("/", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.monotonically_increasing_id().cast("string"))
    cols = {k: F.col(k) for k in ("url", "record_type", "payload_digest", "payload_bytes", "refers_to", "key")}
    r = records.withColumn("key", key).withColumn("header", _header(cols))
    body = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("payload_bytes"))
    n = F.ceil(body / chunk_bytes)
    cut = r.select(
        "page_id", F.col("key").alias("record_id"), "header", "payload", n.alias("n"),
        F.explode(F.sequence(F.lit(0).cast("long"), n + 1)).alias("chunk_no"),
    )
    at = ((F.col("chunk_no") - 1) * chunk_bytes + 1).cast("int")
    data = (
        F.when(F.col("chunk_no") == 0, F.col("header"))
        .when(F.col("chunk_no") > F.col("n"), F.lit(CRLF * 2))
        .otherwise(F.substring(F.col("payload"), at, F.lit(chunk_bytes)))
    )
    bound_batches(records.sparkSession)
    rows = cut.select("record_id", "chunk_no", data.alias("data"), (F.col("chunk_no").between(F.lit(1), F.col("n"))).alias("is_body"))
    return rows.mapInArrow(_running, CHUNKS)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and digests over the payload so far; a record's chunks follow one another in a partition."""
    size, digest = 0, hashlib.sha256()
    for b in batches:
        sizes, digests = [], []
        for no, data, is_body in zip(b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
            if no == 0:
                size, digest = 0, hashlib.sha256()
            if is_body:
                piece = data.as_buffer()
                size += piece.size
                digest.update(piece)
            sizes.append(size)
            digests.append(digest.copy().hexdigest())
        yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=["record_id", "chunk_no", "data", "running_bytes", "running_sha256"])


def write_archive(records: DataFrame, path: str) -> None:
    """Chunk rows through Spark's writer, whose commit survives lost tasks."""
    written(to_chunks(records), path, compression="zstd")


READ = "record_id string, warc_type string, url string, refers_to string, payload_bytes long, payload_digest string, stated_digest string, intact boolean"


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, made by streaming its chunks in order: digests grow chunk by chunk.

    Chunks are dealt by record and sorted, so a reader holds one chunk at a time; ``intact`` is false where
    a running digest, a count or the header's digest differs from what was read.
    """
    bound_batches(spark)
    chunks = spark.read.schema(CHUNKS).parquet(path)
    return chunks.repartition("record_id").sortWithinPartitions("record_id", "chunk_no").mapInArrow(_records, READ)


def parse_header(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC header: {lines[0][:40]!r}")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:] if x)}


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state: dict | None = None

    def closed(s: dict) -> dict:
        head = s["head"]
        stated = head["warc-payload-digest"].removeprefix("sha256:")
        revisit = head["warc-type"] == "revisit"
        digest = stated if revisit else s["digest"].hexdigest()
        size = int(head["warc-payload-length"]) if revisit else s["size"]
        ok = s["ok"] and s["ended"] and digest == stated and s["size"] == int(head["content-length"])
        own = lambda k: head[k][len("<urn:sievework:page:") : -1] if k in head else None
        return {"record_id": own("warc-record-id"), "warc_type": head["warc-type"], "url": head["warc-target-uri"], "refers_to": own("warc-refers-to"), "payload_bytes": size, "payload_digest": digest, "stated_digest": stated, "intact": ok}

    schema = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("stated_digest", pa.string()), ("intact", pa.bool_())])
    for b in batches:
        out = []
        for no, data, run_n, run_d in zip(b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
            if no == 0:
                if state:
                    out.append(closed(state))
                state = {"head": parse_header(data.as_py()), "digest": hashlib.sha256(), "size": 0, "ok": True, "ended": False, "last": 0}
                continue
            state["ok"] &= no == state["last"] + 1
            state["last"] = no
            piece = data.as_buffer()
            if piece.size == 4 and run_n == state["size"] and piece.to_pybytes() == CRLF * 2 and state["size"] >= int(state["head"]["content-length"]):
                state["ended"] = True
            else:
                state["digest"].update(piece)
                state["size"] += piece.size
                state["ok"] &= run_n == state["size"] and run_d == state["digest"].hexdigest()
        yield pa.RecordBatch.from_pylist(out, schema)
    if state:
        yield pa.RecordBatch.from_pylist([closed(state)], schema)


def export_file(chunks: Iterator[bytes], to: BinaryIO) -> int:
    """Writes chunk bytes, in order, as a WARC file; returns its size."""
    return sum(to.write(x) for x in chunks)


def import_file(source: BinaryIO, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[str, int, bytes]]:
    """Streams a WARC file as (record_id, chunk_no, data); memory is one header block or one chunk."""
    reader = io.BufferedReader(source) if not hasattr(source, "peek") else source
    while reader.peek(1)[:1]:
        block = b""
        while not block.endswith(CRLF * 2):
            line = reader.readline()
            if not line:
                raise ValueError("the file ends inside a header block")
            block += line
        head = parse_header(block)
        record, left, no = head["warc-record-id"][len("<urn:sievework:page:") : -1], int(head["content-length"]), 0
        yield record, no, block
        while left:
            piece = reader.read(min(left, chunk_bytes))
            if not piece:
                raise ValueError("the file ends inside a payload")
            left, no = left - len(piece), no + 1
            yield record, no, piece
        end = reader.read(4)
        if end != CRLF * 2:
            raise ValueError("a record doesn't close")
        yield record, no + 1, end


def op5_warc_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per row of ``pages``, written as chunk rows and read back from them."""
    path = new_path(spark, "warc")
    write_archive(classify(table(spark, sf_dir, "pages")), path)
    number = lambda c: F.substring_index(c, "/", 1).try_cast("long")
    return read_archive(spark, path).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest",
        F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"), "intact",
    )


OP5_SQL = """
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, first_value(page_id) OVER o AS first_id, first_value(url) OVER o AS first_url FROM p
      WINDOW o AS (PARTITION BY d ORDER BY page_id NULLS LAST, url NULLS FIRST)),
r AS (SELECT *, n >= 100 AND (page_id IS DISTINCT FROM first_id OR url IS DISTINCT FROM first_url) AS again FROM f)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first_id END AS refers_to, true AS intact
FROM r
"""

QUERIES = {"op5_warc_chunked": op5_warc_chunked}
ORACLE_SQL = {"op5_warc_chunked": OP5_SQL}
