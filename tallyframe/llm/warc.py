"""WARC records: writing, reading, and resolving not-modified revisits.

A revisit answers "not modified": its body is that of the latest earlier full response of the same
canonical URL. The as-of join runs in two levels, so that a URL with any share of all captures never
meets in one task: the last response of each block of time, carried over the blocks of a URL, then
inside the block.
"""

from __future__ import annotations

import gzip
import io
import itertools

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh

#: The header fields that a not-modified answer may update (RFC 9110, 15.4.5).
UPDATABLE = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Seconds in a block of time.
BLOCK_SECONDS = 4096
RECORD = "record_id long, url string, ts long, kind string, status int, headers map<string,string>, payload binary"
#: Between the values of a header field that comes several times.
AGAIN = "\n"


def canonical_url(url: Column) -> Column:
    """Without scheme, www., default port, fragment and utm_ parameters; the host in small letters; no
    closing slash."""
    url = F.regexp_replace(url, "#.*$", "")
    url = F.regexp_replace(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    url = F.regexp_replace(url, "([?&])utm_[^&]*", "$1")
    url = F.regexp_replace(F.regexp_replace(url, "[?&]+$", ""), "([?&])&+", "$1")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, "^[^/?]*", 0)), "^www\\.", ""), ":(80|443)$", "")
    return F.concat(host, F.regexp_replace(F.regexp_replace(url, "^[^/?]*", ""), "/+$", ""))


def small_names(headers: Column) -> Column:
    """Headers by names in small letters; the different values of names that then agree, in the order of
    the names as they were, with AGAIN between them. A null map is empty."""
    entries = F.transform(F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))), lambda e: F.struct(F.lower(e.key).alias("key"), e.value.alias("value")))
    own = lambda name: F.array_distinct(F.transform(F.filter(entries, lambda e: e.key == name), lambda e: e.value))
    value = lambda name: F.when(F.size(own(name)) == 1, own(name)[0]).otherwise(F.array_join(own(name), AGAIN))
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(entries, lambda e: e.key)), lambda name: F.struct(name.alias("key"), value(name).alias("value"))))


def resolve_revisits(records: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """``records`` (RECORD columns) with url_key, source_id, outcome, merged headers and payload.

    A full response (kind "response", status 200) is its own source. A revisit takes the latest response
    of its canonical URL that is earlier by (ts, record_id). Where both name an etag (else a
    last-modified) the two must be equal, or the outcome is "mismatch"; without an earlier response it
    is "missing"; else "resolved", and the response's headers are updated by the fields that the
    revisit may update. Header names count in small letters; values of names that then agree are
    joined. Of responses that repeat a record_id, the earliest gives the body, then the least by hash.
    Null urls match nothing; null times sort first; rows of other kinds pass through as "other". An
    empty table gives an empty result. Extra columns of any name stay, but url_key, outcome and
    source_id are replaced.
    """
    new = ["url_key", "outcome", "source_id"]
    extra = [c for c in records.columns if c not in RECORD_COLUMNS and c not in new]
    own_ = fresh(records, "_w")
    full_, block, at, near_, before, source, found_headers, found_payload, seen = (f"{own_}_{x}" for x in ("full", "block", "at", "near", "before", "source", "headers", "payload", "seen"))
    rows = records.select(*RECORD_COLUMNS, *(F.col(f"`{c}`") for c in extra)).withColumn("headers", small_names(F.col("headers"))).withColumn("url_key", canonical_url(F.col("url")))
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("url_key").isNotNull()
    rows = rows.withColumn(full_, F.coalesce(full, F.lit(False))).withColumn(block, F.floor(F.coalesce("ts", F.lit(0)) / F.lit(block_seconds)))
    # order of captures; a record's own id breaks ties of time
    rows = rows.withColumn(at, F.struct(F.coalesce("ts", F.lit(-(1 << 62))).alias("ts"), "record_id"))
    found = F.struct(F.col(at).alias("at"), F.col("record_id").alias("id"), F.col("headers").getItem("etag").alias("etag"), F.col("headers").getItem("last-modified").alias("modified"))
    blocks = rows.where(full_).groupBy("url_key", block).agg(F.max(found).alias("last"))
    # only blocks with captures exist; the last response before a block is carried to it
    all_blocks = rows.where("url_key is not null").select("url_key", block).distinct().join(blocks, ["url_key", block], "left")
    carried = all_blocks.withColumn(before, F.last("last", ignorenulls=True).over(Window.partitionBy("url_key").orderBy(block).rowsBetween(Window.unboundedPreceding, -1))).select("url_key", block, before)
    within = Window.partitionBy("url_key", block).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    keyed = rows.withColumn(near_, F.last(F.when(F.col(full_), found), ignorenulls=True).over(within))
    keyed = keyed.join(carried, ["url_key", block], "left").withColumn(source, F.coalesce(near_, before))
    own = F.col("headers")
    etag, modified, source_id = (F.col(source)[x] for x in ("etag", "modified", "id"))
    agrees = F.when(own["etag"].isNotNull() & etag.isNotNull(), own["etag"] == etag).when(own["last-modified"].isNotNull() & modified.isNotNull(), own["last-modified"] == modified).otherwise(True)
    revisit = F.col("kind") == "revisit"
    outcome = F.when(F.col(full_), "full").when(~F.coalesce(revisit, F.lit(False)), "other").when(source_id.isNull(), "missing").when(agrees, "resolved").otherwise("mismatch")
    keyed = keyed.withColumn("outcome", outcome).withColumn("source_id", F.when(F.col("outcome") == "full", F.col("record_id")).when(F.col("outcome") == "resolved", source_id))
    # bodies travel once, to the revisits that need them
    body = F.struct(F.col("headers").alias(found_headers), F.col("payload").alias(found_payload))
    bodies = rows.where(full_).groupBy(F.col("record_id").alias("source_id")).agg(F.min_by(body, F.struct("ts", F.sha2("payload", 256))).alias(seen)).select("source_id", f"{seen}.*")
    need = keyed.where("outcome = 'resolved'").join(bodies, "source_id", "left")
    merged = F.map_concat(F.map_filter(found_headers, lambda k, v: ~F.array_contains(F.map_keys(F.map_filter("headers", lambda a, b: a.isin(UPDATABLE))), k)), F.map_filter("headers", lambda k, v: k.isin(UPDATABLE)))
    need = need.withColumn("headers", merged).withColumn("payload", F.col(found_payload))
    columns = [F.col(f"`{c}`") for c in (*RECORD_COLUMNS, *extra, *new)]
    return keyed.where("outcome != 'resolved'").select(*columns).union(need.select(*columns))


RECORD_COLUMNS = [x.strip().split(" ")[0] for x in RECORD.split(", ")]


def format_record(record_id, url, ts, kind, status, headers, payload) -> bytes:
    """One record: a WARC head, an HTTP head and the body; a field with several values comes several
    times. A null payload is an empty one."""
    reason = {200: "OK", 304: "Not Modified"}.get(status, "")
    fields = [(k, x) for k, v in sorted((headers or {}).items()) for x in (v or "").split(AGAIN)]
    block = (f"HTTP/1.1 {status} {reason}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + (payload or b"")
    when = pd.Timestamp(ts or 0, unit="s").strftime("%Y-%m-%dT%H:%M:%SZ")
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:record:{record_id}>\r\nWARC-Date: {when}\r\nWARC-Target-URI: {url}\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _fields(lines) -> dict[str, str]:
    """Header lines by the name that comes first; values of repeated names with AGAIN between them."""
    names: dict[str, str] = {}
    out: dict[str, str] = {}
    for name, _, value in (x.partition(":") for x in lines):
        name = names.setdefault(name.strip().lower(), name.strip())
        out[name] = out[name] + AGAIN + value.strip() if name in out else value.strip()
    return out


def record_number(name: str) -> int | None:
    """The number of a urn:record: name, a 63-bit hash of any other name."""
    name = name.strip("<>")
    number = name.removeprefix("urn:record:")
    if not name or name != number and number.lstrip("-").isdigit():
        return int(number) if name else None
    return xxhash.xxh64_intdigest(name.encode()) >> 1


def parse_records(data: bytes):
    """Records of a plain or gzipped file as dictionaries, one at a time: gzip members are unpacked as
    they are read. A cut-off last record is left out; bodies are bytes; head lines that are not UTF-8
    are read with replacement marks."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            lines = []
            while (line := stream.readline()).strip():
                lines.append(line.decode("utf-8", "replace"))
            fields = {k.lower(): v for k, v in _fields(lines).items()}
            size = int(fields.get("content-length", 0))
            block = stream.read(size)
            if len(block) < size:
                return
            http = block.startswith(b"HTTP/")
            head, _, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
            first, *rest = head.decode("utf-8", "replace").split("\r\n")
            parts = first.split(" ")
            when = pd.Timestamp(fields["warc-date"]).timestamp() if "warc-date" in fields else None
            yield {
                "record_id": record_number(fields.get("warc-record-id", "")),
                "url": fields.get("warc-target-uri"),
                "ts": None if when is None else int(when),
                "kind": fields.get("warc-type"),
                "status": int(parts[1]) if len(parts) > 1 and parts[1].isdigit() else None,
                "headers": _fields(rest),
                "payload": body,
            }
    except EOFError:  # the last gzip member is cut off
        return


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """RECORD rows of all files of a path; a file is one task's work, as gzip members can't be split,
    and its records leave in parts of 256."""
    def run(batches):
        for frame in batches:
            for content in frame["content"]:
                records = parse_records(bytes(content))
                while rows := list(itertools.islice(records, 256)):
                    out = pd.DataFrame(rows, columns=RECORD_COLUMNS)
                    yield out.astype({"status": "Int32", "ts": "Int64", "record_id": "Int64"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, RECORD)


def write_warc(records: DataFrame, path: str) -> None:
    """A file for each partition, a record after another; bodies of any bytes stay as they are."""
    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in RECORD_COLUMNS))
            # the line end that the text writer adds is the last byte of the record
            made = [format_record(*row[:5], dict(row[5] or {}), row[6])[:-1] for row in rows]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["value"])

    records.select(*RECORD_COLUMNS).mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\n").text(path)


def captures(pages: DataFrame) -> DataFrame:
    """RECORD rows made from pages by rule, as a crawl that came again: each page is a response and is
    revisited; one revisit in seven names another etag."""
    key = F.sha2(F.coalesce("html", F.lit("")), 256)
    first = pages.select((F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 10).alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"), F.create_map(F.lit("ETag"), key, F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), (F.col("page_id") * 10).cast("string")).alias("headers"), F.col("html").cast("binary").alias("payload"))
    again = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") * 10 + 100000).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), F.create_map(F.lit("ETag"), F.when(F.col("page_id") % 7 == 0, F.lit("changed")).otherwise(key), F.lit("Date"), (F.col("page_id") * 10 + 100000).cast("string"), F.lit("Content-Length"), F.lit("0")).alias("headers"), F.lit(None).cast("binary").alias("payload"))
    return first.union(again)


def op6(spark, sf_dir: str) -> DataFrame:
    out = resolve_revisits(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return out.select("record_id", "url_key", "kind", "outcome", "source_id", F.sha2(F.coalesce("payload", F.lit(b"")), 256).alias("payload_sha256"), F.col("headers")["date"].alias("date"), F.size("headers").cast("long").alias("n_headers"))


OP6_SQL = r"""
WITH bare AS (
  SELECT page_id, coalesce(html, '') AS html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '([?&])utm_[^&]*', '\1', 'g'), '[?&]+$', ''), '([?&])&+', '\1', 'g') AS u
  FROM pages),
keyed AS (
  SELECT page_id, html, sha256(html) AS etag, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '') || regexp_replace(regexp_replace(u, '^[^/?]*', ''), '/+$', '') AS url_key
  FROM bare),
records AS (
  SELECT page_id * 2 AS record_id, url_key, page_id * 10 AS ts, 'response' AS kind, etag, html FROM keyed
  UNION ALL
  SELECT page_id * 2 + 1, url_key, page_id * 10 + 100000, 'revisit', CASE WHEN page_id % 7 = 0 THEN 'changed' ELSE etag END, '' FROM keyed),
found AS (
  SELECT *, last_value(CASE WHEN kind = 'response' THEN record_id END IGNORE NULLS) OVER (PARTITION BY url_key ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS near FROM records),
judged AS (
  SELECT f.*, CASE WHEN f.kind = 'response' THEN 'full' WHEN f.near IS NULL THEN 'missing' WHEN f.etag = r.etag THEN 'resolved' ELSE 'mismatch' END AS outcome, r.html AS body
  FROM found f LEFT JOIN records r ON r.record_id = f.near)
SELECT record_id, url_key, kind, outcome,
  CASE outcome WHEN 'full' THEN record_id WHEN 'resolved' THEN near END AS source_id,
  sha256(CASE outcome WHEN 'full' THEN html WHEN 'resolved' THEN body ELSE '' END) AS payload_sha256,
  CAST(ts AS VARCHAR) AS date, CAST(3 AS BIGINT) AS n_headers
FROM judged
"""
