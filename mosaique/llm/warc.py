"""WARC records and the resolution of not-modified revisits (operator 8).

A revisit record says that a server answered "not modified". It is joined to the latest earlier full response of
the same canonical URL, an as-of join. If the validators of the two agree, the response's status, payload and
headers stand for the revisit, with the headers that a not-modified answer may update taken from the revisit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions_for, stored

#: Fixed value: headers that a 304 answer may carry and that replace the stored ones (RFC 9110, 15.4.5).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
#: Fixed value: query parameters that do not name a page.
TRACKING = r"(?:utm_[a-z]+|gclid|fbclid|ref)"
RECORD_SCHEMA = "record_id string, record_type string, url string, captured timestamp, status int, headers map<string,string>, payload binary"


def canonical_url(url: Column) -> Column:
    """Scheme, `www.`, default port, fragment, tracking parameters, a final slash and the case of the host do not
    count; parameters are sorted. Null stays null."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(rf"(?i)^{TRACKING}(?:=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records of RECORD_SCHEMA (more columns may follow and are passed on) with: canonical (URL), source_id (the
    response that a revisit stands on), outcome, and status, headers and payload as resolved.

    outcome is `full` for records that are no revisits, `resolved` where the validators of the two agree,
    `resolved unvalidated` where they have none in common to compare, `validators differ` where both records have an
    etag and these differ (weak marks do not count) or, without two etags, both have last-modified and these differ,
    `no earlier response`, or `other profile` for revisits that say in a column profile that they are not about a
    not-modified answer. A revisit that is not resolved keeps what it has. A response counts as earlier if its time
    is smaller or, at the same time, its id; records without url or time are never joined, nor responses without id.
    Header names are compared in lower case. Repeated records stay repeated. Names of columns that begin with
    `_warc_` are the operator's own.

    Records are dealt by ranges of (url, time, id), so a URL with a third of all records spreads over tasks; the
    last response of each range is carried over the next ranges, one row for each partition."""
    spark = records.sparkSession
    lower = F.transform_keys("headers", lambda k, _: F.lower(k))
    rest = [c for c in records.columns if c not in ("status", "headers", "payload", "canonical", "source_id", "outcome")]
    rows = records.select(*rest, "status", F.coalesce(lower, F.expr("cast(map() as map<string,string>)")).alias("headers"), "payload", canonical_url(F.col("url")).alias("canonical"))
    usable = (F.col("record_type") == "response") & (F.col("status") == 200) & F.col("canonical").isNotNull() & F.col("captured").isNotNull()
    is_revisit = F.col("record_type").eqNullSafe("revisit")
    if "profile" in rest:
        other = F.coalesce(~F.col("profile").contains("server-not-modified"), F.lit(False))
    else:
        other = F.lit(False)
    # the as-of join moves ids and validators; payloads are fetched for the revisits that found a response
    slim = rows.select(
        F.col("record_id").alias("id"),
        F.col("canonical").alias("url"),
        F.col("captured").alias("at"),
        F.coalesce(usable, F.lit(False)).alias("full"),
        (is_revisit & ~other).alias("asks"),
        F.col("headers")["etag"].alias("etag"),
        F.col("headers")["last-modified"].alias("modified"),
    )
    partitions = partitions_for(spark, records.count())
    order = [F.col(c).asc_nulls_first() for c in ("url", "at", "id")]
    slim = stored(slim.repartitionByRange(partitions, *order).withColumn("part", F.spark_partition_id()), "warc-ranges")
    tails = slim.filter("full").groupBy("part").agg(F.max(F.struct("url", "at", "id", "etag", "modified")).alias("tail")).collect()
    carried, last = [], None
    found = {r["part"]: r["tail"] for r in tails}
    for part in range(max([partitions - 1, *found]) + 1):
        tail = found.get(part)
        carried.append((part, last))
        last = tail or last
    kind = "struct<url:string,at:timestamp,id:string,etag:string,modified:string>"
    carry = F.broadcast(spark.createDataFrame(carried, f"part int, carry {kind}"))  # a row for each partition
    before = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    response = F.when(F.col("full"), F.struct("url", "at", "id", "etag", "modified"))
    placed = slim.withColumn("seen", F.last(response, ignorenulls=True).over(before)).join(carry, "part", "left").withColumn("old", F.coalesce("seen", "carry"))
    match = placed.filter("asks AND url = old.url AND at IS NOT NULL")
    etag = lambda c: F.regexp_replace(c, "^W/", "")
    differ = F.when(F.col("etag").isNotNull() & F.col("old.etag").isNotNull(), etag(F.col("etag")) != etag(F.col("old.etag"))).otherwise(F.col("modified") != F.col("old.modified"))
    links = match.select(
        F.col("id").alias("_warc_id"), F.col("url").alias("_warc_url"), F.col("at").alias("_warc_at"), F.col("old.id").alias("_warc_source"), differ.alias("_warc_differ")
    ).distinct()
    links = stored(links, "warc-links")
    wanted = links.filter("NOT coalesce(_warc_differ, false)").select("_warc_source", "_warc_url").distinct()
    sources = rows.filter(usable).select(
        F.col("record_id").alias("_warc_source"), F.col("canonical").alias("_warc_url"), F.col("status").alias("_warc_status"), F.col("headers").alias("_warc_headers"), F.col("payload").alias("_warc_payload")
    )
    sources = sources.join(wanted, ["_warc_source", "_warc_url"], "left_semi").dropDuplicates(["_warc_source", "_warc_url"])
    here = (F.col("record_id") == F.col("_warc_id")) & (F.col("canonical") == F.col("_warc_url")) & (F.col("captured") == F.col("_warc_at"))
    joined = rows.filter(is_revisit & ~other).join(links, here, "left").join(sources, ["_warc_source", "_warc_url"], "left")
    there, good = F.col("_warc_source").isNotNull(), F.col("_warc_source").isNotNull() & ~F.coalesce("_warc_differ", F.lit(False))
    updates = F.map_filter("headers", lambda k, _: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter("_warc_headers", lambda k, _: ~F.array_contains(F.map_keys(updates), k)), updates)
    outcome = F.when(~there, "no earlier response").when(F.col("_warc_differ").isNull(), "resolved unvalidated").when(F.col("_warc_differ"), "validators differ").otherwise("resolved")
    revisits = joined.select(
        *rest,
        "canonical",
        F.col("_warc_source").alias("source_id"),
        outcome.alias("outcome"),
        F.when(good, F.col("_warc_status")).otherwise(F.col("status")).alias("status"),
        F.when(good, merged).otherwise(F.col("headers")).alias("headers"),
        F.when(good, F.col("_warc_payload")).otherwise(F.col("payload")).alias("payload"),
    )
    kept = rows.filter(~is_revisit | other)
    full = kept.select(*rest, "canonical", F.lit(None).cast("string").alias("source_id"), F.when(is_revisit, "other profile").otherwise("full").alias("outcome"), "status", "headers", "payload")
    return full.unionByName(revisits)


def _unpacked(data: bytes) -> Iterator[bytes]:
    """The contents of a file in parts: of each gzip member, up to where one is broken or cut off, or the whole."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    rest = data
    while rest[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(wbits=31)
        try:
            part = member.decompress(rest)
        except zlib.error:
            return
        yield part
        rest = member.unused_data


def _headers(lines: list[str]) -> list[tuple[str, str]]:
    """HTTP headers by lower-case name; values of a repeated one are joined by commas, of cookies by line ends."""
    held: dict[str, list[str]] = {}
    for name, _, value in (line.partition(":") for line in lines):
        if name.strip():
            held.setdefault(name.strip().lower(), []).append(value.strip())
    return [(name, ("\n" if name == "set-cookie" else ", ").join(values)) for name, values in held.items()]


def parse_records(data: bytes) -> Iterator[dict]:
    """The response, revisit and resource records of a WARC file's bytes, gzipped (as one member or a member for
    each record) or not. A record that is cut off, broken or without length ends the file."""
    held = b""
    for part in _unpacked(data):
        held, at = held + part if held else part, 0
        while (start := held.find(b"WARC/", at)) >= 0 and (end := held.find(b"\r\n\r\n", start)) >= 0:
            lines = held[start:end].decode("utf-8", "replace").split("\r\n")[1:]
            head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
            if not head.get("content-length", "").isdigit():
                return
            if end + 4 + int(head["content-length"]) > len(held):
                break
            body = held[end + 4 : (at := end + 4 + int(head["content-length"]))]
            kind = head.get("warc-type")
            if kind not in ("response", "revisit", "resource"):
                continue
            status, headers, payload = None, [], body
            if body.startswith(b"HTTP/"):
                top, _, payload = body.partition(b"\r\n\r\n")
                first, *rest = top.decode("latin-1").split("\r\n")
                code = first.split(" ")[1:2]
                status, headers = int(code[0]) if code and code[0].isdigit() else None, _headers(rest)
            yield {
                "record_id": head.get("warc-record-id"), "record_type": kind, "url": head.get("warc-target-uri"), "captured": head.get("warc-date"), "status": status,
                "headers": headers, "payload": payload, "profile": head.get("warc-profile"),
            }
        held = held[at:]


def format_record(record_id: str, kind: str, url: str, captured: str, status: int, headers: dict[str, str], payload: bytes = b"") -> bytes:
    """One WARC record with an HTTP message."""
    http = f"HTTP/1.1 {status} -\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    body = http.encode("latin-1") + payload
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {record_id}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {captured}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files below a path, as RECORD_SCHEMA and profile (that of a revisit). A file is read
    whole, as packed as it is; what one gzip member holds is unpacked at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("captured", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("profile", pa.string())])
        for batch in batches:
            for data in batch.column(0):
                held: list[dict] = []
                for record in parse_records(data.as_py()):
                    held.append(record)
                    if len(held) == 500:
                        yield pa.RecordBatch.from_pylist(held, schema=kind)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=kind)

    text = RECORD_SCHEMA.replace("captured timestamp", "captured string") + ", profile string"
    return files.mapInArrow(run, text).withColumn("captured", F.try_to_timestamp("captured"))
