"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, html_extract, language_id, near_dedup, sharding, token_counts, token_store, warc
from .common import fresh_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache starts empty and fills with the counts of this table's distinct texts."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    counts = token_counts.token_counts(_table(spark, sf_dir, "documents"), path, fresh_path(spark, "token-counts"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


#: Captures made of each page: how many seconds after the first, the record's type, status and how its etag differs.
CAPTURES = [(0, "response", 200, ""), (3600, "revisit", 304, ""), (7200, "revisit", 304, "-changed")]


def captures(pages: DataFrame) -> DataFrame:
    """A crawl of the pages table as WARC records: each page is captured in full, then found unmodified, then
    answered with an etag of another version. The first capture is page_id minutes after the start of 2024."""
    plans = F.array(*(F.struct(F.lit(a).alias("after"), F.lit(t).alias("record_type"), F.lit(s).alias("status"), F.lit(e).alias("mark")) for a, t, s, e in CAPTURES))
    rows = pages.select("page_id", "url", "html", F.explode(plans).alias("c"))
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id") * 60 + F.col("c.after"))
    digest = F.md5(F.coalesce("html", F.lit("")))
    shared = [F.lit("etag"), F.concat(F.lit('"'), digest, F.col("c.mark"), F.lit('"')), F.lit("date"), F.date_format(at, "yyyy-MM-dd HH:mm:ss")]
    full = F.create_map(*shared, F.lit("content-type"), F.lit("text/html"), F.lit("server"), F.lit("origin"))
    short = F.create_map(*shared, F.lit("server"), F.lit("edge"), F.lit("cache-control"), F.lit("max-age=60"))
    is_full = F.col("c.record_type") == "response"
    return rows.select(
        F.concat_ws(":", F.col("page_id"), F.col("c.after")).alias("record_id"),
        F.col("c.record_type").alias("record_type"),
        "url",
        at.alias("captured"),
        F.col("c.status").alias("status"),
        F.when(is_full, full).otherwise(short).alias("headers"),
        F.when(is_full, F.col("html").cast("binary")).alias("payload"),
        "page_id",
    )


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.resolve_revisits(captures(_table(spark, sf_dir, "pages")))
    header = lambda name: F.col("headers")[name]
    return rows.select(
        "page_id",
        "record_id",
        "canonical",
        "source_id",
        "outcome",
        "status",
        header("etag").alias("etag"),
        header("date").alias("date"),
        header("server").alias("server"),
        header("content-type").alias("content_type"),
        header("cache-control").alias("cache_control"),
        F.md5("payload").alias("payload_md5"),
    )


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-store")
    files = token_store.write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return token_store.read_tokens(spark, files, folder)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_table(spark, sf_dir, "documents"), words=2, percent=80)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(_table(spark, sf_dir, "documents"), shards=24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = language_id.fit(docs.filter(F.coalesce(~held_out, F.lit(True))))
    rows = language_id.identify_keys(docs, model)
    return rows.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_token_counts": op3_token_counts,
    "op4_near_dedup": op4_near_dedup,
    "op5_sharding": op5_sharding,
    "op6_html_extract": op6_html_extract,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_token_store": op9_token_store,
    "op10_language_id": op10_language_id,
}

_CANONICAL = """
    regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\\.', ''), ':(?:80|443)$', '')
    || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '')
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END
"""

SQL: dict[str, str] = {
    "op4_near_dedup": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(
                CASE WHEN len(words) >= 2 THEN list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])
                     WHEN len(words) = 1 THEN words ELSE [] END) AS shingle
            FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        f AS (SELECT shingle, count(*) AS df FROM s GROUP BY shingle),
        r AS (
            SELECT s.doc_id, s.shingle, row_number() OVER (PARTITION BY s.doc_id ORDER BY f.df, s.shingle) AS place, n.n
            FROM s JOIN f USING (shingle) JOIN n USING (doc_id)
        ), p AS (SELECT doc_id, shingle, n FROM r WHERE place <= n - ceil(n * 0.8) + 1),
        c AS (
            SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb
            FROM p x JOIN p y ON x.shingle = y.shingle AND x.doc_id < y.doc_id AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 80
        ), l AS (
            SELECT a, b FROM (
                SELECT c.a, c.b, any_value(na) AS na, any_value(nb) AS nb, count(*) AS common
                FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND y.shingle = x.shingle GROUP BY c.a, c.b)
            WHERE 100 * common >= 80 * (na + nb - common)
        ), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        reach AS (
            SELECT doc_id, doc_id AS other FROM documents
            UNION
            SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.other
        ), g AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT g.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, g.doc_id = component_id AS kept
        FROM g LEFT JOIN n USING (doc_id)
    """,
    # the least capacity by binary search, one greedy step in each row of search; then how many shards each end needs
    "op5_sharding": """
        WITH RECURSIVE bits AS (
            SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc
        ), docs AS (
            SELECT doc_id, coalesce(text, '') AS body, strlen(coalesce(text, '')) + 8 AS size, sha256(coalesce(text, '')) AS digest FROM documents
        ), grouped AS (
            SELECT digest, min(doc_id) AS first_key, sum(size) AS bytes FROM docs GROUP BY digest
        ), ends AS MATERIALIZED (
            SELECT digest, first_key, sum(bytes) OVER (ORDER BY first_key, digest)::BIGINT AS stop FROM grouped
        ), t AS (
            SELECT sum(bytes)::BIGINT AS total, max(bytes)::BIGINT AS largest FROM grouped
        ), search AS (
            SELECT greatest((total + 23) // 24, largest) AS lo, (total + 23) // 24 + largest AS hi,
                (greatest((total + 23) // 24, largest) + (total + 23) // 24 + largest) // 2 AS mid, 0::BIGINT AS pos, 0 AS used, total FROM t
            UNION ALL
            SELECT CASE WHEN bad THEN mid + 1 ELSE lo END, CASE WHEN good THEN mid ELSE hi END,
                CASE WHEN bad THEN (mid + 1 + hi) // 2 WHEN good THEN (lo + mid) // 2 ELSE mid END,
                CASE WHEN bad OR good THEN 0 ELSE stop END, CASE WHEN bad OR good THEN 0 ELSE used + 1 END, total
            FROM (
                SELECT s.*, coalesce(e.stop, 0) AS stop, s.pos >= s.total AS good, s.pos < s.total AND (s.used = 24 OR coalesce(e.stop, 0) <= s.pos) AS bad
                FROM search s ASOF LEFT JOIN ends e ON s.pos + s.mid >= e.stop WHERE s.lo < s.hi)
        ), cap AS (
            SELECT min(lo) AS c FROM search WHERE lo >= hi
        ), hops AS MATERIALIZED (
            SELECT a.stop, b.stop AS next FROM (SELECT stop, stop + c AS reach FROM ends, cap) a ASOF JOIN ends b ON a.reach >= b.stop
        ), needs AS (
            SELECT total AS stop, 0 AS n FROM t
            UNION ALL
            SELECT h.stop, n + 1 FROM needs JOIN hops h ON h.next = needs.stop WHERE h.stop < needs.stop AND n < 24
        ), cuts AS (
            SELECT 24 AS remaining, 0::BIGINT AS start, total, c FROM t, cap
            UNION ALL
            SELECT remaining - 1, CASE WHEN start < y.stop AND y.stop <= start + c AND n.n <= remaining - 1 THEN y.stop ELSE furthest END, total, c
            FROM (
                SELECT x.*, CASE WHEN above - target < target - below OR below <= start THEN above ELSE below END AS stop FROM (
                    SELECT s.*, coalesce(lo.stop, 0) AS below, coalesce(up.stop, s.total) AS above, coalesce(far.stop, 0) AS furthest
                    FROM (SELECT *, start + (total - start + remaining - 1) // remaining AS target FROM cuts WHERE remaining > 1) s
                    ASOF LEFT JOIN ends lo ON s.target >= lo.stop ASOF LEFT JOIN ends up ON s.target < up.stop ASOF LEFT JOIN ends far ON s.start + s.c >= far.stop) x) y
            LEFT JOIN needs n ON n.stop = y.stop
        ), placed AS (
            SELECT d.doc_id, d.body, d.size, e.first_key, e.digest, (SELECT count(*) FROM cuts WHERE remaining < 24 AND start < e.stop) AS shard
            FROM docs d JOIN ends e USING (digest)
        )
        SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(size - 8), lambda i: ('0x' || substr(hex(encode(body)), 2 * i + 1, 2))::BIGINT)),
            lambda c, b: xor(c // 256, bits.crc[xor(c, b) % 256 + 1])), 4294967295) AS text_crc32,
            'bytes' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY first_key, digest, doc_id) - 1 AS slot, NULL::INT AS grown_shard
        FROM placed, bits
    """,
    # in these tables the main text is that of an article of p, h1, br and b, with two kinds of references
    "op6_html_extract": """
        WITH a AS (
            SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1), '</?(?:p|h1|br)>') AS parts FROM pages
        ), t AS (
            SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x:
                trim(regexp_replace(regexp_replace(replace(regexp_replace(x, '</?[a-zA-Z][^>]*(?:>|$)', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '[\\s\\p{Z}]+', ' ', 'g'))),
                lambda x: x <> ''), ' ') AS text
            FROM a
        )
        SELECT page_id, url, text, length(text) AS n_chars FROM t
    """,
    "op7_exact_dedup": """
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op8_warc_revisits": f"""
        WITH c AS (
            SELECT page_id, url, html, unnest([
                {{'after': 0, 'kind': 'response', 'status': 200, 'mark': ''}},
                {{'after': 3600, 'kind': 'revisit', 'status': 304, 'mark': ''}},
                {{'after': 7200, 'kind': 'revisit', 'status': 304, 'mark': '-changed'}}]) AS c,
                regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
            FROM pages
        ), q AS (
            SELECT *, list_sort(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'),
                lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|gclid|fbclid|ref)(?:=|$)', 'i'))) AS kept
            FROM c
        ), r AS (
            SELECT page_id, page_id || ':' || c.after AS record_id, c.kind AS kind, c.status AS status, html,
                '"' || md5(coalesce(html, '')) || c.mark || '"' AS etag,
                make_timestamp((1704067200 + page_id * 60 + c.after) * 1000000) AS captured,
                {_CANONICAL} AS canonical
            FROM q
        ), a AS (
            SELECT *, CASE WHEN kind = 'revisit' THEN last_value(CASE WHEN kind = 'response' THEN record_id END IGNORE NULLS) OVER (
                PARTITION BY canonical ORDER BY captured, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS source_id
            FROM r
        ), m AS (
            SELECT a.*, o.etag AS old_etag, o.html AS old_html, o.record_id IS NOT NULL AND o.etag = a.etag AS good
            FROM a LEFT JOIN r o ON o.record_id = a.source_id
        )
        SELECT page_id, record_id, canonical, source_id,
            CASE WHEN kind = 'response' THEN 'full' WHEN source_id IS NULL THEN 'no earlier response'
                 WHEN good THEN 'resolved' ELSE 'validators differ' END AS outcome,
            CASE WHEN good THEN 200 ELSE status END AS status, etag,
            strftime(captured, '%Y-%m-%d %H:%M:%S') AS date,
            CASE WHEN kind = 'response' OR good THEN 'origin' ELSE 'edge' END AS server,
            CASE WHEN kind = 'response' OR good THEN 'text/html' END AS content_type,
            CASE WHEN kind = 'revisit' THEN 'max-age=60' END AS cache_control,
            CASE WHEN kind = 'response' THEN md5(html) WHEN good THEN md5(old_html) END AS payload_md5
        FROM m
    """,
}
