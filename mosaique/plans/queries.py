"""The engine's operators as queries over the driver's tables, each beside the same in DuckDB's SQL.

`embeddings.label` stands for a folder, `vec_id` for a path and `embedding` for the feature vector.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import blob, files, vector
from ..operators import cache, embed, media, metrics, ranking, similarity
from ..operators.cache import FeatureCache
from ..sources import catalog
from ..storage import fresh_path
from ..streaming import ingest
from .engine import Engine, NeedsModel

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Thresholds of the queries; the vectors of different images are far apart in these tables.
SEARCH, COMPARE = 0.2, 0.3
#: SQL that the oracles share: a dot product in double precision, and the file name of a URL.
_V = "embedding::DOUBLE[]"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query by its function's name, with its SQL if it has any."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def r4(value) -> Column:
    """Four decimals; a negative number that rounds to nothing is 0.0, not -0.0."""
    return F.round(value, 4) + F.lit(0.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as a folder: path, file_name, features, label."""
    path = F.col("vec_id").cast("string")
    return table(spark, sf_dir, "embeddings").select(path.alias("path"), F.lpad(path, 12, "0").alias("file_name"), F.col("embedding").alias("features"), "label")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return similarity.first_vector([folder(spark, sf_dir).filter("path = '0'")]) or []


def _as_ids(rows: DataFrame, path: str = "path", sim: str = "similarity", out: str = "similarity") -> DataFrame:
    return rows.select(F.col(path).cast("long").alias("vec_id"), r4(sim).alias(out))


_SIMILAR = f"""
    SELECT e.vec_id, round(list_dot_product(e.{_V}, q.{_V}), 4) + 0.0 AS similarity
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
    WHERE e.vec_id <> 0 AND list_dot_product(e.{_V}, q.{_V}) >= {SEARCH}
"""


@query(_SIMILAR)
def similar_search(spark, sf_dir):
    return _as_ids(similarity.similar(folder(spark, sf_dir), query_vector(spark, sf_dir), "0", SEARCH))


@query(_SIMILAR)
def similar_search_sql(spark, sf_dir):
    """The same as expressions."""
    return _as_ids(similarity.similar(folder(spark, sf_dir), query_vector(spark, sf_dir), "./0", SEARCH, engine="sql"))


@query(f"""
    SELECT vec_id, similarity, row_number() OVER (ORDER BY s DESC, lpad(vec_id::VARCHAR, 12, '0')) AS rank FROM (
        SELECT e.vec_id, list_dot_product(e.{_V}, q.{_V}) AS s, round(list_dot_product(e.{_V}, q.{_V}), 4) + 0.0 AS similarity
        FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0)
    ORDER BY rank LIMIT 10
""")
def similar_topk(spark, sf_dir):
    """The ten best with their ranks: a top-k report."""
    best = similarity.similar(folder(spark, sf_dir), query_vector(spark, sf_dir), "0", -1.0, limit=10)
    return ranking.ranked_top(best, 10, F.desc("similarity"), "file_name").select(F.col("path").cast("long").alias("vec_id"), r4("similarity").alias("similarity"), "rank")


@query(f"""
    SELECT e.vec_id, round(list_dot_product(e.{_V}, q.{_V}), 4) + 0.0 AS similarity
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0 AND list_dot_product(e.{_V}, q.{_V}) >= -1
""")
def similar_limit_zero(spark, sf_dir):
    return _as_ids(similarity.similar(folder(spark, sf_dir), query_vector(spark, sf_dir), "0", -1.0, limit=0))


_COMPARE = f"""
    SELECT t.vec_id, round(max(list_dot_product(t.{_V}, s.{_V})), 4) + 0.0 AS best_similarity
    FROM embeddings t, embeddings s WHERE s.label < 5 AND t.label >= 5 GROUP BY t.vec_id
    HAVING max(list_dot_product(t.{_V}, s.{_V})) >= {COMPARE}
"""


def _compared(spark, sf_dir, sources: str, targets: str, threshold: float, engine: str = "gemm") -> DataFrame:
    rows = folder(spark, sf_dir)
    found = similarity.compare(rows.filter(sources), rows.filter(targets), threshold, engine, best_first=False)
    return _as_ids(found, "target_path", "best_similarity", "best_similarity")


@query(_COMPARE)
def compare_gemm(spark, sf_dir):
    return _compared(spark, sf_dir, "label < 5", "label >= 5", COMPARE)


@query(_COMPARE)
def compare_best_match(spark, sf_dir):
    """The definition as expressions, while pairs are few enough to be rows."""
    return _compared(spark, sf_dir, "label < 5", "label >= 5", COMPARE, "sql")


@query("SELECT vec_id, 1.0::DOUBLE AS best_similarity FROM embeddings WHERE label = 0")
def compare_self(spark, sf_dir):
    return _compared(spark, sf_dir, "label = 0", "label = 0", 0.9)


@query("SELECT vec_id, 1.0::DOUBLE AS best_similarity FROM embeddings WHERE false")
def compare_empty_source(spark, sf_dir):
    return _compared(spark, sf_dir, "label = -1", "label = 0", COMPARE)


@query(f"""
    SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.{_V}, b.{_V}), 4) + 0.0 AS similarity
    FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_dot_product(a.{_V}, b.{_V}) >= {COMPARE}
""")
def self_pairs(spark, sf_dir):
    rows = folder(spark, sf_dir).withColumn("key", F.col("path").cast("long"))
    return similarity.pairs_at_least(rows, COMPARE).withColumn("similarity", r4("similarity"))


@query(f"""
    SELECT row_number() OVER (ORDER BY e.vec_id) - 1 AS index, round(list_dot_product(e.{_V}, q.{_V}), 4) + 0.0 AS similarity
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 1
    QUALIFY list_dot_product(e.{_V}, q.{_V}) >= 0.1
""")
def find_similar_index(spark, sf_dir):
    """One query against a list of candidates, by their places in it."""
    rows = ranking.numbered(folder(spark, sf_dir).filter("label = 1").select(F.col("path").cast("long").alias("k"), "features"), "k", name="index")
    found = similarity.similarity_to(rows, query_vector(spark, sf_dir)).filter(vector.at_least(F.col("similarity"), 0.1))
    return found.select(F.col("index").cast("long").alias("index"), r4("similarity").alias("similarity"))


@query(f"""
    WITH c AS (SELECT vec_id % 50 AS list, {_V} AS v, vec_id // 50 AS place FROM embeddings WHERE vec_id < 500),
    s AS (SELECT list, place, list_dot_product(c.v, q.{_V}) AS s FROM c, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)
    SELECT list, row_number() OVER (PARTITION BY list ORDER BY s DESC, place) AS rank, place AS index, round(s, 4) + 0.0 AS similarity FROM s WHERE s >= 0.05
""")
def find_similar_lists(spark, sf_dir):
    """One query against short lists of candidates: 50 lists of ten."""
    rows = folder(spark, sf_dir).select(F.col("path").cast("long").alias("k"), "features").filter("k < 500")
    lists = rows.groupBy((F.col("k") % 50).alias("list")).agg(F.array_sort(F.collect_list(F.struct("k", "features"))).alias("c"))
    found = vector.find_similar(F.array(*(F.lit(float(x)) for x in query_vector(spark, sf_dir))), F.col("c")["features"], 0.05)
    return lists.select("list", F.posexplode(found).alias("rank", "r")).select("list", (F.col("rank") + 1).cast("long").alias("rank"), F.col("r.index").cast("long").alias("index"), r4("r.similarity").alias("similarity"))


@query(f"""
    WITH x AS (SELECT vec_id, list_transform({_V}, lambda v: v * (vec_id % 4)) AS v FROM embeddings),
    n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM x)
    SELECT vec_id, round(n, 4) + 0.0 AS norm, round(CASE WHEN n > 1e-12 THEN v[1] / n ELSE v[1] END, 4) + 0.0 AS first,
        round(CASE WHEN n > 1e-12 THEN 1.0 ELSE n END, 4) + 0.0 AS norm_after FROM n
""")
def l2_normalize(spark, sf_dir):
    """Vectors at four lengths, of which one is zero and stays zero."""
    scaled = F.transform("embedding", lambda v: v.cast("double") * (F.col("vec_id") % 4))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", scaled.alias("v"))
    unit = vector.l2_normalize(F.col("v"))
    return rows.select("vec_id", r4(vector.norm(F.col("v"))).alias("norm"), r4(unit[0]).alias("first"), r4(vector.norm(unit)).alias("norm_after"))


@query(f"""
    SELECT a.vec_id, round(list_max(list_transform(range(1, len(a.embedding) + 1), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))), 4) + 0.0 AS difference,
        round(1 - list_dot_product(a.{_V}, b.{_V}), 4) + 0.0 AS deviation
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def vector_maxdiff(spark, sf_dir):
    """Each vector against the next one: largest difference of an element, and 1 - cos."""
    a = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return a.join(b, "vec_id").select(
        "vec_id", r4(vector.max_abs_difference(F.col("x"), F.col("y"))).alias("difference"), r4(1 - vector.dot(F.col("x"), F.col("y"))).alias("deviation")
    )


@query(f"""
    WITH s AS (SELECT e.vec_id, list_dot_product(e.{_V}, q.{_V}) AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)
    SELECT vec_id, round(greatest(0, least(100, (s + 1) / 2 * 100)), 3) AS percentage, floor(s * 100 + 0.5)::BIGINT || '%' AS display,
        CASE WHEN s * 100 >= 90 THEN 'high' WHEN s * 100 >= 80 THEN 'medium' ELSE 'low' END AS badge, round(floor(s * 100 + 0.5) / 100, 4) + 0.0 AS threshold
    FROM s
""")
def similarity_display(spark, sf_dir):
    s = F.col("similarity")
    rows = similarity.similarity_to(folder(spark, sf_dir).select("path", "features"), query_vector(spark, sf_dir))
    return rows.select(
        F.col("path").cast("long").alias("vec_id"),
        F.round(vector.percentage(s), 3).alias("percentage"),
        vector.display_percent(s).alias("display"),
        vector.badge(s).alias("badge"),
        r4(vector.slider_threshold(F.floor(s * 100 + 0.5))).alias("threshold"),
    )


@query(f"""
    WITH x AS (SELECT vec_id, list_slice({_V}, 1, 16) AS v FROM embeddings)
    SELECT vec_id, len(v) AS dim, round(v[1] / sqrt(list_dot_product(v, v)), 4) + 0.0 AS first FROM x
""")
def cls_projection(spark, sf_dir):
    token = vector.class_token(F.col("embedding"), 16)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(token).cast("long").alias("dim"), r4(vector.l2_normalize(token)[0]).alias("first"))


@query(f"""
    SELECT e.vec_id, round(list_dot_product(e.{_V}, q.{_V}), 4) + 0.0 AS similarity
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id % 2 = 0
""")
def dim_guard(spark, sf_dir):
    """Vectors of odd ids are cut short and so drop out."""
    cut = F.when(F.col("path").cast("long") % 2 == 1, F.slice("features", 1, 32)).otherwise(F.col("features"))
    return _as_ids(similarity.similarity_to(folder(spark, sf_dir).withColumn("features", cut), query_vector(spark, sf_dir)))


@query(f"SELECT vec_id, true AS same, embedding[1]::DOUBLE AS first, 4 * len(embedding)::BIGINT AS n_bytes FROM embeddings")  # noqa: F541
def blob_codec(spark, sf_dir):
    """Vectors to blobs, with a byte too many, and back."""
    rows = table(spark, sf_dir, "embeddings").withColumn("b", blob.encode("embedding"))
    back = blob.decode(F.concat("b", F.lit(b"\x01")))
    return rows.withColumn("v", back).select("vec_id", (F.col("v") == F.col("embedding")).alias("same"), F.col("v")[0].cast("double").alias("first"), F.octet_length("b").cast("long").alias("n_bytes"))


def _catalog(spark, sf_dir) -> DataFrame:
    """pages as files: url as path, bytes of html as size; each third is given an image's extension."""
    kind = F.element_at(F.array(*map(F.lit, ["", ".JPG", ".txt", ".webp", ".png.gz"])), (F.col("page_id") % 5 + 1).cast("int"))
    clean = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace(clean, "/$", ""), kind).alias("path"), F.octet_length("html").cast("long").alias("file_size"))


_CATALOG = """
    WITH c AS (
        SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') || (['', '.JPG', '.txt', '.webp', '.png.gz'])[page_id % 5 + 1] AS path,
            strlen(html) AS file_size FROM pages)
"""


@query(
    _CATALOG
    + """
    SELECT page_id, path, string_split(path, '/')[-1] AS file_name, lower(regexp_extract(string_split(path, '/')[-1], '^.+\\.([^.]*)$', 1)) AS extension, file_size
    FROM c WHERE lower(regexp_extract(string_split(path, '/')[-1], '^.+\\.([^.]*)$', 1)) IN ('jpg', 'jpeg', 'png', 'bmp', 'gif', 'webp')
"""
)
def catalog_scan(spark, sf_dir):
    path = F.col("path")
    rows = _catalog(spark, sf_dir).filter(files.is_image(path))
    return rows.select("page_id", "path", files.file_name(path).alias("file_name"), files.extension(path).alias("extension"), "file_size").orderBy("file_name", "path")


@query("""
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '.cache/' ELSE '' END || 'a.b/' || page_id || CASE WHEN page_id % 4 = 1 THEN '/.x.png' ELSE '/x.png' END AS path
    FROM pages WHERE page_id % 3 <> 0 AND page_id % 4 <> 1
""")
def hidden_filter(spark, sf_dir):
    """Folders and files whose names begin with a dot are passed over; dots inside names do not matter."""
    top = F.when(F.col("page_id") % 3 == 0, ".cache/").otherwise("")
    end = F.when(F.col("page_id") % 4 == 1, "/.x.png").otherwise("/x.png")
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(top, F.lit("a.b/"), F.col("page_id"), end).alias("path"))
    return rows.filter(~files.is_hidden(F.col("path")))


@query("SELECT page_id, 'a/b/' || page_id AS normal FROM pages")
def path_normal_form(spark, sf_dir):
    """Paths that mean the same compare equal."""
    odd = F.element_at(F.array(F.lit("a/./b//"), F.lit("a\\b\\"), F.lit("a/b/./"), F.lit("a//b/")), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", files.normal_path(F.concat(odd, F.col("page_id"), F.lit("/"))).alias("normal"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), lower('RE'))")
def name_search(spark, sf_dir):
    return ranking.name_contains(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "RE", "p_name")


@query("SELECT c_custkey FROM customer")
def name_search_empty(spark, sf_dir):
    return ranking.name_contains(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "", "c_name").select("c_custkey")


def _entries(spark, sf_dir) -> DataFrame:
    """documents as files: n_chars as size."""
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("file_size"), F.lit(7).cast("long").alias("last_modified"))


def _cached(spark, sf_dir) -> DataFrame:
    """labels as a cache: each seventh file has grown since, each fifth vector has another length."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    vector_ = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.col("quality").cast("double"), F.col("toxic").cast("double"), F.lit(1.0)))
    return rows.select(
        F.col("doc_id").cast("string").alias("path"),
        (F.col("n_chars") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("file_size"),
        F.lit(7).cast("long").alias("last_modified"),
        vector_.cast("array<float>").alias("features"),
        F.when(F.col("doc_id") % 5 == 0, 2).otherwise(3).alias("feature_length"),
    )


_HIT = "l.doc_id IS NOT NULL AND d.doc_id % 7 <> 0 AND d.doc_id % 5 <> 0"


@query(f"SELECT d.doc_id, l.quality::DOUBLE AS first FROM documents d LEFT JOIN labels l USING (doc_id) WHERE {_HIT}")
def cache_hits(spark, sf_dir):
    return cache.hits(_entries(spark, sf_dir), _cached(spark, sf_dir), 3).select("doc_id", F.col("features")[0].cast("double").alias("first"))


@query(f"SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE NOT ({_HIT})")
def cache_misses(spark, sf_dir):
    return cache.misses(_entries(spark, sf_dir), _cached(spark, sf_dir), 3).select("doc_id")


@query(f"""
    SELECT count(*) AS total, count(*) FILTER (WHERE {_HIT}) AS cache_hits, count(*) FILTER (WHERE NOT ({_HIT})) AS cache_misses
    FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def cache_split(spark, sf_dir):
    return cache.counts(_entries(spark, sf_dir), _cached(spark, sf_dir), 3)


@query(f"SELECT d.doc_id, {_HIT} AS hit FROM documents d LEFT JOIN labels l USING (doc_id)")
def cache_resolved(spark, sf_dir):
    """Hits, and misses with a vector made for them, put together again."""
    entries, cached = _entries(spark, sf_dir), _cached(spark, sf_dir)
    hits = cache.hits(entries, cached, 3).select("doc_id", F.lit(True).alias("hit"))
    fresh = cache.misses(entries, cached, 3).select("doc_id", F.lit(False).alias("hit"))
    return cache.merged(hits, fresh)


@query("""
    WITH w AS (
        SELECT doc_id, n_chars AS file_size, 1 AS updated_at FROM documents
        UNION ALL SELECT doc_id, n_chars + 1, 2 FROM documents WHERE doc_id % 3 = 0
        UNION ALL SELECT doc_id, n_chars + 2, 3 FROM documents WHERE doc_id % 9 = 0)
    SELECT doc_id, file_size, updated_at::BIGINT AS updated_at FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY updated_at DESC) = 1
""")
def cache_upsert_latest(spark, sf_dir):
    """Writes that replace rows of the same key: the last one stays."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", F.col("n_chars").alias("file_size"))
    rows = rows.withColumn("last_modified", F.lit(0).cast("long"))
    at = lambda n, step: (rows.filter(F.col("doc_id") % step == 0).withColumns({"file_size": F.col("file_size") + n - 1, "updated_at": F.lit(n).cast("long")}))
    return cache.upsert(cache.upsert(at(1, 1), at(2, 3)), at(3, 9)).select("doc_id", "file_size", "updated_at")


@query("SELECT count(*) AS cached_count, true AS has_bytes, true AS is_valid FROM embeddings")
def cache_stats(spark, sf_dir):
    """A cache written, written again and counted."""
    store = FeatureCache(spark, fresh_path(spark, "cache"))
    rows = folder(spark, sf_dir).withColumns({"file_size": F.lit(1).cast("long"), "last_modified": F.lit(2).cast("long")})
    store.store(rows.filter("label < 6"))
    store.store(rows.filter("label > 3"))
    return store.stats().select("cached_count", (F.col("cache_size_bytes") > 0).alias("has_bytes"), "is_valid")


@query("SELECT doc_id FROM labels JOIN documents USING (doc_id) WHERE doc_id % 5 = 0")
def stale_dim(spark, sf_dir):
    """Cache rows of a length that is not asked for."""
    return _cached(spark, sf_dir).filter(F.col("feature_length") != 3).select(F.col("path").cast("long").alias("doc_id"))


@query("""
    SELECT doc_id, CASE WHEN n_chars <= 224 THEN 512 WHEN n_chars <= 256 THEN 256 ELSE 64 END AS chunk_size,
        ((row_number() OVER (ORDER BY doc_id) - 1) // 256)::BIGINT AS chunk FROM documents
""")
def chunk_index(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", config.chunk_size_column(F.col("n_chars")).alias("chunk_size"))
    return ranking.chunked(rows, 256, "doc_id").select("doc_id", "chunk_size", "chunk")


@query("""
    SELECT p_partkey, ((row_number() OVER o - 1) // 7)::BIGINT AS grid_row, ((row_number() OVER o - 1) % 7)::BIGINT AS grid_col
    FROM part WINDOW o AS (ORDER BY p_name, p_partkey)
""")
def grid_layout(spark, sf_dir):
    return ranking.grid(table(spark, sf_dir, "part").select("p_partkey", "p_name"), 7, "p_name", "p_partkey").select("p_partkey", "grid_row", "grid_col")


@query("""
    SELECT p_partkey FROM part QUALIFY (row_number() OVER (ORDER BY p_name, p_partkey) - 1) // 7 BETWEEN 2 AND 10
""")
def grid_visible(spark, sf_dir):
    """The lines that a window of 600 points at 1,000 shows at 200 points a line, and three on both sides."""
    return ranking.visible(table(spark, sf_dir, "part").select("p_partkey", "p_name"), 7, 1000, 600, 200, "p_name", "p_partkey").select("p_partkey")


@query("SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 200 OFFSET 200")
def page_slice(spark, sf_dir):
    return ranking.page(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), 200, 200, F.desc("p_retailprice"), "p_partkey").select("p_partkey")


@query("""
    SELECT p_partkey, row_number() OVER o || ' / ' || count(*) OVER () AS position,
        coalesce(lag(p_partkey) OVER o, last_value(p_partkey) OVER (ORDER BY p_name, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS previous_key,
        coalesce(lead(p_partkey) OVER o, first_value(p_partkey) OVER o) AS next_key
    FROM part WINDOW o AS (ORDER BY p_name, p_partkey)
""")
def wraparound_nav(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return ranking.neighbours(rows, "p_partkey", "p_name", "p_partkey").select("p_partkey", "position", "previous_key", "next_key")


@query("""
    SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents
""")
def rank_by_size(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return ranking.ranked(rows, F.desc("n_chars"), "doc_id").select("doc_id", "n_chars", "rank")


@query("""
    WITH n AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS idx, count(*) OVER () AS total FROM part)
    SELECT p_partkey FROM n WHERE idx % (total // 5) = 0 AND idx < (total // 5) * 5
""")
def every_nth(spark, sf_dir):
    """Five rows, evenly apart: a sampling operator."""
    return ranking.every_nth(table(spark, sf_dir, "part").select("p_partkey"), 5, "p_partkey").select("p_partkey")


@query("""
    WITH n AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS idx, count(*) OVER () AS total FROM supplier)
    SELECT r.i, n.s_suppkey FROM range(5000) r(i) JOIN n ON r.i % n.total = n.idx
""")
def cyclic_replication(spark, sf_dir):
    return ranking.cycled(table(spark, sf_dir, "supplier").select("s_suppkey"), 5000, "s_suppkey").select("i", "s_suppkey")


@query("SELECT user_id, max(n) AS attempts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id HAVING max(n) < 20")
def request_dedup(spark, sf_dir):
    """Requests of a user once each, unless tried too often; a request of a kind is tried as often as it occurs."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("attempts"))
    return ranking.distinct_requests(rows, "user_id", "attempts", 20)


@query("""
    SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN d.n_chars ELSE 0 END AS file_size, CASE WHEN d.doc_id % 2 = 0 THEN 5 ELSE 0 END::BIGINT AS modified
    FROM documents d
""")
def result_entries(spark, sf_dir):
    """Results joined to a catalog that has half of them."""
    docs = table(spark, sf_dir, "documents").withColumn("path", F.col("doc_id").cast("string"))
    known = docs.filter("doc_id % 2 = 0").select("path", F.col("n_chars").alias("file_size"), F.lit(5).cast("long").alias("modified"))
    return ranking.with_entries(docs.select("path", "doc_id"), known).select("doc_id", "file_size", "modified")


@query("""
    SELECT event_type, round(avg(value), 6) AS avg, min(value) AS min, count(value) AS n,
        list_sort(list(value))[least(floor(count(value) * 95 / 100)::BIGINT + 1, count(value))] AS p95
    FROM events GROUP BY event_type
""")
def latency_stats(spark, sf_dir):
    return metrics.latency(table(spark, sf_dir, "events"), "event_type", "value").withColumn("avg", F.round("avg", 6))


@query("""
    SELECT user_id, round(avg(value) FILTER (WHERE rn > 1), 6) AS warm_avg FROM (
        SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) GROUP BY user_id
""")
def warmup_avg(spark, sf_dir):
    return metrics.warm_average(table(spark, sf_dir, "events"), "user_id", "value", "ts", "event_id").withColumn("warm_avg", F.round("warm_avg", 6))


@query("""
    WITH e AS (SELECT user_id, event_type, avg(value) AS s FROM events GROUP BY ALL),
    g AS (SELECT user_id AS item, min(s) AS low, max(s) AS high FROM e GROUP BY user_id)
    SELECT item, round(low, 6) AS low, round(high, 6) AS high, round(high - low, 6) AS spread, round(max(high - low) OVER (), 6) AS max_spread FROM g
""")
def backend_spread(spark, sf_dir):
    scores = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("backend"), F.col("user_id").alias("item")).agg(F.avg("value").alias("similarity"))
    found = similarity.agreement(scores)
    return found.select("item", *(F.round(c, 6).alias(c) for c in ("low", "high", "spread", "max_spread")))


@query("""
    WITH RECURSIVE s AS (
        SELECT user_id, row_number() OVER w AS i, epoch_us(ts) / 1e6 AS t, sum(value) OVER w AS processed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    ), r AS (
        SELECT user_id, i, 0.0::DOUBLE AS rate, t, processed FROM s WHERE i = 1
        UNION ALL
        SELECT s.user_id, s.i,
            CASE WHEN s.processed > r.processed AND s.t - r.t > 0.001 THEN
                CASE WHEN r.rate > 0 THEN 0.6 * r.rate + 0.4 * (s.processed - r.processed) / (s.t - r.t) ELSE (s.processed - r.processed) / (s.t - r.t) END
                ELSE r.rate END,
            CASE WHEN s.processed > r.processed AND s.t - r.t > 0.001 THEN s.t ELSE r.t END,
            CASE WHEN s.processed > r.processed AND s.t - r.t > 0.001 THEN s.processed ELSE r.processed END
        FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1
    )
    SELECT user_id, round(rate, 6) AS rate FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1
""")
def speed_ema(spark, sf_dir):
    """A rolling speed for each user, from the running sum of values."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = table(spark, sf_dir, "events").select(
        "user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.sum("value").over(w).alias("processed")
    )
    return metrics.rolling_speeds(rows, "user_id", "t", "processed", "event_id").withColumn("rate", F.round("rate", 6))


@query("SELECT event_id, 116444736000000000 + epoch_us(ts) * 10 AS filetime, floor(epoch_us(ts) / 1000000)::BIGINT AS modified FROM events")
def filetime(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", files.filetime(F.col("ts")).alias("filetime"), files.epoch_seconds(F.col("ts")).alias("modified"))


@query("""
    SELECT event_id, round(least(value / greatest(event_id % 3, 1e-9), 1e6), 4) + 0.0 AS rate,
        CASE WHEN value >= 100 THEN floor(value + 0.5)::BIGINT::VARCHAR ELSE printf('%.1f', round(value, 1)) END AS speed,
        round(CASE WHEN event_id > 0 THEN (event_id % 10) / event_id::DOUBLE ELSE 0 END, 8) AS done,
        'Extracting features: ' || (event_id % 10) || '/' || event_id || ' images (Cache: ' || (event_id % 3) || ' hits, ' || (event_id % 7) || ' misses)' AS message,
        'Loading features: 0/' || event_id || ' images' AS loading,
        'Loaded features: ' || (event_id % 3) || '/' || event_id || ' images from cache (' || (event_id % 7) || ' to extract)' AS loaded,
        'Extracted features from ' || (event_id * 2) || ' images (Cache: ' || (event_id % 3) || ' hits, ' || (event_id % 7) || ' misses) at '
            || CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN event_id * 2 ELSE event_id END || ' img/s.' AS extracted
    FROM events
""")
def progress_text(spark, sf_dir):
    i, v = F.col("event_id"), F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id",
        r4(F.least(files.rate(v, (i % 3).cast("double")), F.lit(1e6))).alias("rate"),
        files.speed_text(v).alias("speed"),
        F.round(files.ratio((i % 10).cast("double"), i), 8).alias("done"),
        files.progress_text(i % 10, i, i % 3, i % 7).alias("message"),
        files.loading_text(i).alias("loading"),
        files.loaded_text(i % 3, i, i % 7).alias("loaded"),
        files.extracted_text(i * 2, i % 3, i % 7, (i % 3).cast("double")).alias("extracted"),
    )


@query("""
    SELECT p_partkey, (1 + 4 + ((p_size * 20) // 16) * ((p_partkey % 1000) // 16)) * 384 AS output_dim,
        CASE p_partkey % 3 WHEN 0 THEN p_size * 20 WHEN 1 THEN 224 ELSE 256 END AS side FROM part
""")
def output_dim(spark, sf_dir):
    side, tier = F.col("p_size") * 20, F.element_at(F.array(F.lit("HIGH"), F.lit("ultra"), F.lit("other")), (F.col("p_partkey") % 3 + 1).cast("int"))
    dim = config.output_dim_column(side, F.col("p_partkey") % 1000, F.lit(16), F.lit(4), F.lit(384))
    return table(spark, sf_dir, "part").select("p_partkey", dim.cast("long").alias("output_dim"), config.input_side_column(tier, side).cast("long").alias("side"))


@query("""
    SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 384 WHEN 1 THEN 768 WHEN 2 THEN 1024 WHEN 3 THEN 1280 END AS expected FROM part
""")
def expected_len(spark, sf_dir):
    names = ["m/dino_vits16.onnx", "ViTB16-q4.gguf", "x\\vitl16.onnx", "vith16plus", "vits16/model.onnx", "model.onnx"]
    path = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", config.expected_length(path).alias("expected"))


@query("""
    WITH d AS (SELECT p_partkey, p_size * 40 AS w, floor(p_retailprice)::BIGINT AS h FROM part)
    SELECT p_partkey, CASE WHEN w >= h THEN 150 ELSE greatest(1, trunc(w::FLOAT / h::FLOAT * 150::FLOAT)::INT) END AS width,
        CASE WHEN w >= h THEN greatest(1, trunc(h::FLOAT / w::FLOAT * 150::FLOAT)::INT) ELSE 150 END AS height FROM d
""")
def thumb_dims(spark, sf_dir):
    w, h = files.thumbnail_size(F.col("p_size") * 40, F.floor("p_retailprice"), 150)
    return table(spark, sf_dir, "part").select("p_partkey", w.alias("width"), h.alias("height"))


@query("""
    WITH n AS (SELECT doc_id, n_chars * (CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE 1000000000 END)::BIGINT AS n FROM documents)
    SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN regexp_replace(printf('%.1f', round(n / 1024.0::DOUBLE, 1)), '\\.0$', '') || ' KB'
        WHEN n < 1073741824 THEN regexp_replace(printf('%.1f', round(n / 1048576.0::DOUBLE, 1)), '\\.0$', '') || ' MB'
        WHEN n < 1099511627776 THEN regexp_replace(printf('%.1f', round(n / 1073741824.0::DOUBLE, 1)), '\\.0$', '') || ' GB'
        ELSE regexp_replace(printf('%.1f', round(n / 1099511627776.0::DOUBLE, 1)), '\\.0$', '') || ' TB' END AS size FROM n
""")
def format_bytes(spark, sf_dir):
    by = F.element_at(F.array(*(F.lit(x).cast("long") for x in (1, 1000, 1_000_000, 1_000_000_000))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", files.format_bytes(F.col("n_chars") * by).alias("size"))


#: Beginnings of files of each image format, in hexadecimal.
_HEADS = ["FFD8FFE000104A464946", "89504E470D0A1A0A", "474946383961", "424D36000000", "524946460000000057454250", "0000001C6674797061766966", "00112233"]


@query("""
    SELECT item_id, (['image/jpeg', 'image/png', 'image/gif', 'image/bmp', 'image/webp', 'image/avif', 'image/jpeg'])[item_id % 7 + 1] AS mime, item_id % 7 = 0 AS jpeg
    FROM benchmark
""")
def mime_sniff(spark, sf_dir):
    head = F.unhex(F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("item_id") % 7 + 1).cast("int")))
    data = F.concat(head, F.col("text").cast("binary"))
    return table(spark, sf_dir, "benchmark").select("item_id", files.mime_of_base64(files.to_base64(data)).alias("mime"), files.is_jpeg(data).alias("jpeg"))


@query("SELECT item_id, base64(encode(text)) AS encoded FROM benchmark")
def base64_text(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", files.to_base64(F.col("text")).alias("encoded"))


@query("SELECT vec_id, label FROM embeddings WHERE label < 5 UNION ALL SELECT vec_id, label FROM embeddings WHERE label >= 5")
def union_extracted(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return cache.merged(rows.filter("label < 5"), rows.filter("label >= 5"))


@query(f"""
    WITH v AS (
        SELECT vec_id AS item, 'a' AS backend, {_V} AS v FROM embeddings
        UNION ALL SELECT vec_id, 'b', list_transform({_V}, lambda x: x * 0.5) FROM embeddings
        UNION ALL SELECT vec_id, 'c', list_transform({_V}, lambda x: x * -0.25) FROM embeddings)
    SELECT x.item, x.backend AS backend_a, y.backend AS backend_b, round(list_dot_product(x.v, y.v), 4) + 0.0 AS similarity
    FROM v x JOIN v y ON x.item = y.item AND x.backend < y.backend
""")
def cross_backend_agreement(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    by = lambda name, k: rows.select(F.lit(name).alias("backend"), F.col("vec_id").alias("item"), F.transform("embedding", lambda x: x.cast("double") * k).alias("features"))
    found = similarity.backend_pairs(by("a", 1.0).unionByName(by("b", 0.5)).unionByName(by("c", -0.25)))
    return found.withColumn("similarity", r4("similarity"))


@query("""
    SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank
    FROM lineitem ORDER BY rank LIMIT 100
""")
def top_rows(spark, sf_dir):
    """A top-k report over the largest table: each task keeps its best rows only."""
    order = [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"]
    return ranking.ranked_top(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), 100, *order).select("l_orderkey", "l_linenumber", "rank")


@query("""
    SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 30)
""")
def misses_at_scale(spark, sf_dir):
    """The cache's anti-join on the largest tables."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("path"), F.lit(1).alias("file_size"), F.lit(1).alias("last_modified"))
    items = table(spark, sf_dir, "lineitem").filter("l_quantity > 30").select(F.col("l_orderkey").alias("path")).distinct()
    known = items.withColumns({"file_size": F.lit(1), "last_modified": F.lit(1), "feature_length": F.lit(1), "features": F.array(F.lit(1.0))})
    return cache.misses(orders, known, 1).select("o_orderkey")


def _pictures(spark, sf_dir) -> DataFrame:
    """A PNG for each part: a plain colour with a stripe, and some bytes that are none."""

    def draw(batches):
        for frame in batches:
            out = []
            for key, size in zip(frame["p_partkey"], frame["p_size"], strict=True):
                if key % 17 == 0:
                    out.append(b"no image")
                    continue
                pixels = np.full((int(size) + 2, 24, 3), int(key) % 256, dtype=np.uint8)
                pixels[: int(size) % 5 + 1] = (255, int(key * 7) % 256, 0)
                out.append(media.encode_png(pixels))
            yield frame.assign(content=out, path=frame["p_partkey"].astype(str))[["p_partkey", "path", "content"]]

    return table(spark, sf_dir, "part").select("p_partkey", "p_size").mapInPandas(draw, "p_partkey long, path string, content binary")


_DRAWN = "SELECT p_partkey, p_size + 2 AS h, p_partkey % 17 <> 0 AS good FROM part"


@query(f"""
    SELECT p_partkey, CASE WHEN good THEN CASE WHEN h <= 24 THEN 16 ELSE greatest(1, trunc(24::FLOAT / h::FLOAT * 16::FLOAT)::INT) END END AS width,
        CASE WHEN good THEN CASE WHEN h <= 24 THEN greatest(1, trunc(h::FLOAT / 24::FLOAT * 16::FLOAT)::INT) ELSE 16 END END AS height,
        good AS jpeg, CASE WHEN NOT good THEN 'unknown format' END AS error FROM ({_DRAWN})
""")
def thumbnails(spark, sf_dir):
    made = media.thumbnails(_pictures(spark, sf_dir), 16)
    jpeg_ = F.coalesce(files.is_jpeg(F.col("thumbnail")), F.lit(False))
    return made.select(F.col("path").cast("long").alias("p_partkey"), "width", "height", jpeg_.alias("jpeg"), "error")


@query(f"SELECT count(*) FILTER (WHERE good) AS made, count(*) FILTER (WHERE NOT good) AS failed FROM ({_DRAWN})")
def thumbnail_counts(spark, sf_dir):
    return media.thumbnail_counts(media.thumbnails(_pictures(spark, sf_dir), 8))


@query(f"""
    SELECT p_partkey, CASE WHEN good THEN 384 ELSE -1 END AS dim, CASE WHEN good THEN 1.0::DOUBLE END AS norm,
        CASE WHEN NOT good THEN 'unknown format' END AS error FROM ({_DRAWN})
""")
def embed_stub(spark, sf_dir):
    """A vector for each picture; what cannot be decoded has an error and does not stop the rest."""
    rows = embed.embed(_pictures(spark, sf_dir), embed.HistogramBackend, config.Settings())
    return rows.select("p_partkey", F.coalesce(F.size("features"), F.lit(-1)).alias("dim"), r4(vector.norm(F.col("features"))).alias("norm"), "error")


@query(f"SELECT round(max(1 - list_dot_product(a.{_V}, b.{_V})), 4) + 0.0 AS deviation, count(*) AS n FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def max_deviation(spark, sf_dir):
    """The largest deviation of a vector from the next one."""
    a = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return a.join(b, "vec_id").agg(r4(F.max(1 - vector.dot(F.col("x"), F.col("y")))).alias("deviation"), F.count(F.lit(1)).alias("n"))


def _local_folder(spark, name: str) -> str:
    """A new folder that the driver and the tasks list and read with the machine's own calls, in the shared one, which
    must be mounted."""
    path = fresh_path(spark, name)
    if not path.startswith("file:") and "://" in path:
        raise RuntimeError(f"{path} is no mounted folder")
    root = "/" + path.removeprefix("file:").lstrip("/")
    os.makedirs(root)
    return root


_FILES = ["a.jpg", "B.PNG", "_under.png", ".dot.png", "t.txt", "noext", "sub/c.webp", "sub/a.jpg", "sub/.hid/e.png", "sub/deep/er/z.gif"]


@query(f"""
    SELECT path, string_split(path, '/')[-1] AS file_name, strlen(path) AS file_size, 0::BIGINT AS with_thumbnail
    FROM (SELECT unnest({_FILES}) AS path) WHERE NOT regexp_matches('/' || path, '/[.]') AND regexp_matches(lower(path), '[^/][.](jpg|jpeg|png|bmp|gif|webp)$')
""")
def folder_scan(spark, sf_dir):
    """The catalog of a folder of files, hidden ones and other kinds among them."""
    root = _local_folder(spark, "scan")
    for name in _FILES:
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "wb") as out:
            out.write(b"x" * len(name))
    rows = catalog.scan(spark, root, progress=lambda found, seconds: None)
    return rows.select(F.expr(f"substring(path, {len(root) + 2})").alias("path"), "file_name", "file_size", F.lit(catalog.thumbnail_count(rows)).cast("long").alias("with_thumbnail"))


def _photos(spark, sf_dir, name: str) -> str:
    """A folder with a small PNG for each nation, of which every seventh file is broken."""
    root = _local_folder(spark, name)
    for (key,) in table(spark, sf_dir, "nation").select("n_nationkey").collect():  # a table of fixed size
        rng = np.random.default_rng(key)
        with open(f"{root}/{key:03d}.png", "wb") as out:
            out.write(media.encode_png(rng.integers(0, 255, (9, 11, 3), dtype=np.uint8)) if key % 7 else b"broken")
    return root


_GOOD = "SELECT count(*) AS n, count(*) FILTER (WHERE n_nationkey % 7 <> 0) AS good FROM nation"


@query(f"""
    SELECT unnest(['cached at first', 'extract', 'extract again', 'cached', 'similar from cache', 'similar', 'in memory', 'limited', 'compare', 'stats', 'cleared', 'in memory after']) AS step,
        unnest([n, n, good, n - good, n - good, good - 1, good - 1, 2, good, good, 1, 0])::BIGINT AS n, unnest(['needs model', 'misses', 'hits', 'needs model', 'needs model', 'rows', 'rows', 'rows', 'rows', 'valid', 'done', 'none']) AS what
    FROM ({_GOOD})
""")
def engine_session(spark, sf_dir):
    """A folder asked for before and after its vectors are made: what is answered from the cache, from memory, and
    what needs a model."""
    root = _photos(spark, sf_dir, "photos")
    settings = config.Settings(model=config.ModelConfig(24, 1, 1, 4, height=16, width=16))
    engine = Engine(spark, settings, cache_root=fresh_path(spark, "caches"))
    source, steps = f"{root}/001.png", []
    told = lambda found, what="rows": (found.misses, "needs model") if isinstance(found, NeedsModel) else (0, "none") if found is None else (found.count(), what)
    steps.append(("cached at first", *told(engine.cached_folder(root))))
    steps.append(("extract", engine.extract(root).misses, "misses"))
    steps.append(("extract again", engine.extract(root).hits, "hits"))
    steps.append(("cached", *told(engine.cached_folder(root))))
    steps.append(("similar from cache", *told(engine.similar(source, root, -1.0, cache_only=True))))
    steps.append(("similar", *told(engine.similar(source, root, -1.0))))
    steps.append(("in memory", *told(engine.similar_in_snapshot(source, root, -1.0))))
    steps.append(("limited", *told(engine.similar_in_snapshot(source, root, -1.0, limit=2))))
    steps.append(("compare", *told(engine.compare(root, root, 0.99))))
    steps.append(("stats", engine.cache_stats(root).first()["valid_count"], "valid"))
    steps.append(("cleared", int(engine.clear_cache(root)), "done"))
    steps.append(("in memory after", *told(engine.similar_in_snapshot(source, root, -1.0))))
    return spark.createDataFrame(steps, "step string, n long, what string")


@query("SELECT s_suppkey, 24 AS dim, 1.0::DOUBLE AS norm FROM supplier WHERE s_suppkey % 17 <> 0")
def streaming_ingest(spark, sf_dir):
    """Pictures that arrive as files, embedded in micro-batches and upserted into a cache; a second run of the same
    stream finds nothing new."""
    inbox, store, state = fresh_path(spark, "inbox"), FeatureCache(spark, fresh_path(spark, "ingested")), fresh_path(spark, "stream-state")
    settings = config.Settings(model=config.ModelConfig(24, 1, 1, 4, height=16, width=16))

    def put(batches):
        folder_, at = fs.FileSystem.from_uri(inbox)
        folder_.create_dir(at, recursive=True)
        for batch in batches:
            for key in batch.column(0).to_pylist():
                pixels = np.full((8, 8, 3), key % 256, dtype=np.uint8)
                pixels[: key % 5 + 1] = (255, key * 7 % 256, 0)
                with folder_.open_output_stream(f"{at}/{key}.png") as out:
                    out.write(media.encode_png(pixels) if key % 17 else b"no image")
            yield batch

    table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("key")).repartition(8).mapInArrow(put, "key long").count()
    for _ in range(2):
        ingest.ingest(spark, inbox, store, state, settings=settings, files_per_batch=512).awaitTermination()
    found = store.rows()
    return found.select(F.regexp_extract("file_name", r"^(\d+)", 1).cast("long").alias("s_suppkey"), F.col("feature_length").alias("dim"), r4(vector.norm(F.col("features"))).alias("norm"))


@query("SELECT doc_id, n_chars FROM documents")
def streaming_rows(spark, sf_dir):
    """documents as a stream in micro-batches, each upserted by foreachBatch, so that a batch tried again changes
    nothing."""
    source = table(spark, sf_dir, "documents")
    out, checkpoint, inbox = fresh_path(spark, "rows"), fresh_path(spark, "stream-state"), fresh_path(spark, "inbox")
    source.select("doc_id", "n_chars").repartition(4, "doc_id").write.parquet(inbox)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/part={number}")

    stream = spark.readStream.schema("doc_id long, n_chars long").option("maxFilesPerTrigger", 2).parquet(inbox)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("doc_id long, n_chars long").parquet(f"{out}/part=*")
