"""Catalog, cache, similarity, ranking, metrics, media, embedding, engine, streaming and command line."""

import json
import math
import os
import random
import sqlite3
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaique import cli, config
from mosaique.operators import cache, embed, jpeg, media, metrics, ranking, similarity, vit
from mosaique.operators.cache import FeatureCache
from mosaique.plans import reports
from mosaique.plans.engine import Engine, NeedsModel, Snapshot, SnapshotRegistry
from mosaique.sources import catalog
from mosaique.sources.legacy_sqlite import read_legacy
from mosaique.storage import fresh_path
from mosaique.streaming import ingest as streams

SETTINGS = config.Settings(model=config.ModelConfig(24, 1, 1, 4, height=16, width=16))


def picture(seed: int, width: int = 12, height: int = 9) -> bytes:
    rng = np.random.default_rng(seed)
    return media.encode_png(rng.integers(0, 255, (height, width, 3), dtype=np.uint8))


@pytest.fixture
def tree(tmp_path):
    """Image files by name; all but the text file hold PNG bytes."""
    for i, name in enumerate(["a.jpg", "B.PNG", "_under.png", ".dot.png", "t.txt", "noext", "sub/c.webp", "sub/a.jpg", "sub/.hid/e.png", "_u/f.png"]):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(picture(i))
    os.symlink(tmp_path / "a.jpg", tmp_path / "link.jpg")
    return tmp_path


def names(df, root):
    return [os.path.relpath(r["path"].removeprefix("file:"), root) for r in df.collect()]


def test_catalog_rules(spark, tree):
    assert names(catalog.scan(spark, str(tree)), tree) == ["B.PNG", "_under.png", "a.jpg", "sub/a.jpg", "sub/c.webp", "_u/f.png"]
    assert names(catalog.scan(spark, str(tree), recursive=False), tree) == ["B.PNG", "_under.png", "a.jpg"]
    row = catalog.scan(spark, str(tree)).filter("file_name = 'B.PNG'").first()
    assert (row["file_size"], row["filetime"]) == catalog.file_identity(str(tree / "B.PNG")) and row["thumbnail"] is None
    assert row["modified"] == int(os.stat(tree / "B.PNG").st_mtime)
    assert set(names(catalog.scan_binary(spark, f"file:{tree}"), tree)) == {"B.PNG", "a.jpg", "link.jpg", "sub/a.jpg", "sub/c.webp"}
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.photos.link./it's", f"file://{tree}")
    assert sorted(r["file_name"] for r in catalog.scan(spark, "viewfs://photos/it's").collect()) == ["B.PNG", "a.jpg", "a.jpg", "c.webp", "link.jpg"]
    with pytest.raises(catalog.NotAFolder):
        catalog.scan(spark, str(tree / "none"))
    with pytest.raises(catalog.NotAFolder):
        catalog.scan(spark, str(tree / "t.txt"))
    os.makedirs(tree / "void")
    assert catalog.scan(spark, str(tree / "void")).count() == 0
    got = catalog.contents(spark.createDataFrame([(str(tree / "a.jpg"),), ("/no/such",), (None,)], "path string")).collect()
    assert bytes(got[0]["content"]) == picture(0) and got[1]["content"] is None and got[2]["content"] is None


def test_legacy_cache(spark, tmp_path):
    path = str(tmp_path / "old.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE ImageFeatures (FilePath TEXT PRIMARY KEY, FileName TEXT, FileSize INTEGER, LastModified INTEGER, DinoFeatures BLOB, DinoFeatureLength INTEGER, CreatedAt INTEGER, UpdatedAt INTEGER)")
        rows = [("/a", "a", 1, 2, np.array([1, 2], "<f4").tobytes() + b"z", 2, 3, 4), ("/b", "b", 1, 2, np.array([1, 2, 3], "<f4").tobytes(), 3, 3, 4), ("/c", "c", 1, 2, b"", 2, 3, 4)]
        db.executemany("INSERT INTO ImageFeatures VALUES (?,?,?,?,?,?,?,?)", rows)
    assert {r["path"]: list(r["features"]) for r in read_legacy(spark, path).collect()} == {"/a": [1, 2], "/b": [1, 2, 3], "/c": []}
    assert [r["path"] for r in read_legacy(spark, path, 2).collect()] == ["/a"] and read_legacy(spark, path, 4).count() == 0
    (tmp_path / "bad.db").write_bytes(b"not a database" * 100)
    assert read_legacy(spark, str(tmp_path / "bad.db")).count() == 0  # with a warning in the worker
    assert read_legacy(spark, str(tmp_path / "none.db")).count() == 0


ROW = "path string, file_name string, file_size long, last_modified long, features array<float>"


def test_feature_cache(spark):
    store = FeatureCache(spark, fresh_path(spark, "cache"))
    assert store.rows().count() == 0 and store.identity() is None and not store.stats().first()["is_valid"] and not store.clear()
    store.store(spark.createDataFrame([("/t.jpg", "t.jpg", 10, 7, [1.0, 2.0, 3.0, 4.0])], ROW))
    assert store.get("/t.jpg", 10, 7, 4) == [1, 2, 3, 4]
    assert store.get("/t.jpg", 10, 7, 8) is None and store.get("/t.jpg", 11, 7, 4) is None and store.get("/t.jpg", 10, 8, 4) is None
    before = store.identity()
    store.store(spark.createDataFrame([("/t.jpg", "t.jpg", 10, 7, [5.0, 6.0])], ROW))
    assert store.get("/t.jpg", 10, 7, 2) == [5, 6] and store.identity() != before and store.load(4).count() == 0
    stats = store.stats().first()
    assert stats["cached_count"] == 1 and stats["cache_size_bytes"] > 0 and stats["is_valid"]
    assert store.clear() and not store.clear() and store.rows().count() == 0


def test_split_of_hits_and_misses(spark):
    entries = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1), ("d", 1, 1)], "path string, file_size long, last_modified long")
    rows = [("a", 1, 1, [1.0, 2.0], 2, "m", "fast"), ("b", 1, 2, [1.0, 2.0], 2, "m", "fast"), ("c", 1, 1, [1.0], 1, "m", "fast"), ("d", 1, 1, [3.0, 4.0], 2, "other", "fast")]
    cached = spark.createDataFrame(rows, "path string, file_size long, last_modified long, features array<float>, feature_length int, model_id string, tier string")
    assert [r["path"] for r in cache.hits(entries, cached, 2).orderBy("path").collect()] == ["a", "d"]
    assert [r["path"] for r in cache.hits(entries, cached, 2, model_id="m", tier="fast").collect()] == ["a"]
    assert sorted(r["path"] for r in cache.misses(entries, cached, 2, model_id="m", tier="fast").collect()) == ["b", "c", "d"]
    assert tuple(cache.counts(entries, cached, 2).first()) == (4, 2, 2)


def folder(spark, vectors, prefix=""):
    rows = [(f"{prefix}{i:03d}", f"{i % 7}.jpg", [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "path string, file_name string, features array<float>")


def unit(rng, n, dim):
    v = rng.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("small_blocks", [False, True])
def test_compare_equals_brute_force(spark, monkeypatch, small_blocks):
    if small_blocks:
        monkeypatch.setattr(similarity, "SOURCE_BYTES", 96 * 8 * 20)
        monkeypatch.setattr(similarity, "ROWS", 16)
    rng = np.random.default_rng(42)
    sources, targets = unit(rng, 70, 96), unit(rng, 130, 96)
    got = {r["path"]: r["best"] for r in similarity.best_matches(folder(spark, sources), folder(spark, targets)).collect()}
    assert got == pytest.approx({f"{i:03d}": v for i, v in enumerate((targets @ sources.T).max(axis=1))}, abs=1e-4)
    small = similarity.best_matches_sql(folder(spark, sources[:9]), folder(spark, targets[:11]))
    assert {r["path"]: r["best"] for r in small.collect()} == pytest.approx({f"{i:03d}": v for i, v in enumerate((targets[:11] @ sources[:9].T).max(axis=1))}, abs=1e-4)


def test_many_pairs_are_not_listed(spark):
    rng = np.random.default_rng(5)
    sources, targets = unit(rng, 2100, 8), unit(rng, 2101, 8)
    twice = folder(spark, targets).unionByName(folder(spark, targets[:3]))  # rows of one name are one target
    best = similarity.best_matches_sql(folder(spark, sources), twice)
    assert "Join" not in best._jdf.queryExecution().executedPlan().toString()
    got = best.collect()
    assert len(got) == 2101
    assert {r["path"]: r["best"] for r in got} == pytest.approx({f"{i:03d}": v for i, v in enumerate((targets @ sources.T).max(axis=1))}, abs=1e-4)


def test_compare_edges(spark):
    a = folder(spark, [[1, 0, 0], [0, 1, 0]])
    assert [r["best_similarity"] for r in similarity.compare(a, folder(spark, [[1, 0, 0]], "t")).collect()] == [1.0]
    assert similarity.compare(a, folder(spark, [[1, 0]], "t"), -1.0).count() == 0
    assert similarity.compare(a.filter("false"), a).count() == 0 and similarity.compare(a, a).count() == 2
    mixed = folder(spark, [[float("nan"), 0, 0], [0, 0, 0], [2, 0, 0], [1, 0]], "t")
    assert {r["target_path"]: r["best_similarity"] for r in similarity.compare(a, mixed, 0.0).collect()} == {"t001": 0.0, "t002": 1.0}
    assert similarity.compare(a, mixed, 0.0, engine="sql").count() == 2
    lengths = folder(spark, [[1, 0], [1, 0, 0]], "t")  # the first source's length counts, in both engines
    for engine in ("gemm", "sql"):
        assert [r["target_path"] for r in similarity.compare(folder(spark, [[1, 0, 0], [1, 0]]), lengths, 0.5, engine).collect()] == ["t001"]


@pytest.mark.parametrize("engine", ["gemm", "sql"])
def test_similar(spark, engine):
    rows = folder(spark, [[1, 0], [0.9, 0.1], [0.9, 0.1], [0, 1], [1, 0, 0], [float("nan"), 0]])
    found = [(r["path"], round(r["similarity"], 3)) for r in similarity.similar(rows, [1.0, 0.0], "./000", 0.9, engine=engine).collect()]
    assert found == [("001", 0.9), ("002", 0.9)] or found == []  # 0.9 is not exact in single precision
    found = [r["path"] for r in similarity.similar(rows, [1.0, 0.0], "x/000", 0.5, limit=2, engine=engine).collect()]
    assert found == ["000", "001"]
    assert similarity.similar(rows, [1.0, 0.0], None, 0.0, engine=engine).count() == 4


def test_normalising_is_linear_in_the_length(spark):
    import time

    from mosaique.functions import vector

    def seconds(dim):
        rows = spark.range(200_000 // dim).select(F.expr(f"transform(sequence(1, {dim}), x -> cast(x + id AS double))").alias("v")).cache()
        rows.count()
        began = time.perf_counter()
        total = rows.select(F.sum(F.aggregate(vector.l2_normalize(F.col("v")), F.lit(0.0), lambda s, x: s + x * x))).first()[0]
        assert total == pytest.approx(200_000 // dim)
        return time.perf_counter() - began

    seconds(50)
    assert seconds(10_000) < 12 * seconds(100) + 2
    row = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>")
    assert [r[0] for r in row.select(vector.l2_normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0], None]


def test_pairs_and_agreement(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = unit(rng, 60, 8)
    rows = folder(spark, v).withColumn("key", F.col("path").cast("long"))
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if v[i] @ v[j] >= 0.5}
    for size in (64 << 20, 8 * 8 * 7):
        monkeypatch.setattr(similarity, "SOURCE_BYTES", size)
        assert {(r["a"], r["b"]) for r in similarity.pairs_at_least(rows, 0.5).collect()} == want
    assert similarity.pairs_at_least(rows.filter("false"), 0.5).count() == 0
    scores = spark.createDataFrame([("x", 1, 0.5), ("y", 1, 0.7), ("x", 2, 0.1), ("y", 2, 0.1)], "backend string, item long, similarity double")
    assert {r["item"]: (round(r["spread"], 6), round(r["max_spread"], 6)) for r in similarity.agreement(scores).collect()} == {1: (0.2, 0.2), 2: (0.0, 0.2)}


def test_ranking(spark):
    rng = random.Random(1)
    values = [rng.randrange(50) for _ in range(137)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long").repartition(5)
    order = sorted(range(137), key=lambda i: (values[i], i))
    assert {r["id"]: r["idx"] for r in ranking.numbered(rows, "v", "id").collect()} == {k: n for n, k in enumerate(order)}
    around = {r["id"]: (r["previous_key"], r["next_key"], r["position"]) for r in ranking.neighbours(rows, "id", "v", "id").collect()}
    assert around[order[0]] == (order[-1], order[1], "1 / 137") and around[order[-1]] == (order[-2], order[0], "137 / 137")
    assert [r["id"] for r in ranking.page(rows, 10, 5, "v", "id").collect()] == order[10:15]
    assert ranking.top(rows, 0, "v").count() == 137 and [r["id"] for r in ranking.top(rows, 3, "v", "id").collect()] == order[:3]
    assert {r["id"]: (r["grid_row"], r["grid_col"]) for r in ranking.grid(rows, 4, "v", "id").collect()} == {k: (n // 4, n % 4) for n, k in enumerate(order)}
    assert {r["grid_row"] for r in ranking.visible(rows, 4, 1000, 300, 100, "v", "id").collect()} == set(range(7, 16))
    assert ranking.cycled(rows, 300, "v", "id").count() == 300 and ranking.cycled(rows.filter("false"), 5, "v").count() == 0
    assert [r["id"] for r in ranking.every_nth(rows, 5, "v", "id").orderBy("idx").collect()] == order[::27][:5]
    assert ranking.neighbours(rows.filter("false"), "id", "v").count() == 0
    assert {r["chunk"] for r in ranking.chunked(rows, 64, "v").collect()} == {0, 1, 2}
    asked = spark.createDataFrame([("a", 0), ("a", 1), ("b", 3)], "path string, attempts int")
    assert [tuple(r) for r in ranking.distinct_requests(asked).collect()] == [("a", 1)]


def test_metrics(spark):
    rows = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate([9, 1, 5, 5, 7])] + [("h", 0, 3.0)], "k string, i long, v double")
    got = {r["k"]: (r["avg"], r["min"], r["n"], r["p95"]) for r in metrics.latency(rows, "k", "v").collect()}
    assert got == {"g": (5.4, 1.0, 5, 9.0), "h": (3.0, 3.0, 1, 3.0)}
    assert {r["k"]: r["warm_avg"] for r in metrics.warm_average(rows, "k", "v", "i").collect()} == {"g": 4.5, "h": None}
    samples = [(0.0, 0), (1.0, 10), (1.0005, 20), (2.0, 10), (3.0, 30), (5.0, 50)]
    speed = streams.Speed()
    want = [speed.sample(*s) for s in samples][-1]
    rows = spark.createDataFrame([(g, t, n) for t, n in samples for g in ("a", "b", None)] + [("one", 1.0, 5)], "k string, t double, n long")
    assert {r["k"]: r["rate"] for r in metrics.rolling_speeds(rows, "k", "t", "n").collect()} == pytest.approx({"a": want, "b": want, None: want, "one": 0.0})
    assert metrics.rolling_speeds(rows.filter("false"), "k", "t", "n").count() == 0
    arr = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(float(n)).alias("processed")) for t, n in samples))
    assert spark.range(1).select(metrics.rolling_speed(arr)).first()[0] == pytest.approx(want) and want == pytest.approx(10.0)


def png(color: int, rows: list[bytes], width: int, palette: bytes = b"") -> bytes:
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    head = part(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, color, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + (part(b"PLTE", palette) if palette else b"") + part(b"IDAT", zlib.compress(b"".join(rows))) + part(b"IEND", b"")


def test_decoding():
    rng = np.random.default_rng(5)
    pixels = rng.integers(0, 255, (7, 5, 3), dtype=np.uint8)
    assert (media.decode(media.encode_png(pixels)) == pixels).all()
    flat, zero = pixels.reshape(7, 15).astype(int), np.zeros(15, dtype=int)
    rows = []
    for y in range(7):
        up, kind = (flat[y - 1] if y else zero), y % 5
        left = np.concatenate([np.zeros(3, int), flat[y][:-3]])
        corner = np.concatenate([np.zeros(3, int), up[:-3]])
        p = left + up - corner
        near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [zero, left, up, (left + up) // 2, near][kind]
        rows.append(bytes([kind]) + ((flat[y] - guess) % 256).astype(np.uint8).tobytes())
    assert (media.decode(png(2, rows, 5)) == pixels).all()
    assert media.decode(png(0, [b"\x00\x05\x09"], 2)).tolist() == [[[5, 5, 5], [9, 9, 9]]]
    assert media.decode(png(3, [b"\x00\x01\x00"], 2, b"\x01\x02\x03\x04\x05\x06")).tolist() == [[[4, 5, 6], [1, 2, 3]]]
    assert media.decode(png(6, [b"\x00\x01\x02\x03\x00"], 1)).tolist() == [[[1, 2, 3]]]
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 62, 0, 54, 40, 1, 2, 1, 24, 0, 8, 0, 0, 0, 0) + bytes([1, 2, 3, 0, 4, 5, 6, 0])
    assert media.decode(bmp).tolist() == [[[6, 5, 4]], [[3, 2, 1]]]
    for bad in (None, b"", b"text", png(2, [b"\x00"], 5), b"\x89PNG\r\n\x1a\n", b"BM"):
        with pytest.raises(media.Undecodable):
            media.decode(bad)


def test_model_input_and_thumbnails(spark, tmp_path):
    white = media.preprocess(np.full((10, 10, 3), 255, np.uint8), config.PRESETS["small"])
    assert white.shape == (3, 518, 518) and white[0].mean() == pytest.approx((1 - 0.485) / 0.229, abs=1e-4)
    rows = spark.createDataFrame([("a", picture(1, 64, 48)), ("a", picture(1, 64, 48)), ("b", b"no"), ("c", picture(2, 2000, 3)), ("d", None)], "path string, content binary")
    got = {r["path"]: r for r in media.thumbnails(rows, 32).collect()}
    assert set(got) == {"a", "b", "c", "d"} and got["b"]["thumbnail"] is None and got["b"]["error"]
    for name in "ac":
        (tmp_path / f"{name}.jpg").write_bytes(bytes(got[name]["thumbnail"]))
    sizes = {r["path"][-5:-4]: (r["height"], r["width"]) for r in media.jvm_images(spark, f"file:{tmp_path}").collect()}
    assert sizes == {"a": (24, 32), "c": (1, 32)}


def test_jpeg(spark, tmp_path):
    y, x = np.mgrid[0:45, 0:61]
    smooth = np.stack([x * 4, y * 5, 255 - x * 3], axis=2).astype(np.uint8)
    (tmp_path / "s.jpg").write_bytes(jpeg.encode(smooth, 90))
    (tmp_path / "n.jpg").write_bytes(jpeg.encode(np.random.default_rng(1).integers(0, 255, (9, 8, 3), dtype=np.uint8)))
    (tmp_path / "one.jpg").write_bytes(jpeg.encode(np.full((1, 1, 3), 255, np.uint8)))
    got = {r["path"].rpartition("/")[2]: r for r in media.jvm_images(spark, f"file:{tmp_path}").collect()}
    assert set(got) == {"s.jpg", "n.jpg", "one.jpg"}
    back = np.frombuffer(got["s.jpg"]["pixels"], np.uint8).reshape(45, 61, 3).astype(int)
    assert np.abs(back - smooth).mean() < 3


def plain_transformer(t, c, image):
    """The same network token by token, in loops."""
    side, patch = c.height // c.patch, c.patch
    tokens = [t["cls_token"].ravel(), *t["reg_token"].reshape(c.registers, -1)]
    for r in range(side):
        for q in range(side):
            cut = image[:, r * patch : (r + 1) * patch, q * patch : (q + 1) * patch]
            tokens.append((t["patch_embed.proj.weight"] * cut).sum(axis=(1, 2, 3)) + t["patch_embed.proj.bias"])
    dim = c.hidden // c.heads

    def norm(v, name):
        return (v - v.mean()) / np.sqrt(v.var() + 1e-5) * t[f"{name}.weight"] + t[f"{name}.bias"]

    def turn(v, n):
        if n <= c.registers:
            return v
        r, q = divmod(n - 1 - c.registers, side)
        at, out = [2 * (r + 0.5) / side - 1, 2 * (q + 0.5) / side - 1], v.copy()
        for j in range(dim // 2):
            axis, k = divmod(j, dim // 4)
            a = 2 * np.pi * at[axis] * 100.0 ** (-4 * k / dim)
            out[j], out[j + dim // 2] = v[j] * np.cos(a) - v[j + dim // 2] * np.sin(a), v[j + dim // 2] * np.cos(a) + v[j] * np.sin(a)
        return out

    for i in range(c.layers):
        b = f"blocks.{i}"
        qkv = [(t[f"{b}.attn.qkv.weight"] @ norm(v, f"{b}.norm1") + t[f"{b}.attn.qkv.bias"]).reshape(3, c.heads, dim) for v in tokens]
        mixed = []
        for n in range(len(tokens)):
            heads = []
            for h in range(c.heads):
                s = np.array([turn(qkv[n][0, h], n) @ turn(qkv[m][1, h], m) / np.sqrt(dim) for m in range(len(tokens))])
                w = np.exp(s - s.max())
                heads.append(sum(w[m] / w.sum() * qkv[m][2, h] for m in range(len(tokens))))
            mixed.append(t[f"{b}.attn.proj.weight"] @ np.concatenate(heads) + t[f"{b}.attn.proj.bias"])
        tokens = [v + m * t[f"{b}.gamma_1"] for v, m in zip(tokens, mixed, strict=True)]
        after = []
        for v in tokens:
            u = t[f"{b}.mlp.fc1.weight"] @ norm(v, f"{b}.norm2") + t[f"{b}.mlp.fc1.bias"]
            u = u * 0.5 * (1 + np.array([math.erf(x / math.sqrt(2)) for x in u]))
            after.append(v + t[f"{b}.mlp.fc2.weight"] @ u + t[f"{b}.mlp.fc2.bias"])
        tokens = after
    return np.array([norm(v, "norm") for v in tokens])


def test_vision_transformer(spark, tmp_path):
    rng, c = np.random.default_rng(9), config.ModelConfig(16, 2, 2, 12, patch=4, registers=2, height=12, width=12)
    make = lambda *shape: rng.normal(size=shape).astype(np.float32)
    t = {"cls_token": make(1, 1, 16), "reg_token": make(1, 2, 16), "patch_embed.proj.weight": make(16, 3, 4, 4), "patch_embed.proj.bias": make(16), "norm.weight": make(16), "norm.bias": make(16)}
    for i in range(2):
        b = f"blocks.{i}"
        t |= {f"{b}.{n}.{k}": make(16) for n in ("norm1", "norm2") for k in ("weight", "bias")}
        t |= {f"{b}.attn.qkv.weight": make(48, 16), f"{b}.attn.qkv.bias": make(48), f"{b}.attn.proj.weight": make(16, 16), f"{b}.attn.proj.bias": make(16), f"{b}.gamma_1": make(16)}
        t |= {f"{b}.mlp.fc1.weight": make(12, 16), f"{b}.mlp.fc1.bias": make(12), f"{b}.mlp.fc2.weight": make(16, 12), f"{b}.mlp.fc2.bias": make(16)}
    path = str(tmp_path / "m.safetensors")
    vit.write_safetensors(path, t)
    model = vit.VisionTransformer(vit.read_safetensors(path), c)
    image = make(3, 12, 12)
    assert model.forward(image[None])[0] == pytest.approx(plain_transformer(t, c, image), rel=1e-4, abs=1e-4)
    rows = spark.createDataFrame([("a", picture(1)), ("b", b"no")], "path string, content binary")
    settings = config.Settings(model=c)
    got = {r["path"]: r for r in embed.embed(rows, vit.NumpyBackend, settings, path).collect()}
    assert len(got["a"]["features"]) == 16 and got["b"]["features"] is None
    gated = {k.replace("fc1", "fc1_g"): v for k, v in t.items() if "fc1" in k}
    assert vit.VisionTransformer(t | gated, c).forward(image[None]).shape == (1, 12, 16)
    with pytest.raises(ValueError):
        vit.VisionTransformer({}, c)


class Fussy(embed.HistogramBackend):
    """Fails for a whole batch if one image is bad."""

    def extract(self, images):
        if len(images) > 1 and any(x.startswith(b"bad") for x in images):
            raise RuntimeError("batch")
        return super().extract(images)


def test_embedding_isolates_failures(spark):
    rows = spark.createDataFrame([("a", picture(1)), ("b", b"bad"), ("c", picture(1)), ("d", None)], "path string, content binary").coalesce(1)
    got = {r["path"]: r for r in embed.embed(rows, Fussy, SETTINGS).collect()}
    assert got["b"]["features"] is None and got["b"]["error"] and got["d"]["error"] == "unreadable"
    assert got["a"]["features"] == got["c"]["features"] and len(got["a"]["features"]) == 24
    assert np.linalg.norm(got["a"]["features"]) == pytest.approx(1, abs=1e-5)
    assert (embed.pooled(np.zeros((1, 30), np.float32), SETTINGS) == 0).all()


def test_jvm_images(spark, tree):
    got = {r["path"].rpartition(tree.name + "/")[2]: r for r in media.jvm_images(spark, f"file:{tree}").collect()}
    assert bytes(got["a.jpg"]["pixels"]) == media.decode(picture(0)).tobytes()  # by content, whatever the name


@pytest.fixture
def photos(spark, tmp_path):
    """One picture as JPEG (baseline with fewer chroma samples, progressive) and GIF, as the JVM writes them."""
    y, x = np.mgrid[0:45, 0:61]
    pixels = np.stack([x * 4, y * 5, 255 - x * 3], axis=2).astype(np.uint8)
    folder = tmp_path / "photos"
    folder.mkdir()
    (tmp_path / "p.png").write_bytes(media.encode_png(pixels))
    io, file = spark._jvm.javax.imageio.ImageIO, spark._jvm.java.io.File
    image = io.read(file(str(tmp_path / "p.png")))
    assert io.write(image, "jpg", file(str(folder / "_base.jpg"))) and io.write(image, "gif", file(str(folder / "g.gif")))
    writer = io.getImageWritersByFormatName("jpeg").next()
    how = writer.getDefaultWriteParam()
    how.setProgressiveMode(1)
    stream = io.createImageOutputStream(file(str(folder / "prog.jpg")))
    writer.setOutput(stream)
    writer.write(None, spark._jvm.javax.imageio.IIOImage(image, None, None), how)
    stream.close()
    return folder, pixels


def test_real_jpeg_and_gif(spark, engine, photos):
    folder, pixels = photos
    assert b"\xff\xc2" in (folder / "prog.jpg").read_bytes()
    for path in folder.iterdir():
        assert np.abs(media.decode(path.read_bytes()).astype(int) - pixels).mean() < (12 if path.suffix == ".gif" else 4), path
    for r in media.jvm_images(spark, f"file:{folder}").collect():
        want = np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"], 3).astype(int)
        found = media.decode(open(r["path"].removeprefix("file:").replace("//", ""), "rb").read())
        assert np.abs(found - want).mean() < (1e-9 if r["path"].endswith(".gif") else 3), r["path"]
    with pytest.raises(media.Undecodable):
        media.decode((folder / "prog.jpg").read_bytes()[:300])
    for name in ("_base.jpg", "prog.jpg"):
        data = (folder / name).read_bytes()
        whole = media.decode(data).astype(float)
        for least, step in (((8, 6), 8), ((9, 6), 4), ((16, 12), 4), ((31, 23), 2), ((32, 23), 1), ((99, 99), 1)):
            small = media.decode(data, lambda width, height, least=least: least)
            assert small.shape == (-(-45 // step), -(-61 // step), 3)
            mean = whole[: 45 // step * step, : 61 // step * step].reshape(45 // step, step, 61 // step, step, 3).mean(axis=(1, 3))
            assert np.abs(small[: 45 // step, : 61 // step] - mean).mean() < 4
        assert jpeg.dimensions(media.thumbnail(data, 7)) == (7, 5) == media.thumbnail_dims(61, 45, 7)
    got = engine.extract(str(folder))
    assert got.failed == 0 and got.rows.count() == 3
    assert engine.similar(str(folder / "_base.jpg"), str(folder), 0.9).count() == 2
    assert all(r["thumbnail"] for r in engine.thumbnails(str(folder), 20).collect())


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, SETTINGS, cache_root=f"file://{tmp_path}/caches")


def test_engine(spark, engine, tree):
    root = str(tree)
    first = engine.extract(root)
    assert (first.hits, first.misses, first.failed) == (0, 6, 0) and first.rows.count() == 6
    again = engine.extract(root)
    assert (again.hits, again.misses) == (6, 0)
    os.utime(tree / "a.jpg", (1, 1))
    (tree / "bad.png").write_bytes(b"text")
    found = engine.cached_folder(root)
    assert isinstance(found, NeedsModel) and found.misses == 2
    assert isinstance(engine.similar(str(tree / "B.PNG"), root, cache_only=True), NeedsModel)
    rows = engine.similar(str(tree / "B.PNG"), root, 0.0)
    assert "B.PNG" not in names(rows, tree) and rows.count() == 5
    held = engine.similar_in_snapshot(str(tree / "B.PNG"), root, 0.0, limit=2)
    assert held.count() == 2 and engine.similar_in_snapshot(str(tree / "t.txt"), root) is None
    assert engine.compare(root, root, 0.99).count() == 6
    assert isinstance(engine.compare(root, root, cache_only=True), NeedsModel)  # the bad file is never cached
    stats = engine.cache_stats(root).first()
    assert stats["cached_count"] == 6 and stats["valid_count"] == 6
    outside = tree.parent / "query.png"
    outside.write_bytes(picture(1))
    best = engine.similar(str(outside), root, 0.999).collect()
    assert [r["file_name"] for r in best] == ["B.PNG"]
    with pytest.raises(FileNotFoundError):
        engine.similar(str(tree / "none.png"), root)
    other = Engine(spark, config.Settings(model=SETTINGS.model, tier="high"), cache_root=engine.cache_root)
    assert other._resolved(root)[2] == 0
    other.legacy_keys = True
    assert other._resolved(root)[2] == 6
    assert engine.clear_cache(root) and not engine.clear_cache(root) and root not in engine.snapshots
    bare = Engine(spark, SETTINGS, make=None, cache_root=engine.cache_root)
    with pytest.raises(RuntimeError):
        bare.extract(root)
    assert bare.backend_info() == {"loaded": False} and engine.backend_info()["feature_dim"] == 24
    assert engine.thumbnails(root, 8).count() == 7


def test_snapshot_registry(spark):
    held, rows = SnapshotRegistry(2), spark.range(1)
    held.put("a", Snapshot(rows, "1", 3, 1.0))
    held.put("b", Snapshot(rows, "1", 3, 2.0))
    held.put("b", Snapshot(rows, "2", 3, 3.0))
    assert len(held) == 2  # replacing evicts nothing
    held.put("c", Snapshot(rows, "1", 3, 4.0))
    assert "a" not in held and "b" in held and held.get("b", "2", 3) and held.get("b", "1", 3) is None and "b" not in held


def test_command_line(engine, tree, capsys):
    def call(*args):
        code = cli.main(["--json", "--quiet", *args], engine)
        out = capsys.readouterr()
        return code, json.loads(out.out) if code == 0 else out.err

    root = str(tree)
    code, doc = call("scan", root, "--no-recursive")
    assert code == 0 and doc["count"] == 3 and set(doc["images"][0]) == {"path", "file_name", "file_size", "modified"}
    code, doc = call("extract", root, "--dump", str(tree / "dump.json"))
    assert doc["cache_misses"] == 6 and doc["feature_dim"] == 24
    dumped = json.loads((tree / "dump.json").read_text())
    assert dumped["feature_dim"] == 24 and len(dumped["images"]) == 6 and len(dumped["images"][0][1]) == 24
    code, doc = call("similar", str(tree / "a.jpg"), root, "--threshold", "0", "--limit", "2")
    assert doc["count"] == 2 and doc["cache_only"] and set(doc["results"][0]) == {"path", "file_name", "similarity"}
    code, doc = call("compare", root, root)
    assert doc["count"] == 6 and set(doc["matches"][0]) == {"target_path", "target_file_name", "best_similarity"}
    assert call("cache", "stats", root)[1]["cached_count"] == 6
    assert call("cache", "clear", root)[1]["cleared"] and not call("cache", "clear", root)[1]["cleared"]
    assert call("scan", str(tree / "none"))[0] == 1
    with pytest.raises(SystemExit) as stop:
        cli.main(["nothing"], engine)
    assert stop.value.code == 2
    assert cli.main(["similar", str(tree / "a.jpg"), root, "--threshold", "0"], engine) == 0
    assert "  1. " in capsys.readouterr().out
    assert reports.listing([{"p": "x", "s": 0.5}], "p", "s") == ["  1. 0.5000  x"]


def test_streaming_ingest(spark, tree, tmp_path):
    store = FeatureCache(spark, fresh_path(spark, "cache"))
    seen, listener = [], []
    watch = streams.ProgressListener(listener.append)
    spark.streams.addListener(watch)
    for _ in range(2):  # the second time there is nothing new
        streams.ingest(spark, f"file:{tree}", store, f"file://{tmp_path}/state", settings=SETTINGS, files_per_batch=2, progress=seen.append).awaitTermination()
    spark.streams.removeListener(watch)
    assert {r["file_name"] for r in store.load(24).collect()} == {"a.jpg", "B.PNG", "c.webp", "link.jpg"} and max(p.processed for p in seen) >= 4


def adam7(pixels: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """The parts of an interlaced picture as rows of bytes."""
    return [pixels[y::dy, x::dx] for y, x, dy, dx in media.ADAM7 if pixels[y::dy, x::dx].size]


def png_of(parts: list[np.ndarray], size: tuple[int, int], depth: int, color: int, interlace: int, palette: bytes = b"") -> bytes:
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    head = part(b"IHDR", struct.pack(">IIBBBBB", size[1], size[0], depth, color, 0, 0, interlace))
    rows = b"".join(b"\0" + row.tobytes() for p in parts for row in p)
    return b"\x89PNG\r\n\x1a\n" + head + (part(b"PLTE", palette) if palette else b"") + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


@pytest.mark.parametrize("size", [(1, 1), (3, 2), (9, 13), (16, 16)])
def test_kinds_of_png(size):
    rng = np.random.default_rng(size[0])
    rgb = rng.integers(0, 256, (*size, 3), dtype=np.uint8)
    flat = [p.reshape(len(p), -1) for p in adam7(rgb)]
    assert (media.decode(png_of(flat, size, 8, 2, 1)) == rgb).all()
    wide = lambda p: np.stack([p, rng.integers(0, 256, p.shape, dtype=np.uint8)], axis=-1).reshape(len(p), -1)
    assert (media.decode(png_of([wide(rgb)], size, 16, 2, 0)) == rgb).all()
    assert (media.decode(png_of([wide(p) for p in adam7(rgb)], size, 16, 2, 1)) == rgb).all()
    for depth in (1, 2, 4):
        gray = rng.integers(0, 1 << depth, (*size, 1), dtype=np.uint8)

        def packed(p, depth=depth):
            bits = np.unpackbits(p.reshape(len(p), -1, 1), axis=2)[:, :, 8 - depth :]
            return np.packbits(bits.reshape(len(p), -1), axis=1)

        want = np.repeat(gray.astype(int) * 255 // ((1 << depth) - 1), 3, axis=2)
        assert (media.decode(png_of([packed(gray)], size, depth, 0, 0)) == want).all() and (media.decode(png_of([packed(p) for p in adam7(gray)], size, depth, 0, 1)) == want).all()
        colors = rng.integers(0, 256, (1 << depth, 3), dtype=np.uint8)
        assert (media.decode(png_of([packed(gray)], size, depth, 3, 0, colors.tobytes())) == colors[gray[:, :, 0]]).all()
    with pytest.raises(media.Undecodable):
        media.decode(png_of(flat[:1], (20, 20), 8, 2, 1))


def test_thumbnail_cache(spark):
    rows = spark.createDataFrame([(f"p{i}", picture(i) if i else b"broken") for i in range(8)], "path string, content binary")
    held = media.ThumbnailCache(5, 2)
    first = held.batch(rows, ["p1", "p0", "p2", "p1"], 6)
    assert first[0] == first[3] != first[2] and first[1] is None and len(held.held) == 2
    assert held.batch(rows.filter("false"), ["p1", "p0", "p2"], 6) == [first[0], None, first[2]]  # from memory
    assert held.batch(rows.filter("false"), ["p1"], 6, force=True) == [None] and held.batch(rows, ["p1"], 6, force=True) == first[:1]
    held.batch(rows, [f"p{i}" for i in range(3, 8)], 6)
    assert len(held.held) <= 5 and ("p1", 6) not in held.held and ("p7", 6) in held.held
    made = media.thumbnails(rows, 6)
    assert media.thumbnail_counts(made).first().asDict() == {"made": 7, "failed": 1} and made.filter("path = 'p1'").select("width", "height").first() == (6, 4)


def test_scan_with_progress(spark, tree):
    for i in range(9):
        (tree / "sub" / f"d{i}" / "e").mkdir(parents=True)
        (tree / "sub" / f"d{i}" / "e" / "x.png").write_bytes(b"x")
    seen = []
    rows = catalog.scan(spark, str(tree), progress=lambda found, seconds: seen.append((found, seconds)))
    assert rows.count() == 15 == seen[-1][0] and seen == sorted(seen) and catalog.thumbnail_count(rows) == 0
    assert len(catalog._Reader(str(tree), True).partitions()) > 9 and len(catalog._Reader(str(tree), False).partitions()) == 1


def onnx_file(path, side: int) -> None:
    """A model that averages each channel over (n, 3, side, side), written by hand: two nodes and their edges."""

    def field(number: int, value: bytes | int) -> bytes:
        def number_(n: int) -> bytes:
            return bytes([n & 127 | 128]) + number_(n >> 7) if n > 127 else bytes([n])

        return number_(number << 3) + number_(value) if isinstance(value, int) else number_(number << 3 | 2) + number_(len(value)) + value

    def tensor(name: str, dims: list[int | str]) -> bytes:
        shape = b"".join(field(1, field(2, d.encode()) if isinstance(d, str) else field(1, d)) for d in dims)
        return field(1, name.encode()) + field(2, field(1, field(1, 1) + field(2, shape)))

    def node(kind: str, source: str, out: str) -> bytes:
        return field(1, field(1, source.encode()) + field(2, out.encode()) + field(4, kind.encode()))

    graph = node("GlobalAveragePool", "image", "mean") + node("Flatten", "mean", "out") + field(2, b"g")
    graph += field(11, tensor("image", ["n", 3, side, side])) + field(12, tensor("out", ["n", 3]))
    path.write_bytes(field(1, 8) + field(7, graph) + field(8, field(2, 13)))


def test_onnx_backend(spark, tmp_path):
    onnx_file(tmp_path / "mean.onnx", 8)
    images = [picture(1), picture(2)]
    backend = embed.OnnxBackend(config.PRESETS["small"])
    with pytest.raises(ValueError):
        backend.load(None)
    backend.load(str(tmp_path / "mean.onnx"))
    assert (backend.config.height, backend.config.width) == (8, 8) and backend.info().quantization == "F32"
    want = np.stack([media.preprocess(media.decode(x), backend.config).mean(axis=(1, 2)) for x in images])
    assert backend.extract(images) == pytest.approx(want, abs=1e-5)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*images, b"broken"])], "id long, content binary")
    got = {r["id"]: r for r in embed.embed(rows, embed.OnnxBackend, config.Settings(), str(tmp_path / "mean.onnx")).collect()}
    assert got[2]["features"] is None and got[2]["error"] == "unknown format"
    assert got[0]["features"] == pytest.approx(want[0] / np.linalg.norm(want[0]), abs=1e-5)


def test_backends_stay_in_the_worker(monkeypatch):
    made = []

    class Counted(embed.HistogramBackend):
        def load(self, path):
            made.append(path)

    Counted.__qualname__ = "Counted"
    for path in ("a", "a", "b"):
        embed.backend_for(Counted, config.PRESETS["small"], path)
    assert made == ["a", "b"]
    embed._MADE.clear()


def test_model_choice(spark, tree, tmp_path, monkeypatch, capsys):
    models = tmp_path / "models"
    models.mkdir()
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("MOSAIQUE_MODELS", str(models))
    engine = Engine(spark, cache_root=f"file://{tmp_path}/caches")
    assert engine.load_model() == "tiles model loaded: none needed"
    for wrong in (dict(backend="onnx"), dict(path="none.onnx")):
        with pytest.raises(FileNotFoundError):
            engine.load_model(**wrong)
    with pytest.raises(ValueError):
        engine.load_model("other")
    onnx_file(models / "model.onnx", 8)
    (models / "model_vitb16.safetensors").write_bytes(b"")
    assert engine.load_model() == f"onnx model loaded: {models}/model.onnx" and engine.make is embed.OnnxBackend and engine.settings.model_id == "onnx:model.onnx"
    assert engine.load_model(path=str(models / "model_vitb16.safetensors"), tier="ultra").startswith("numpy")
    assert (engine.settings.model.hidden, engine.settings.model.height, engine.settings.tier) == (768, 224, "ultra")
    monkeypatch.setenv("MOSAIQUE_NUMPY_MODEL", str(models / "model_vitb16.safetensors"))
    assert engine.load_model("numpy", tier="high").endswith("vitb16.safetensors") and engine.settings.model.width == 518
    # a model of 3 numbers instead of 384: extracted and cached, not found by the length that the name tells
    assert cli.main(["--json", "--quiet", "--backend", "onnx", "extract", str(tree)], engine) == 0
    assert json.loads(capsys.readouterr().out)["cache_misses"] == 6
    assert cli.main(["--quiet", "--backend", "numpy", "--model", "none", "extract", str(tree)], engine) == 1
    with pytest.raises(SystemExit):
        cli.main(["--backend", "other", "scan", str(tree)], engine)


def test_missing_weights_are_named(spark, tmp_path):
    c = config.ModelConfig(8, 1, 2, 16, patch=4, registers=2, height=8, width=8)
    names = [v[0] for v in vit.NAMES.values()] + [f"{v[0].format(i=0)}.weight" for k, v in vit.LAYER_NAMES.items() if k != "qkv" and not k.startswith("scale")]
    tensors = {n: np.zeros((1, 1), np.float32) for n in names}
    vit.VisionTransformer(tensors, c)
    for gone, said in ((vit.NAMES["registers"][0], "registers"), (f"{vit.LAYER_NAMES['down'][0].format(i=0)}.weight", "down.w")):
        with pytest.raises(ValueError, match=said):
            vit.VisionTransformer({k: v for k, v in tensors.items() if k != gone}, c)
