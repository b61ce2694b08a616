import pytest
from pyspark.sql import functions as F

from gleanery.functions import keys, normalize, rubric
from gleanery.functions.cleaning import cleaned_hash, instant


def one(spark, expr, **cols):
    names = list(cols)
    row = spark.range(1).select(*[F.lit(v[0]).cast(v[1]).alias(n) if isinstance(v, tuple) else F.lit(v).alias(n) for n, v in cols.items()] or ["id"])
    assert names is not None
    return row.select(expr().alias("x")).first()["x"]


@pytest.mark.parametrize(("axes", "total", "level"), [((0, 0, 0), 0, "low"), ((1, 0, 0), 1, "low"), ((1, 1, 0), 2, "medium"), ((2, 1, 0), 3, "medium"), ((2, 2, 0), 4, "high"), ((2, 2, 1), 5, "high"), ((3, 0, 0), None, None), ((0, 0, None), None, None)])
def test_rubric(spark, axes, total, level):
    df = spark.createDataFrame([axes], "public_relevance int, harm_urgency int, vulnerability int")
    assert tuple(df.select(rubric.score().alias("s"), rubric.level(rubric.score()).alias("l")).first()) == (total, level)


def test_bands_and_rounding(spark):
    df = spark.createDataFrame([(0.49,), (0.5,), (0.7,), (0.9,), (float("nan"),), (None,)], "p double")
    assert [r[0] for r in df.select(rubric.confidence_band(F.col("p"))).collect()] == ["<0.50", "0.50-0.70", "0.70-0.90", ">=0.90", None, None]
    assert [r[0] for r in spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double").select(rubric.half_even(F.col("x"))).collect()] == [0, 2, 2]


def test_argmax_takes_the_first(spark):
    df = spark.createDataFrame([(0.4, 0.4, 0.2), (0.1, 0.4, 0.4), (None, 0.4, 0.4)], "a double, b double, c double")
    assert [r[0] for r in df.select(rubric.argmax_first(["a", "b", "c"], [F.col(x) for x in "abc"])).collect()] == ["a", "b", None]


def test_tie_is_fake(spark):
    df = spark.createDataFrame([(0.4, 0.2), (0.39, 0.2), (0.5, 0.0)], "p double, rho double")
    assert [r[0] for r in df.select(rubric.fused_fake(F.col("p"), F.col("rho"), 0.5)).collect()] == [True, False, True]


def test_cleaning(spark):
    df = spark.createDataFrame([(" SHA256:AB\t",), ("",), ("  ",), (None,)], "h string")
    assert [r[0] for r in df.select(cleaned_hash("h")).collect()] == ["ab", None, None, None]
    times = [("2026-01-01T00:00:00Z",), ("2026-01-01 00:00:00+05:30",), ("2026-01-01T00:00:00",), ("2026-13-01T00:00:00Z",), ("n/a",), (None,)]
    assert [r[0] is not None for r in spark.createDataFrame(times, "t string").select(instant(F.col("t"))).collect()] == [True, True, False, False, False, False]


def test_keys(spark):
    import hashlib

    df = spark.createDataFrame([("k",), (None,)], "k string")
    assert df.select(keys.rank_key(42, "x", "k")).first()[0] == hashlib.sha256(b"42:x:k").hexdigest()
    assert df.select(keys.blind_id("HT", "p", "k")).first()[0] == "HT-" + hashlib.sha256(b"p:k").hexdigest()[:20]
    texts = [('{"b": 1, "a": "é"}',), ('{"a":1,"a":2}',), ("no",), (None,)]
    assert [r[0] for r in spark.createDataFrame(texts, "t string").select(keys.canonical_json_text("t")).collect()] == ['{"a":"é","b":1}', None, None, None]
    names = [("  Straße　Ａ ",), ("",), (None,), ("x" * 81,)]
    assert [r[0] for r in spark.createDataFrame(names, "t string").select(keys.identity_key("t")).collect()] == ["strasse a", None, None, None]


def test_normalize(spark):
    df = spark.createDataFrame([(" REAL ",), ("2",), ("x",), (None,)], "l string")
    label, reason = normalize.mapped_label(F.col("l"), {"real": "real"}, {"2": "tampered"})
    assert [tuple(r) for r in df.select(label, reason).collect()] == [("real", None), (None, "tampered"), (None, "unsupported_label"), (None, "missing_label")]
    paths = [("a/b.jpg", True), ("/a", False), ("a/../b", False), ("a//b", False), ("c:x", False), ("a\\b", False), ("", False), (None, False)]
    assert [r[0] for r in spark.createDataFrame(paths, "p string, ok boolean").select(normalize.safe_path(F.col("p"))).collect()] == [ok for _, ok in paths]
    texts = [("token=abc",), ("/home/me",), ("plain " * 100,), (None,)]
    got = [r[0] for r in spark.createDataFrame(texts, "t string").select(normalize.redacted(F.col("t"), 10)).collect()]
    assert got == ["[redacted-secret]", "[redacted-local-path]", "plain plai", None]
    assert [r[0] for r in spark.createDataFrame([("true",), ("True",), ("false",), (None,)], "b string").select(normalize.strict_bool(F.col("b"))).collect()] == [True, None, False, None]
