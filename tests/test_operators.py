import hashlib
import random
from fractions import Fraction

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gleanery.operators import aggregates, fusion, integrity, metrics, relations, review, sampling


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_binary_metrics_and_auc(spark):
    df = spark.createDataFrame([(1, 0.1, False), (2, 0.8, False), (3, 0.2, True), (4, 0.9, True)], "i int, p double, t boolean")
    m = metrics.binary_metrics(df.agg(*metrics.confusion(F.col("p"), F.col("t")))).first()
    assert (m["tp"], m["fp"], m["tn"], m["fn"], m["accuracy"]) == (1, 1, 1, 1, 0.5)
    assert metrics.rank_auc(df, "p", "t", "i").first()["auc"] == 0.75
    empty = metrics.binary_metrics(df.limit(0).agg(*metrics.confusion(F.col("p"), F.col("t")))).first()
    assert empty["accuracy"] is None and metrics.rank_auc(df.limit(0), "p", "t", "i").first()["auc"] is None


def test_auc_ties(spark):
    df = spark.createDataFrame([(1, 0.5, True), (2, 0.5, False)], "i int, p double, t boolean")
    assert metrics.rank_auc(df, "p", "t", "i").first()["auc"] == 0.0
    assert metrics.rank_auc(df, "p", "t", "i", ties="average").first()["auc"] == 0.5


def test_kappa_of_perfect_and_single_class(spark):
    table = spark.createDataFrame([(0, 0, 5), (1, 1, 4), (2, 2, 3)], "t int, p int, n long")
    assert tuple(metrics.weighted_kappa(table).first()) == (12, 1.0, 1.0)
    assert metrics.weighted_kappa(table.filter("t = 0")).first()["linear_kappa"] is None


def test_numbered_over_many_partitions(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id")).repartition(7)
    got = sampling.numbered(df, ["k"]).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1, 1001)) and [r["k"] for r in got] == sorted(r["k"] for r in got)
    assert sampling.numbered(df.limit(0), ["k"]).count() == 0


def test_largest_remainder(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "k string, n long")
    assert rows(sampling.largest_remainder(df, "k", "n", 7)) == [("a", 5, 4), ("b", 3, 2), ("c", 2, 1)]
    assert [q for *_, q in rows(sampling.largest_remainder(df, "k", "n", 99))] == [5, 3, 2]


def test_twister_golden():
    ids = [f"SF-{i:04d}" for i in range(1, 31)]
    assert sorted(sampling.twister_sample(ids, 6, 42)) == ["SF-0001", "SF-0004", "SF-0008", "SF-0009", "SF-0021", "SF-0024"]


def test_quota_prefix_equals_the_loop(spark):
    rnd = random.Random(1)
    data = [(i, f"k{rnd.randrange(60)}", rnd.choice(["real", "fake", None])) for i in range(200)]
    label_of = {}
    data = [(i, k, label_of.setdefault(k, lb)) for i, k, lb in data]
    quotas, target, seen, n, want = {"real": 10, "fake": 15}, 22, set(), {"real": 0, "fake": 0}, []
    for i, k, lb in data:
        if len(want) < target and lb in quotas and n[lb] < quotas[lb] and k not in seen:
            seen.add(k)
            n[lb] += 1
            want.append(i)
    df = spark.createDataFrame(data, "i int, k string, l string")
    assert sorted(r["i"] for r in sampling.quota_prefix(df, "k", "l", ["i"], quotas, target).collect()) == want


def test_relations(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, None, 1), (3, "z", 1)], "k int, v string, t int")
    b = spark.createDataFrame([(1, "x", 2), (2, "y", 2), (4, "q", 2)], "k int, v string, t int")
    assert dict(rows(relations.keyed_difference(a, b, ["k"], ignore=["t"]))) == {1: "same", 2: "changed", 3: "removed", 4: "added"}
    assert rows(relations.set_report(a.select("k"), b.select("k"))) == [(2, 1, 1, False)]
    assert rows(relations.log_prefix(a.limit(1), b, "k", "v")) == [(1, 0, True)]
    assert rows(relations.union_first([a, b], "k").select("k", "source_no")) == [(1, 0), (2, 0), (3, 0), (4, 1)]
    with pytest.raises(PySparkException):
        relations.merged_one_to_one(a.unionByName(a), b, "k").collect()


def test_aggregates(spark):
    df = spark.createDataFrame([("a", "real", 1), ("a", "fake", 2), ("b", "real", 3), ("b", "real", 4), ("c", "odd", 5), (None, "real", 6)], "k string, l string, m int")
    got = {r["k"]: (r["label"], r["status"]) for r in aggregates.resolved_label(df, "k", "l", ["real", "fake"]).collect()}
    assert got == {"a": ("unknown", "conflict"), "b": ("real", "verified"), "c": ("unknown", "no_evidence")}
    assert [tuple(r) for r in aggregates.duplicate_groups(df, "k", "m").orderBy("k").collect()] == [("a", 2, 1, 2), ("b", 2, 3, 4)]
    items = spark.createDataFrame([("g", f"{i:03d}") for i in range(7)] + [("h", "x"), ("h", None), (None, "y")], "g string, i string")
    sha = lambda x: hashlib.sha256("\n".join(x).encode()).hexdigest()
    tree = lambda x, n: sha(x) if len(x) <= n else tree([sha(x[i : i + n]) for i in range(0, len(x), n)], n)
    got = {r["g"]: r["digest"] for r in aggregates.ordered_digest(items, ["g"], "i").collect()}
    assert got == {"g": sha([f"{i:03d}" for i in range(7)]), "h": sha(["x"]), None: sha(["y"])}
    assert {r["g"]: r["digest"] for r in aggregates.ordered_digest(items, ["g"], "i", 3).collect()}["g"] == tree([f"{i:03d}" for i in range(7)], 3)
    both = df.unionByName(df.limit(0)).repartition(3)
    assert aggregates.set_digest(both, F.concat_ws("|", "k", "l")).first() == aggregates.set_digest(df, F.concat_ws("|", "k", "l")).first()
    assert [r["n"] for r in aggregates.reindexed_counts(df, "l", ["fake", "none"]).orderBy("place").collect()] == [1, 0]


def test_fusion(spark):
    assert fusion.joint_grid(spark, range(0, 100, 5), range(0, 101, 5), range(31), 100, 200).filter("w_low <= w_medium").count() > 0
    df = spark.createDataFrame([("a", 0.25, 0.5, 0.25, 0.25, True), ("b", 0.5, 0.0, 0.0, 0.0, False), ("c", None, 0.1, 0.1, 0.8, True)], "k string, p_fake double, p_low double, p_medium double, p_high double, fake boolean")
    exact = {r["k"]: (r["numerator"], r["denominator"]) for r in fusion.exact_breakpoints(df, (Fraction(1, 3), Fraction(2, 3), Fraction(1)), "k").collect()}
    assert exact == {"a": ("3", "7"), "b": (None, None), "c": (None, None)}
    got = fusion.policies(df.filter("k <> 'c'"), (0.0, 0.0, 1.0), fusion.epsilon_grid(spark, 2, 2.0), F.lit(1)).orderBy("step").collect()
    assert [(r["accuracy"], r["recall"], r["corrections"]) for r in got] == [(0.0, 0.0, 0), (0.5, 1.0, 1), (0.5, 1.0, 1)]


def test_review(spark):
    df = spark.createDataFrame([("a", 1, 10, "correct", "x"), ("a", 2, 9, "confirm", "x"), ("a", 3, 12, "confirm", "y"), (None, 4, 1, "confirm", "q")], "k string, i int, t int, act string, p string")
    assert rows(review.chain_breaks(df, "k", ["i"], "t", "act", F.col("p"))) == [("a", 3, 1, 1)]
    assert rows(review.latest(df, "k", ["i"], ["p"])) == [("a", 3, "y")]
    master, back = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert rows(review.merged(master, back, ["k"], ["v"])) == [(1, "a"), (2, "b")]
    with pytest.raises(PySparkException):
        review.merged(master, spark.createDataFrame([(1, "other")], "k int, v string"), ["k"], ["v"]).collect()


def test_integrity(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, None), ("b", 3, True)], "g string, o int, d boolean")
    assert {r["g"]: r["contiguous"] for r in integrity.gaps(df, ["g"], "o").collect()} == {"a": True, "b": False}
    assert rows(integrity.first_open(df, ["g"], "o", "d")) == [("a", 2), ("b", 1)]
    assert rows(integrity.checks(df, {"done": F.col("d")})) == [("done", 4, 2)]
