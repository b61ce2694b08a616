import random

from pyspark.sql import functions as F

from gleanery.functions.rubric import ordinal_decode
from gleanery.operators import aggregates, fusion, sampling
from gleanery.plans import reference


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_duplicate_members_has_all(spark):
    data = [("a", i) for i in range(50)] + [("a", 0), ("b", 50), ("b", 51), ("c", 52), (None, 53), (None, 54)]
    df = spark.createDataFrame(data, "k string, m int")
    assert rows(aggregates.duplicate_members(df, "k", "m")) == [("a", 50, i) for i in range(50)] + [("b", 2, 50), ("b", 2, 51)]


def f1(pairs, c):
    hit, both = sum(t == p == c for t, p in pairs), sum(t == c for t, _ in pairs) + sum(p == c for _, p in pairs)
    return 2 * hit / both if both else 0


def test_threshold_search_is_the_search_by_hand(spark):
    rng = random.Random(5)
    data = [(rng.choice([0.3, 0.44, 0.5, rng.random()]), rng.choice([0.3, 0.48, 0.7, rng.random()]), rng.randrange(3)) for _ in range(60)]
    df = spark.createDataFrame([*data, (None, 0.5, 1), (0.5, 0.5, None)], "p1 double, p2 double, t int")
    grid = [round(0.3 + 0.02 * i, 2) for i in range(21)]
    want = []
    for i, t1 in enumerate(grid):
        for j, t2 in enumerate(grid):
            pairs = [(t, 0 if p1 < t1 else 1 if min(p1, p2) < t2 else 2) for p1, p2, t in data]
            want.append((-round(sum(f1(pairs, c) for c in range(3)) / 3, 12), abs(i - 10) + abs(j - 10), t1, t2))
    got = fusion.threshold_search(df).orderBy("place").collect()
    assert [(r["t1"], r["t2"], r["macro_f1"]) for r in got] == [(t1, t2, round(-f, 6)) for f, _, t1, t2 in sorted(want)]
    # the column expression decodes alike at the chosen pair
    best = got[0]
    pairs = [(r["t"], ["low", "medium", "high"].index(r["p"])) for r in df.dropna().select("t", ordinal_decode(F.col("p1"), F.col("p2"), best["t1"], best["t2"]).alias("p")).collect()]
    assert round(sum(f1(pairs, c) for c in range(3)) / 3, 6) == best["macro_f1"]
    other = fusion.threshold_search(df.withColumn("t", 2 - F.col("t"))).orderBy("place").first()
    assert other != best  # the choice follows the rows


def test_joint_search_is_the_search_by_hand(spark):
    rng = random.Random(6)
    data = [(rng.choice([0.5, 0.45, 0.475, 0.6, rng.random()]), *(rng.choice([0.0, 0.25, 0.5, 1.0]) for _ in range(3)), rng.random() < 0.5) for _ in range(60)]
    df = spark.createDataFrame(data, "p_fake double, p_low double, p_medium double, p_high double, fake boolean")
    want = []
    for l in range(0, 21, 5):
        for m in range(l, 21, 5):
            for e in range(0, 31, 3):
                said = [pf >= 0.5 - e / 200 * (l / 20 * a + m / 20 * b + h) for pf, a, b, h, _ in data]
                pairs = [(x[-1], s) for x, s in zip(data, said)]
                base = [(x[-1], x[0] >= 0.5) for x in data]
                right, tp = (lambda ps: sum(t == p for t, p in ps)), (lambda ps: sum(t and p for t, p in ps))
                regressions = sum(b == t != s for (t, s), (_, b) in zip(pairs, base))
                ok = 100 * (right(base) - right(pairs)) <= 3 * len(data) and tp(pairs) >= tp(base)
                f, g = round(f1(pairs, True), 12), round((f1(pairs, True) + f1(pairs, False)) / 2, 12)
                want.append((not ok, -tp(pairs), -g, regressions, -f, e, (3 * l - 20) ** 2 + (3 * m - 40) ** 2, l + m, l, m))
    got = fusion.joint_search(df, range(0, 21, 5), range(0, 21, 5), range(0, 31, 3), 20, 200).orderBy("place").collect()
    assert [(r["feasible"], r["macro_f1"], r["regressions"], r["fake_f1"], r["epsilon"], r["w_low"], r["w_medium"]) for r in got] == [
        (not x[0], round(-x[2], 6), x[3], round(-x[4], 6), x[5] / 200, x[8] / 20, x[9] / 20) for x in sorted(want)
    ]


def test_priorities_of_all_usable_rows(spark, tmp_path):
    p = [(f"h{i}", "v1", i, None if i % 7 == 0 else f" D{i % 3}", (float("nan") if i == 3 else None if i == 4 else 0.5), 0.2, 0.3, 0.5 if i != 5 else None, " HIGH" if i == 7 else "low") for i in range(80)]
    df = spark.createDataFrame([*p, p[9]], "content_hash string, model_version string, predicted_at int, source_dataset string, confidence double, prob_low double, prob_medium double, prob_high double, model_prediction string")
    df.write.parquet(f"{tmp_path}/predictions.parquet")
    got = reference.QUERIES["p25_priority_all"](spark, str(tmp_path)).collect()
    assert sorted(r["content_hash"] for r in got) == sorted([*(f"h{i}" for i in range(80) if i not in (3, 4, 5)), "h9"])
    assert {r["content_hash"]: r["priority"] for r in got}["h7"] == 3.3  # high is predicted, no dataset: 2 + 0.5 + 0.8
    assert {r["content_hash"]: r["priority"] for r in got}["h8"] == 1.425  # f1 0.5


def test_the_whole_log_is_compared(spark, tmp_path):
    keys = [1, 7, 508, 4_999, 5_518, 9_000, 10_027]  # of these 7, 508, 5518 and 10027 are changed
    spark.createDataFrame([(k, 2.0) for k in keys for _ in range(3)], "l_orderkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert rows(reference.QUERIES["u07_log_whole"](spark, str(tmp_path))) == [(7, 4, False)]


def test_twister_strata_are_the_reference_split(spark):
    pools = {"b": [f"{i * 7919 % 1000:03}" for i in range(400)], "a": [f"x{i:02}" for i in range(60)], "c": ["k1", "k2"]}
    df = spark.createDataFrame([(s, k) for s, ks in pools.items() for k in [*ks, ks[0]]] + [("z", "k"), ("a", None)], "s string, k string")
    rng, want = random.Random(42), []
    for s in ("b", "a", "c"):
        want += [(s, i, k, len(pools[s])) for i, k in enumerate(rng.sample(sorted(pools[s]), min(50, len(pools[s]))), 1)]
    assert rows(sampling.twister_strata(df, "s", "k", ["b", "a", "c"], 50, 42)) == sorted(want)
