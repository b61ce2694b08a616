import random
from datetime import datetime

from gleanery.llm import proportions as P

PRED = "content_hash string, source_dataset string, source_label string, model_prediction string, confidence double, predicted_at timestamp, target_id int"
TARGET = "target_id long, sample_name string, sample_size long, source_dataset string, source_label string, model_prediction string, target_share double, min_count long"
T = [datetime(2026, 1, d) for d in range(1, 9)]


def test_allocation_keeps_its_bounds():
    rnd = random.Random(4)
    for _ in range(500):
        n = rnd.randrange(1, 9)
        shares = [rnd.choice([0.0, rnd.random()]) for _ in range(n)]
        floors, caps, size = [rnd.randrange(0, 9) for _ in range(n)], [rnd.randrange(0, 40) for _ in range(n)], rnd.randrange(0, 120)
        q = P.allocate(size, shares, floors, caps)
        low = [min(f, c) for f, c in zip(floors, caps)]
        assert all(a <= x <= c for a, x, c in zip(low, q, caps))
        reach = sum(c if s > 0 else a for s, a, c in zip(shares, low, caps))
        assert sum(q) == max(sum(low), min(size, reach))


def test_allocation_is_largest_remainder_without_bounds():
    assert P.allocate(10, [0.5, 0.25, 0.25], [0, 0, 0], [99, 99, 99]) == [5, 3, 2]
    assert P.allocate(100, [0.9, 0.1], [0, 20], [200, 200]) == [80, 20]
    assert P.allocate(100, [0.5, 0.5], [0, 0], [10, 200]) == [10, 90]


def rows():
    out = [(f"h{i}", rnd_case(i), "Real" if i % 2 else " fake", "low", 0.5, T[0], 1) for i in range(40)]
    out += [("h0", "A", "real", "high", 0.9, T[3], 1), ("h1", "A", "real", "high", float("nan"), T[3], 1), ("h2", "A", "real", "high", None, T[3], 1), ("h3", "A", "real", "high", 1.5, T[3], 1)]
    return out + [(None, "A", "real", "low", 0.5, T[0], 1), ("x", "", "real", "low", 0.5, T[0], 1), ("y", None, "real", "low", 0.5, T[0], 1), ("z", "A", "unknown", "low", 0.5, T[0], 1)] + out[:5]


def rnd_case(i):
    return ["A", "a ", " A"][i % 3]


def targets():
    return [(1, "s", 10, "A", "real", "low", 0.5, 2), (2, "s", 10, "A", "fake", "low", 0.4, 0), (3, "s", 10, "A", "real", "high", 0.1, 3), (4, "t", 4, "A", "real", "low", 1.0, 0)]


def test_sample(spark):
    plan_in = spark.createDataFrame(rows(), PRED), spark.createDataFrame(targets(), TARGET)
    images, plan = P.sample_plan(*plan_in)
    got = {r["target_id"]: (r["needed"], r["available"], r["shortfall"]) for r in plan.collect()}
    assert got == {1: (5, 20, 0), 2: (4, 19, 0), 3: (3, 1, 2), 4: (4, 20, 0)}
    for cells in (2, 4096):
        drawn = P.draw(images, plan, cells=cells).collect()
        assert len({(r["sample_name"], r["content_hash"]) for r in drawn}) == len(drawn) == 14
        quota = {r["target_id"]: r["quota"] for r in plan.collect()}
        assert all(sum(r["target_id"] == t for r in drawn) == q for t, q in quota.items())
    again = {(r["sample_name"], r["content_hash"]) for r in P.draw(images, plan).collect()}
    assert again == {(r["sample_name"], r["content_hash"]) for r in drawn}


def test_empty(spark):
    images, plan = P.sample_plan(spark.createDataFrame([], PRED), spark.createDataFrame(targets(), TARGET))
    assert {r["available"] for r in plan.collect()} == {0} and P.draw(images, plan).count() == 0
