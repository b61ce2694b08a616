import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gleanery.functions.cleaning import cleaned_hash
from gleanery.operators.orphans import Child, Parent, orphans, orphans_by_period

T0 = datetime(2026, 1, 1)
PARENT, CHILD = "content_hash string, loaded_at timestamp, deleted_at timestamp", "entry_id long, content_hash string, added_at timestamp, key string, t int"


def find(spark, parents, children, **options):
    p = spark.createDataFrame(parents, PARENT)
    c = spark.createDataFrame(children, CHILD)
    h = cleaned_hash("content_hash")
    return orphans(
        [Child("batch_images", c, F.col("entry_id"), h, F.col("added_at"), "images")], [Parent("images", p, h, F.col("loaded_at"), F.col("deleted_at"))], **options
    )


def brute(parents, children):
    clean = lambda h: None if h is None else (h.strip(" \t").lower().removeprefix("sha256:") or None)
    bad = set()
    for i, h, t, *_ in children:
        k = clean(h)
        if k and not any(clean(p) == k and a is not None and t is not None and a <= t and (b is None or t < b) for p, a, b in parents):
            bad.add(i)
    return bad


def test_against_brute_force_with_hot_keys(spark):
    rnd = random.Random(5)
    day = lambda: None if rnd.random() < 0.05 else T0 + timedelta(days=rnd.randrange(20))
    spell = lambda k: rnd.choice([k, k.upper(), f" {k}\t", f"sha256:{k}", f" SHA256:{k}"])
    keys = ["hot"] * 8 + ["a", "b", "c", "d" * 64]
    parents = [(spell(rnd.choice(keys)), day(), day() if rnd.random() < 0.7 else None) for _ in range(60)]
    children = [(i, rnd.choice([None, "", " ", spell(rnd.choice(keys)), spell("none")]), day(), "x", 1) for i in range(400)]
    children += children[:20]  # repeated rows
    want = brute(parents, children)
    assert 20 < len(want) < 380
    for options in ({}, {"hot_rows": 5, "most_segments": 4}, {"hot_rows": 1, "most_segments": 16}):
        rows = find(spark, parents, children, **options).collect()
        assert sorted(r["row_id"] for r in rows) == sorted(want)


def test_empty_tables_and_periods(spark):
    children = [(1, "a", T0, None, None), (2, None, T0, None, None), (3, "b", None, None, None)]
    assert {r["row_id"] for r in find(spark, [], children).collect()} == {1, 3}
    assert find(spark, [("a", T0, None)], []).count() == 0
    report = {(r["period"], r["orphan_rows"]) for r in orphans_by_period(find(spark, [], children)).collect()}
    assert report == {("2026-01", 1), (None, 1)}
