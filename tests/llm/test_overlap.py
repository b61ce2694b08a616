import random
import re

from pyspark.sql import functions as F

from gleanery.functions.cleaning import cleaned, cleaned_hash
from gleanery.llm import overlap

SCHEMA = "assignment_id long, content_hash string, role string, split_seed int, prompt string, cls string, id int"


def records(df):
    return overlap.records(
        df, row_id="assignment_id", group=F.col("split_seed"), split=cleaned("role"), key=cleaned_hash("content_hash"), text=F.col("prompt"),
        evaluation=["gold_development", "gold_test"], training=["unassigned"],
    )


def brute(rows):
    def shingles(p):
        w = re.findall("[a-z0-9]+", (p or "").lower())
        return set(zip(w, w[1:], w[2:]))

    clean = lambda h: (h or "").strip(" \t").lower().removeprefix("sha256:")
    out = set()
    for i, h, r, s, p, *_ in rows:
        for j, g, q, t, o, *_ in rows:
            if s == t and s is not None and (r or "").strip().lower() in ("gold_test", "gold_development") and (q or "").strip().lower() == "unassigned":
                a, b = shingles(p), shingles(o)
                if (clean(h) and clean(h) == clean(g)) or (a and b and 5 * len(a & b) >= 3 * len(a | b)):
                    out.add((i, j))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(2)
    words = ["red", "blue", "cat", "dog", "on", "a", "mat", "of", "tin", "sun"]
    prompts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(2, 14))) for _ in range(6)]
    rows = []
    for i in range(220):
        p = rnd.choice([None, "", "8k", "hot hot prompt of all", *prompts])
        if p and rnd.random() < 0.5:
            w = p.split()
            w[rnd.randrange(len(w))] = rnd.choice(words)
            p = ", ".join(w).upper()
        rows.append((i, rnd.choice([None, "", f"h{i % 30}", f" SHA256:H{i % 30}"]), rnd.choice(["gold_test", "Gold_Development ", "unassigned", " UNASSIGNED", None]), rnd.choice([20, 42, None]), p, "x", 1))
    rows += rows[:10]
    got = {tuple(r) for r in overlap.overlapping_pairs(records(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == brute(rows) and len(got) > 20


def test_empty_and_counts(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert overlap.overlapping_pairs(records(none)).count() == 0
    rows = [(1, "a", "gold_test", 1, "one two three", "", 0), (2, "b", "gold_test", 1, None, "", 0), (3, "A", "unassigned", 1, "One, two - three", "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = overlap.overlap_counts(records(df), df.select(F.col("assignment_id").alias("id"), F.lit("s").alias("source"))).collect()
    assert [tuple(r) for r in got] == [("gold_test", "s", 2, 1, 1, 1)]
