import random

from pyspark.sql import functions as F

from gleanery.streaming.changefeed import apply_files, review_sequence

SCHEMA = "feed_pos long, change_no long, change_op string, review_id long, reviewed_at string, version int, seq string"


def run(spark, tmp_path, parts, **options):
    path = str(tmp_path / "feed.parquet")
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    got = apply_files(spark, path, key="review_id", sequence=review_sequence, op=lambda: F.col("change_op"), payload=["change_no", "version", "seq"], **options)
    return {r["review_id"]: r["change_no"] for r in got.collect()}


def brute(rows):
    seen, state = {}, {}
    for r in rows:
        if r[3] is not None and r[4] and r[4][-1] == "Z" and (r[2] or "").strip().lower()[:1] in ("i", "u", "d"):
            seen[r[1]] = r
    for r in sorted(seen.values(), key=lambda r: (r[4].replace(" ", "T"), r[1])):
        op = r[2].strip().lower()[0]
        if op == "d":
            state.pop(r[3], None)
        elif op == "i" or r[3] in state:
            state[r[3]] = r[1]
    return state


def test_against_sequential_replay_in_any_order(spark, tmp_path):
    rnd = random.Random(3)
    rows = []
    for n in range(300):
        op = rnd.choice(["insert", " I", "upd", "Update", "d", "DELETE "])
        at = f"2026-01-01{rnd.choice('T ')}00:00:{rnd.randrange(30):02d}Z"
        rows.append((n, n, op, 1 if rnd.random() < 0.3 else rnd.randrange(25), at, 1, "x"))
    rows += rnd.sample(rows, 80)  # repeated deliveries
    rows += [(900, 900, "i", None, "2026-01-01T00:00:59Z", 1, "x"), (901, 901, "d", 1, "2026-01-01T00:00:59", 1, "x"), (902, 902, None, 1, "2026-01-01T00:01:00Z", 1, "x"), (903, 903, "d", 1, None, 1, "x")]
    rnd.shuffle(rows)
    want = brute(rows)
    assert 5 < len(want) < 26
    assert run(spark, tmp_path, [rows[:100], rows[100:250], rows[250:]], bytes_per_trigger=1) == want  # a micro-batch per file


def test_late_insert_revives_update(spark, tmp_path):
    early = [(1, 2, "u", 7, "2026-01-01T00:00:02Z", 1, "x")]
    late = [(2, 1, "i", 7, "2026-01-01T01:00:01+01:00", 1, "x")]
    assert run(spark, tmp_path, [early, late], bytes_per_trigger=1) == {7: 2}


def test_empty_feed(spark, tmp_path):
    assert run(spark, tmp_path, [[]]) == {}
