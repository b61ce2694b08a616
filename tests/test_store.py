import random

import pytest
from pyspark.sql import functions as F

from gleanery.functions import normalize as N
from gleanery.functions import rubric as R
from gleanery.operators import relations as J
from gleanery.operators import review as V
from gleanery.streaming import collect, runtime

c = F.col


def col(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(f(c("x"))).collect()]


def test_paths_of_archives(spark):
    bad = [None, "", "/a", "a\\b", "a\x00b", "x/a:b", "c:x", "a/../b", "./a", "a//b", "..", "/"]
    assert col(spark, bad, N.safe_path) == [False] * len(bad)
    assert col(spark, ["a", "a/b.png", "a/", "a//", "a/...x"], N.safe_path) == [True] * 5


def test_redaction(spark):
    secret = ["x token=1", "PAßWORD=q", "ſecret=1", "X-Amz-Signature=ab", "see hf_" + "a" * 16 + " there", "hf_" + "B7" * 10]
    assert col(spark, secret, N.redacted) == ["[redacted-secret]"] * len(secret)
    assert col(spark, ["~/x", "/etc/passwd", "C:\\x", "d:/x"], N.redacted) == ["[redacted-local-path]"] * 4
    plain = ["the token: none", "a /etc/passwd", "hf_short", "xhf_" + "a" * 16, "hf_" + "a" * 16 + "_", "", None]
    assert col(spark, plain, N.redacted) == plain
    assert col(spark, ["y" * 20_000], lambda x: F.length(N.redacted(x))) == [16_384]
    assert col(spark, ["  a ", "  ", None, "z" * 2_000], N.sample_id) == ["a", None, None, "z" * 1_024]


def test_extensions_and_states(spark):
    assert col(spark, ["JPEG2000", "jpeg", "HEIF-X", " ", "", None], N.extension) == ["jp2", "jpg", "heifx", None, None, None]
    with pytest.raises(Exception, match="no safe extension"):
        col(spark, ["--"], lambda x: N.extension(x, strict=True))
    states = ['{"a": {"Token_x": 1}}', '{"a": ["/home/x"]}', '{"a": "password=1"}', "no json", '{"a": [1, "b", null]}', None]
    assert col(spark, states, N.sensitive_state) == [True, True, True, True, False, False]
    assert col(spark, ["images/ab.png", "images/a/b.png", "x/ab.png", "images/../b", None], lambda x: N.contained_path(x, "images")) == [True, False, False, False, False]


def test_priority_and_probabilities(spark):
    df = spark.createDataFrame([("high", 0.1, 0.2, 0.7, 0.7), ("low", 0.7, 0.2, 0.1, 0.7), (None, 0.7, 0.2, 0.1, 0.7)], "m string, a double, b double, c double, p double")
    got = [round(r[0], 9) for r in df.select(R.priority(c("m"), [c("a"), c("b"), c("c")], c("p"), F.lit(None).cast("double"))).collect()]
    assert got == [2.8, 0.8, 0.8]
    close = spark.createDataFrame([(0.5, 0.3, 0.2, 0.500005), (0.5, 0.3, 0.2, 0.50002), (0.5, 0.3, 0.21, 0.5)], "a double, b double, c double, p double")
    assert [r[0] for r in close.select(R.probabilities_consistent([c("a"), c("b"), c("c")], c("p"))).collect()] == [True, False, False]


def test_audited_join(spark):
    images = spark.createDataFrame(
        [("i1", "h1", "readable", "A", "r/images/1.png", "real", "verified"), ("i2", "h2", "readable", "A", "r/2.png", "unknown", "unverified"), ("i2b", "h2", "readable", "B", "r/2b.png", "unknown", "unverified"),
         ("i3", "h3", "invalid_image", "A", "r/3.png", "unknown", "unverified"), ("i4", "h4", "readable", "A", "r/4.png", "unknown", "unverified"), ("i5", "h5", "readable", "A", "r/5.png", "unknown", "unverified"),
         ("i6", "h6", "readable", "A", "r/6.png", "unknown", "unverified"), ("i7", None, "missing", "A", "r/7.png", "unknown", "unverified")],
        "image_id string, content_hash string, file_status string, component string, image_path string, normalized_label string, label_status string",
    )
    entries = spark.createDataFrame(
        [("e1", "h1", "", "A", "images/1.png", "fake", 3), ("e1", "h1", "", "A", "images/1.png", "fake", 3), ("e2", "h2", "", None, None, None, 1), ("e3", "h3", "", None, None, None, 1), ("e4", "h4", "bad", None, None, None, 1),
         ("e5", "h5", "", None, None, None, 1), ("e5b", "h5", "", None, None, None, 1), ("e6", "h6", "", "B", None, None, 1), ("e9", "h9", "", None, None, None, 1), ("e0", None, "", None, None, None, 1)],
        "record_id string, content_hash string, validation_error string, component string, relative_image_path string, normalized_label string, score int",
    )
    results, joined, issues = J.audited_join(images, entries, ["score"])
    assert {r["record_id"]: r["status"] for r in results.collect()} == {
        "e1": "linked", "e2": "ambiguous_image", "e3": "image_integrity_problem", "e4": "invalid_annotation", "e5": "conflicting_annotations",
        "e5b": "conflicting_annotations", "e6": "annotation_metadata_conflict", "e9": "unmatched", "e0": "unmatched",
    }
    got = {r["image_id"]: (r["annotation_join_status"], r["score"], r["normalized_label"], r["label_status"]) for r in joined.collect()}
    assert got["i1"] == ("linked", 3, "unknown", "conflict") and got["i7"] == ("unannotated", None, "unknown", "unverified") and got["i2b"][0] == "ambiguous_image"
    assert sum(v[1] is not None for v in got.values()) == 1 and [r["image_id"] for r in issues.collect()] == ["i1"]


def test_lease_timeline(spark):
    ask = [
        (1, "ann", "reserve", None, 100), (2, "ben", "reserve", None, 105), (3, "ann", "reserve", None, 108), (4, "ann", "renew", 1, 110), (5, "cyd", "reserve", None, 150),
        (6, "cyd", "reserve", None, 171), (7, "ann", "complete", 1, 172), (8, "cyd", "complete", 6, 173), (9, "ben", "renew", 6, 174), (10, "ben", "release", 2, 175), (11, "dan", "reserve", None, 176),
        (12, "dan", "release", 11, 177), (13, "dan", "release", 11, 178), (14, "dan", "dance", None, 179),
    ]
    events = spark.createDataFrame([("q", *x) for x in ask], "queue string, event_id long, person string, op string, token long, at long")
    items = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", None), ("r", "z")], "queue string, item string")
    got = {r["event_id"]: (r["outcome"], r["item"], r["expires"]) for r in V.lease_replay(events, items, 60).collect()}
    assert got[1] == ("granted", "a", 160) and got[2] == ("granted", "b", 165) and got[3] == ("resumed", "a", 160) and got[4] == ("renewed", "a", 170)
    assert got[5] == ("empty", None, None) and got[6] == ("granted", "a", 231) and got[7][0] == "expired" and got[8] == ("completed", "a", None)
    assert got[9][0] == "expired" and got[10][0] == "none" and got[11] == ("granted", "b", 236) and got[12] == ("released", "b", None) and got[13][0] == "none" and got[14][0] == "unknown"
    assert V.lease_replay(events.limit(0), items, 60).count() == 0


def test_review_chain_and_plan(spark):
    t = lambda x: f"2024-01-01 0{x}:00:00"
    o = spark.createDataFrame([("h", "ann", t(1), "k", 1), ("g", "ann", t(1), "k", 1)], "h string, annotator_key string, at string, kept string, x int").withColumn("at", c("at").cast("timestamp"))
    e = spark.createDataFrame(
        [("h", 1, "ben", "confirm", "", t(2), "k", 1), ("h", 2, "ben", "correct", " ", t(3), "k", 2), ("h", 3, "ann", "confirm", "", t(3), "k", 2), ("h", 4, "ben", "confirm", "", t(2), "k", 2), ("h", 5, "ben", "correct", "r", t(4), "k", 0),
         ("h", 6, "ben", "confirm", "", t(5), "k", 1), ("h", 7, "ben", "correct", "r", t(6), "j", 1), ("g", 8, "ben", "drop", "", t(5), "k", 1), ("z", 9, "ben", "confirm", "", t(5), "k", 1)],
        "h string, review_id int, reviewer_key string, action string, reason string, at string, kept string, x int",
    ).withColumn("at", c("at").cast("timestamp"))
    got = {r["review_id"]: r["error"] for r in V.chain_errors(e, o, "h", ["x"]).collect()}
    assert got == {1: None, 2: "missing_reason", 3: "self_review", 4: "time_backward", 5: None, 6: "payload_changed", 7: "payload_changed", 8: "unknown_action", 9: "no_annotation"}
    ret = spark.createDataFrame([("s", 1, "a", "x"), ("s", 2, "b", "y"), ("s", 3, "c", "z"), ("s", 4, "d", "z"), ("s", 5, "e", "z"), ("s", 6, None, "z")], "snapshot_id string, local_review_id int, content_hash string, event_sha256 string")
    imp = spark.createDataFrame([("s", 1, "x", "x"), ("s", 2, "y", "w")], "snapshot_id string, local_review_id int, event_sha256 string, current_sha256 string")
    plan = V.snapshot_plan(ret, imp, spark.createDataFrame([("c",), (None,)], "content_hash string"), spark.createDataFrame([("d",)], "content_hash string"))
    assert {r["local_review_id"]: r["plan"] for r in plan.collect()} == {1: "identical", 2: "conflict_changed", 3: "conflict_reviewed", 4: "conflict_reserved", 5: "pending", 6: "pending"}
    base = spark.createDataFrame([(1, "a", t(1), "x"), (2, "b", t(1), "y"), (3, "c", t(1), "z")], "review_id int, content_hash string, reviewed_at string, event_sha256 string")
    now = spark.createDataFrame([(1, "a", t(1), "x"), (2, "b", t(1), "!"), (4, "d", t(5), "q"), (5, "d", t(5), "q"), (6, "a", t(5), "q"), (7, "f", t(2), "q"), (0, "g", t(5), "q")], "review_id int, content_hash string, reviewed_at string, event_sha256 string")
    errors = {r["review_id"] if r["review_id"] is not None else r["content_hash"]: r["error"] for r in V.snapshot_errors(base, now, F.lit(t(3))).collect()}
    assert errors == {2: "base_changed", 3: "base_changed", 4: None, 5: "re_review", 6: "re_review", 7: "predates_snapshot", 0: "predates_base"}


def test_collected_equals_a_loop(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(160):
        label = rnd.choice(["real", "fake", None])
        rows.append((i, label, None if label else rnd.choice(["missing_label", None]), rnd.random() < 0.1, rnd.random() < 0.1, rnd.choice([None, f"s{rnd.randrange(60)}"]), f"h{rnd.randrange(90)}"))
    quotas, target = {"real": 14, "fake": 20}, 30
    want, ids, hashes, n = {}, set(), set(), {"real": 0, "fake": 0}
    for i, label, problem, broken, excluded, s, h in rows:
        if sum(n.values()) >= target or all(n[k] >= q for k, q in quotas.items()):
            want[i] = "not_read"
        elif problem or label is None:
            want[i] = problem or "unsupported_label"
        elif n[label] >= quotas[label]:
            want[i] = f"quota_{label}_reached"
        elif broken or excluded:
            want[i] = "invalid_image" if broken else "excluded"
        elif s in ids or h in hashes:
            want[i] = "duplicate"
        else:
            want[i] = "accepted"
            n[label] += 1
            ids |= {s} - {None}
            hashes.add(h)
    df = spark.createDataFrame(rows, "i int, label string, problem string, broken boolean, excluded boolean, s string, h string")
    got = {r["i"]: r["outcome"] for r in collect.collected(df, [c("s"), c("h")], "label", ["i"], quotas, target).collect()}
    assert got == want and len(set(want.values())) >= 7


def test_run_of_a_collection(tmp_path):
    now = [0.0]
    waits = []
    clock = lambda: now[0]
    sleep = lambda s: (waits.append(s), now.__setitem__(0, now[0] + s))
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 4:
            raise OSError("away")
        return "here"

    assert runtime.retried(flaky, 5, 1, 3, None, sleep) == "here" and waits == [1, 2, 3]
    with pytest.raises(ValueError):
        runtime.retried(lambda: int("x"), 5, 1, 3, None, sleep)
    with pytest.raises(OSError):
        runtime.retried(lambda: open(tmp_path / "none"), 9, 4, 9, runtime.Deadline(10, 2, clock), sleep)
    published, seen = [], []

    def step():
        seen.append(1)
        now[0] += 1
        return {"real": len(seen), "fake": 0} if len(seen) < 8 else None

    done = lambda counts: collect.complete(counts, {"real": 5, "fake": 1}, 99)
    assert runtime.run_collection(step, done, runtime.Deadline(100, 1, clock), lambda x: published.append(x["real"]), 3) == ("source_exhausted", {"real": 7, "fake": 0})
    assert published == [3, 6, 7]
    seen.clear()
    assert runtime.run_collection(step, lambda x: collect.complete(x, {"real": 2}, 99), runtime.Deadline(100, 1, clock))[0] == "quotas_reached"
    assert runtime.run_collection(step, done, runtime.Deadline(2, 1, clock))[0] == "runtime_safety_buffer"
    d = runtime.Deadline(9, 1, clock)
    d.stop("sigterm")
    assert runtime.run_collection(step, done, d)[0] == "shutdown_sigterm"
    assert runtime.guard_resume(str(tmp_path / "run"), "a", False) is False and runtime.guard_resume(str(tmp_path / "run"), "a", True) is True
    for fingerprint, resume in (("b", True), ("a", False)):
        with pytest.raises(ValueError):
            runtime.guard_resume(str(tmp_path / "run"), fingerprint, resume)


def test_joins_with_conditions(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "k string, v int")
    b = spark.createDataFrame([("x", 1), ("z", 2)], "k string, v int")
    with pytest.raises(Exception, match="overlap: x"):
        J.none_in_common(a, b, "k", "overlap").collect()
    assert J.none_in_common(a, b.filter("k = 'z'"), "k", "overlap").count() == 3
    assert sorted((r["k"], r["same"]) for r in J.compared_runs(a.filter("k is not null"), b, "k", ["v"]).collect()) == [("x", True), ("y", False), ("z", False)]
    with pytest.raises(Exception, match="repeated key: x"):
        J.with_details(a, b.union(b), "k", ["v"]).collect()
    who = spark.createDataFrame([("x", "ann"), ("x", "ben"), ("y", "ann"), ("z", None)], "k string, p string")
    ask = spark.createDataFrame([("x",), ("y",), ("z",), (None,)], "k string").withColumn("p", F.lit("ann"))
    assert {r["k"]: r["other"] for r in J.has_other(ask, who, "k", "p", "other").collect()} == {"x": True, "y": False, "z": False, None: False}
