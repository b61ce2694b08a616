import random
import re

import pytest
from pyspark.sql import functions as F

from gleanery.functions.cleaning import cleaned_hash
from gleanery.llm import history as H
from gleanery.session import materialize, scratch

SCHEMA = "record_id long, batch_no int, stream_position long, content_hash string, source_dataset string, sample_id string, prompt string, rid int, keys string"


def prepared(spark, rows):
    c = F.col
    sample = F.nullif(F.btrim("sample_id"), F.lit(""))
    return H.prepared(
        spark.createDataFrame(rows, SCHEMA), row_id=c("record_id"), order=[c("batch_no"), c("stream_position")],
        keys=[H.exact_key("hash", cleaned_hash("content_hash")), H.exact_key("sample", c("source_dataset"), sample)], text=c("prompt"), keep=["batch_no"],
    )


def refused(spark, rows, excluded, store=None):
    ex = spark.createDataFrame([(x,) for x in excluded], "h string").select(H.exact_key("hash", cleaned_hash("h")).alias("key"))
    return sorted(r["rid"] for r in H.refused_records(prepared(spark, rows), "batch_no", ex, store).collect())


def brute(rows, excluded):
    hashes, samples, sets, out = set(), set(), [], []
    for r in sorted(set(rows), key=lambda r: (r[1] is not None, r[1], r[2])):
        h, s = (r[3] or "").strip().lower().removeprefix("sha256:"), (r[5] or "").strip()
        w = re.findall("[a-z0-9]+", (r[6] or "").lower())
        sh = set(zip(w, w[1:], w[2:]))
        if h in excluded or (h and h in hashes) or (s and (r[4], s) in samples) or any(5 * len(sh & x) >= 3 * len(sh | x) for x in sets if sh):
            out.append(r[0])
            continue
        hashes |= {h} - {""}
        samples |= {(r[4], s)} if s else set()
        sets += [sh] if sh else []
    return sorted(out)


def make(seed, n, batches=5, words="red blue cat dog on a mat of tin sun under over".split(), longest=16):
    rnd = random.Random(seed)
    prompts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(3, longest))) for _ in range(30)]
    rows = []
    for i in range(n):
        p = rnd.choice([None, "", "uhd", "one hot prompt of all", *prompts, " ".join(rnd.choice(words) for _ in range(9))])
        if p and rnd.random() < 0.5:
            w = p.split()
            w[rnd.randrange(len(w))] = rnd.choice(words)
            p = ", ".join(w)
        rows.append((i, rnd.choice([None, *range(1, batches)]), i, rnd.choice([None, "", f"h{rnd.randrange(150)}", f"SHA256:H{rnd.randrange(150)} "]), rnd.choice(["A", "B"]), rnd.choice([None, " ", f"s{rnd.randrange(99)}", f" s{rnd.randrange(99)}"]), p, 1, "x"))
    return rows + rows[:6]


def test_against_one_by_one(spark):
    rows, excluded = make(4, 120, 3), ["h1", "h2"]
    want = brute(rows, excluded)
    assert 30 < len(want) < 115
    assert refused(spark, rows, excluded) == want


def test_one_batch_and_long_texts(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(*r[:1], 1, *r[2:]) for r in make(9, 90, words=words, longest=260)]
    assert refused(spark, rows, []) == brute(rows, [])


def test_empty(spark):
    assert refused(spark, [], ["h1"]) == []
    assert refused(spark, [(1, 1, 1, "a", "A", None, None, 1, "")], []) == []


def test_store_is_closed_opened_and_ingests_run_again(spark):
    rows = [r for r in make(7, 100, 4) if r[1] is not None]
    path = scratch(spark, "kept")
    H.History.create(spark, path, 3)
    got = {}
    for n in range(1, 4):
        store = H.History.open(spark, path)
        batch = materialize(prepared(spark, [r for r in rows if r[1] == n]).drop("batch_no"), "batch")
        if n == 2:  # one that breaks off before its commit leaves nothing
            broken = H.History.open(spark, path)
            broken._write_commit = lambda: (_ for _ in ()).throw(RuntimeError("the driver died"))
            with pytest.raises(RuntimeError):
                broken.ingest(batch, "2")
            store = H.History.open(spark, path)
        got[n] = sorted(r["rid"] for r in store.ingest(batch, str(n)).collect())
        version = store.state["version"]
        again = H.History.open(spark, path)
        assert sorted(r["rid"] for r in again.ingest(batch, str(n)).collect()) == got[n] and again.state["version"] == version
    assert sorted(x for v in got.values() for x in v) == brute(rows, [])


def test_template_that_appears_late(spark, monkeypatch):
    monkeypatch.setattr(H, "HOT", 12)
    rnd = random.Random(2)
    fresh = lambda: " ".join(f"v{rnd.randrange(10**6)}" for _ in range(9))
    rows = [(i, 1, i, None, "A", None, fresh(), 1, "x") for i in range(20)]
    rows += [(100 + i, 2, i, None, "A", None, f"the one template {fresh()}", 1, "x") for i in range(40)]
    rows += [(200 + i, 3, i, None, "A", None, f"the one template {fresh()}" if i % 4 else rows[25 + i][6], 1, "x") for i in range(20)]
    store = H.History.create(spark, scratch(spark, "late"), 3)
    fits = []
    fit = store._fit
    monkeypatch.setattr(store, "_fit", lambda batch: fits.append(1) or fit(batch))
    assert refused(spark, rows, [], store) == brute(rows, [])
    assert len(fits) == 2


def test_what_is_read_follows_the_batch_not_the_history(spark):
    rnd = random.Random(5)
    fresh = lambda: " ".join(f"v{rnd.randrange(10**6)}" for _ in range(12))
    rows = [(1000 * b + i, b, i, f"h{b}x{i}", "A", None, fresh(), 1, "x") for b in range(1, 9) for i in range(60)]
    store = H.History.create(spark, scratch(spark, "read"), 3)
    assert refused(spark, rows, [], store) == []
    first, last = store.stats[2], store.stats[-1]
    assert last["history_prints"] > 2 * first["history_prints"]
    assert last["read"] < 0.2 * last["history_prints"]
