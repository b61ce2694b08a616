import random

from gleanery.plans import reference
from gleanery.streaming import collect


def test_state_goes_from_batch_to_batch(spark, tmp_path, monkeypatch):
    rnd, data, left = random.Random(8), [], []
    for b in range(1, 11):
        for p in range(1, 141):
            data.append((b, p, f"{rnd.randrange(1100):064x}", rnd.choice(["real", "real", "fake"])))  # keys under two labels, too
    shuffled = rnd.sample(data, len(data))
    spark.createDataFrame(shuffled, "batch_no int, stream_position long, content_hash string, normalized_label string").repartition(3).write.parquet(f"{tmp_path}/collection_manifest.parquet")
    want, seen, n = [], set(), {"real": 0, "fake": 0}
    for b, p, k, lb in data:
        if len(want) < 800 and n[lb] < {"real": 400, "fake": 500}[lb] and k not in seen:
            seen.add(k)
            n[lb] += 1
            want.append((b, p, lb))
    accept = collect.accept
    monkeypatch.setattr(collect, "accept", lambda rows, key, label, order, places, target: left.append((dict(places), target)) or accept(rows, key, label, order, places, target))
    got = reference.QUERIES["r04_stream_quota"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == want
    assert len(left) == 5 and left[0] == ({"real": 400, "fake": 500}, 800)
    assert all(a[1] > b[1] for a, b in zip(left, left[1:]))  # places taken by earlier micro-batches are gone
