import random

from gleanery.streaming import collect
from gleanery.streaming.runtime import stream_files

SCHEMA = "pos int, k string, l string"


def sequential(data, quotas, target):
    seen, n, out = set(), dict.fromkeys(quotas, 0), []
    for i, k, lb in data:
        if len(out) < target and lb in quotas and n[lb] < quotas[lb] and k is not None and k not in seen:
            seen.add(k)
            n[lb] += 1
            out.append(i)
    return out


def test_collection_equals_the_loop_even_for_keys_under_two_labels(spark, tmp_path):
    rnd = random.Random(7)
    data = [(i, rnd.choice([None] + [f"k{x}" for x in range(50)]), rnd.choice(["real", "fake", "odd"])) for i in range(240)]
    for quotas, target in (({"real": 8, "fake": 12}, 18), ({"real": 3, "fake": 40}, 99)):
        at = tmp_path / f"in{target}.parquet"
        for p in range(3):
            spark.createDataFrame(data[p * 80 : p * 80 + 80], SCHEMA).coalesce(1).write.mode("append").parquet(str(at))
        out = str(tmp_path / f"out{target}")
        # the files are taken in order of their time
        collect.collect_stream(stream_files(spark, str(at), 1), out, key="k", label="l", order=["pos"], quotas=quotas, target=target)
        assert sorted(r["pos"] for r in spark.read.parquet(out).collect()) == sequential(data, quotas, target)


def test_distinct_keys(spark, tmp_path):
    at = str(tmp_path / "k.parquet")
    spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, None, "x")], SCHEMA).write.parquet(at)
    assert sorted((r["k"] or "") for r in collect.distinct_keys(stream_files(spark, at), ["k"]).collect()) == ["", "a"]
