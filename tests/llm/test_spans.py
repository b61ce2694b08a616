import random

import pytest

from gleanery.llm import spans as S


def brute(texts, length):
    w = {i: {t[k : k + length] for k in range(len(t) - length + 1)} for i, t in texts if t}
    return {(i, j) for i in w for j in w if i < j and w[i] & w[j]}


def make(seed):
    rnd = random.Random(seed)
    alphabet = "ab é🙂\n"
    passages = ["".join(rnd.choice(alphabet) for _ in range(n)) for n in (19, 20, 21, 35, 60)] + ["-" * 50, "ab" * 40]
    texts = [(i, "".join(rnd.choice([rnd.choice(passages), rnd.choice(alphabet) * rnd.randrange(9)]) for _ in range(rnd.randrange(6)))) for i in range(60)]
    hot = "".join(rnd.choice(alphabet) for _ in range(70))
    texts += [(100 + i, hot) for i in range(15)]  # copies
    return texts + [(200, None), (201, ""), (202, "x" * 19), (203, "x" * 20), (204, "yx" + "x" * 20)]


@pytest.mark.parametrize("chars", [1 << 20, 64])
def test_pairs_against_brute_force(spark, monkeypatch, chars):
    monkeypatch.setattr(S, "CHARS", chars)
    texts = make(chars)
    df = spark.createDataFrame([(i, t, "c") for i, t in texts], "doc_id long, text string, cls string")
    got = [tuple(r) for r in S.sharing_pairs(df, "doc_id", "text", 20).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts, 20) and len(got) > 200


def test_long_texts_are_cut_with_overlap():
    text = "".join(chr(97 + (i * 7919) % 26) for i in range(5000))
    S_chars, S.CHARS = S.CHARS, 300
    try:
        import pyarrow as pa

        seen = []
        for ids, texts in S._stretches([pa.RecordBatch.from_pydict({"i": [1], "t": [text]})], 20):
            w = S.windows(texts, 20)
            seen += [int(o) + ids[d][2] for o, d in zip(w.offset, w.doc)]
        assert sorted(seen) == list(range(5000 - 19))
    finally:
        S.CHARS = S_chars


def test_share(spark):
    p = "0123456789abcdefghijKLMNO"
    rows = [(1, "xx" + p + "yy"), (2, p), (3, "none of it at all, really"), (4, ""), (5, None), (6, p + "|" + p)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_chars"], r["shared_chars"]) for r in S.shared_share(df, "doc_id", "text", 20).collect()}
    assert got == {1: (29, 25), 2: (25, 25), 3: (25, 0), 4: (0, 0), 5: (None, None), 6: (51, 50)}
    assert S.sharing_pairs(df.limit(0), "doc_id", "text", 20).count() == 0
    assert S.shared_share(df.limit(0), "doc_id", "text", 20).count() == 0
