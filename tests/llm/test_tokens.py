import random

import pytest

from gleanery.llm import tokens as T

ATOMS = ["a", " ", "  ", "\n", "\t", "the", " the", "'s", "'re", "'", "é", "日", "1", "..", "-", "\xa0", " ", "🙂", "ÃÂ", "\x1c", "\x85", "re"]


@pytest.fixture(scope="module")
def vocab():
    return T.vocabulary()


def test_lookahead_of_a_small_list():
    # ab joins first; then b can be taken from a by a later "bc" only where no ab is: one byte; cab adds c
    assert T.lookahead({b"a": 0, b"b": 1, b"c": 2}) == 1
    assert T.lookahead({b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"cab": 4}) == 2


def test_chunks_give_the_ids_of_the_whole(vocab):
    rnd = random.Random(1)
    for i in range(150):
        s = "".join(rnd.choice(ATOMS) * rnd.choice([1, 1, 1, 5, 40]) for _ in range(rnd.randrange(25)))
        if i % 3 == 0:
            s += rnd.choice(ATOMS) * rnd.randrange(3000) + s
        want = vocab.bpe.encode_ordinary(s)
        for chunk in (7, 64, 900):
            assert T.encode(vocab, s, chunk) == want


def test_memory_stays_bounded_in_one_endless_piece(vocab):
    e, ids = T.Encoder(vocab, 1 << 12), []
    for _ in range(200):
        ids += e.feed("=" * 4096)
        assert len(e.text) + (len(e.open[1]) if e.open else 0) < 20_000
    ids += e.finish()
    assert "".join(vocab.bytes[i].decode() for i in ids) == "=" * (200 * 4096)


def test_decoder_waits_for_whole_characters(vocab):
    d = T.Decoder(vocab)
    out = [d.feed([i]) for i in vocab.bpe.encode_ordinary("🙂é日")]
    assert "".join(out) + d.finish() == "🙂é日" and "�" not in "".join(out)


def test_table(spark):
    rows = [(1, "Hello world", 9), (2, "", 9), (3, None, 9), (4, "x" * 200_000, 9), (4, "x", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted((r["doc_id"], len(r["ids"])) for r in T.token_ids(df, "doc_id", "text").collect())
    assert got[:3] == [(1, 2), (2, 0), (3, 0)] and got[3] == (4, 1)
    back = {r["doc_id"]: r["text"] for r in T.decoded(T.token_ids(df.limit(4), "doc_id", "text"), "doc_id", "ids").collect()}
    assert back == {1: "Hello world", 2: "", 3: "", 4: "x" * 200_000}
    assert T.token_ids(df.limit(0), "doc_id", "text").count() == 0
