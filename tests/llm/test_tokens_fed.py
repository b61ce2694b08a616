import random

from gleanery.llm import tokens as T


def test_every_text_is_fed(monkeypatch):
    vocab, rnd, fed, early = T.vocabulary(), random.Random(3), [], 0
    feed = T.Encoder.feed
    monkeypatch.setattr(T.Encoder, "feed", lambda self, chunk: fed.append(len(chunk)) or feed(self, chunk))
    for n in (1, 40, 400, 5_000, 30_000):
        for atoms in (["word", " ", "\n", "é"], ["日本", "語"], ["=", "=="], ["ab", "c"]):
            text = "".join(rnd.choice(atoms) for _ in range(n))
            fed.clear()
            parts = list(T.encode_stream(vocab, text))
            assert sum(fed) == len(text) and max(fed) <= T.CHUNK
            assert [t for p in parts for t in p] == vocab.bpe.encode_ordinary(text)
            assert n < 5_000 or sum(map(len, parts[:-1])) > 0.8 * sum(map(len, parts))  # most ids come before the end
