"""Encoding of a corpus by a public byte-level BPE, as a transducer with bounded lookahead.

Text is fed in chunks; tokens are emitted as soon as no further text can change them, so that the memory
held for a text doesn't depend on its length.  Two things can still change:

* the *pieces* the split pattern makes.  A piece is final once three more characters are seen; between
  a printing character and a blank or line feed there is a boundary whatever comes before or after.
* the *tokens of an unfinished piece*.  Appended bytes change merges at the end first, and each merge
  rule can carry a difference to the left by the length of its left part at most, to be taken up by a
  later rule whose right part begins with that left part.  :func:`lookahead` follows these chains
  through the merge list; tokens that end at least so many bytes before the end are stable.

Decoding is the reverse machine: bytes of tokens go in, characters come out once complete.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the split pattern published with this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CLASSES = {"letter": r"\p{L}+", "number": r"\p{N}+", "other": r"[^\s\p{L}\p{N}]+", "space": r"\s+"}
PIECE_LOOKAHEAD = 3
CHUNK = 1 << 8  # characters a feed; below the length of most documents


def lookahead(ranks: dict[bytes, int]) -> int:
    """Bytes after which a token of an unfinished piece is stable: the longest chain of rules.

    Rules are taken from the last rank to the first; ``reach[x]`` is the longest way to the left that
    begins with a later rule whose right part begins with ``x``.  Every split of a token into two
    earlier tokens counts as a rule.
    """
    reach: dict[bytes, int] = {}
    longest = 1
    for rank, token in sorted(((r, t) for t, r in ranks.items() if len(t) > 1), reverse=True):
        found = []
        for i in range(1, len(token)):
            left, right = token[:i], token[i:]
            if all(x in ranks and (len(x) == 1 or ranks[x] < rank) for x in (left, right)):
                found.append((right, len(left) + reach.get(left, 0)))
        for right, far in found:
            longest = max(longest, far)
            for j in range(1, len(right) + 1):
                if (x := right[:j]) in ranks and far > reach.get(x, 0):
                    reach[x] = far
    return longest


class Vocabulary:
    """Ranks of a file of base64 tokens, their lookahead, and the encoder of whole pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.bytes = {r: t for t, r in self.ranks.items()}

    @property
    def lookahead(self) -> int:
        if not hasattr(self, "_lookahead"):
            self._lookahead = lookahead(self.ranks)
        return self._lookahead

    def piece(self, data: bytes) -> list[int]:
        return self.bpe._encode_single_piece(data)


@lru_cache(maxsize=4)
def vocabulary(folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> Vocabulary:
    """The vocabulary ``name``; read once per Python worker."""
    return Vocabulary(f"{folder}/{name}.tiktoken")


class Encoder:
    """Feed a text in chunks and take the ids that are final; :meth:`finish` gives the rest."""

    def __init__(self, vocab: Vocabulary, held: int = 1 << 16):
        self.vocab, self.held = vocab, max(held, 64)
        self.text = ""
        self.open: tuple[str, bytes] | None = None  # class and remaining bytes of a piece that goes on

    def feed(self, chunk: str) -> list[int]:
        self.text += chunk
        out = self._continue() if self.open else []
        if not self.open and (cut := _safe_cut(self.text)):
            out += self.vocab.bpe.encode_ordinary(self.text[:cut])
            self.text = self.text[cut:]
        if not self.open and len(self.text) > self.held:
            out += self._pieces()
        return out

    def finish(self) -> list[int]:
        out = []
        if self.open:
            out = self._continue(last=True)
        out += self.vocab.bpe.encode_ordinary(self.text)
        self.text = ""
        return out

    def _pieces(self) -> list[int]:
        """No boundary is certain by itself: split by the pattern, and open the piece at the end."""
        out, at = [], 0
        for m in regex.finditer(PATTERN, self.text):
            if m.end() + PIECE_LOOKAHEAD > len(self.text):
                break
            out += self.vocab.piece(m.group().encode())
            at = m.end()
        self.text = self.text[at:]
        if len(self.text) > self.held:
            last = self.text[-PIECE_LOOKAHEAD - 1]
            kind = next(k for k, p in CLASSES.items() if regex.match(p, last))
            start = 1 if kind != "space" and self.text[0] == " " else 0
            run = regex.match(CLASSES[kind], self.text, pos=start).end()
            run -= kind == "space"  # the last blank of a run may go with what follows
            self.open = (kind, self.text[:run].encode())
            self.text = self.text[run:]
            out += self._stable()
        return out

    def _stable(self) -> list[int]:
        kind, data = self.open
        out, used = [], 0
        for t in self.vocab.piece(data):
            n = len(self.vocab.bytes[t])
            if used + n > len(data) - self.vocab.lookahead:
                break
            out.append(t)
            used += n
        self.open = (kind, data[used:])
        return out

    def _continue(self, last: bool = False) -> list[int]:
        kind, data = self.open
        m = regex.match(CLASSES[kind], self.text)
        run = m.end() if m else 0
        ends = last or run < len(self.text)
        if kind == "space" and run and not (last and run == len(self.text)):
            run -= 1  # \s+(?!\S): before a printing character the run gives up its last blank
        self.open = (kind, data + self.text[:run].encode())
        self.text = self.text[run:]
        if ends:
            out = self.vocab.piece(self.open[1])
            self.open = None
            return out
        return self._stable() if len(self.open[1]) > self.held else []


def _safe_cut(text: str) -> int:
    """The last place between a printing ASCII character and a blank or line feed; 0 if there is none."""
    at = len(text)
    while (at := max(text.rfind(" ", 0, at), text.rfind("\n", 0, at))) > 0:
        if "!" <= text[at - 1] <= "~":
            return at
    return 0


class Decoder:
    """Feed ids and take the characters that are complete; broken bytes come out as U+FFFD at the end."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.machine = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: list[int]) -> str:
        return self.machine.decode(b"".join(self.vocab.bytes[i] for i in ids))

    def finish(self) -> str:
        return self.machine.decode(b"", final=True)


def encode_stream(vocab: Vocabulary, text: str, chunk: int = CHUNK) -> Iterator[list[int]]:
    """The ids of one text, in the order and the portions in which they become final."""
    e = Encoder(vocab, chunk)
    for i in range(0, len(text), chunk):
        yield e.feed(text[i : i + chunk])
    yield e.finish()


def encode(vocab: Vocabulary, text: str, chunk: int = CHUNK) -> list[int]:
    return [t for part in encode_stream(vocab, text, chunk) for t in part]


def token_ids(df: DataFrame, row_id: str, text: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """``(row_id, ids)`` of every row; an empty and a null text have the empty list.

    One narrow pass: no shuffle, only the two columns are read, each worker loads the vocabulary once.
    """
    id_type = df.schema[row_id].dataType.simpleString()

    def run(batches):
        vocab = vocabulary(folder, name)
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                part = b.slice(s, 1024)
                ids = [np.fromiter((t for p in encode_stream(vocab, x) for t in p), np.int32) if x else _NONE for x in part.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else _NONE))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[row_id, "ids"])

    return df.select(row_id, text).mapInArrow(run, f"`{row_id}` {id_type}, ids array<int>")


def token_counts(df: DataFrame, row_id: str, text: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """``(row_id, n_tokens)``; 0 for an empty and a null text."""
    return token_ids(df, row_id, text, folder, name).select(row_id, F.size("ids").alias("n_tokens"))


def decoded(df: DataFrame, row_id: str, ids: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """``(row_id, text)`` back from ids, fed to the decoder in portions; null ids give null."""
    id_type = df.schema[row_id].dataType.simpleString()

    def one(vocab: Vocabulary, x: list[int], portion: int = 4096) -> str:
        d = Decoder(vocab)
        return "".join([d.feed(x[i : i + portion]) for i in range(0, len(x), portion)]) + d.finish()

    def run(batches):
        vocab = vocabulary(folder, name)
        for b in batches:
            texts = [None if x is None else one(vocab, x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[row_id, "text"])

    return df.select(row_id, ids).mapInArrow(run, f"`{row_id}` {id_type}, text string")


_NONE = np.zeros(0, np.int32)
