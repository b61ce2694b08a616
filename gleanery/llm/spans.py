"""Exact runs of code points that stand in more than one text.

Every window of ``length`` code points is represented by one *anchor*, the least of the hashes of the
half as long windows inside it.  The choice depends on the window's content alone, so equal windows have
equal anchors, and there are about thirty times fewer anchors than windows.

1. Each partition counts its anchors' documents in a count-min sketch; the partitions' sketches are
   merged.  A sketch only ever overestimates, so an anchor it calls unrepeated is unrepeated.
2. A second pass over the texts emits the windows of anchors that are estimated repeated, and groups
   them exactly, by 128 bits of hash of the whole window.

Windows that stand in the same set of texts are as many witnesses of the same pairs, so groups are
first merged by a digest of that set.  Texts that are copies of each other are one class until the end.
No text leaves its partition and no group is gathered into one place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.session import materialize

U = np.uint64
ROWS = 2
BLOCK_BITS = 20
CHARS = 1 << 20  # code points that are hashed at a time
FLUSH = 1 << 22  # anchors that a partition holds before it sends them counted


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Rolling:
    """Hashes of all windows of an array of code points, by prefix sums of powers modulo 2^64."""

    def __init__(self, base: int, salt: int):
        self.base, self.salt, self.size = base, U(salt), 0

    def _powers(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                p = np.full(self.size + 1, b, U)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def prefix(self, chars: np.ndarray) -> np.ndarray:
        self._powers(len(chars))
        out = np.zeros(len(chars) + 1, U)
        np.cumsum(_mix(chars.astype(U) + self.salt) * self.up[: len(chars)], out=out[1:])
        return out

    def at(self, prefix: np.ndarray, starts: np.ndarray | slice, k: int) -> np.ndarray:
        if isinstance(starts, slice):
            n = len(prefix) - k
            return _mix((prefix[k:] - prefix[:n]) * self.down[:n])
        return _mix((prefix[starts + k] - prefix[starts]) * self.down[starts])


# created once per process; powers grow to the longest text seen
_FIRST, _SECOND = _Rolling(0x9E3779B97F4A7C15, 0x1B873593), _Rolling(0xD1342543DE82EF95, 0x5BD1E995)


@dataclass
class Windows:
    """The windows of a stretch of texts: ``start`` and ``doc`` (number of the text) of each, the number of its
    anchor among ``anchor_hash`` / ``anchor_doc``, and the prefix sums to hash windows with."""

    start: np.ndarray
    doc: np.ndarray
    offset: np.ndarray
    anchor: np.ndarray
    anchor_hash: np.ndarray
    anchor_doc: np.ndarray
    chars: np.ndarray
    length: int

    def keys(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = self.start[which]
        return tuple(r.at(r.prefix(self.chars), s, self.length).view(np.int64) for r in (_FIRST, _SECOND))


def windows(texts: list[str], length: int) -> Windows:
    """All windows of ``length`` code points that lie within one of the texts."""
    k = (length + 1) // 2
    span = length - k + 1  # anchors to choose from
    sizes = np.array([len(t) for t in texts], np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(texts)), sizes)
    begin = (ends - sizes)[doc]
    n = len(chars) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return Windows(none, none, none, none, np.zeros(0, U), none, chars, length)
    inside = np.arange(n) + length <= ends[doc[:n]]
    h = _FIRST.at(_FIRST.prefix(chars), slice(None), k)
    # the hash's upper 40 bits and the place: ties go to the left, as they do in every copy
    key = (h & U(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=U)
    pad = -len(key) % span
    grid = np.concatenate([key, np.full(pad, ~U(0))]).reshape(-1, span)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[:n], left[span - 1 : span - 1 + n])
    start = np.flatnonzero(inside)
    where = (least[start] & U(0xFFFFFF)).astype(np.int64)
    new = np.r_[True, where[1:] != where[:-1]] if len(where) else np.zeros(0, bool)
    place = where[new]
    return Windows(start, doc[start], start - begin[start], np.cumsum(new) - 1, h[place], doc[place], chars, length)


def _stretches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[list, list[str]]]:
    """Row ids and texts of at least ``length``, some :data:`CHARS` at a time; a longer text is cut into
    stretches that overlap by ``length - 1``, so that each window is in exactly one."""
    ids, texts, held = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if t is None or len(t) < length:
                continue
            step = CHARS - length + 1
            for at in range(0, len(t) - length + 1, step):
                part = t[at : at + CHARS] if len(t) > CHARS else t
                ids.append((i, t, at))
                texts.append(part)
                held += len(part)
                if held >= CHARS:
                    yield ids, texts
                    ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (_mix(hashes + U(row * 0x9E3779B9 + 1)) >> U(64 - bits)).astype(np.int64)


def repeated_anchors(docs: DataFrame, row_id: str, text: str, length: int, bits: int) -> list[np.ndarray]:
    """For each sketch row the packed bits of the cells that count two or more documents.

    A counter need not go beyond two.  What a partition sends is its non-empty blocks, compressed; what comes
    to the driver is ``ROWS x 2^bits / 8`` bytes, whatever the size of the corpus.
    """
    block = 1 << min(BLOCK_BITS, bits)

    schema = pa.schema([("r", pa.int32()), ("b", pa.int32()), ("one", pa.binary()), ("two", pa.binary())])

    def blocks(hashes: np.ndarray) -> pa.RecordBatch:
        rows = []
        for r in range(ROWS):
            cell, n = np.unique(_cells(hashes, r, bits), return_counts=True)
            cuts = np.searchsorted(cell, np.arange(0, (1 << bits) + 1, block))
            for i in np.flatnonzero(np.diff(cuts)):
                part = np.zeros(block, np.uint8)
                part[cell[cuts[i] : cuts[i + 1]] - i * block] = np.minimum(2, n[cuts[i] : cuts[i + 1]])
                rows.append((r, int(i), *(zlib.compress(np.packbits(part >= m).tobytes(), 1) for m in (1, 2))))
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in rows], schema=schema)

    def count(batches):
        held, n = [], 0
        for _, texts in _stretches(batches, length):
            w = windows(texts, length)
            if not len(w.anchor_hash):
                continue
            held.append(np.unique(np.stack([w.anchor_doc.astype(U), w.anchor_hash]), axis=1)[1])
            n += len(held[-1])
            if n >= FLUSH:
                yield blocks(np.concatenate(held))
                held, n = [], 0
        if held:
            yield blocks(np.concatenate(held))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        one, two = np.zeros(block // 8, np.uint8), np.zeros(block // 8, np.uint8)
        for a, b in zip(rows["one"], rows["two"]):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            two |= b | (one & a)
            one |= a
        return pd.DataFrame({"r": rows["r"][:1], "b": rows["b"][:1], "two": [zlib.compress(two.tobytes(), 1)]})

    parts = docs.select(row_id, text).mapInArrow(count, "r int, b int, one binary, two binary")
    merged = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(ROWS)]
    for x in parts.groupBy("r", "b").applyInPandas(merge, "r int, b int, two binary").toLocalIterator():
        merged[x["r"]][x["b"] * block // 8 : (x["b"] + 1) * block // 8] = np.frombuffer(zlib.decompress(x["two"]), np.uint8)
    return merged


def sketch_bits(docs: DataFrame, text: str, length: int, least: int = 18, most: int = 29) -> int:
    """Bits of a sketch row with about five cells for each anchor, between ``least`` and ``most``.  Beyond
    ``most`` (64 MB a row) more windows pass the sketch; the result stays the same."""
    total = docs.agg(F.sum(F.length(text))).first()[0] or 0
    anchors = total * 2 // max(1, length // 2)
    return int(min(most, max(least, (5 * anchors).bit_length())))


def shared_windows(docs: DataFrame, row_id: str, text: str, length: int, positions: bool) -> DataFrame:
    """``k1, k2`` (a window's hash) and, with ``positions``, ``row_id, at`` of every window whose anchor may be
    repeated, or else ``cls``, the digest of the whole text, once per text and window."""
    docs = docs.select(row_id, text).filter(F.length(text) >= length)
    bits = sketch_bits(docs, text, length)
    shared = docs.sparkSession.sparkContext.broadcast(repeated_anchors(docs, row_id, text, length, bits))
    id_type = docs.schema[row_id].dataType.simpleString()

    def run(batches):
        from hashlib import md5

        planes = shared.value
        for ids, texts in _stretches(batches, length):
            w = windows(texts, length)
            alive = np.ones(len(w.anchor_hash), bool)
            for r in range(ROWS):
                c = _cells(w.anchor_hash, r, bits)
                alive &= (planes[r][c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
            which = np.flatnonzero(alive[w.anchor])
            if not len(which):
                continue
            k1, k2 = w.keys(which)
            doc = w.doc[which]
            if positions:
                at = w.offset[which] + np.array([x[2] for x in ids])[doc]
                cols = [pa.array([x[0] for x in ids]).take(pa.array(doc)), pa.array(at)]
            else:
                first = np.unique(np.stack([doc, k1, k2]), axis=1, return_index=True)[1]
                k1, k2, doc = k1[first], k2[first], doc[first]
                used, back = np.unique(doc, return_inverse=True)
                digests = pa.array([md5(ids[i][1].encode("utf-8", "surrogatepass")).digest() for i in used], pa.binary())
                cols = [digests.take(pa.array(back))]
            for i in range(0, len(k1), 1 << 16):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[i : i + (1 << 16)]) if isinstance(x, np.ndarray) else x[i : i + (1 << 16)] for x in (k1, k2, *cols)],
                    names=["k1", "k2", *([row_id, "at"] if positions else ["cls"])],
                )

    tail = f"`{row_id}` {id_type}, at bigint" if positions else "cls binary"
    return docs.mapInArrow(run, f"k1 bigint, k2 bigint, {tail}")


def sharing_classes(docs: DataFrame, row_id: str, text: str, length: int = 120) -> tuple[DataFrame, DataFrame]:
    """``(cls_a, cls_b)`` of classes of equal texts that have a common run, and ``(row_id, cls)`` of the members."""
    rows = shared_windows(docs, row_id, text, length, positions=False)
    # one exchange by window serves the removal of copies and the grouping
    rows = rows.repartition("k1", "k2").dropDuplicates(["k1", "k2", "cls"])
    g = W.partitionBy("k1", "k2")
    sets = rows.select(
        "cls", F.count("*").over(g).alias("n"), F.sum(F.xxhash64("cls").cast("decimal(20,0)")).over(g).alias("s"),
        F.bit_xor(F.xxhash64(F.lit(1), "cls")).over(g).alias("x"),
    ).filter("n > 1")
    sets = materialize(sets.distinct(), "sharers")
    on = ["n", "s", "x"]
    pairs = sets.alias("a").join(sets.withColumnRenamed("cls", "cls_b").alias("b"), on).filter("cls < cls_b")
    members = docs.filter(F.length(text) >= length).select(row_id, F.unhex(F.md5(text)).alias("cls"))
    return pairs.select(F.col("cls").alias("cls_a"), "cls_b").distinct(), members


def sharing_pairs(docs: DataFrame, row_id: str, text: str, length: int = 120) -> DataFrame:
    """``(a, b)``, a < b, of all rows whose texts have a common run of at least ``length`` code points.

    Texts are compared as they stand.  Null, empty and shorter texts share nothing; copies share all
    they have; no rows give no pairs.
    """
    classes, members = sharing_classes(docs, row_id, text, length)
    members = materialize(members.dropDuplicates([row_id]), "members")
    a = members.select(F.col(row_id).alias("x"), F.col("cls").alias("cls_a"))
    b = members.select(F.col(row_id).alias("y"), F.col("cls").alias("cls_b"))
    across = classes.join(a, "cls_a").join(b, "cls_b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    copied = members.groupBy("cls").agg(F.count("*").alias("n")).filter("n > 1").select("cls")
    twice = members.join(copied, "cls")
    within = (
        twice.select(F.col(row_id).alias("a"), "cls")
        .join(twice.select(F.col(row_id).alias("b"), "cls"), "cls")
        .filter("a < b")
        .select("a", "b")
    )
    return across.unionByName(within)


def shared_share(docs: DataFrame, row_id: str, text: str, length: int = 120) -> DataFrame:
    """``(row_id, n_chars, shared_chars, shared_share)`` of every row: how much of the text stands in runs that
    another row has too.  A null text has null numbers, an empty one 0 and a null share; a repeated row is one row.

    Of each window the least and the greatest row are enough to tell whether another has it, so that a window which a
    third of the rows have is combined before the shuffle; no text leaves its partition.
    """
    rows = materialize(shared_windows(docs, row_id, text, length, positions=True), "windows")
    ends = rows.groupBy("k1", "k2").agg(F.min(row_id).alias("first"), F.max(row_id).alias("last")).filter("first < last")
    places = rows.join(ends.select("k1", "k2"), ["k1", "k2"], "left_semi").select(row_id, "at").distinct()
    gap = F.lead("at").over(W.partitionBy(row_id).orderBy("at")) - F.col("at")  # a partition is one text
    covered = places.select(row_id, F.least(F.coalesce(gap, F.lit(length)), F.lit(length)).alias("c"))
    covered = covered.groupBy(row_id).agg(F.sum("c").alias("shared_chars"))
    every = docs.select(row_id, F.length(text).cast("long").alias("n_chars")).groupBy(row_id).agg(F.max("n_chars").alias("n_chars"))
    shared = F.when(F.col("n_chars").isNotNull(), F.coalesce("shared_chars", F.lit(0)))
    return every.join(covered, row_id, "left").select(
        row_id, "n_chars", shared.alias("shared_chars"), F.try_divide(shared, "n_chars").alias("shared_share")
    )
