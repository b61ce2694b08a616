"""Word shingles, and the signatures that make a similarity join exact without comparing all pairs.

Two sets with at least the share ``num/den`` of their union in common agree in at least
``ceil(num/den * n)`` elements of either.  Hence, in any one total order of all elements, they have ``l`` common
elements among their first ``n - ceil(num/den * n) + l``.  With rare elements first, ``l = 2`` and a fixed division of
elements into rare and common ones, either a rare element is shared there or two common ones are; a set is signed
with its rare elements and with the pairs of its common ones, and only equal signatures are joined.  A pair of common
elements is rare in its turn, so that few candidates have to be verified.  Order and division decide the cost alone,
never the result; they come from a count sketch of fixed size.

A set of one element is signed with it.  Pairs would be too many for long sets: above ``LONG`` elements, and down to
what can still be alike with such a set, sets are signed with the single elements for ``l = 1`` (too).
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.session import materialize

NUM, DEN = 3, 5
LONG = 128
WORD = "[a-z0-9]+"
SINGLE, PAIR, PREFIX = 1, 2, 3  # forms of signatures: a rare element, two common ones, an element of a long set


def words_of(text: Column) -> Column:
    """The longest runs of a-z and 0-9 in the lower-cased text; null for a null text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _bound(value: Column, f) -> Column:
    """``f(value)`` as one expression that computes ``value`` once: the optimiser puts the definition of a column
    wherever the column is used, inside lambdas too, where it would be computed for every element."""
    return F.get(F.transform(F.array(value), f), 0)


def shingle_set(words: Column, k: int = 3) -> Column:
    """The sorted set of hashes of ``k`` consecutive words; null below ``k`` words."""

    def of(w: Column) -> Column:
        at = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])
        return F.when(F.size(w) >= k, F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - k), at))))

    return _bound(words, of)


def canonical(text: Column, least: int = 3) -> Column:
    """The record after case, punctuation and white space are normalised; null below ``least`` words."""
    return _bound(words_of(text), lambda w: F.when(F.size(w) >= least, F.array_join(w, " ")))


def canonical_set(canon: Column, k: int = 3) -> Column:
    """The shingle set of a canonical text."""
    return shingle_set(F.split(canon, " "), k)


def _grams(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of every ``k`` consecutive words of canonical texts the number of the text and where they begin; then all words
    as numbers of the distinct ones, and those."""
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    many = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    row = np.repeat(np.arange(len(many)), many)
    begin = np.flatnonzero(np.arange(len(row)) + k <= np.repeat(np.cumsum(many), many))
    return row[begin], begin, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def set_arrays(texts: pa.Array, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The shingle sets of canonical texts, sorted and one after the other, and their sizes; a null text has none.

    They are made of whole Arrow batches: a distinct word is hashed once, and no array goes through rows.  The hashes
    are not those of :func:`shingle_set`.
    """
    row, begin, code, words = _grams(texts, k)
    word = np.frombuffer(b"".join(blake2b(w.encode(), digest_size=8).digest() for w in words.to_pylist()), np.uint64)[code]
    s = np.zeros(len(begin), np.uint64)
    for i in range(k):
        s = _mix(s + word[begin + i])
    s = s.view(np.int64)
    by = np.argsort(s)
    by = by[np.argsort(row[by].astype(np.uint16 if len(texts) <= 1 << 16 else np.int64), kind="stable")]
    row, s = row[by], s[by]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    return s[new], np.bincount(row[new], minlength=len(texts))


def shares_reached(texts: pa.Array, a: np.ndarray, b: np.ndarray, num: int = NUM, den: int = DEN, k: int = 3, most: int = 1 << 21) -> np.ndarray:
    """Whether the texts of each pair ``(a, b)`` of places have at least ``num/den`` of their shingles' union in common.

    Exact: words are compared by their numbers among all words here, never by hashes.  Not more than about ``most``
    shingles are looked up at once.
    """
    row, begin, code, words = _grams(texts, k)
    gram = code[begin]
    for i in range(1, k):  # the number of the words so far, among all such beginnings
        gram = np.unique(gram * len(words) + code[begin + i], return_inverse=True)[1]
    own = np.unique(row << 32 | gram)
    size = np.bincount(own >> 32, minlength=len(texts))
    start = np.cumsum(size) - size
    out = np.zeros(len(a), bool)
    turns = np.cumsum(size[a]) // most
    for turn in np.unique(turns):
        at = np.flatnonzero(turns == turn)
        n = size[a[at]]
        end = np.cumsum(n)
        mine = own[np.arange(int(end[-1])) + np.repeat(start[a[at]] - end + n, n)]
        other = np.repeat(b[at], n) << 32 | (mine & 0xFFFFFFFF)
        there = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other if len(own) else np.zeros(0, bool)
        both = np.bincount(np.repeat(np.arange(len(at)), n)[there], minlength=len(at))
        out[at] = (both > 0) & (both * den >= (n + size[b[at]] - both) * num)
    return out


def fit_order(sets: DataFrame, arr: str, cells: int = 1 << 22, two_sided: tuple[str, str] | None = None) -> np.ndarray:
    """How often the shingles of each of ``cells`` hash cells occur, saturating at 65,535.

    At most ``cells`` rows come to the driver, whatever the size of the corpus.  With ``two_sided``,
    the names of two boolean columns, a cell without rows of either side counts 0: what no set of the
    other side has can't be a common element, and a sketch never says so wrongly.
    """
    sides = list(two_sided or [])
    # the outer form brings no condition of its own below the projection that makes the sets
    rows = sets.select(F.explode_outer(arr).alias("s"), *sides).filter("s is not null").groupBy(F.pmod("s", F.lit(cells)).cast("int").alias("cell"))
    agg = rows.agg(F.least(F.count("*"), F.lit(65535)).cast("int").alias("n"), *[F.max(c).alias(c) for c in sides])
    agg = agg.filter(" and ".join(sides) if sides else "n > 1")
    got = agg.select("cell", "n").toArrow()
    order = np.zeros(cells, np.uint16)
    order[got["cell"].to_numpy()] = got["n"].to_numpy()
    return order


def fit_common(sets: DataFrame, arr: str, rare: int, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that occur more than ``rare`` times, sorted, and how often they do, saturating at 65,535.

    Not more than ``most`` come to the driver: with more, ``rare`` is raised to the least number that leaves so many.
    Others have no place here, so the rarest don't crowd a sketch however many they are.
    """
    rows = sets.select(F.explode_outer(arr).alias("s")).filter("s is not null").groupBy("s").agg(F.least(F.count("*"), F.lit(65535)).cast("int").alias("n"))
    rows = materialize(rows.filter(F.col("n") > rare), "common")
    held = 0
    for n, count in sorted(rows.groupBy("n").count().collect(), reverse=True):  # a row a number, at most 65,535
        held += count
        if held > most:
            rows = rows.filter(F.col("n") > n)
            break
    got = rows.toArrow()
    s, n = got["s"].to_numpy(), got["n"].to_numpy().astype(np.uint16)
    by = np.argsort(s)
    return s[by], n[by]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(flat: np.ndarray, sizes: np.ndarray, order: np.ndarray, rare: int, skip_zero: bool, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the set and key of all signatures of sets that lie in ``flat`` one after the other."""
    return _signed(flat, sizes, order[flat % len(order)], rare, skip_zero, num, den)[:2]


def _signed(flat: np.ndarray, sizes: np.ndarray, rank: np.ndarray, rare: int, skip_zero: bool, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`_keys`, with the form of each signature; ``rank`` says how often each element occurs."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    by = np.lexsort((flat, rank, row))
    flat, rank = flat[by], rank[by]
    pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    n = sizes[row]
    spare = n - (n * num + den - 1) // den
    useful = rank > 0 if skip_zero else np.ones(len(flat), bool)
    short = useful & (n <= LONG) & (pos < spare + 2)
    single = short & ((rank <= rare) | (n == 1))
    long_ = useful & (n * den > LONG * num) & (pos < spare + 1)
    forms = [np.full(int(single.sum()), SINGLE, np.int8), np.full(int(long_.sum()), PREFIX, np.int8)]
    rows, keys = [row[single], row[long_]], [flat[single], (_mix(flat[long_].view(np.uint64)) + np.uint64(1)).view(np.int64)]
    common = np.flatnonzero(short & ~single)
    # the order is total, so equal pairs come in the same order in every set
    r, f = row[common], _mix(flat[common].view(np.uint64))
    for d in range(1, len(common)):
        same = np.flatnonzero(r[d:] == r[:-d])
        if not len(same):
            break
        rows.append(r[same])
        keys.append(_mix(f[same] * np.uint64(3) + f[same + d]).view(np.int64))
        forms.append(np.full(len(same), PAIR, np.int8))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(forms)


def signatures(
    sets: DataFrame, keep: list[str], arr: str, order: np.ndarray, rare: int, skip_zero: bool = False, num: int = NUM, den: int = DEN
) -> DataFrame:
    """``keep`` columns, ``n`` (size of the set), ``bits`` and ``s`` of every signature; none for a null or empty set.

    ``bits`` has a bit set for each element, by its hash: sets differ in at least as many elements as their bits do.

    Elements that ``order`` counts at most ``rare`` times are rare.  With ``skip_zero``, for an order made with
    ``two_sided``, what counts 0 signs nothing.
    """
    fields = [sets.schema[c] for c in keep]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n int, bits bigint, s bigint"

    def sign(batches):
        for b in batches:
            lists = b.column(arr)
            sizes = np.diff(lists.offsets.to_numpy())
            if lists.null_count:
                sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
            flat = lists.flatten().to_numpy()
            row, key = _keys(flat, sizes, order, rare, skip_zero, num, den)
            bits = _bits(flat, sizes)
            cols = [b.column(c).take(pa.array(row)) for c in keep]
            cols += [pa.array(sizes[row], pa.int32()), pa.array(bits[row], pa.int64()), pa.array(key, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "n", "bits", "s"])

    return sets.select(*keep, arr).mapInArrow(sign, ddl)


def _bits(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes), np.int64)
    some = sizes > 0
    if len(flat):
        one = np.uint64(1) << (_mix(flat.view(np.uint64)) >> np.uint64(58))
        out[some] = np.bitwise_or.reduceat(one, (np.cumsum(sizes) - sizes)[some]).view(np.int64)
    return out


def may_be_alike(a: str, b: str, num: int = NUM, den: int = DEN) -> Column:
    """What the sizes and bits of two rows of :func:`signatures` allow: alike sets differ in at most
    ``(den - num) / (den + num)`` of their sizes' sum."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = F.bit_count(F.col(f"{a}.bits").bitwiseXOR(F.col(f"{b}.bits")))
    return (na * den >= nb * num) & (nb * den >= na * num) & (apart * (num + den) <= (na + nb) * (den - num))


def alike(a: Column, b: Column, num: int = NUM, den: int = DEN) -> Column:
    """Whether two shingle sets have at least num/den of their union in common; each is computed once."""

    def share(p: Column) -> Column:
        both = F.size(F.array_intersect(p["a"], p["b"]))
        return both * den >= (F.size(p["a"]) + F.size(p["b"]) - both) * num

    return _bound(F.struct(a.alias("a"), b.alias("b")), share)
