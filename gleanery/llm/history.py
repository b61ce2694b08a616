"""Deduplicating new batches against everything accepted before, without reading the history.

A :class:`History` is a persistent store at a path, opened again by :meth:`History.open`.  Its three parts lie in
buckets of segments (:mod:`gleanery.llm.fingerprints`), each behind Bloom filters:

* ``keys`` - 128 bits of hash of the exact keys of accepted records, and of excluded keys;
* ``prints`` - fingerprints of texts: the winnowed shingle hashes, with a mark of the set and the text they are from.
  Winnowing by position only promises to find long common runs; here the window lies over the set in a fixed order,
  which promises a common fingerprint for any two sets with the required share in common (the signatures of
  :mod:`gleanery.llm.shingles`);
* ``texts`` - the canonical texts the prints are from, looked up to verify the coverage of a candidate.

An ingest takes one batch.  One exchange brings the batch's keys, prints and texts to their buckets (keys and prints
packed many into a row, made from whole Arrow batches), where the filters
prescreen them, positives are looked up, what is repeated within the batch is found, and prints and texts are appended.
Candidates are verified by their texts, looked up where they lie; one of the history counts if the key of its text is
that of an accepted record.  The rest contends in order for the keys it shares, two alike texts for a key of their own,
and the keys of what is accepted are appended.  An ingest starts few jobs, all of fixed form, since each costs the
driver memory and time however small the batch is.  Then one commit, a file that names all live segments, makes the ingest part of the history; an ingest that broke off before left
nothing, one that is run again after its commit returns what it returned.

The order of shingles, which decides cost and never results, is part of the store: how often the common ones occur, by
their full hashes, as a sketch of fixed size would call all of them common once it is full.  It is fitted anew, and the prints
made again from the texts, when the history has grown :data:`REFIT`-fold, which amortises, and when an element taken
for rare turns out to be frequent, so that a template that appears late doesn't stay one long list.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import fingerprints as P
from gleanery.llm.shingles import DEN, NUM, SINGLE, _bound, _mix, _signed, canonical, fit_common, set_arrays, shares_reached
from gleanery.session import discard, materialize, scratch, settings, temporaries

EXACT = 0  # kind of a key that goes to a bucket, beside the forms of signatures
KNOWN, REPEATED, CANDIDATE, PAIR = range(4)  # kinds of rows that come from it
ACCEPTED, OPEN, REFUSED = range(3)  # states of a record; of several votes the greatest holds
RARE = 4  # shingles that the fitted texts have at most so often sign alone
HOT = 128  # texts under an element taken for rare, from which the order is fitted anew
REFIT = 4
# a small batch is read by few tasks; a large one still by as many as its bytes ask for
FILES = {"spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": "65536"}
SLICES = 8  # tasks that may share the verification against the texts of one bucket
MARK_BITS = 48
FORM = 2  # of the store; shingles were hashed otherwise in those that have none
# keys and prints go to a bucket many in one row, as PACKED, since each row costs more than what is in it; texts one by one
PACKED = np.dtype([("kind", np.int8), ("fp", np.int64), ("x", np.int64), ("ref", np.int64)])
PIECE, MOST = 1 << 15, 1 << 22  # keys and prints of a row, and of an Arrow batch, at most
ROWS = pa.schema([("bucket", pa.int32()), ("packed", pa.binary()), ("fp", pa.int64()), ("x", pa.int64()), ("text", pa.string())])
ROWS_DDL = "bucket int, packed binary, fp bigint, x bigint, text string"
HITS = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64())])
HITS_DDL = "kind tinyint, a bigint, b bigint"
LIKE = pa.schema([("kind", pa.int8()), ("fp", pa.int64()), ("chk", pa.int64()), ("kfp", pa.int64()), ("kchk", pa.int64())])
LIKE_DDL = "kind tinyint, fp bigint, chk bigint, kfp bigint, kchk bigint"
EMPTY: dict[str, P.Live] = {"keys": [], "prints": [], "texts": []}


def exact_key(kind: str, *parts: Column) -> Column:
    """128 bits of hash of an exact key; null where a part is null.  Each part is computed once."""

    def of(key: Column) -> Column:
        each = [key[f"p{i}"] for i in range(len(parts))]
        return F.when(
            F.concat(*[p.cast("string") for p in each]).isNotNull(),
            F.struct(F.xxhash64(F.lit(kind), *each).alias("fp"), F.xxhash64(*each, F.lit(kind)).alias("chk")),
        )

    return _bound(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]), of)


def prepared(df: DataFrame, *, row_id: Column, order: list[Column], keys: list[Column], text: Column, keep: list[str]) -> DataFrame:
    """``rid, ord, keys, cls, canon`` and the columns to ``keep`` of records.

    ``canon`` is the canonical text, null where it has no shingle; ``cls``, its hash, is one more exact key.  Null
    parts of the order come first; repeated rows are one record.  A null row id is no record.
    """
    rows = df.select(
        *keep, row_id.alias("rid"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], row_id.alias("rid")).alias("ord"),
        F.array(*keys).alias("keys"), text.alias("text"),
    ).filter("rid is not null")
    rows = rows.withColumn("canon", canonical(F.col("text"))).withColumn("cls", exact_key("text", F.col("canon")))
    return rows.select(*keep, "rid", "ord", F.filter(F.concat("keys", F.array("cls")), lambda k: k.isNotNull()).alias("keys"), "cls", "canon")


def marks(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A bit for each element of a set, by its hash, and the set's size in the lowest 16 bits."""
    out = np.zeros(len(sizes), np.uint64)
    some = sizes > 0
    if len(flat):
        one = np.uint64(1) << ((_mix(flat.view(np.uint64)) >> np.uint64(20)) % np.uint64(MARK_BITS))
        out[some] = np.bitwise_or.reduceat(one, (np.cumsum(sizes) - sizes)[some])
    return (out << np.uint64(16) | np.minimum(sizes, 0xFFFF).astype(np.uint64)).view(np.int64)


def marks_allow(a: np.ndarray, b: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """What two marks allow: alike sets differ in at most ``(den - num) / (den + num)`` of their sizes' sum, and in
    at least as many elements as their bits do.  The size 65,535 stands for any from there on."""
    na, nb = a & 0xFFFF, b & 0xFFFF
    apart = np.bitwise_count((a ^ b).view(np.uint64) >> np.uint64(16)).astype(np.int64)
    ok = (na * den >= nb * num) & (nb * den >= na * num) & (apart * (num + den) <= (na + nb) * (den - num))
    return ok | (na == 0xFFFF) | (nb == 0xFFFF)


def _together(*calls: Callable) -> list:
    """Results of calls that start jobs and don't depend on one another, run at the same time."""
    with ThreadPoolExecutor(len(calls)) as pool:
        return [f.result() for f in [pool.submit(c) for c in calls]]


def _table(schema: pa.Schema, **cols) -> pa.RecordBatch:
    n = max(len(v) for v in cols.values())
    arr = lambda v, t: v if isinstance(v, pa.Array) else pa.array(v, t)
    return pa.RecordBatch.from_arrays([arr(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)


def _group_starts(*cols: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted columns."""
    new = np.ones(len(cols[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return np.flatnonzero(new)


def _packed(buckets: int, kind: np.ndarray, fp: np.ndarray, x: np.ndarray, ref: np.ndarray) -> pa.RecordBatch:
    """Keys and prints by their buckets, at most :data:`PIECE` in a row."""
    bucket = (fp % buckets).astype(np.uint16 if buckets <= 1 << 16 else np.int32)
    by = np.argsort(bucket, kind="stable")
    data = np.empty(len(by), PACKED)
    for name, c in zip(PACKED.names, (kind, fp, x, ref)):
        data[name] = c[by]
    bucket = bucket[by]
    begin = _group_starts(bucket)
    pieces = -(-np.diff(np.r_[begin, len(by)]) // PIECE)
    at = np.repeat(begin, pieces) + PIECE * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    ends = pa.py_buffer((np.r_[at, len(by)] * PACKED.itemsize).astype(np.int32))
    return _table(ROWS, bucket=bucket[at], packed=pa.Array.from_buffers(pa.binary(), len(at), [None, ends, pa.py_buffer(data.tobytes())]))


def _rows_of(buckets: int, root: str, order: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keys, prints and texts of records ``(rid, keys, id, chk, canon)``; of what is repeated in an Arrow batch only the least and the
    greatest record, and each text once, so that a key or text that a third of the rows have sends little from a task."""

    def run(batches):
        for b in batches:
            lists, out = b.column("keys"), []
            parts = lists.flatten()
            if len(parts):
                fp, chk = parts.field("fp").to_numpy(), parts.field("chk").to_numpy()
                rid = np.repeat(b.column("rid").to_numpy(), np.diff(lists.offsets.to_numpy()))
                by = np.lexsort((rid, chk, fp))
                fp, chk, rid = fp[by], chk[by], rid[by]
                first = _group_starts(fp, chk)
                last = np.r_[first[1:], len(fp)] - 1
                pick = np.unique(np.concatenate([first, last[rid[last] != rid[first]]]))
                out.append((np.full(len(pick), EXACT, np.int8), fp[pick], chk[pick], rid[pick]))
            some = b.filter(b.column("canon").is_valid())
            if some.num_rows:
                ids, chk = some.column("id").to_numpy(), some.column("chk").to_numpy()
                by = np.lexsort((chk, ids))
                some = some.take(pa.array(by[_group_starts(ids[by], chk[by])]))
                ids = some.column("id").to_numpy()
                yield _table(ROWS, bucket=ids % buckets, fp=ids, x=some.column("chk"), text=some.column("canon"))
                flat, sizes = set_arrays(some.column("canon"))
                row, key, form = _signed(flat, sizes, P.counts_of(root, order, flat), RARE, False, NUM, DEN)
                out.append((form, key, marks(flat, sizes)[row], ids[row]))
            if out:
                cols = [np.concatenate(c) for c in zip(*out)]
                for i in range(0, len(cols[0]), MOST):
                    yield _packed(buckets, *(c[i : i + MOST] for c in cols))

    return run


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle set of each text."""
    for b in batches:
        flat, sizes = set_arrays(b.column(0))
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.r_[0, np.cumsum(sizes)].astype(np.int32), flat)], names=["set"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of one bucket after the other; they come sorted by bucket."""
    held, at = [], None
    for b in batches:
        which = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(which[1:] != which[:-1]) + 1), len(which)]
        for s, e in zip(cuts, cuts[1:]):
            if s == e:
                continue
            if held and which[s] != at:
                yield at, pa.Table.from_batches(held)
                held = []
            at = int(which[s])
            held.append(b.slice(s, e - s))
    if held:
        yield at, pa.Table.from_batches(held)


def _looked_up(root: str, live: P.Live, fp: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], int]:
    """Of sorted distinct fingerprints all prints: number of the key and columns; and how many prints were read."""
    key, cols, read = [], [], 0
    for name, _, _ in live:
        s = P.Segment(root, name)
        k, c = s.find(fp.view(np.uint64))
        read += s.touched
        if len(k):
            key.append(k)
            cols.append(c)
    if not key:
        return np.zeros(0, np.int64), [], read
    return np.concatenate(key), [np.concatenate(x) for x in zip(*cols)], read


def _add_texts(root: str, live: P.Live, rows: pa.Table) -> P.Live:
    fp, chk = rows.column("fp").to_numpy(), rows.column("x").to_numpy()
    by = np.lexsort((chk, fp))
    one = by[_group_starts(fp[by], chk[by])]
    blobs = rows.column("text").take(pa.array(one)).cast(pa.large_binary()).combine_chunks()
    ends = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset : blobs.offset + len(one) + 1]
    data = blobs.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes()
    return P.append(root, "texts", live, fp[one].view(np.uint64), [ends[:-1] - ends[0], np.diff(ends), chk[one]], data)[0]


def _probe_bucket(root: str, bucket: int, rows: pa.Table, live: dict[str, P.Live], fit_only: bool, to: str, hot: int) -> Iterator[pa.RecordBatch]:
    """Look the rows of a bucket up, find what is repeated among them, and append prints and texts; ``to`` names the
    file of the note of what was appended; more texts than ``hot`` under a rare element are noted."""
    texts = rows.column("text").is_valid()
    note: dict = {"bucket": bucket, "probes": 0, "read": 0, "candidates": 0, "pairs": 0, "known": 0, "repeated": 0, "hot": 0}
    found = rows.filter(texts)
    if found.num_rows and not fit_only:
        note["texts"] = _add_texts(root, live["texts"], found)
    data = np.frombuffer(b"".join(rows.column("packed").drop_null().to_pylist()), PACKED)
    kind, fp, x, ref = (np.ascontiguousarray(data[c]) for c in PACKED.names)
    keys = kind == EXACT
    if keys.any():
        f, c, r = fp[keys], x[keys], ref[keys]
        by = np.lexsort((r, c, f))
        f, c, r = f[by], c[by], r[by]
        first = _group_starts(f, c)
        several = r[np.r_[first[1:], len(f)] - 1] != r[first]
        f, c = f[first], c[first]
        own = np.argsort(f.view(np.uint64), kind="stable")
        f, c, several = f[own], c[own], several[own]
        probe, back = np.unique(f.view(np.uint64), return_inverse=True)
        k, cols, read = _looked_up(root, live["keys"], probe.view(np.int64))
        known = np.zeros(len(f), bool)
        if len(k):
            there = set(zip(probe[k].view(np.int64).tolist(), cols[0].tolist()))
            may = np.flatnonzero(np.isin(back, k))
            known[may] = [(a, b) in there for a, b in zip(f[may].tolist(), c[may].tolist())]
        note |= {"probes": len(f), "read": read, "known": int(known.sum()), "repeated": int((several & ~known).sum())}
        out = known | several
        if out.any():
            yield _table(HITS, kind=np.where(known, KNOWN, REPEATED)[out], a=f[out], b=c[out])
    if not keys.all():
        f, m, r, k = fp[~keys], x[~keys], ref[~keys], kind[~keys]
        by = np.lexsort((r, f.view(np.uint64)))
        f, m, r, k = f[by], m[by], r[by], k[by]
        one = _group_starts(f, r)
        f, m, r, k = f[one], m[one], r[one], k[one]
        begin = _group_starts(f)
        size = np.diff(np.r_[begin, len(f)])
        mine = np.repeat(np.arange(len(begin)), size)
        old = np.zeros(len(begin), np.int64)
        if not fit_only:
            key, cols, read = _looked_up(root, live["prints"], f[begin])
            note["read"] += read
            note["probes"] += len(begin)
            if len(key):
                old = np.bincount(key, minlength=len(begin))
                # each print of the history with each text of the batch that has the fingerprint
                times = size[key]
                at = np.repeat(begin[key], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                mark, owner = np.repeat(cols[0], times), np.repeat(cols[1], times)
                ok = marks_allow(m[at], mark)
                a, b = r[at][ok], owner[ok]
                by = np.lexsort((b, a))
                a, b = a[by], b[by]
                if len(a):
                    own = _group_starts(a, b)
                    a, b = a[own], b[own]
                note["candidates"] = len(a)
                if len(a):
                    yield _table(HITS, kind=np.full(len(a), CANDIDATE), a=a, b=b)
            for d in range(1, int(size.max())):  # texts of the batch under one fingerprint, d places apart
                at = np.flatnonzero(mine[d:] == mine[:-d])
                at = at[marks_allow(m[at], m[at + d])]
                note["pairs"] += len(at)
                if len(at):
                    yield _table(HITS, kind=np.full(len(at), PAIR), a=r[at], b=r[at + d])
            note["hot"] = int(((old + size > hot) & (k[begin] == SINGLE)).sum())
        note["prints"], note["rewritten"] = P.append(root, "prints", [] if fit_only else live["prints"], f.view(np.uint64), [m, r])
    P.put(root, f"{to}-{bucket}", [json.dumps(note).encode()])


def _add_keys(root: str, bucket: int, rows: pa.Table, live: dict[str, P.Live]) -> dict:
    fp, chk = rows.column("fp").to_numpy(), rows.column("x").to_numpy()
    by = np.lexsort((chk, fp))
    one = by[_group_starts(fp[by], chk[by])]
    return {"bucket": bucket, "keys": P.append(root, "keys", live["keys"], fp[one].view(np.uint64), [chk[one]])[0]}


def _texts_of(root: str, live: dict[str, dict[str, P.Live]], buckets: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The texts of ids: sorted ids, the second halves of the hashes and the texts."""
    fp, chk, texts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    ids = np.unique(ids.view(np.uint64))
    which = ids.view(np.int64) % buckets
    for b in np.unique(which):
        own = ids[which == b]
        for name, _, _ in live.get(str(b), EMPTY)["texts"]:
            s = P.Segment(root, name)
            key, (at, size, c) = s.find(own)
            fp.append(own[key].view(np.int64))
            chk.append(c)
            texts += s.texts(at, size)
    by = np.argsort(fp := np.concatenate(fp), kind="stable")
    return fp[by], np.concatenate(chk)[by], pa.array(texts, pa.large_string()).take(pa.array(by))


def _verify(root: str, live: dict[str, dict[str, P.Live]], buckets: int, hits: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows ``(kind, fp, chk, kfp, kchk)``: a key or text, and what records that have it contend for within the batch.

    Keys contend for themselves.  Of pairs of ids the texts that are alike are found; two of the batch contend for a
    key of their own, since of both at most one record can be accepted.
    """
    kind, ref, other = (hits.column(c).to_numpy() for c in ("kind", "a", "b"))
    exact = kind <= REPEATED
    if exact.any():
        fp, chk = ref[exact], other[exact]
        yield _table(LIKE, kind=kind[exact], fp=fp, chk=chk, kfp=fp, kchk=chk)
    kind, ref, other = kind[~exact], ref[~exact], other[~exact]
    if not len(kind):
        return
    by = np.lexsort((other, ref, kind))
    by = by[_group_starts(kind[by], ref[by], other[by])]
    kind, ref, other = kind[by], ref[by], other[by]
    ids, chks, texts = _texts_of(root, live, buckets, np.concatenate([ref, other]))
    old = np.unique(other[kind == CANDIDATE].view(np.uint64))
    accepted = set()
    which = old.view(np.int64) % buckets
    for b in np.unique(which):
        own = old[which == b]
        key, cols, _ = _looked_up(root, live.get(str(b), EMPTY)["keys"], own.view(np.int64))
        accepted.update(zip(own[key].view(np.int64).tolist(), cols[0].tolist()) if len(key) else ())
    counts = np.fromiter((x in accepted for x in zip(ids.tolist(), chks.tolist())), bool, len(ids))
    # every text of the one id with every text of the other
    left, right = np.searchsorted(ids, ref), np.searchsorted(ids, other)
    many = np.searchsorted(ids, other, "right") - right
    times = (np.searchsorted(ids, ref, "right") - left) * many
    turn = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    many = np.repeat(many, times)
    one, two, kind = np.repeat(left, times) + turn // many, np.repeat(right, times) + turn % many, np.repeat(kind, times)
    ok = (kind == PAIR) | counts[two]
    one, two, kind = one[ok], two[ok], kind[ok]
    ok = shares_reached(texts, one, two)
    k, one, two = kind[ok], one[ok], two[ok]
    if len(k):
        a, ca, b, cb = ids[one], chks[one], ids[two], chks[two]
        turn = (a > b) | ((a == b) & (ca > cb))
        lo, hi = np.where(turn, [b, cb], [a, ca]).view(np.uint64), np.where(turn, [a, ca], [b, cb]).view(np.uint64)
        own = [_mix(_mix(_mix(lo[i] + np.uint64(1)) ^ hi[i]) * np.uint64(3) ^ _mix(lo[1 - i] ^ _mix(hi[1 - i] + np.uint64(2)))).view(np.int64) for i in (0, 1)]
        yield _table(LIKE, kind=k, fp=a, chk=ca, kfp=own[0], kchk=own[1])
        near = k == PAIR
        yield _table(LIKE, kind=k[near], fp=b[near], chk=cb[near], kfp=own[0][near], kchk=own[1][near])


def _contended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes of the keys; their rows come sorted by key, state and order.  An accepted record takes its key from all
    others; else the first of the open ones may have it."""
    at, lead, taken = None, 0, False
    for b in batches:
        if not b.num_rows:
            continue
        rid, fp, chk, state = (b.column(c).to_numpy() for c in ("rid", "kfp", "kchk", "state"))
        begin = _group_starts(fp, chk)
        leads, takes = rid[begin].copy(), state[begin] == ACCEPTED
        if at == (fp[0], chk[0]):
            leads[0], takes[0] = lead, taken
        at, lead, taken = (fp[-1], chk[-1]), leads[-1], takes[-1]
        size = np.diff(np.r_[begin, len(fp)])
        own, gone = rid == np.repeat(leads, size), np.repeat(takes, size)
        vote = np.where(state != OPEN, state, np.where(own, ACCEPTED, np.where(gone, REFUSED, OPEN)))
        yield b.set_column(b.schema.get_field_index("state"), "state", pa.array(vote, pa.int8()))


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states of records after the votes of their keys, which come together; a refused record is one row."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    rid, first, back = np.unique(rows.column("rid").to_numpy(), return_index=True, return_inverse=True)
    state = np.zeros(len(rid), np.int8)
    np.maximum.at(state, back, rows.column("state").to_numpy())
    keep = state[back] != REFUSED
    keep[first] = True
    rows, back = rows.filter(pa.array(keep)), back[keep]
    out = state[back] == REFUSED
    mine = rows.column("rid").to_numpy()
    for c, v in (("kfp", np.where(out, mine, rows.column("kfp").to_numpy())), ("kchk", np.where(out, mine, rows.column("kchk").to_numpy())), ("state", state[back])):
        rows = rows.set_column(rows.schema.get_field_index(c), c, pa.array(v))
    yield from rows.to_batches(max_chunksize=10_000)


def _notes(root: str, to: str) -> list[dict]:
    folder, name = to.split("/")
    return [json.loads(P.get(root, f"{folder}/{n}")) for n in P.names(root, folder) if n.startswith(f"{name}-") and not n.endswith(".tmp")]


def _with(live: dict, notes: list[dict], kinds: tuple[str, ...]) -> dict:
    """The live segments after what tasks report."""
    out = dict(live)
    for n in notes:
        b = str(n["bucket"])
        out[b] = EMPTY | out.get(b, {}) | {k: n[k] for k in kinds if k in n}
    return out


class History:
    """The persistent store of accepted records at ``path``; see the module's text.  One writer at a time.

    ``buckets``, fixed when the store is created, is the number of shares that tasks handle as a whole: a batch's share
    must fit a task's memory.  ``stats`` has a row for each ingest since the store was opened: fingerprints probed,
    prints of the history read for them, prints and texts there.
    """

    def __init__(self, spark: SparkSession, path: str, state: dict):
        self.spark, self.path, self.state = spark, path, state
        self.buckets: int = state["buckets"]
        self.root = f"{path}/store"
        self.stats: list[dict] = []
        self._stale: list[str] = []

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int) -> History:
        """A new, empty store."""
        state = {"version": 0, "form": FORM, "buckets": buckets, "order": None, "fitted": 0, "texts": 0, "ingests": {}, "live": {}}
        store = cls(spark, path, state)
        store._write_commit()
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> History:
        """The store as its last commit left it; files that no commit names are removed."""
        root = f"{path}/store"
        commits = [n for n in P.names(root, "commits") if n.endswith(".json")]
        if not commits:
            raise FileNotFoundError(f"no store at {path}")
        store = cls(spark, path, json.loads(P.get(root, f"commits/{commits[-1]}")))
        if store.state.get("form") != FORM:  # its prints would be looked up in vain
            raise ValueError(f"the store at {path} is of form {store.state.get('form')}, not {FORM}")
        live = {s[0] for b in store.state["live"].values() for kind in b.values() for s in kind} | {store.state["order"]}
        for kind in ("keys", "prints", "texts", "orders", "notes"):
            for n in P.names(root, kind):
                if f"{kind}/{n}" not in live:
                    P.drop(root, f"{kind}/{n}")
        return store

    def drop(self) -> None:
        """Remove the store; what ingests have returned stays readable."""
        discard(self.root)

    # ---- commits ------------------------------------------------------------------------------------------

    def _write_commit(self) -> None:
        P.put(self.root, self._commit(), [json.dumps(self.state).encode()])

    def _commit(self) -> str:
        return f"commits/{self.state['version']:010d}.json"

    def _committed(self, name: str | None, live: dict[str, dict[str, P.Live]], **more) -> None:
        old = {s[0] for b in self.state["live"].values() for kind in b.values() for s in kind}
        before = self._commit()
        ingests = self.state["ingests"] if name is None else self.state["ingests"] | {name: f"refused/{name}"}
        self.state = self.state | {"version": self.state["version"] + 1, "live": live, "ingests": ingests} | more
        self._write_commit()
        now = {s[0] for b in live.values() for kind in b.values() for s in kind}
        for n in [*(old - now), *(set(self._stale) - now), before]:
            P.drop(self.root, n)
        self._stale = []

    # ---- tasks --------------------------------------------------------------------------------------------

    def _by_bucket(self, rows: DataFrame) -> DataFrame:
        # no number of partitions: adaptive execution puts as many buckets into a task as are worth one
        return rows.repartition("bucket").sortWithinPartitions("bucket")

    def _probe(self, batch: DataFrame, order: str) -> tuple[DataFrame, list[dict]]:
        """What is found for a batch (:func:`_verify`), and the notes of the buckets (one each).

        An exchange ends when all that feeds it has, so whoever verifies finds the notes of all buckets.
        """
        root, commit, buckets, to = self.root, self._commit(), self.buckets, f"notes/{uuid.uuid4().hex}"
        records = batch.select("rid", "keys", F.col("cls.fp").alias("id"), F.col("cls.chk").alias("chk"), "canon")

        def run(batches):
            now = None
            for b in batches:
                if b.num_rows and now is None:
                    now = _with(P.document(root, commit)["live"], _notes(root, to), ("prints", "texts"))
                if b.num_rows:
                    yield from _verify(root, now, buckets, b)

        # the pairs of one text are shared by several tasks, so that a text with many candidates is no hot task
        spread = F.pmod("b", F.lit(buckets)), F.pmod(F.xxhash64("a"), F.lit(SLICES))
        found = self._in_buckets(records, order, to, False).repartition(*spread).sortWithinPartitions("b", "a")
        return materialize(found.mapInArrow(run, LIKE_DDL), "hits"), self._noted(to)

    def _noted(self, to: str) -> list[dict]:
        """The notes under a name, which are then removed."""
        found = _notes(self.root, to)
        for n in found:
            P.drop(self.root, f"{to}-{n['bucket']}")
        return found

    def _in_buckets(self, records: DataFrame, order: str, to: str, fit_only: bool) -> DataFrame:
        root, commit, buckets, hot = self.root, self._commit(), self.buckets, HOT

        def run(batches):
            now = P.document(root, commit)["live"]
            for b, rows in _buckets(batches):
                yield from _probe_bucket(root, b, rows, now.get(str(b), EMPTY), fit_only, to, hot)

        return self._by_bucket(records.mapInArrow(_rows_of(buckets, root, order), ROWS_DDL)).mapInArrow(run, HITS_DDL)

    def _add(self, rows: DataFrame) -> list[dict]:
        """Append exact keys ``(bucket, fp, x)``; the notes of the buckets."""
        root, commit = self.root, self._commit()

        def run(batches):
            now = P.document(root, commit)["live"]
            for b, part in _buckets(batches):
                note = _add_keys(root, b, part, now.get(str(b), EMPTY))
                yield pa.RecordBatch.from_arrays([pa.array([json.dumps(note)])], names=["note"])

        return [json.loads(r["note"]) for r in self._by_bucket(rows).mapInArrow(run, "note string").collect()]  # a row a bucket

    def _bucket(self, fp: str) -> Column:
        return F.pmod(F.col(fp), F.lit(self.buckets)).cast("int").alias("bucket")

    def exclude(self, keys: DataFrame) -> None:
        """Refuse every record that has one of ``keys`` (column ``key``: :func:`exact_key`); nulls are ignored."""
        rows = keys.filter("key is not null").select("key.fp", "key.chk").distinct()
        rows = rows.select(self._bucket("fp"), "fp", F.col("chk").alias("x"))
        self._committed(None, _with(self.state["live"], self._add(rows), ("keys",)))

    # ---- the order of shingles ----------------------------------------------------------------------------

    def _texts(self) -> DataFrame:
        """``(id, canon)`` of all texts of the history."""
        root = self.root
        files = [s[0] for b in self.state["live"].values() for s in b["texts"]]

        def run(batches):
            for b in batches:
                for name in b.column(0).to_pylist():
                    s = P.Segment(root, name)
                    ids, (at, size, _) = s.all()
                    data = s.bytes()
                    texts = [data[a : a + n].decode() for a, n in zip(at.tolist(), size.tolist())]
                    for i in range(0, len(texts), 4096):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 4096].view(np.int64)), pa.array(texts[i : i + 4096])], names=["id", "canon"])

        names = self.spark.createDataFrame([(n,) for n in files], "name string")
        return names.repartition(max(1, min(len(files), self.buckets))).mapInArrow(run, "id bigint, canon string")

    def _fit(self, batch: DataFrame) -> str:
        """Fit the order to the history and the batch, make the history's prints anew by it, and commit both."""
        fresh = batch.filter("canon is not null").select("canon")
        count = lambda df: df.select("canon").mapInArrow(_sets_of, "set array<bigint>")
        name = f"orders/{self.state['version'] + 1:010d}"
        texts = self.state["texts"]
        old = [self._texts().select("canon")] if texts else []
        P.put_counts(self.root, name, *fit_common(count(old[0].unionByName(fresh) if old else fresh), "set", RARE))
        live = {b: v | {"prints": []} for b, v in self.state["live"].items()}
        if texts:
            nothing = F.array().cast("array<struct<fp:bigint,chk:bigint>>")
            records = self._texts().select(F.lit(0).cast("bigint").alias("rid"), nothing.alias("keys"), "id", F.lit(0).cast("bigint").alias("chk"), "canon")
            to = f"notes/{uuid.uuid4().hex}"
            self._in_buckets(records, name, to, True).write.format("noop").mode("overwrite").save()
            live = _with(live, self._noted(to), ("prints",))
        before = self.state["order"]
        self._committed(None, live, order=name, fitted=texts)
        if before:
            P.drop(self.root, before)
        return name

    # ---- ingest -------------------------------------------------------------------------------------------

    def ingest(self, batch: DataFrame, name: str) -> DataFrame:
        """Decide ``batch`` (:func:`prepared`, as a table), add what is accepted and return the refused ``rid``.

        The result is that of taking the records one by one in their order.  ``name`` is the batch's own: ingested
        once, it returns the same rows again.
        """
        out = f"{self.path}/refused/{name}"
        if name in self.state["ingests"]:
            return self.spark.read.schema("rid bigint").parquet(out)
        with temporaries(self.spark), settings(self.spark, FILES):
            order, fitted = self.state["order"], False
            if order is None or self.state["texts"] >= REFIT * max(1, self.state["fitted"]):
                order, fitted = self._fit(batch), True
            hits, notes = self._probe(batch, order)
            if not fitted and sum(n["hot"] for n in notes):
                self._stale += [s[0] for n in notes for kind in ("prints", "texts") for s in n.get(kind, [])]
                hits, notes = self._probe(batch, self._fit(batch))
            total = {k: sum(n[k] for n in notes) for k in ("probes", "read", "candidates", "pairs", "known", "repeated")}
            live = _with(self.state["live"], notes, ("prints", "texts"))
            gone = self._decide(batch, hits, total["repeated"] + total["pairs"] > 0)
            keys = batch.select("rid", "keys").join(gone, "rid", "left_anti").select(F.explode("keys").alias("k")).select(self._bucket("k.fp"), "k.fp", F.col("k.chk").alias("x"))
            _, added = _together(lambda: gone.coalesce(2).write.mode("overwrite").parquet(out), lambda: self._add(keys))
            live = _with(live, added, ("keys",))
            count = lambda kind: sum(s[2] for b in live.values() for s in b[kind])
            self.stats.append({"ingest": name, **total, "history_prints": count("prints"), "history_keys": count("keys")})
            self._committed(name, live, texts=count("texts"))
        if len(self.stats) % 4 == 0:  # broadcast blocks of ended queries lie in memory, here and in executors, until then
            self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema("rid bigint").parquet(out)

    def _decide(self, batch: DataFrame, hits: DataFrame, contested: bool) -> DataFrame:
        """``rid`` of the records that are refused, one row each.

        What the history refuses is out at once.  The others contend for keys, in rounds: the first under all its keys
        is accepted, and takes them from the rest.  The first of all always is, so rounds come to an end; their number
        is the longest chain of decisions that depend on one another, whatever the number of records.
        """
        own = batch.select("rid", "ord", F.explode("keys").alias("k")).select("rid", "ord", "k.fp", "k.chk").join(hits, ["fp", "chk"])
        state = F.when(F.col("kind").isin(KNOWN, CANDIDATE), REFUSED).otherwise(OPEN).cast("byte").alias("state")
        rows = own.select("rid", "ord", "kfp", "kchk", state)
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        vote = lambda df: df.repartition("rid").mapInArrow(_voted, kinds)
        turn = lambda df: vote(df.repartition("kfp", "kchk").sortWithinPartitions("kfp", "kchk", "state", "ord").mapInArrow(_contended, kinds))
        rows = vote(rows)
        while True:
            rows = materialize(turn(turn(rows)) if contested else rows, "decided")  # mostly the first is accepted, then the rest refused
            if not contested or rows.filter(F.col("state") == OPEN).isEmpty():
                return rows.filter(F.col("state") == REFUSED).select("rid")


def refused_records(records: DataFrame, batch: str, excluded: DataFrame, store: History | None = None) -> DataFrame:
    """``rid`` of the records refused when ``records`` (:func:`prepared`, with the column ``batch`` kept) are
    ingested batch after batch, nulls first; ``excluded`` has the column ``key``.

    Batches are staged as they would arrive, and each ingest reads its own.  Without a ``store`` one is made and removed.
    """
    spark = records.sparkSession
    staged = scratch(spark, "staged")
    records.write.option("compression", "zstd").partitionBy(batch).parquet(staged)
    rows = spark.read.schema(records.schema).parquet(staged)
    numbers = sorted((r[0] for r in rows.select(batch).distinct().collect()), key=lambda x: (x is not None, x))  # the list of batches
    if not numbers:
        return records.select("rid").limit(0)
    own = store is None
    store = store or History.create(spark, scratch(spark, "history"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    store.exclude(excluded)
    for n in numbers:
        store.ingest(rows.filter(F.col(batch).eqNullSafe(F.lit(n))).drop(batch), str(n))
        discard(f"{staged}/{batch}={'__HIVE_DEFAULT_PARTITION__' if n is None else n}")
    if own:
        store.drop()
    discard(staged)
    return spark.read.schema("rid bigint").parquet(*[f"{store.path}/refused/{n}" for n in numbers])
