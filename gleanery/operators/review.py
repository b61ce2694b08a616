"""Append-only histories: latest state, chains, leases, merges."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: list[str], kept: list[str]) -> DataFrame:
    """Of each key the row that is last in ``order``; partial results before the shuffle, so a hot key is
    no hot task.  Null keys form no group."""
    got = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*[F.col(c) for c in dict.fromkeys([*order, *kept])])).alias("m"))
    return got.select(key, *[F.col(f"m.{c}").alias(c) for c in dict.fromkeys([*order, *kept])])


def latest_or_original(original: DataFrame, changes: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Each original row with the fields of the last change of its key, where that has them, and ``changed``."""
    last = latest(changes, key, order, fields).select(key, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_c"))
    rows = original.join(last, key, "left")
    for f in fields:
        rows = rows.withColumn(f, F.coalesce(f"_{f}", f))
    return rows.withColumn("changed", F.coalesce("_c", F.lit(False))).drop("_c", *[f"_{f}" for f in fields])


def chain_breaks(df: DataFrame, key: str, order: list[str], time: str, action: str, payload: Column) -> DataFrame:
    """Per key the events, and those out of order in time, and confirmations whose payload is not the one before.

    ``lag`` within the key's order; no event list is gathered.
    """
    w = W.partitionBy(key).orderBy(*order)
    rows = df.filter(F.col(key).isNotNull()).withColumn("_p", payload)
    rows = rows.withColumn("_bt", F.lag(time).over(w)).withColumn("_bp", F.lag("_p").over(w)).withColumn("_n", F.row_number().over(w))
    late = F.col(time) < F.col("_bt")
    differs = (F.col("_n") > 1) & (F.col(action) == "confirm") & ~F.col("_p").eqNullSafe(F.col("_bp"))
    return rows.groupBy(key).agg(F.count("*").alias("events"), F.count_if(F.coalesce(late, F.lit(False))).alias("time_breaks"), F.count_if(F.coalesce(differs, F.lit(False))).alias("payload_breaks"))


def folded(df: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """The state after each event: of each field the last value set so far."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.select("*", *[F.last(f, ignorenulls=True).over(w).alias(f"state_{f}") for f in fields])


def sessions(df: DataFrame, key: str, time: str, order: list[str], gap_seconds: int) -> DataFrame:
    """Runs of a key's events with at most ``gap_seconds`` between neighbours, numbered from 1 as ``session``."""
    w = W.partitionBy(key).orderBy(time, *order)
    us = F.unix_micros(F.col(time).cast("timestamp"))
    fresh = F.coalesce(us - F.lag(us).over(w) > gap_seconds * 1_000_000, F.lit(True))
    return df.withColumn("_f", fresh.cast("int")).withColumn("session", F.sum("_f").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_f")


# What may be asked of a lease queue, and what may come of it.
LEASE_OPS = ("reserve", "renew", "release", "complete")
LEASE_SCHEMA = "event_id long, queue string, outcome string, item string, token long, expires double"


def lease_replay(events: DataFrame, items: DataFrame, seconds: float) -> DataFrame:
    """A log of requests to lease queues, replayed: what each request gets.

    ``events``: queue, event_id (unique), person, op, token (of the lease meant, else null), at (seconds).  ``items``:
    queue, item.  A queue serves its requests in order of ``at``, then event_id:

    * reserve: expired leases go; a person who holds one gets it back unchanged (``resumed``), else the least item that
      nobody holds and that isn't done (``granted``), else ``empty``.  The token is the number of the granting event.
    * renew: a live lease of that token and person ends ``seconds`` from now (``renewed``), else ``expired``.
    * release: a lease of that token and person goes (``released``), else ``none``.
    * complete: a live lease of that token and person goes and its item is done (``completed``), else ``expired``.

    Other ops are ``unknown``.  Each request depends on those before it in its queue, so a queue is one sequence; queues
    (a batch's images of one kind) are independent and spread over tasks, which hold the open leases of one queue and
    its open items.  Requests and items come sorted, from disk if need be, never as a group.
    """
    e = events.select("queue", F.lit(1).alias("kind"), F.col("at").cast("double").alias("at"), "event_id", "person", "op", F.col("token").cast("long").alias("token"), F.lit(None).cast("string").alias("item"))
    i = items.filter(F.col("item").isNotNull()).select("queue", F.lit(0).alias("kind"), F.lit(None).cast("double").alias("at"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("string").alias("person"), F.lit(None).cast("string").alias("op"), F.lit(None).cast("long").alias("token"), F.col("item").cast("string").alias("item")).distinct()
    rows = e.unionByName(i).filter(F.col("queue").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, state = None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["queue"] != queue:
                    queue, state = r["queue"], LeaseQueue(seconds)
                if r["kind"] == 0:
                    state.add(r["item"])
                else:
                    out.append((r["event_id"], queue, *state.serve(r["op"], r["person"], r["token"], r["event_id"], r["at"])))
            names = ["event_id", "queue", "outcome", "item", "token", "expires"]
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64()]
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=names)

    return rows.repartition("queue").sortWithinPartitions("queue", "kind", "item", "at", "event_id").mapInArrow(run, LEASE_SCHEMA)


class LeaseQueue:
    """One queue of :func:`lease_replay`: one lease an item, one a person."""

    def __init__(self, seconds: float):
        self.seconds, self.open, self.back = seconds, deque(), []
        self.leases: dict[int, list] = {}  # token: [item, person, expires]
        self.of: dict[str, int] = {}

    def add(self, item: str) -> None:
        """Items come in ascending order."""
        self.open.append(item)

    def _drop(self, token: int, returned: bool) -> str:
        item, person, _ = self.leases.pop(token)
        del self.of[person]
        if returned:
            heapq.heappush(self.back, item)
        return item

    def serve(self, op: str, person: str, token: int | None, number: int, at: float) -> tuple:
        if op == "reserve":
            for t in [t for t, x in self.leases.items() if x[2] <= at]:
                self._drop(t, True)
            if person in self.of:
                t = self.of[person]
                return "resumed", self.leases[t][0], t, self.leases[t][2]
            if not self.open and not self.back:
                return "empty", None, None, None
            first = heapq.heappop(self.back) if self.back and (not self.open or self.back[0] < self.open[0]) else self.open.popleft()
            self.leases[number], self.of[person] = [first, person, at + self.seconds], number
            return "granted", first, number, at + self.seconds
        if op not in LEASE_OPS:
            return "unknown", None, token, None
        mine = self.leases.get(token)
        if mine is None or mine[1] != person or (op != "release" and mine[2] <= at):
            return ("none" if op == "release" else "expired"), None, token, None
        if op == "renew":
            mine[2] = at + self.seconds
            return "renewed", mine[0], token, mine[2]
        return ("released" if op == "release" else "completed"), self._drop(token, op == "release"), token, None


def review_errors(reviews: DataFrame, originals: DataFrame, key: str) -> DataFrame:
    """Each review with the first rule it breaks, null if none: no_annotation, self_review, unknown_action,
    missing_reason.  ``originals``: key and annotator_key, of each key one row; ``reviews``: reviewer_key, action, reason."""
    there = originals.filter(F.col(key).isNotNull()).select(key, F.col("annotator_key").alias("_by"), F.lit(True).alias("_o"))
    blank = F.btrim(F.coalesce("reason", F.lit("")), F.lit(" \t\r\n")) == ""
    error = (
        F.when(F.col("_o").isNull(), "no_annotation").when(F.coalesce(F.col("_by") == F.col("reviewer_key"), F.lit(False)), "self_review")
        .when(~F.coalesce(F.col("action").isin("confirm", "correct"), F.lit(False)), "unknown_action").when((F.col("action") == "correct") & blank, "missing_reason")
    )
    return reviews.join(there, key, "left").withColumn("error", error).drop("_by", "_o")


def model_review_fold(events: DataFrame, key: str, person: str, order: list[str], prediction: str) -> DataFrame:
    """Blind model reviews as a log of ``op`` (initial, final, complete) and ``label``: what comes of each event.

    The first valid initial label of a key and person stands: another one is ``initial_fixed``, the same again ``saved``.
    Without it the other ops are ``no_initial``.  A key is completed once: later ones are ``already_completed``.  A label
    that is no level is ``bad_label``.  A completion has ``agreement_initial`` and ``agreement_final`` with the prediction.
    """
    valid = F.coalesce(F.col("label").isin("low", "medium", "high"), F.lit(False))
    mine = W.partitionBy(key, person).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = events.withColumn("initial", F.first(F.when((F.col("op") == "initial") & valid, F.col("label")), ignorenulls=True).over(mine))
    done = (F.col("op") == "complete") & valid & F.col("initial").isNotNull()
    first = rows.filter(done & F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order, person)).alias("_first"))
    rows = rows.join(first, key, "left")
    outcome = (
        F.when(~valid, "bad_label").when(F.col("initial").isNull(), "no_initial")
        .when((F.col("op") == "initial") & (F.col("label") != F.col("initial")), "initial_fixed")
        .when((F.col("op") == "complete") & ~F.struct(*order, person).eqNullSafe(F.col("_first")), "already_completed")
        .when(F.col("op") == "complete", "completed").when(F.col("op").isin("initial", "final"), "saved").otherwise("unknown")
    )
    agrees = lambda c: F.when(F.col("outcome") == "completed", F.col(c).eqNullSafe(F.col(prediction)))
    return rows.withColumn("outcome", outcome).drop("_first").withColumn("agreement_initial", agrees("initial")).withColumn("agreement_final", agrees("label"))


def snapshot_plan(returned: DataFrame, imports: DataFrame, master: DataFrame, reserved: DataFrame) -> DataFrame:
    """What a merge would do with each returned review event.

    ``returned``: snapshot_id, local_review_id, content_hash, event_sha256.  ``imports``: snapshot_id, local_review_id,
    event_sha256 and ``current_sha256``, the digest of the event as the master has it now.  ``master``: content_hash of
    reviewed keys; ``reserved``: content_hash under a live review lease.  An event imported before, known by snapshot and
    local id, is ``identical`` if both digests are its own, else ``conflict_changed``; of the others a key that the master
    has reviewed is ``conflict_reviewed``, one that is reserved ``conflict_reserved``, and the rest ``pending``.
    """
    old = imports.groupBy("snapshot_id", "local_review_id").agg(F.min("event_sha256").alias("_e"), F.max("event_sha256").alias("_f"), F.min("current_sha256").alias("_c"), F.lit(True).alias("_old"))
    has = lambda df, n: df.filter(F.col("content_hash").isNotNull()).select("content_hash").distinct().withColumn(n, F.lit(True))
    got = returned.join(old, ["snapshot_id", "local_review_id"], "left").join(has(master, "_m"), "content_hash", "left").join(has(reserved, "_r"), "content_hash", "left")
    same = F.coalesce((F.col("_e") == F.col("event_sha256")) & (F.col("_f") == F.col("event_sha256")) & (F.col("_c") == F.col("event_sha256")), F.lit(False))
    plan = (
        F.when(F.col("_old") & same, "identical").when(F.col("_old"), "conflict_changed").when(F.col("_m"), "conflict_reviewed")
        .when(F.col("_r"), "conflict_reserved").otherwise("pending")
    )
    return got.withColumn("plan", plan).drop("_e", "_f", "_c", "_old", "_m", "_r")


def snapshot_errors(base: DataFrame, current: DataFrame, created: Column) -> DataFrame:
    """The events a returned snapshot adds, with the first rule they break, null if none: base_changed (an event of
    the base is missing or differs, listed too), predates_base, re_review, predates_snapshot.

    ``base`` and ``current``: review_id, content_hash, reviewed_at and ``event_sha256``; ``created`` the issue time."""
    top = base.agg(F.coalesce(F.max("review_id"), F.lit(0)).alias("_top"))  # one row
    had = base.filter(F.col("content_hash").isNotNull()).select("content_hash").distinct().withColumn("_had", F.lit(True))
    b = base.select("review_id", F.col("event_sha256").alias("_b"), F.col("content_hash").alias("_bh"))
    got = current.join(b, "review_id", "full_outer").join(had, "content_hash", "left").join(F.broadcast(top), F.lit(True))
    fresh = F.col("_b").isNull()
    first = W.partitionBy("content_hash", fresh).orderBy("review_id")
    got = got.withColumn("_n", F.row_number().over(first))
    error = (
        F.when(~fresh & ~F.col("event_sha256").eqNullSafe(F.col("_b")), "base_changed").when(~fresh, None).when(F.col("review_id") <= F.col("_top"), "predates_base")
        .when(F.col("_had") | (F.col("_n") > 1), "re_review").when(~F.coalesce(F.col("reviewed_at") >= created, F.lit(False)), "predates_snapshot")
    )
    rows = got.withColumn("error", error).filter(fresh | F.col("error").isNotNull())
    return rows.select("review_id", F.coalesce("content_hash", "_bh").alias("content_hash"), "error")


def chain_errors(events: DataFrame, originals: DataFrame, key: str, rubric: list[str]) -> DataFrame:
    """Each review event with the first rule its chain breaks, null if none: no_annotation, self_review,
    unknown_action, missing_reason, time_backward (before the event before it, the first before the original), and
    payload_changed: a confirmation that differs from the event before it, or a correction that differs outside the rubric.

    ``events``: key, review_id (the order), reviewer_key, action, reason, at (timestamp), ``kept`` (digest of the payload
    outside the rubric) and the rubric's fields; ``originals``: key, annotator_key, at, ``kept`` and the fields, one a key.
    Original and events are one sequence, in which ``lag`` has what came before.
    """
    o = originals.filter(F.col(key).isNotNull()).select(key, F.lit(-1).cast("long").alias("review_id"), F.col("annotator_key").alias("reviewer_key"), F.lit("original").alias("action"), F.lit(None).cast("string").alias("reason"), "at", "kept", *rubric)
    both = o.unionByName(events.select(key, F.col("review_id").cast("long").alias("review_id"), "reviewer_key", "action", "reason", "at", "kept", *rubric))
    w = W.partitionBy(key).orderBy("review_id")
    rows = both.withColumn("_p", F.lag(F.struct("at", "kept", F.struct(*rubric).alias("r"))).over(w))
    rows = rows.withColumn("_by", F.first(F.when(F.col("action") == "original", F.col("reviewer_key"))).over(w)).withColumn("_o", F.first(F.col("action") == "original").over(w))
    same = F.col("kept").eqNullSafe(F.col("_p.kept")) & ((F.col("action") == "correct") | F.struct(*rubric).eqNullSafe(F.col("_p.r")))
    blank = F.btrim(F.coalesce("reason", F.lit("")), F.lit(" \t\r\n")) == ""
    error = (
        F.when(~F.coalesce("_o", F.lit(False)), "no_annotation").when(F.coalesce(F.col("_by") == F.col("reviewer_key"), F.lit(False)), "self_review")
        .when(~F.coalesce(F.col("action").isin("confirm", "correct"), F.lit(False)), "unknown_action").when((F.col("action") == "correct") & blank, "missing_reason")
        .when(~F.coalesce(F.col("at") >= F.col("_p.at"), F.lit(False)), "time_backward").when(~same, "payload_changed")
    )
    return rows.filter(F.col("action").isNull() | (F.col("action") != "original")).select(key, "review_id", error.alias("error"))


def snapshot_summary(images: DataFrame, annotated: DataFrame, reviewed: DataFrame, key: str) -> DataFrame:
    """Images, annotated, unannotated, reviewed and awaiting review, by distinct keys."""
    n = lambda df, name: df.filter(F.col(key).isNotNull()).agg(F.count_distinct(key).alias(name))
    got = n(images, "images").join(n(annotated, "annotated"), F.lit(True)).join(n(reviewed, "reviewed"), F.lit(True))  # one row each
    return got.withColumn("unannotated", F.col("images") - F.col("annotated")).withColumn("awaiting_review", F.col("annotated") - F.col("reviewed"))


def merge_plan(master: DataFrame, returned: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Per returned row ``pending`` (new), ``identical`` or ``conflict`` with the master; a merge may
    run only where no row is in conflict, and running it twice gives the same master."""
    pack = lambda d, n: d.select(*keys, F.struct(*fields).alias(n))
    plan = F.when(F.col("_m").isNull(), "pending").when(F.col("_m").eqNullSafe(F.col("_r")), "identical").otherwise("conflict")
    return pack(returned, "_r").join(pack(master, "_m"), keys, "left").select(*keys, plan.alias("plan"))


def merged(master: DataFrame, returned: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The master with the pending rows; raises, when it runs, if any row is in conflict."""
    plan = merge_plan(master, returned, keys, fields)
    checked = plan.filter("plan <> 'identical'").withColumn(
        "plan", F.when(F.col("plan") == "conflict", F.raise_error(F.lit("the returned rows conflict with the master"))).otherwise(F.col("plan"))
    )
    new = returned.join(checked.filter("plan = 'pending'").select(*keys), keys, "left_semi")
    return master.select(*keys, *fields).unionByName(new.select(*keys, *fields))
