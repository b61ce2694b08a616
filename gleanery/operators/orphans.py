"""References to records that are not there at the time of the referring row.

Parents and children are put into one tagged long form ``(parent table, key, time, kind, delta)``,
grouped by parent table and key, and each child is kept whose group shows no live parent at that
point: the running sum of ``+1`` (a parent row appears) and ``-1`` (it goes) is zero.  One shuffle
carries the whole operator; no parent-child pair is ever formed.

Hot keys.  One key may hold a third of all rows, so its group must not be one task.  Keys with more
than ``hot_rows`` rows are found by a heavy-hitter sketch (its size is a parameter), their time axis is
cut at quantiles into segments of about ``hot_rows`` rows, as many as that takes, and each segment is a
group of its own.  What earlier segments
leave alive enters a later one as a *carry* row, computed from per-segment sums.  The result is the
same for any segmentation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.functions.cleaning import packed_key

CARRY, PARENT, CHILD = -1, 0, 2


@dataclass(frozen=True)
class Parent:
    """Rows of ``table``: ``key`` is there from ``start`` (included) to ``end`` (not included; null: for ever)."""

    table: str
    df: DataFrame
    key: Column
    start: Column
    end: Column


@dataclass(frozen=True)
class Child:
    """Rows of ``table`` that name ``key`` of the parent table ``parent`` at ``time``."""

    table: str
    df: DataFrame
    row_id: Column
    key: Column
    time: Column
    parent: str


def _parent_events(p: Parent) -> DataFrame:
    rows = p.df.select(
        packed_key(p.key.cast("string")).alias("key"), p.start.alias("start"), p.end.alias("end")
    ).filter("key is not null and start is not null and (end is null or end > start)")
    events = F.array(
        F.struct(F.col("start").alias("t"), F.lit(1).alias("delta")),
        F.struct(F.col("end").alias("t"), F.lit(-1).alias("delta")),
    )
    return (
        rows.select("key", F.explode(events).alias("e"))
        .filter("e.t is not null")
        .select(
            F.lit(p.table).alias("parent"), "key", F.col("e.t").alias("t"), F.lit(PARENT).cast("tinyint").alias("kind"),
            F.col("e.delta").alias("delta"), F.lit(None).cast("string").alias("table_name"), F.lit(None).cast("long").alias("row_id"),
        )
    )


def _child_events(c: Child) -> DataFrame:
    return c.df.select(
        F.lit(c.parent).alias("parent"), packed_key(c.key.cast("string")).alias("key"), c.time.alias("t"),
        F.lit(CHILD).cast("tinyint").alias("kind"), F.lit(0).alias("delta"), F.lit(c.table).alias("table_name"), c.row_id.cast("long").alias("row_id"),
    ).filter("key is not null")


def _hot(events: DataFrame, hot_rows: int, tracked: int, most: int) -> list[tuple[int, list[int]]]:
    """(hash of parent and key, inner segment bounds in microseconds) of at most ``tracked`` heavy keys: a bound for every
    ``hot_rows`` rows that the sketch counts, at most ``most`` - 1 a key."""
    h = events.select(F.xxhash64("parent", "key").alias("h"), F.unix_micros("t").alias("us")).filter("us is not null")
    top = h.agg(F.expr(f"approx_top_k(h, {tracked}, {tracked * 16})").alias("top")).first()["top"] or []
    heavy = {r["item"]: max(2, min(most, -(-r["count"] // hot_rows))) for r in top if r["count"] >= hot_rows}
    if not heavy:
        return []
    # each power of two of segments has its own aggregate, so that a key gets as many quantiles as it needs
    sizes = sorted({1 << (n - 1).bit_length() for n in heavy.values()})
    quantiles = [F.percentile_approx("us", [i / n for i in range(1, n)], max(1000, 4 * n)).alias(f"b{n}") for n in sizes]
    rows = h.filter(F.col("h").isin(list(heavy))).groupBy("h").agg(*quantiles).collect()
    return [(r["h"], sorted(set(r[f"b{1 << (heavy[r['h']] - 1).bit_length()}"]))) for r in rows]


def orphans(
    children: list[Child], parents: list[Parent], hot_rows: int = 50_000, tracked: int = 256, most_segments: int = 4096
) -> DataFrame:
    """``(parent, table_name, row_id, time)`` of every child row whose key no parent row has at its time.

    Defined cases: a null key is no reference and never an orphan; a null time can't lie in any
    parent's interval, so such a row is an orphan; a parent without ``start`` or with ``end <= start``
    is never there; a repeated row is one record; with empty parents every key is an orphan, with
    empty children the result is empty.  Only the columns named in the specs are read, so further
    columns may have any name.  ``tracked`` and ``most_segments`` bound what the driver holds of hot keys
    and what is broadcast: the bounds together are at most the rows divided by ``hot_rows / 2``.
    """
    child = _union([_child_events(c) for c in children])
    events = _union([_parent_events(p) for p in parents]).unionByName(child.filter("t is not null"))
    hot = _hot(events, hot_rows, tracked, most_segments)
    if hot:
        events = _segmented(events, hot)
    else:
        events = events.withColumn("seg", F.lit(0))
    w = W.partitionBy("parent", "key", "seg").orderBy("t", "kind").rowsBetween(W.unboundedPreceding, 0)
    found = (
        events.withColumn("live", F.sum("delta").over(w))
        .filter((F.col("kind") == CHILD) & (F.col("live") == 0))
        .select("parent", "table_name", "row_id", "t")
    )
    untimed = child.filter("t is null").select("parent", "table_name", "row_id", "t")
    return found.unionByName(untimed).dropDuplicates(["table_name", "row_id"]).withColumnRenamed("t", "time")


def _segmented(events: DataFrame, hot: list[tuple[int, list[int]]]) -> DataFrame:
    spark = events.sparkSession
    bounds = F.broadcast(spark.createDataFrame(hot, "h long, bounds array<long>"))  # at most tracked rows
    us = F.unix_micros("t")
    events = (
        events.withColumn("h", F.xxhash64("parent", "key"))
        .join(bounds, "h", "left")
        .withColumn("seg", F.when(F.col("bounds").isNull(), 0).otherwise(F.size(F.filter("bounds", lambda b: b <= us))))
    )
    sums = (
        events.filter((F.col("kind") == PARENT) & F.col("bounds").isNotNull())
        .groupBy("parent", "key", "seg", F.size("bounds").alias("last"))
        .agg(F.sum("delta").alias("delta"))
    )
    carry = (
        sums.filter("seg < last")
        .select("parent", "key", "delta", F.explode(F.sequence(F.col("seg") + 1, F.col("last"))).alias("seg"))
        .groupBy("parent", "key", "seg")
        .agg(F.sum("delta").cast("int").alias("delta"))
        .select(
            "parent", "key", F.lit(None).cast("timestamp").alias("t"), F.lit(CARRY).cast("tinyint").alias("kind"), "delta",
            F.lit(None).cast("string").alias("table_name"), F.lit(None).cast("long").alias("row_id"), "seg",
        )
    )
    return events.drop("h", "bounds").unionByName(carry)


def _union(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def orphans_by_period(found: DataFrame, period: str = "month") -> DataFrame:
    """Orphan rows per child table, parent table and period; a row without time has the period null."""
    fmt = {"month": "yyyy-MM", "day": "yyyy-MM-dd", "year": "yyyy"}[period]
    return found.groupBy("table_name", "parent", F.date_format("time", fmt).alias("period")).agg(
        F.count("*").alias("orphan_rows")
    )
