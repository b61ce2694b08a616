"""Deterministic selection: hash ranks, orders, deals, quotas."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.functions.keys import rank_key
from gleanery.session import materialize
from gleanery.streaming.collect import accept


def hash_rank_top_k(df: DataFrame, strata: list[str], key: str, k: int, seed: int = 42, purpose: str = "sample") -> DataFrame:
    """The ``k`` rows of each stratum with the smallest rank keys, with ``rank_in_stratum``.

    Spark limits each partition to ``k`` rows a stratum before the shuffle, so a hot stratum is no hot task.
    """
    w = W.partitionBy(*strata).orderBy(rank_key(seed, purpose, key), key)
    return df.withColumn("rank_in_stratum", F.row_number().over(w)).filter(F.col("rank_in_stratum") <= k)


def numbered(df: DataFrame, order: list[Column | str], into: str = "position") -> DataFrame:
    """1, 2, ... over the whole frame in ``order`` without one task that sorts all.

    Rows are range-partitioned and sorted within, and each partition's offset is the number of rows
    before it.  Equal order keys are numbered in no particular order.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    rows = materialize(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "numbered")
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a partition
    before = counts.withColumn("_before", F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)))
    offsets = F.broadcast(before.select("_part", F.coalesce("_before", F.lit(0)).alias("_before")))
    return rows.join(offsets, "_part").withColumn(into, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def _by_range(df: DataFrame, col: str, what: str) -> DataFrame:
    """``df`` sorted by ``col`` over range partitions, as a table, with the number of each row's partition as ``_part``."""
    return materialize(df.repartitionByRange(col).withColumn("_part", F.spark_partition_id()), what)


def with_next(df: DataFrame, col: str, into: str, last: Column) -> DataFrame:
    """Each row with the next value of ``col`` over the whole frame, ``last`` for the greatest, without one task that sees
    all: within range partitions by ``lead``, across them by the first value of the next (a row a partition)."""
    rows = _by_range(df, col, "ranges")
    firsts = rows.groupBy("_part").agg(F.min(col).alias("_first"))  # one row a partition
    after = F.broadcast(firsts.select("_part", F.lead("_first").over(W.orderBy("_part")).alias("_after")))
    within = F.lead(col).over(W.partitionBy("_part").orderBy(col))
    return rows.join(after, "_part").withColumn(into, F.coalesce(within, F.col("_after"), last)).drop("_part", "_after")


def with_sum_before(df: DataFrame, col: str, value: str, into: str) -> DataFrame:
    """Each row with the sum of ``value`` over all rows of lesser ``col``; ``col`` is unique.  As :func:`with_next`."""
    rows = _by_range(df, col, "ranges")
    sums = rows.groupBy("_part").agg(F.sum(value).alias("_n"))  # one row a partition
    before = F.broadcast(sums.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before")))
    within = F.coalesce(F.sum(value).over(W.partitionBy("_part").orderBy(col).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.join(before, "_part").withColumn(into, F.col("_before") + within).drop("_part", "_before")


def bucketed(df: DataFrame, strata: list[str], key: str, buckets: int, size: int, seed: int = 42) -> DataFrame:
    """Of each stratum ``buckets`` runs of ``size`` consecutive hash ranks, numbered from 0 as ``bucket``."""
    got = hash_rank_top_k(df, strata, key, buckets * size, seed, "bucket")
    return got.withColumn("bucket", F.floor((F.col("rank_in_stratum") - 1) / size).cast("int"))


def round_robin(df: DataFrame, order: list[Column | str], people: list[str], into: str = "assignee") -> DataFrame:
    """Rows dealt to ``people`` in turn, in one order over all."""
    names = F.array(*[F.lit(p) for p in people])
    return numbered(df, order).withColumn(into, F.get(names, F.pmod(F.col("position") - 1, F.lit(len(people))).cast("int")))


def first_of(df: DataFrame, keys: list[str], order: list[str], kept: list[str], others: str, id_col: str) -> DataFrame:
    """Of each key the first row in ``order`` (its ``kept`` columns) and how many ``others`` were left out.

    One aggregation with partial results; null keys form no group.
    """
    rows = df.dropna(subset=keys)
    first = F.min(F.struct(*[F.col(c) for c in [*order, *kept]])).alias("f")
    got = rows.groupBy(*keys).agg(first, (F.count_distinct(id_col) - 1).alias(others))
    return got.select(*keys, *[F.col(f"f.{c}").alias(c) for c in dict.fromkeys([*order, *kept]) if c not in keys], others)


def largest_remainder(counts: DataFrame, key: str, count: str, size: int) -> DataFrame:
    """Integer shares of ``size`` in proportion to ``count``, never above it; ties by key.

    ``counts`` is already aggregated, a row per stratum.  ``size`` above the total gives everything.
    """
    every = W.partitionBy(F.lit(0))
    total = F.sum(count).over(every)
    want = F.least(F.lit(size), total)
    exact = F.col(count) * want  # whole numbers, so that remainders are exact
    base = F.floor(exact / total).cast("long")
    rows = counts.withColumn("_base", base).withColumn("_rest", exact - base * total).withColumn("_want", want)
    left = F.col("_want") - F.sum("_base").over(every)
    by = F.row_number().over(W.orderBy(F.col("_rest").desc(), F.col(key)))
    return rows.withColumn("_by", by).withColumn("_left", left).select(
        key, count, (F.col("_base") + (F.col("_by") <= F.col("_left")).cast("long")).alias("quota")
    )


def take_quota(df: DataFrame, quotas: DataFrame, key: str, row_key: str, seed: int = 42, purpose: str = "quota") -> DataFrame:
    """Of each stratum its ``quota`` rows of smallest rank key.  ``quotas`` has a row per stratum."""
    most = quotas.agg(F.max("quota")).first()[0] or 0
    ranked = hash_rank_top_k(df, [key], row_key, int(most), seed, purpose)
    return ranked.join(quotas.select(key, "quota"), key).filter(F.col("rank_in_stratum") <= F.col("quota"))


def representative_and_targeted(df: DataFrame, key: str, row_key: str, score: str, size: int, share: float = 0.6, seed: int = 42) -> DataFrame:
    """``share`` of ``size`` in proportion to the strata, the rest by highest ``score`` among what is left."""
    first = round(size * share)
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    rep = take_quota(df, largest_remainder(counts, key, "n", first), key, row_key, seed).select(row_key)
    rest = df.join(rep, row_key, "left_anti").orderBy(F.col(score).desc(), rank_key(seed, "targeted", row_key)).limit(size - first)
    return rep.withColumn("component", F.lit("representative")).unionByName(rest.select(row_key).withColumn("component", F.lit("targeted")))


def quota_prefix(df: DataFrame, key: str, label: str, order: list[str], quotas: dict[str, int], target: int) -> DataFrame:
    """Rows accepted in stream order: first of its key, label below its quota, total below the target.

    Decided as :func:`gleanery.streaming.collect.accept` does, exactly as one after the other.  Null keys and labels are
    not accepted.
    """
    return accept(df, key, label, order, quotas, target)


def twister_sample(keys: list[str], size: int, seed: int) -> list[str]:
    """X03, X05 in parity mode: ``random.Random(seed).sample`` of the sorted keys, on the driver, for lists of
    a few thousand; :func:`hash_rank_top_k` is the form for tables."""
    return random.Random(seed).sample(sorted(keys), size)


def twister_strata(df: DataFrame, stratum: str, key: str, order: list[str], size: int, seed: int) -> DataFrame:
    """X03 in parity mode: ``size`` keys of each stratum, as one ``random.Random(seed)`` samples the strata's sorted
    keys in the given ``order`` of strata; a stratum of fewer keys gives all, and ``pool`` has their number.

    A sample is of places, whatever the keys, so only the number of keys of each stratum comes to the driver, and the
    keys are numbered there where they lie.
    """
    no = F.create_map(*[F.lit(x) for i, s in enumerate(order) for x in (s, i)])[F.col(stratum)]
    rows = df.filter(F.col(key).isNotNull() & F.col(stratum).isin(order)).select(stratum, key, no.alias("_no")).distinct()
    rows = numbered(rows, ["_no", key])
    counts = {r["_no"]: r["n"] for r in rows.groupBy("_no").agg(F.count("*").alias("n")).collect()}  # a row per stratum
    rng, before, picks = random.Random(seed), 0, []
    for i in range(len(order)):
        n = counts.get(i, 0)
        picks += [(before + at + 1, place, n) for place, at in enumerate(rng.sample(range(n), min(size, n)), 1)]
        before += n
    drawn = df.sparkSession.createDataFrame(picks, "position long, place int, pool long")  # size x strata rows
    return rows.join(F.broadcast(drawn), "position").select(stratum, "place", key, "pool")


def twister_order(keys: list[str], seed: int) -> list[str]:
    """X05 in parity mode: the sorted keys shuffled by ``random.Random(seed)``."""
    out = sorted(keys)
    random.Random(seed).shuffle(out)
    return out
