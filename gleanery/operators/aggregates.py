"""Counts, duplicates, conflicts, digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.sampling import numbered


def pivot_counts(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """Counts per ``row`` with one column per value (0 where there are none) and ``other``."""
    cols = [F.count_if(F.col(col) == v).alias(f"n_{v}") for v in values]
    other = F.count_if(~F.coalesce(F.col(col).isin(values), F.lit(False))).alias("n_other")
    return df.groupBy(row).agg(*cols, other)


def progress(df: DataFrame, batch: str, key: str, flags: list[str]) -> DataFrame:
    """Distinct keys, and those with each flag, per batch and (batch null, ``is_total``) over all.

    The total counts each key once though it may be in several batches, so it is no sum of the rows.
    """
    rows = df.filter(F.col(key).isNotNull()).groupBy(batch, key).agg(*[F.max(f).alias(f) for f in flags])
    n = [F.count("*").alias("items"), *[F.count_if(F.col(f)).alias(f) for f in flags]]
    per = rows.groupBy(batch).agg(*n).withColumn("is_total", F.lit(False))
    total = rows.groupBy(key).agg(*[F.max(f).alias(f) for f in flags]).agg(*n)
    return per.unionByName(total.select(F.lit(None).cast(df.schema[batch].dataType).alias(batch), "items", *flags, F.lit(True).alias("is_total")))


def duplicate_groups(df: DataFrame, key: str, member: str) -> DataFrame:
    """Keys with more than one member: how many, least and greatest; :func:`duplicate_members` lists them."""
    rows = df.filter(F.col(key).isNotNull()).select(key, member).distinct()
    counts = rows.groupBy(key).agg(F.count("*").alias("members"), F.min(member).alias("first_member"), F.max(member).alias("last_member"))
    return counts.filter("members > 1")


def duplicate_members(df: DataFrame, key: str, member: str) -> DataFrame:
    """Every member of the keys that have more than one, a row each, with the key's number of members.

    The long form has no list that one key could fill; counts have partial results, and the join splits hot keys.
    """
    rows = df.filter(F.col(key).isNotNull()).select(key, F.col(member).alias("member")).distinct()
    counts = rows.groupBy(key).agg(F.count("*").alias("members")).filter("members > 1")
    return rows.join(counts, key).select(key, "members", "member")


def resolved_label(df: DataFrame, key: str, label: str, verified: list[str]) -> DataFrame:
    """Per key the label that all verified evidence names.

    One distinct label: ``verified``; several: label ``unknown``, ``conflict``; none: ``unknown``, ``no_evidence``.
    """
    known = F.when(F.col(label).isin(verified), F.col(label))
    got = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(known).alias("labels"), F.min(known).alias("_l"), F.count(known).alias("evidence"))
    return got.select(
        key, F.when(F.col("labels") == 1, F.col("_l")).otherwise("unknown").alias("label"), "labels", "evidence",
        F.when(F.col("labels") == 1, "verified").when(F.col("labels") > 1, "conflict").otherwise("no_evidence").alias("status"),
    )


def set_digest(df: DataFrame, row: Column) -> DataFrame:
    """A digest of a frame as a bag of rows, whatever their order: number of rows, sum and xor of row hashes.

    It is combined from partial results and needs no sort; ``ordered_digest`` is the byte-exact form of short lists.
    """
    h = F.conv(F.substring(F.sha2(row, 256), 1, 12), 16, 10).cast("long")
    return df.select(h.alias("h")).agg(F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("hash_sum"), F.bit_xor("h").alias("hash_xor"))


def ordered_digest(df: DataFrame, group: list[str], item: str, fan: int = 1000) -> DataFrame:
    """sha256 of each group's sorted items (texts) joined by line feeds; above ``fan`` items, of the digests of runs of
    ``fan`` sorted items, and so on, a tree.  No list is longer than ``fan``; null items count for nothing."""
    rows = numbered(df.filter(F.col(item).isNotNull()).select(*group, F.col(item).alias("_x")), [*group, "_x"], "_no")
    first = rows.groupBy(*group).agg(F.min("_no").alias("_first"), F.count("*").alias("items"))
    same = reduce(lambda a, b: a & b, [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group])
    rows = rows.alias("a").join(first.alias("b"), same).select(*[F.col(f"a.{g}").alias(g) for g in group], (F.col("_no") - F.col("_first")).alias("_at"), "_x", "items")
    most = rows.agg(F.max("items")).first()[0] or 0  # one number: how deep the tree is
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda s: s["_x"]), "\n")
    while True:
        run = F.floor(F.col("_at") / fan).alias("_at")
        rows = rows.groupBy(*group, "items", run).agg(F.sha2(joined, 256).alias("_x"))
        if most <= fan:
            return rows.select(*group, "items", F.col("_x").alias("digest"))
        most = -(-most // fan)


def reindexed_counts(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    """Counts in a fixed order of values, 0 for those without rows, others left out; ``place`` is the order."""
    spark = df.sparkSession
    order = spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{col} string, place int")
    counts = df.filter(F.col(col).isin(values)).groupBy(col).agg(F.count("*").alias("n"))
    return order.join(counts, col, "left").select(col, "place", F.coalesce("n", F.lit(0)).alias("n"))


def distributions(df: DataFrame, columns: list[str], crossed: list[tuple[str, str]]) -> DataFrame:
    """Counts of each value of each column and of pairs, in one aggregation.

    ``(statistic, value, n)``; null values count as ``null``.  All share one scan, and partial counts come before
    the one shuffle.
    """
    sets = [[c] for c in columns] + [list(p) for p in crossed]
    name = lambda s: " x ".join(s)
    text = lambda s: F.concat_ws(" x ", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in s])
    pairs = F.array(*[F.struct(F.lit(name(s)).alias("statistic"), text(s).alias("value")) for s in sets])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.statistic", "p.value").agg(F.count("*").alias("n"))
