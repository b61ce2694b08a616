"""Checks that come out as rows: uniqueness, order, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``(rule, rows, broken)`` of all rules in one scan; a rule is broken where it is false or null."""
    n = F.array(*[F.struct(F.lit(k).alias("rule"), F.count_if(~F.coalesce(c, F.lit(False))).alias("broken")) for k, c in rules.items()])
    return df.agg(F.count("*").alias("rows"), n.alias("n")).select("rows", F.inline("n")).select("rule", "rows", "broken")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number; nulls count as a key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def gaps(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """Per group whether ``order`` runs 1, 2, ... n without gap or repeat, from counts alone."""
    n = F.count(order)
    got = df.groupBy(*group).agg(n.alias("rows"), F.min(order).alias("first"), F.max(order).alias("last"), F.count_distinct(order).alias("places"))
    return got.withColumn("contiguous", (F.col("first") == 1) & (F.col("last") == F.col("rows")) & (F.col("places") == F.col("rows")))


def first_open(df: DataFrame, group: list[str], position: str, done: str) -> DataFrame:
    """Per group the least position that is not done, 0 if all are."""
    return df.groupBy(*group).agg(F.coalesce(F.min(F.when(~F.coalesce(F.col(done), F.lit(False)), F.col(position))), F.lit(0)).alias("resume_at"))


def running_order_ok(df: DataFrame, group: list[str], order: str, time: str) -> DataFrame:
    """Rows whose time is before that of the row before them in ``order``."""
    w = W.partitionBy(*group).orderBy(order)
    return df.withColumn("_b", F.lag(time).over(w)).filter(F.col(time) < F.col("_b")).drop("_b")
