"""A sample whose shares per category match targets, with minimum counts and availability caps.

Categories are counted with partial aggregation; quotas are integers by largest remainder between
floors and caps; of each category the smallest random keys are taken.  The cut through the keys is
found from a histogram of the keys, so no category is ever sorted or gathered as a whole, though one
may hold a third of all rows: only the one histogram cell that holds the cut is ranked.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.functions.cleaning import cleaned, cleaned_hash
from gleanery.session import materialize

CATEGORY = ["source_dataset", "source_label", "model_prediction"]


def latest_usable(predictions: DataFrame) -> DataFrame:
    """One row per image: ``content_hash`` and the cleaned category of its latest usable prediction.

    Usable: confidence in [0, 1] (null and NaN are not), source_label real or fake, model_prediction
    low, medium or high, source_dataset not empty; a null hash names no image.  Of rows with the same
    latest time the largest category stands; a null time is earlier than any.
    """
    rows = predictions.select(
        cleaned_hash("content_hash").alias("content_hash"), "confidence", "predicted_at", *[cleaned(c).alias(c) for c in CATEGORY]
    ).filter(
        F.col("content_hash").isNotNull() & ~F.isnan("confidence") & F.col("confidence").between(0, 1)
        & F.col("source_label").isin("real", "fake") & F.col("model_prediction").isin("low", "medium", "high") & (F.col("source_dataset") != "")
    )
    last = F.max(F.struct("predicted_at", *CATEGORY)).alias("last")
    return rows.groupBy("content_hash").agg(last).select("content_hash", *[f"last.{c}" for c in CATEGORY])


def availability(images: DataFrame, targets: DataFrame) -> DataFrame:
    """The targets with ``available`` images of their category and ``needed``: the larger of min_count and
    target_share x sample_size, rounded half up; nulls among the numbers count as 0."""
    have = images.groupBy(*CATEGORY).agg(F.count("*").alias("available"))
    share = F.coalesce(F.round(F.col("target_share") * F.col("sample_size")), F.lit(0)).cast("long")
    rows = targets.select(
        "target_id", "sample_name", "sample_size", "target_share", "min_count", *[cleaned(c).alias(c) for c in CATEGORY],
        F.greatest(share, F.coalesce("min_count", F.lit(0))).alias("needed"),
    )
    return rows.join(have, CATEGORY, "left").withColumn("available", F.coalesce("available", F.lit(0)))


def allocate(size: int, shares: list[float], floors: list[int], caps: list[int]) -> list[int]:
    """Integer quotas that sum to ``size`` where floors and caps leave room.

    Each quota is ``level x share`` held between floor and cap, with one level for all; fractions are
    rounded by largest remainder, ties by larger share and then by place.  Floors above a cap fall to
    it.  Where the floors alone exceed ``size`` they stand, where the caps fall short of it they do.
    """
    f = [min(max(0, lo), c) for lo, c in zip(floors, caps)]
    s = [Fraction(max(0.0, x)) for x in shares]
    if sum(f) >= size:
        return f
    reach = [c if x > 0 else lo for c, x, lo in zip(caps, s, f)]
    if sum(reach) <= size:
        return reach
    at = lambda level: [min(max(level * x, lo), r) for x, lo, r in zip(s, f, reach)]
    marks = sorted({m for x, lo, r in zip(s, f, reach) if x > 0 for m in (lo / x, r / x)})
    lo = Fraction(0)
    for hi in marks:  # the sum grows with the level and is linear between marks
        if sum(at(hi)) >= size:
            break
        lo = hi
    a, b = sum(at(lo)), sum(at(hi))
    quota = at(lo + (hi - lo) * (size - a) / (b - a))
    whole = [int(q) for q in quota]
    by = sorted(range(len(s)), key=lambda i: (whole[i] - quota[i], -s[i], i))
    for i in by[: size - sum(whole)]:
        whole[i] += 1
    return whole


def quotas(available: DataFrame) -> DataFrame:
    """``available`` with ``quota``: one :func:`allocate` per sample.  The targets are a specification of
    a handful of rows per sample, so a sample's targets are one group."""
    fields = available.select("target_id", "sample_name", *CATEGORY, "needed", "available").schema

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("target_id")
        numbers = rows.fillna({"target_share": 0.0, "min_count": 0, "sample_size": 0})
        rows["quota"] = allocate(
            int(numbers["sample_size"].max()), [float(x) for x in numbers["target_share"]], [int(x) for x in numbers["min_count"]],
            [int(x) for x in rows["available"]],
        )
        return rows[[*fields.names, "quota"]]

    ddl = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in fields) + ", quota long"
    return available.groupBy("sample_name").applyInPandas(one, ddl)


def draw(images: DataFrame, quota: DataFrame, seed: int = 0, cells: int = 4096) -> DataFrame:
    """``(sample_name, target_id, content_hash)``: of each target's category the ``quota`` smallest random keys.

    The keys are hashes of seed, sample and image, so samples are independent and a rerun is equal.
    ``quota`` must be a table (its size decides whether it is broadcast).
    """
    cell_bits = cells.bit_length() - 1
    key: Column = F.xxhash64(F.lit(seed), "sample_name", "content_hash")
    pool = (
        images.join(quota.filter("quota > 0").select("sample_name", "target_id", "quota", *CATEGORY), CATEGORY)
        .select("sample_name", "target_id", "quota", "content_hash", key.alias("key"))
        .withColumn("cell", F.shiftrightunsigned("key", 64 - cell_bits).cast("int"))
    )
    w = W.partitionBy("target_id").orderBy("cell")
    hist = pool.groupBy("target_id", "quota", "cell").agg(F.count("*").alias("n"))
    cut = (
        hist.withColumn("before", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
        .filter("before < quota and before + n >= quota")
        .select("target_id", F.col("cell").alias("cut"), (F.col("quota") - F.col("before")).alias("rest"))
    )
    pool = pool.join(materialize(cut, "cuts"), "target_id")
    inner = pool.filter("cell < cut")
    edge = pool.filter("cell = cut").withColumn("rank", F.row_number().over(W.partitionBy("target_id").orderBy("key", "content_hash")))
    cols = ["sample_name", "target_id", "content_hash"]
    return inner.select(*cols).unionByName(edge.filter("rank <= rest").select(*cols))


def sample_plan(predictions: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The usable images and the targets with needed, available, quota and shortfall, both as tables."""
    images = materialize(latest_usable(predictions), "usable")
    plan = quotas(availability(images, targets)).withColumn("shortfall", F.greatest(F.lit(0), F.col("needed") - F.col("available")))
    return images, materialize(plan, "quotas", 1)
