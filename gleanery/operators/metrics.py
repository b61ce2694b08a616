"""Evaluation of classifiers: binary, multiclass, ordinal, per stratum.

Every metric is a combination of counts and sums, so that one aggregation with partial results gives it for all
strata.  Ratios without a denominator are null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.operators.sampling import numbered, with_sum_before


def confusion(p: Column, truth: Column, threshold: float = 0.5) -> list[Column]:
    """Tp, fp, tn, fn of ``p >= threshold``; rows with a null on either side count nowhere."""
    pred = p >= threshold
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    return [n(pred & truth, "tp"), n(pred & ~truth, "fp"), n(~pred & ~truth, "tn"), n(~pred & truth, "fn")]


def binary_metrics(counts: DataFrame) -> DataFrame:
    """A10: accuracy, balanced accuracy, precision, recall, F1 from :func:`confusion` counts."""
    c = {x: F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn")}
    div = lambda a, b: F.try_divide(a, F.nullif(b, F.lit(0.0)))
    recall, spec = div(c["tp"], c["tp"] + c["fn"]), div(c["tn"], c["tn"] + c["fp"])
    return counts.select(
        "*", F.round(div(c["tp"] + c["tn"], c["tp"] + c["fp"] + c["tn"] + c["fn"]), 6).alias("accuracy"),
        F.round((recall + spec) / 2, 6).alias("balanced_accuracy"), F.round(div(c["tp"], c["tp"] + c["fp"]), 6).alias("precision"),
        F.round(recall, 6).alias("recall"), F.round(div(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"]), 6).alias("f1"),
    )


def stratified_confusion(df: DataFrame, p: Column, truth: Column, stratum: str) -> DataFrame:
    """Counts per stratum and, with ``is_total``, over all, by grouping sets: one scan, one shuffle."""
    rows = df.select(F.col(stratum), p.alias("_p"), truth.alias("_t"))
    got = rows.rollup(stratum).agg(F.grouping(stratum).alias("g"), *confusion(F.col("_p"), F.col("_t")))
    return got.withColumn("is_total", F.col("g") == 1).drop("g")


def rank_auc(df: DataFrame, p: str, truth: str, ordinal: str, ties: str = "stable") -> DataFrame:
    """Rank-sum ROC AUC.  ``stable``: ties in order of ``ordinal``, ranks numbered without a single-task
    sort; ``average``: ties share their mean rank, from a histogram of the distinct values."""
    rows = df.filter(F.col(p).isNotNull() & F.col(truth).isNotNull())
    if ties == "average":
        hist = rows.groupBy(p).agg(F.count_if(truth).alias("pos"), F.count_if(~F.col(truth)).alias("neg"))
        got = with_sum_before(hist, p, "neg", "_b").agg(
            F.sum(F.col("pos") * (F.col("_b") + F.col("neg") / 2)).alias("wins"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives")
        )
    else:
        ranked = numbered(rows.select(p, truth, ordinal), [p, ordinal], "_rank")
        n = F.count_if(truth)
        got = ranked.agg(
            (F.sum(F.when(F.col(truth), F.col("_rank"))) - n * (n + 1) / 2).alias("wins"), n.alias("positives"), F.count_if(~F.col(truth)).alias("negatives")
        )
    area = F.try_divide(F.col("wins"), F.nullif((F.col("positives") * F.col("negatives")).cast("double"), F.lit(0.0)))
    return got.select("positives", "negatives", F.round(area, 6).alias("auc"))


def contingency(df: DataFrame, truth: Column, pred: Column) -> DataFrame:
    """``(t, p, n)`` of class indices, rows with a null on either side left out."""
    return df.select(truth.alias("t"), pred.alias("p")).filter("t is not null and p is not null").groupBy("t", "p").agg(F.count("*").alias("n"))


def per_class(table: DataFrame, classes: int) -> DataFrame:
    """Support, precision, recall and F1 of each class; a ratio without a denominator is 0."""
    rows = []
    for i in range(classes):
        tp = F.sum(F.when((F.col("t") == i) & (F.col("p") == i), F.col("n")).otherwise(0))
        t = F.sum(F.when(F.col("t") == i, F.col("n")).otherwise(0))
        p = F.sum(F.when(F.col("p") == i, F.col("n")).otherwise(0))
        rows.append(F.struct(F.lit(i).alias("class"), tp.alias("tp"), t.alias("support"), p.alias("predicted")))
    got = table.agg(F.array(*rows).alias("r")).select(F.inline("r"))
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0))), F.lit(0.0))
    tp, t, p = F.col("tp"), F.col("support"), F.col("predicted")
    return got.select(
        "class", "support", F.round(div(tp, p), 6).alias("precision"), F.round(div(tp, t), 6).alias("recall"), F.round(div(2 * tp, p + t), 6).alias("f1")
    )


def averaged_f1(classes: DataFrame) -> DataFrame:
    """Macro F1 and F1 weighted by support."""
    weighted = F.try_divide(F.sum(F.col("f1") * F.col("support")), F.nullif(F.sum("support").cast("double"), F.lit(0.0)))
    return classes.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(weighted, 6).alias("weighted_f1"))


def weighted_kappa(table: DataFrame) -> DataFrame:
    """Cohen's kappa with linear and quadratic weights; null where no disagreement is expected.

    The expected disagreement is a product of margins, so it needs the margins' first and second moments alone
    for the quadratic form, and a join of the two small margins for the linear one.
    """
    t = table.groupBy(F.col("t").alias("i")).agg(F.sum("n").alias("a"))
    p = table.groupBy(F.col("p").alias("j")).agg(F.sum("n").alias("b"))
    d = F.abs(F.col("t") - F.col("p"))
    seen = table.agg(F.sum("n").alias("total"), F.sum(d * F.col("n")).alias("o1"), F.sum(d * d * F.col("n")).alias("o2"))
    both = t.join(F.broadcast(p), F.lit(True))  # a row per class on either side
    e = F.abs(F.col("i") - F.col("j"))
    expected = both.agg(F.sum(e * F.col("a") * F.col("b")).alias("e1"), F.sum(e * e * F.col("a") * F.col("b")).alias("e2"))
    kappa = lambda o, x: F.round(1 - F.try_divide(F.col(o) * F.col("total"), F.nullif(F.col(x).cast("double"), F.lit(0.0))), 6)
    return seen.join(F.broadcast(expected), F.lit(True)).select(F.col("total").alias("n"), kappa("o1", "e1").alias("linear_kappa"), kappa("o2", "e2").alias("quadratic_kappa"))


def ordinal_errors(df: DataFrame, truth: Column, pred: Column, group: list[str] | None = None) -> DataFrame:
    """N, exact share, mean absolute error, and counts of rows too low, exact, too high and far off."""
    rows = df.select(*(group or []), (pred - truth).alias("_e")).filter("_e is not null")
    e = F.col("_e")
    return rows.groupBy(*(group or [])).agg(
        F.count("*").alias("n"), F.round(F.avg((e == 0).cast("double")), 6).alias("exact"), F.round(F.avg(F.abs(e)), 6).alias("mae"),
        F.count_if(e < 0).alias("too_low"), F.count_if(e > 0).alias("too_high"), F.count_if(F.abs(e) > 1).alias("two_off"),
    )


def weighted_recall(df: DataFrame, fake: Column, said_fake: Column, weight: Column) -> DataFrame:
    """Recall on true fakes weighted by severity; a null decision is a miss."""
    hit = F.coalesce(said_fake, F.lit(False))
    w = F.when(fake, weight)
    total = F.sum(w).cast("double")
    return df.agg(
        F.count_if(fake).alias("fakes"), F.round(F.try_divide(F.count_if(fake & hit).cast("double"), F.nullif(F.count_if(fake).cast("double"), F.lit(0.0))), 6).alias("recall"),
        F.round(F.try_divide(F.sum(F.when(hit, w).otherwise(F.when(fake, 0))).cast("double"), F.nullif(total, F.lit(0.0))), 6).alias("weighted_recall"),
    )


def largest_errors(df: DataFrame, error: Column, keys: list[str], k: int = 15) -> DataFrame:
    """The ``k`` rows of largest error with their rank (a report)."""
    rows = df.withColumn("error", error).filter("error is not null").orderBy(F.col("error").desc(), *keys).limit(k)
    return rows.withColumn("rank", F.row_number().over(W.orderBy(F.col("error").desc(), *keys)))


def component_accuracy(df: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Per component of a rubric the rows that have both values, the share that is equal, and the mean distance."""
    one = [F.struct(F.lit(k).alias("component"), F.count(p - t).alias("n"), F.round(F.avg((p == t).cast("double")), 6).alias("accuracy"), F.round(F.avg(F.abs(p - t)), 6).alias("mae")) for k, (t, p) in pairs.items()]
    return df.agg(F.array(*one).alias("x")).select(F.inline("x"))


def error_distances(table: DataFrame, classes: int) -> DataFrame:
    """Of a :func:`contingency` table the rows at each distance of ranks, 0 included; with ``balanced_accuracy``, the
    mean recall of the classes that occur."""
    d = F.abs(F.col("t") - F.col("p"))
    counts = F.array(*[F.struct(F.lit(i).alias("distance"), F.coalesce(F.sum(F.when(d == i, F.col("n"))), F.lit(0)).alias("n")) for i in range(classes)])
    recalls = [F.try_divide(F.sum(F.when((F.col("t") == i) & (F.col("p") == i), F.col("n")).otherwise(0)).cast("double"), F.nullif(F.sum(F.when(F.col("t") == i, F.col("n")).otherwise(0)).cast("double"), F.lit(0.0))) for i in range(classes)]
    there = F.filter(F.array(*recalls), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(there, F.lit(0.0), lambda a, x: a + x), F.nullif(F.size(there).cast("double"), F.lit(0.0)))
    return table.agg(counts.alias("x"), F.round(mean, 6).alias("balanced_accuracy")).select(F.inline("x"), "balanced_accuracy")


def top_recall(df: DataFrame, truth: Column, pred: Column, top: int) -> DataFrame:
    """Recall on the rows whose true class is ``top``; a prediction that is null, as after a failed parse, is a miss
    and counted as ``unparsed``."""
    is_top = F.coalesce(truth == top, F.lit(False))
    hit = is_top & F.coalesce(pred == top, F.lit(False))
    recall = F.try_divide(F.count_if(hit).cast("double"), F.nullif(F.count_if(is_top).cast("double"), F.lit(0.0)))
    return df.agg(F.count_if(is_top).alias("support"), F.count_if(hit).alias("hits"), F.count_if(is_top & pred.isNull()).alias("unparsed"), F.round(recall, 6).alias("recall"))


def krippendorff(ratings: DataFrame, unit: str, rater: str, value: Column) -> DataFrame:
    """Krippendorff's alpha for nominal values: 1 - observed / expected disagreement, null where none is expected.

    Of each unit with two raters or more the counts of each value are enough, so no pair of raters is formed.
    """
    rows = ratings.select(F.col(unit).alias("u"), F.col(rater).alias("r"), value.alias("v")).dropna().distinct()
    cells = rows.groupBy("u", "v").agg(F.count("*").alias("n"))
    units = cells.groupBy("u").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("q")).filter("m > 1")
    seen = units.agg(F.sum("m").alias("total"), F.sum((F.col("m") * F.col("m") - F.col("q")) / (F.col("m") - 1)).alias("o"), F.count("*").alias("units"))
    values = cells.join(units.select("u"), "u", "left_semi").groupBy("v").agg(F.sum("n").alias("n"))
    square = values.agg(F.sum(F.col("n") * F.col("n")).alias("s"))
    expected = F.try_divide(F.col("total") * F.col("total") - F.col("s"), F.nullif(F.col("total") - 1, F.lit(0)))
    alpha = 1 - F.try_divide(F.col("o"), F.nullif(expected.cast("double"), F.lit(0.0)))
    return seen.join(F.broadcast(square), F.lit(True)).select("units", F.col("total").alias("ratings"), F.round(alpha, 6).alias("alpha"))  # one row each
