"""Searching decision thresholds: grids, exact breakpoints, constraints, folds."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.functions.keys import rank_key
from gleanery.functions.rubric import prudence
from gleanery.operators.sampling import numbered, with_next


def epsilon_grid(spark: SparkSession, steps: int = 100, top: float = 0.5) -> DataFrame:
    """``steps + 1`` values from 0 to ``top``."""
    return spark.range(steps + 1).select(F.col("id").cast("int").alias("step"), (F.col("id") * F.lit(top) / steps).alias("epsilon"))


def joint_grid(spark: SparkSession, low: range, medium: range, epsilon: range, scale: int, epsilon_scale: int) -> DataFrame:
    """Weights ``low <= medium <= 1`` (in units of 1/scale) with every epsilon; nested generators, no join."""
    seq = lambda r: F.array(*[F.lit(x) for x in r])
    one = spark.range(1).select(F.explode(seq(low)).alias("l"))
    two = one.select("l", F.explode(F.filter(seq(medium), lambda m: (m >= F.col("l")) & (m <= scale))).alias("m"))
    return two.select("l", "m", F.explode(seq(epsilon)).alias("e")).select(
        (F.col("l") / scale).alias("w_low"), (F.col("m") / scale).alias("w_medium"), (F.col("e") / epsilon_scale).alias("epsilon")
    )


def joint_search(df: DataFrame, low: range, medium: range, epsilon: range, scale: int, epsilon_scale: int, loss: float = 0.03) -> DataFrame:
    """Each cell of :func:`joint_grid` (weight of high: 1) over all rows, with the place of the cell by the
    search's criteria: feasible (accuracy within ``loss`` of ``p_fake >= 0.5``, recall on fakes not below it), recall,
    macro-F1, fewer regressions, F1 of fakes, smaller epsilon, nearness to (1/3, 2/3, 1), smaller weights.

    ``df``: ``p_fake, p_low, p_medium, p_high, fake``, probabilities not negative, epsilons ascending.  Under a pair
    of weights a row's decision changes at one epsilon, so rows are counted by pair and that place, and the cells
    accumulated: what is shuffled has the size of the grid.  Counts and whole numbers are compared where ties matter.
    """
    pairs = F.array(*[F.struct(F.lit(a).alias("l"), F.lit(b).alias("m")) for a in low for b in medium if a <= b <= scale])
    rows = df.dropna(subset=["p_fake", "p_low", "p_medium", "p_high", "fake"]).select("p_fake", "p_low", "p_medium", "p_high", "fake", F.explode(pairs).alias("w"))
    rows = rows.select("p_fake", "fake", "w", ((F.col("w.l") / scale) * F.col("p_low") + (F.col("w.m") / scale) * F.col("p_medium") + F.col("p_high")).alias("rho"))
    # the first place whose epsilon makes the row fake: the quotient, set right by the comparison itself; len(epsilon) if none does
    end = len(epsilon)
    said = lambda k: F.col("p_fake") >= 0.5 - ((epsilon.start + k * epsilon.step) / F.lit(epsilon_scale)) * F.col("rho")
    at = (F.try_divide(0.5 - F.col("p_fake"), F.nullif("rho", F.lit(0.0))) * epsilon_scale - epsilon.start) / epsilon.step
    rows = rows.withColumn("k", F.ceil(F.greatest(F.lit(1.0), F.least(F.lit(float(end)), at))).cast("int"))
    k = F.col("k")
    place = F.when(said(F.lit(0)), 0).when(said(k - 1), k - 1).when(said(k), k).otherwise(k + 1)
    cells = rows.select("w", F.least(place, F.lit(end)).alias("at"), "fake", (F.col("p_fake") >= 0.5).alias("base")).groupBy("w", "at", "fake", "base").agg(F.count("*").alias("n"))
    grid = cells.select("*", F.explode(F.array(*[F.lit(i) for i in range(end)])).alias("e"))  # at most some thousand cells, by every epsilon
    hit = F.col("at") <= F.col("e")
    n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    got = grid.groupBy("w", "e").agg(
        n(F.col("fake") & hit).alias("tp"), n(F.col("fake") & ~hit).alias("fn"), n(~F.col("fake") & hit).alias("fp"), n(~F.col("fake") & ~hit).alias("tn"),
        n((hit != F.col("base")) & (hit != F.col("fake"))).alias("regressions"), n(F.col("base") == F.col("fake")).alias("right0"), n(F.col("base") & F.col("fake")).alias("tp0"),
    )
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0))), F.lit(0.0))
    tp, fn, fp, tn, total = *[F.col(x) for x in ("tp", "fn", "fp", "tn")], F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")
    f1 = div(2 * tp, 2 * tp + fp + fn)
    got = got.select("*", F.round(f1, 12).alias("f1"), F.round((f1 + div(2 * tn, 2 * tn + fp + fn)) / 2, 12).alias("macro"), total.alias("total"))
    # losses in ten thousandths, so that a loss of exactly ``loss`` is within it
    ok = (10000 * (F.col("right0") - tp - tn) <= round(10000 * loss) * F.col("total")) & (tp >= F.col("tp0"))
    left, mid = F.col("w.l"), F.col("w.m")
    far = (3 * left - scale) * (3 * left - scale) + (3 * mid - 2 * scale) * (3 * mid - 2 * scale)
    order = [ok.desc(), tp.desc(), F.col("macro").desc(), F.col("regressions"), F.col("f1").desc(), F.col("e"), far, left + mid, left, mid]
    ranked = got.withColumn("feasible", ok).withColumn("place", F.row_number().over(W.orderBy(*order)))  # one row per cell
    return ranked.select(
        (left / scale).alias("w_low"), (mid / scale).alias("w_medium"), ((epsilon.start + F.col("e") * epsilon.step) / epsilon_scale).alias("epsilon"),
        F.round(div(tp + tn, F.col("total")), 6).alias("accuracy"), F.round(div(tp, tp + fn), 6).alias("recall"), F.round("macro", 6).alias("macro_f1"),
        F.round("f1", 6).alias("fake_f1"), "regressions", "feasible", "place",
    )


def policies(df: DataFrame, weights: tuple[float, float, float], epsilons: DataFrame, weight: Column) -> DataFrame:
    """For each epsilon accuracy, recall on fakes, weighted recall, corrections and regressions.

    ``df``: ``p_fake, p_low, p_medium, p_high, fake``.  A row's decision changes at one epsilon, so rows are
    reduced to counts per grid cell first and the cells accumulated: no row meets every epsilon.
    """
    count = epsilons.agg(F.array_sort(F.collect_list("epsilon")).alias("eps"))  # the grid, a parameter
    rho = prudence(weights)
    # fake at epsilon e if and only if e >= (0.5 - p_fake) / rho; the first such grid place, or none
    rows = df.join(F.broadcast(count), F.lit(True))
    first = F.size(F.filter("eps", lambda e: ~(F.col("p_fake") >= 0.5 - e * rho)))
    base = F.col("p_fake") >= 0.5
    cells = rows.select(first.alias("step"), "fake", base.alias("base"), weight.alias("w")).groupBy("step", "fake", "base").agg(F.count("*").alias("n"), F.coalesce(F.sum("w"), F.lit(0)).alias("w"))
    cells = cells.agg(F.collect_list(F.struct("step", "fake", "base", "n", "w")).alias("c"))  # at most four per grid place
    grid = epsilons.join(F.broadcast(cells), F.lit(True))

    def total(pick, value) -> Column:
        return F.aggregate("c", F.lit(0.0), lambda acc, x: acc + F.when(pick(x, x["step"] <= F.col("step")), value(x).cast("double")).otherwise(0.0))

    n, w = (lambda x: x["n"]), (lambda x: x["w"])
    got = grid.select(
        "step", "epsilon", total(lambda x, said: x["fake"] == said, n).alias("right"), total(lambda x, said: F.lit(True), n).alias("rows"),
        total(lambda x, said: x["fake"] & said, n).alias("tp"), total(lambda x, said: x["fake"], n).alias("fakes"),
        total(lambda x, said: x["fake"] & said, w).alias("wtp"), total(lambda x, said: x["fake"], w).alias("wfakes"),
        total(lambda x, said: (x["fake"] == said) & (x["base"] != said), n).cast("long").alias("corrections"),
        total(lambda x, said: (x["fake"] != said) & (x["base"] != said), n).cast("long").alias("regressions"),
    )
    div = lambda a, b: F.round(F.try_divide(F.col(a), F.nullif(F.col(b), F.lit(0.0))), 6)
    return got.select("step", "epsilon", div("right", "rows").alias("accuracy"), div("tp", "fakes").alias("recall"), div("wtp", "wfakes").alias("weighted_recall"), "corrections", "regressions")


def breakpoints(df: DataFrame, weights: tuple[float, float, float], most: float = 0.5) -> DataFrame:
    """X11 in doubles: the distinct epsilons in [0, most) at which a decision changes, with the next one: the
    policies are the half-open intervals between them.  ``changed`` rows change at the lower end."""
    at = F.try_divide(0.5 - F.col("p_fake"), F.nullif(prudence(weights), F.lit(0.0)))
    points = df.select(F.round(at, 9).alias("lower")).filter(F.col("lower").between(0, most) & (F.col("lower") < most)).groupBy("lower").agg(F.count("*").alias("changed"))
    return with_next(points, "lower", "upper", F.lit(most))


def exact_breakpoints(df: DataFrame, weights: tuple[Fraction, Fraction, Fraction], key: str) -> DataFrame:
    """X11 in exact rationals: numerator and denominator of each row's breakpoint as text; null where rho is 0.

    The doubles are taken as the binary fractions they are; no built-in type holds their products.
    """
    wl, wm, wh = weights

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            num, den = [], []
            for x in f[["p_fake", "p_low", "p_medium", "p_high"]].itertuples(index=False):
                at = None
                if not any(pd.isna(v) for v in x):
                    rho = wl * Fraction(x.p_low) + wm * Fraction(x.p_medium) + wh * Fraction(x.p_high)
                    at = (Fraction(1, 2) - Fraction(x.p_fake)) / rho if rho else None
                num.append(None if at is None else str(at.numerator))
                den.append(None if at is None else str(at.denominator))
            yield pd.DataFrame({key: f[key], "numerator": num, "denominator": den})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "p_fake", "p_low", "p_medium", "p_high").mapInPandas(run, f"`{key}` {kind}, numerator string, denominator string")


def best(rows: DataFrame, feasible: Column, criteria: list[Column], k: int = 1) -> DataFrame:
    """Of the feasible rows the first ``k`` by lexicographic criteria (a selection of parameters)."""
    return rows.filter(feasible).orderBy(*criteria).limit(k)


def with_fold(df: DataFrame, key: str, label: str, folds: int = 5, seed: int = 20) -> DataFrame:
    """A fold from 0 per row, stratified: rows are numbered by label and rank key, and dealt to the folds in turn, so
    that the folds of a label differ by one row at most.  Numbered over range partitions; no label is one task."""
    return numbered(df, [label, rank_key(seed, "fold", key), key], "_n").withColumn("fold", F.pmod(F.col("_n") - 1, F.lit(folds)).cast("int")).drop("_n")


def fold_stability(df: DataFrame, key: str, weights: tuple[float, float, float], epsilons: list[float], folds: int = 5, seed: int = 20) -> DataFrame:
    """Of each fold the epsilon that the other folds choose (recall on fakes, then accuracy, then the smaller), and
    the accuracy and recall it has on the fold itself.

    ``df``: key, p_fake, p_low, p_medium, p_high, fake.  Rows are counted by fold and the first epsilon that makes them
    fake, and those counts, of the size of the grid, accumulated: each row is read once for all folds and policies.
    """
    rows = with_fold(df.withColumn("_l", F.col("fake").cast("int")), key, "_l", folds, seed)
    rho = prudence(weights)
    eps = F.array(*[F.lit(e) for e in epsilons])
    first = F.size(F.filter(eps, lambda e: ~(F.col("p_fake") >= 0.5 - e * rho)))
    cells = rows.select("fold", first.alias("at"), "fake").groupBy("fold", "at", "fake").agg(F.count("*").alias("n"))
    grid = cells.select("*", F.posexplode(eps).alias("i", "epsilon"))  # grid x folds x 2 cells at most, by the grid
    hit = F.col("at") <= F.col("i")
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    per = grid.groupBy("fold", "i", "epsilon").agg(n(hit == F.col("fake")).alias("right"), n(F.col("fake") & hit).alias("tp"), n(F.col("fake")).alias("fakes"), n(F.lit(True)).alias("rows"))
    every = per.groupBy("i").agg(*[F.sum(c).alias(f"all_{c}") for c in ("right", "tp", "fakes", "rows")])
    both = per.join(every, "i")
    rest = lambda c: F.col(f"all_{c}") - F.col(c)
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0))), F.lit(0.0))
    order = W.partitionBy("fold").orderBy(div(rest("tp"), rest("fakes")).desc(), div(rest("right"), rest("rows")).desc(), F.col("epsilon"))  # the grid a fold
    chosen = both.withColumn("_r", F.row_number().over(order)).filter("_r = 1")
    return chosen.select("fold", "epsilon", "rows", F.round(div(F.col("right"), F.col("rows")), 6).alias("accuracy"), F.round(div(F.col("tp"), F.col("fakes")), 6).alias("recall"))


def threshold_grid(spark: SparkSession, n: int = 21, low: float = 0.3, step: float = 0.02) -> DataFrame:
    """All pairs of ``n`` thresholds, from nested generators."""
    at = lambda i: F.round(F.lit(low) + i * step, 2)
    one = spark.range(n).select(at(F.col("id")).alias("t1"))
    return one.select("t1", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)).alias("t2"))


def threshold_search(df: DataFrame, n: int = 21, low: float = 0.3, step: float = 0.02, default: float = 0.5) -> DataFrame:
    """Macro-F1 of the ordinal decoding at every pair of :func:`threshold_grid`, and the place of the pair: by
    macro-F1 descending, L1 distance to the default thresholds, t1, t2; place 1 is the choice.

    ``df``: ``p1`` P(at least medium), ``p2`` P(high), ``t`` the true level from 0.  A row passes the thresholds up to
    a grid place, so rows are counted by the places of p1 and of the capped p2 and by level (at most (n + 1)^2 x 3
    counts), which are accumulated per pair: no row meets every pair.
    """
    at = F.array(*[F.lit(round(low + i * step, 2)) for i in range(n)])
    passed = lambda p: F.size(F.filter(at, lambda x: x <= p))
    known = df.dropna(subset=["p1", "p2", "t"])
    counts = known.select(passed(F.col("p1")).alias("a"), passed(F.least("p1", "p2")).alias("b"), "t").groupBy("a", "b", "t").agg(F.count("*").alias("n"))
    pairs = counts.select("*", F.posexplode(at).alias("i", "t1")).select("*", F.posexplode(at).alias("j", "t2"))
    level = F.when(F.col("i") >= F.col("a"), 0).when(F.col("j") >= F.col("b"), 1).otherwise(2)
    sums = [F.sum(F.when(cond, F.col("n")).otherwise(0)).alias(f"{name}{k}") for k in range(3) for name, cond in (
        ("hit", (F.col("t") == k) & (F.col("p") == k)), ("true", F.col("t") == k), ("said", F.col("p") == k)
    )]
    table = pairs.withColumn("p", level).groupBy("t1", "t2").agg(*sums)
    f1 = lambda k: F.coalesce(F.try_divide(2.0 * F.col(f"hit{k}"), F.nullif((F.col(f"true{k}") + F.col(f"said{k}")).cast("double"), F.lit(0.0))), F.lit(0.0))
    got = table.select("t1", "t2", F.round((f1(0) + f1(1) + f1(2)) / 3, 12).alias("f"), F.round(F.abs(F.col("t1") - default) + F.abs(F.col("t2") - default), 6).alias("distance"))
    order = [F.col("f").desc(), "distance", "t1", "t2"]
    return got.select("t1", "t2", F.round("f", 6).alias("macro_f1"), "distance", F.row_number().over(W.orderBy(*order)).alias("place"))  # one row per pair
