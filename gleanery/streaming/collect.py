"""Collecting a stream of records under quotas per label, without repeats and exclusions.

The rule for one record after the other: a full label skips it, an excluded key refuses it, a key that was
accepted refuses it, else it is accepted, until the target is reached.  A micro-batch is decided as a whole
with the same result; its accepted rows are written under its version, and what earlier versions
accepted is the state, so that a batch that is run again after a failure gives the same files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.session import materialize, scratch
from gleanery.streaming.runtime import run_available


def accept(rows: DataFrame, key: str, label: str, order: list[str], left: dict[str, int], target: int) -> DataFrame:
    """The accepted of ``rows`` (none of them known or excluded), with ``left`` places per label.

    Of each key the first row that doesn't meet a full label.  A row that stands behind ``left`` first rows of its
    label meets a full one for certain, so such rows are removed until none is left.
    """
    places = {k: v for k, v in left.items() if v > 0}
    if not places or target <= 0:
        return rows.limit(0)
    rows = rows.filter(F.col(key).isNotNull() & F.col(label).isin(list(places)))
    quota = F.create_map(*[F.lit(x) for kv in places.items() for x in kv])[F.col(label)]
    rows = materialize(rows, "candidates")
    while True:
        first = rows.groupBy(key).agg(F.min(F.struct(*order, label)).alias("f")).select(key, *[F.col(f"f.{c}").alias(c) for c in [*order, label]])
        place = F.row_number().over(W.partitionBy(label).orderBy(*order, key))
        # only the first rows of a label are ever needed, so the window is cut in each partition
        kept = materialize(first.withColumn("_n", place).filter(F.col("_n") <= max(places.values())).filter(F.col("_n") <= quota), "kept")
        full = kept.groupBy(label).agg(F.count("*").alias("_n"), F.max(F.struct(*order, key)).alias("_last")).filter(F.col("_n") >= quota).select(label, "_last")
        over = rows.join(F.broadcast(full), label).filter(F.struct(*order, key) > F.col("_last")).select(key, label, *order)
        again = rows.select(key, label).distinct().groupBy(key).agg(F.count("*").alias("_l")).filter("_l > 1").select(key)
        moved = over.join(again, key, "left_semi")
        if moved.isEmpty():
            return rows.join(kept.select(key, label, *order), [key, label, *order], "left_semi").dropDuplicates([key]).orderBy(*order, key).limit(target)
        rows = materialize(rows.join(moved, [key, label, *order], "left_anti"), "candidates")


def collect_stream(
    stream: DataFrame, out: str, *, key: str, label: str, order: list[str], quotas: dict[str, int], target: int,
    excluded: DataFrame | None = None, checkpoint: str | None = None,
) -> None:
    """Consume what is available; accepted rows lie under ``out/version=<batch>``."""
    spark = stream.sparkSession

    def each(batch: DataFrame, version: int) -> None:
        before = accepted_rows(spark, out, stream).filter(F.col("version") < version)
        counts = {r[label]: r["n"] for r in before.groupBy(label).agg(F.count("*").alias("n")).collect()}  # a row per label
        left = {k: v - counts.get(k, 0) for k, v in quotas.items()}
        rows = batch.join(before.select(key).distinct(), key, "left_anti")
        if excluded is not None:
            rows = rows.join(excluded.select(key).distinct(), key, "left_anti")
        got = accept(rows, key, label, order, left, target - sum(counts.values()))
        got.write.mode("overwrite").parquet(f"{out}/version={version}")

    run_available(stream, each, checkpoint, mode="append")


def accepted_rows(spark: SparkSession, out: str, like: DataFrame) -> DataFrame:
    """All accepted rows with their version; none before the first batch."""
    try:
        return spark.read.parquet(out)
    except Exception as e:  # noqa: BLE001 - no folder yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], like.schema).withColumn("version", F.lit(0))


def collected(rows: DataFrame, keys: list[Column], label: str, order: list[str], quotas: dict[str, int], target: int | None = None) -> DataFrame:
    """What becomes of each record of a stream, taken one after the other: ``rows`` with ``outcome``.

    ``rows``: the columns of ``order`` (together unique), ``label`` (null if unsupported), ``problem`` (the reason why the
    record has no label, else null), ``broken`` (its image is invalid) and ``excluded``.  In this order: the problem,
    ``quota_<label>_reached``, ``invalid_image``, ``excluded``, ``duplicate`` (an accepted record has one of its ``keys``;
    null keys are none), ``accepted``; and ``not_read`` after the record that fills the last quota or the ``target``.

    Quotas only cut: until a label is full, acceptance doesn't depend on them.  So the records are decided without
    quotas, those of the label that is full first are dropped behind that place, and what is left is decided anew, once
    a label.  Deciding goes in rounds: a record that is first under all its keys is accepted, what shares a key with it
    is a duplicate.
    """
    at = F.struct(*order)
    base = rows.withColumn("_at", at).withColumn("_keys", F.filter(F.array(*[F.when(k.isNotNull(), F.struct(F.lit(i).alias("i"), k.cast("string").alias("k"))) for i, k in enumerate(keys)]), lambda k: k.isNotNull()))
    base = materialize(base, "records")
    ready = base.filter(F.col("problem").isNull() & F.col(label).isNotNull() & ~F.coalesce("broken", F.lit(False)) & ~F.coalesce("excluded", F.lit(False)))
    ready = ready.select("_at", "_keys", F.col(label).alias("_label"))
    full: dict[str, object] = {k: None for k, n in quotas.items() if n <= 0}
    ready = ready.filter(F.col("_label").isin(list(quotas))) if quotas else ready.limit(0)
    while True:
        open_ = ready
        for name, last in full.items():
            open_ = open_.filter((F.col("_label") != name) | (F.col("_at") <= last) if last is not None else F.col("_label") != name)
        won = materialize(_greedy(open_), "accepted")
        ends = {}
        for name, n in quotas.items():  # a few labels
            if name not in full:
                ranked = won.filter(F.col("_label") == name).orderBy("_at").limit(n)
                got = ranked.agg(F.count("*").alias("n"), F.max("_at").alias("last")).first()
                if got["n"] == n:
                    ends[name] = got["last"]
        if not ends:
            break
        name = min(ends, key=lambda k: tuple(ends[k]))
        full[name] = F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, ends[name])])
    stop = F.lit(None).cast(won.schema["_at"].dataType)
    if target is not None:
        got = won.orderBy("_at").limit(target).agg(F.count("*").alias("n"), F.max("_at").alias("last")).first()
        if got["n"] == target:
            stop = F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, got["last"])]) if target else F.lit(None)
    if full and set(full) == set(quotas) and all(v is not None for v in full.values()):
        stop = F.least(stop, F.greatest(*full.values()) if len(full) > 1 else next(iter(full.values())))
    quota = F.lit(False)
    for name, last in full.items():
        quota = quota | ((F.col(label) == name) & ((F.col("_at") > last) if last is not None else F.lit(True)))
    got = base.join(won.select("_at", F.lit(True).alias("_won")), "_at", "left")
    outcome = (
        F.when(F.coalesce(F.col("_at") > stop, F.lit(False)), "not_read").when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col(label).isNull() | ~F.coalesce(F.col(label).isin(list(quotas)), F.lit(False)), "unsupported_label")
        .when(F.coalesce(quota, F.lit(False)), F.concat(F.lit("quota_"), F.col(label), F.lit("_reached"))).when(F.coalesce("broken", F.lit(False)), "invalid_image")
        .when(F.coalesce("excluded", F.lit(False)), "excluded").when(F.col("_won"), "accepted").otherwise("duplicate")
    )
    return got.withColumn("outcome", outcome).drop("_at", "_keys", "_won")


def _greedy(rows: DataFrame) -> DataFrame:
    """Of ``(_at, _keys, _label)`` what is accepted when taken in order of ``_at`` and no two may share a key."""
    done, left = [rows.filter(F.size("_keys") == 0)], rows.filter(F.size("_keys") > 0)
    while True:
        keys = left.select("_at", F.explode("_keys").alias("k"))
        lead = keys.groupBy("k").agg(F.min("_at").alias("lead"))
        first = keys.join(lead, "k").groupBy("_at").agg(F.min(F.col("_at") == F.col("lead")).alias("ok")).filter("ok").select("_at")
        won = materialize(left.join(first, "_at", "left_semi"), "won")
        taken = won.select(F.explode("_keys").alias("k")).distinct()
        lost = keys.join(taken, "k", "left_semi").select("_at").distinct()
        left = materialize(left.join(lost, "_at", "left_anti"), "left")
        done.append(won)
        if left.isEmpty():
            out = done[0]
            for d in done[1:]:
                out = out.unionByName(d)
            return out


def complete(accepted: dict[str, int], quotas: dict[str, int], target: int) -> str | None:
    """Why a collection is at its end, or null if it goes on: target_reached, quotas_reached."""
    if sum(accepted.values()) >= target:
        return "target_reached"
    return "quotas_reached" if all(accepted.get(k, 0) >= n for k, n in quotas.items()) else None


def first_seen(stream: DataFrame, keys: list[str], watermark: tuple[str, str] | None = None) -> DataFrame:
    """The distinct keys of a stream.  Without a watermark exact, with state for every key ever seen; with
    ``(time column, delay)`` state is dropped after the delay, and a repeat later than that passes."""
    if watermark:
        return stream.withWatermark(*watermark).dropDuplicatesWithinWatermark(keys)
    return stream.select(*keys).dropDuplicates(keys)


def distinct_keys(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run :func:`first_seen` over what is available and give the keys."""
    out = scratch(stream.sparkSession, "seen")
    run_available(first_seen(stream, keys), lambda b, v: b.write.mode("overwrite").parquet(f"{out}/version={v}"), mode="append")
    return stream.sparkSession.read.parquet(out).select(*keys)


def window_counts(stream: DataFrame, time: str, length: str, group: list[str], value: str, late: str) -> DataFrame:
    """Counts and sums per tumbling window and group, with events later than ``late`` left out."""
    w = F.window(time, length)
    return stream.withWatermark(time, late).groupBy(w, *group).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def sliding_counts(stream: DataFrame, time: str, length: str, slide: str, group: list[str], value: str, late: str) -> DataFrame:
    """As :func:`window_counts`, in windows that begin every ``slide``."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length, slide), *group).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def session_counts(stream: DataFrame, time: str, gap: str, group: list[str], value: str, late: str) -> DataFrame:
    """As :func:`window_counts`, in sessions that end after ``gap`` without events.  For streams in append mode."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("window"), *group).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def latest_windows(stream: DataFrame, group: list[str], out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a windowed aggregation over what is available; of each window its newest version.

    With the same ``out`` and ``checkpoint`` a later call goes on where this one ended."""
    out = out or scratch(stream.sparkSession, "windows")
    run_available(stream, lambda b, v: b.write.mode("overwrite").parquet(f"{out}/version={v}"), checkpoint)
    last = stream.sparkSession.read.parquet(out).groupBy("window", *group).agg(F.max(F.struct("version", "n", "total")).alias("m"))
    return last.select(F.col("window.start").alias("start"), *group, "m.n", "m.total")
