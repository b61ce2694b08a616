"""Applying a feed of inserts, updates and deletes that arrives repeated and out of order.

The state of one key is a pair that is merged by maximum, so that it comes out the same for every
order and any number of deliveries:

* ``base``  - sequence of the newest insert or delete, and which of the two (the tombstone);
* ``image`` - sequence of the newest insert or update, and its payload.

An update without a row must do nothing, an insert over a row sets it, a delete removes it.  Hence the
row exists if and only if ``base`` is an insert; every change after it is then an update of an existing
row, so the present row is ``image``.  A late insert revives an update that came before it, which a rule
of "apply what is newer than the last sequence" alone would have lost.

The merge is a streaming aggregation: Spark keeps the pair per key in the state store (RocksDB, so
that state may outgrow memory) and combines before the shuffle, so that a hot key sends one row per
task.  Each micro-batch emits the keys it changed; they are written under ``version=<batch id>`` by
overwriting, so that a batch that is run again after a failure leaves the same files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.cleaning import cleaned, instant
from gleanery.session import scratch
from gleanery.streaming.runtime import run_available, stream_files

def merged_state(feed: DataFrame, key: str, sequence: list[Column], op: Column, payload: list[str]) -> DataFrame:
    """``(key, base, image)`` of a batch or streaming feed.

    Rows with a null key, a null first sequence field or an operation that does not begin with i, u or
    d are no changes.  Changes equal in all of ``sequence`` are one change; should their payloads
    differ in spelling, the largest payload stands, whatever the order of arrival.
    """
    seq = F.struct(*[c.alias(f"s{i}") for i, c in enumerate(sequence)])
    letter = F.substring(cleaned(op), 1, 1)
    rows = feed.select(
        F.col(key), seq.alias("seq"), letter.alias("op"), F.struct(*[F.col(c) for c in payload]).alias("payload")
    ).filter(F.col(key).isNotNull() & F.col("seq.s0").isNotNull() & F.col("op").isin("i", "u", "d"))
    return rows.groupBy(key).agg(
        F.max(F.when(F.col("op") != "u", F.struct("seq", "op"))).alias("base"),
        F.max(F.when(F.col("op") != "d", F.struct("seq", "payload"))).alias("image"),
    )


def run_feed(
    feed: DataFrame, out: str, checkpoint: str | None, *, key: str, sequence: list[Column], op: Column, payload: list[str]
) -> None:
    """Consume what is available of a streaming feed, one versioned upsert folder a micro-batch.

    With the same ``checkpoint`` and ``out``, a later call goes on where this one ended.
    """

    def upsert(batch: DataFrame, version: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/version={version}")

    run_available(merged_state(feed, key, sequence, op, payload), upsert, checkpoint)


def current_rows(spark: SparkSession, out: str, key: str) -> DataFrame:
    """The rows that exist after all versions: of each key its newest version, unless a tombstone."""
    return (
        spark.read.parquet(out)
        .groupBy(key)
        .agg(F.max(F.struct("version", "base", "image")).alias("m"))
        .filter("m.base.op = 'i'")
        .select(key, "m.image.payload.*")
    )


def apply_files(
    spark: SparkSession, path: str, *, key: str, sequence, op, payload: list[str], bytes_per_trigger: int = 64 << 20
) -> DataFrame:
    """Current rows of a feed that lies in Parquet files, read as a stream.

    ``sequence`` and ``op`` are built by calling them, as columns of the feed.  An empty feed gives
    an empty result; columns beside key, sequence, operation and payload are not read.
    """
    feed = stream_files(spark, path, bytes_per_trigger)
    out = scratch(spark, "feed")
    seq, operation = sequence(), op()
    # an empty first version gives the folder its schema, whatever the feed holds
    merged_state(spark.createDataFrame([], feed.schema), key, seq, operation, payload).write.parquet(f"{out}/version=-1")
    run_feed(feed, out, None, key=key, sequence=seq, op=operation, payload=payload)
    return current_rows(spark, out, key)


def review_sequence() -> list[Column]:
    """Order of review changes: the instant of ``reviewed_at``, then ``change_no``."""
    return [instant(F.col("reviewed_at")), F.col("change_no")]
