"""Reading files as a stream, and running one to the end of what is available."""

from __future__ import annotations

import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from gleanery.session import discard, scratch, settings
from gleanery.sources.sinks import write_if_changed

# State beyond memory, small checkpoints, few old versions.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


def stream_files(spark: SparkSession, path: str, bytes_per_trigger: int = 64 << 20) -> DataFrame:
    """A Parquet file or a folder of them as a stream, some bytes a micro-batch."""
    schema = spark.read.parquet(path).schema
    # as a pattern, the path may be one file as well as a folder of files
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str | None = None, mode: str = "update") -> None:
    """Run all micro-batches that are available; ``each`` gets the batch and its version, again after a failure.

    Without a ``checkpoint`` folder one is made and removed at the end.
    """
    at = checkpoint or scratch(stream.sparkSession, "checkpoint")
    with settings(stream.sparkSession, STATE):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", at).foreachBatch(each).trigger(availableNow=True).start()
        query.awaitTermination()
    if checkpoint is None:
        discard(at)


# ---- the collection's run --------------------------------------------------------------------------------


class Deadline:
    """A time limit with a buffer before it, in which no new micro-batch is begun; and a stop that signals ask for."""

    def __init__(self, seconds: float, buffer: float = 0.0, clock: Callable[[], float] = time.monotonic):
        self.clock, self.end, self.buffer, self.stopped = clock, clock() + seconds, buffer, ""

    def stop(self, reason: str) -> None:
        self.stopped = reason

    def reason(self) -> str | None:
        """``shutdown_<reason>``, ``runtime_safety_buffer``, or null while there is time."""
        if self.stopped:
            return f"shutdown_{self.stopped}"
        return "runtime_safety_buffer" if self.clock() >= self.end - self.buffer else None


def retried(call: Callable[[], object], retries: int, first: float, longest: float, deadline: Deadline | None = None, sleep: Callable[[float], None] = time.sleep) -> object:
    """The result of ``call``, tried again ``retries`` times after waits that double up to ``longest`` seconds.

    A ValueError, which no repetition mends, is raised at once, the last failure at the end, or when the wait would pass
    the deadline's buffer."""
    for i in range(retries + 1):
        try:
            return call()
        except ValueError:
            raise
        except Exception:
            wait = min(first * 2**i, longest)
            if i == retries or (deadline and deadline.clock() + wait >= deadline.end - deadline.buffer):
                raise
            sleep(wait)


def guard_resume(folder: str, fingerprint: str, resume: bool) -> bool:
    """Whether a run resumes one before it: ``folder`` keeps the fingerprint of the settings that decide the order of
    the stream.  Resuming with another one, or beginning anew where a run has left state, raises ValueError."""
    at = Path(folder) / "fingerprint"
    if not at.exists():
        at.parent.mkdir(parents=True, exist_ok=True)
        write_if_changed(str(at), fingerprint.encode())
        return False
    if not resume:
        raise ValueError(f"{folder} has the state of an earlier run")
    if at.read_text() != fingerprint:
        raise ValueError("the settings differ from those of the run to be resumed")
    return True


def run_collection(step: Callable[[], dict[str, int] | None], finished: Callable[[dict[str, int]], str | None], deadline: Deadline, publish: Callable[[dict[str, int]], None] | None = None, every: int = 0) -> tuple[str, dict[str, int]]:
    """Micro-batches until there is a reason to end: ``(reason, accepted by label)``.

    ``step`` consumes the next micro-batch, its effects durable when it returns, and gives the accepted by label so far, or
    null if the source is exhausted.  Reasons: those of ``finished`` and of the deadline, ``source_exhausted``.  With
    ``publish``, it is called whenever ``every`` more are accepted, and at the end for the rest."""
    counts: dict[str, int] = {}
    published = 0
    while True:
        reason = finished(counts) or deadline.reason()
        if reason is None:
            got = step()
            if got is None:
                reason = "source_exhausted"
            else:
                counts = got
        total = sum(counts.values())
        if publish and total > published and (reason or total - published >= max(1, every)):
            publish(counts)
            published = total
        if reason:
            return reason, counts
