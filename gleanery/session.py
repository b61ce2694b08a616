"""Session factory, table access and the shared scratch folder.

Everything that cuts lineage writes a table below the folder named by ``spark.checkpoint.dir``, so
that the loss of an executor never loses a stage's result.  A folder of our own is made only where
that setting is absent, as in tests.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
# shuffle files go when the query that wrote them ends, not when the driver happens to collect garbage
CLEANUP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def session(app: str = "gleanery", cores: int = 8, partitions: int | None = None) -> SparkSession:
    """A local session with the settings the operators expect: UTC, adaptive execution, Arrow."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remove(path: str) -> None:
    """Delete a folder on whatever file system its path names; one that is gone already is fine."""
    context = SparkContext._active_spark_context
    if context is None:
        return
    try:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
    except (Py4JError, OSError):  # the session has ended
        return


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; on a local master, where it is unset, one of our own.

    On a cluster a folder of one machine would be read by others in vain, so there the setting must be given.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="gleanery-")
        atexit.register(_remove, _own[app])
    return _own[app]


def scratch(spark: SparkSession, what: str) -> str:
    """A new, unused path below the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, path)
    return path


def discard(path: str) -> None:
    """Remove a scratch path early, once nothing reads it any more."""
    _remove(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings for the plans and streams that start inside; the session gets its own back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_open: list[list[str]] = []


@contextmanager
def temporaries(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`materialize` writes inside are removed at the end, but for those to be kept; shuffle files
    of the queries inside go with each query, so a frame may be run once only."""
    _open.append([])
    try:
        with settings(spark, CLEANUP):
            yield
    finally:
        for path in _open.pop():
            discard(path)


def materialize(df: DataFrame, what: str, partitions: int | None = None, keep: bool = False) -> DataFrame:
    """Write ``df`` to a scratch table and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    if _open and not keep:
        _open[-1].append(path)
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
