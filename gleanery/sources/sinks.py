"""Sinks whose reruns leave the same bytes, and upserts."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append as JSON lines, nulls kept."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def _replace(path: Path, data: bytes) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=path.parent)
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, path)
    except BaseException:
        Path(tmp).unlink(missing_ok=True)
        raise


def write_if_changed(path: str, data: bytes) -> bool:
    """Replace a file as a whole, and only if its bytes differ; whether it was written."""
    p = Path(path)
    if p.exists() and p.read_bytes() == data:
        return False
    _replace(p, data)
    return True


def publish(path: str, data: bytes) -> bool:
    """Write once; the same bytes again are fine, others raise FileExistsError."""
    p = Path(path)
    if p.exists():
        if p.read_bytes() != data:
            raise FileExistsError(f"{path} holds other bytes")
        return False
    _replace(p, data)
    return True


def csv_bytes(df: DataFrame, order: list[str], most: int = 100_000) -> bytes:
    """A small export as CSV with fixed header, line feeds and order; nulls empty, booleans lower case.

    It is made on the driver: more than ``most`` rows raise ValueError, :func:`write_csv` is for those."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows; write_csv writes them from the executors")
    cols = [F.when(F.col(c), "true").when(~F.col(c), "false").alias(c) if t == "boolean" else F.col(c) for c, t in df.dtypes]
    return df.orderBy(*order).select(*cols).toPandas().to_csv(index=False, lineterminator="\n").encode()


def write_csv(df: DataFrame, path: str, order: list[str], by: str | None = None) -> None:
    """A large export as sorted CSV files, with ``by`` in a folder per value."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = rows.write.mode("overwrite").option("header", True).option("emptyValue", "").option("lineSep", "\n")
    (writer.partitionBy(by) if by else writer).csv(path)


def write_objects(df: DataFrame, root: str, folder: str, name: str, extension: str, content: str) -> DataFrame:
    """Bytes as ``root/folder/name.extension``, once per name, from the executors to a shared folder.

    Returns ``(folder, name, outcome)``: written, present, or conflict where other bytes lie there.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for f, n, e, data in frame.itertuples(index=False):
                try:
                    out.append("written" if publish(f"{root}/{f}/{n}.{e}", bytes(data)) else "present")
                except FileExistsError:
                    out.append("conflict")
            yield pd.DataFrame({"folder": frame.iloc[:, 0], "name": frame.iloc[:, 1], "outcome": out})

    return df.select(folder, name, extension, content).mapInPandas(run, "folder string, name string, outcome string")


def zip_bytes(entries: dict[str, bytes]) -> bytes:
    """A ZIP that depends on its entries alone: sorted names, one fixed time, one mode."""
    from io import BytesIO

    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in sorted(entries):
            info = zipfile.ZipInfo(name, date_time=(1980, 1, 1, 0, 0, 0))
            info.compress_type, info.external_attr = zipfile.ZIP_DEFLATED, 0o644 << 16
            z.writestr(info, entries[name])
    return out.getvalue()


def upsert(old: DataFrame, new: DataFrame, keys: list[str], ignore: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(merged, outcomes)``: rows of ``new`` replace those of the same keys.

    Outcomes per new key: created, updated or unchanged; fields in ``ignore`` (a time stamp) don't count as a
    change.  A null key equals a null key.  Repeated keys within ``new`` raise when it runs.
    """
    cols = [c for c in old.columns if c not in keys]
    seen = [c for c in cols if c not in (ignore or [])]
    n = new.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(F.struct(*cols)).alias("_v"))
    once = F.when(F.col("_n") > 1, F.raise_error(F.lit("repeated key among the new rows"))).otherwise(F.col("_v"))
    n = n.withColumn("_v", once).drop("_n")
    o = old.select(*keys, F.struct(*cols).alias("_o"))
    same = [o[k].eqNullSafe(n[k]) for k in keys]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    both = o.join(n, cond, "full_outer")
    pick = [F.coalesce(n[k], o[k]).alias(k) for k in keys]
    value = F.coalesce("_v", "_o")
    merged = both.select(*pick, value.alias("_x")).select(*keys, *[F.col(f"_x.{c}").alias(c) for c in cols]).select(*old.columns)
    eq = F.lit(True)
    for c in seen:
        eq = eq & F.col(f"_o.{c}").eqNullSafe(F.col(f"_v.{c}"))
    outcome = F.when(F.col("_o").isNull(), "created").when(eq, "unchanged").otherwise("updated")
    return merged, both.filter("_v is not null").select(*pick, outcome.alias("outcome"))


def write_json(path: str, value: object) -> bool:
    """Canonical JSON, written only if it changed."""
    return write_if_changed(path, (json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n").encode())


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@contextmanager
def lock(path: str) -> Iterator[None]:
    """One build at a time: a lock file that is made only if it isn't there, and removed at the end; else BlockingIOError."""
    try:
        fd = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    except FileExistsError:
        raise BlockingIOError(f"{path} is held by another build") from None
    try:
        os.write(fd, str(os.getpid()).encode())
        yield
    finally:
        os.close(fd)
        Path(path).unlink(missing_ok=True)


def snapshot_tables(spark: SparkSession, source: str, target: str, names: list[str]) -> dict[str, int]:
    """A copy of tables as they are now, their rows by name; a target that has any of them raises FileExistsError."""
    out = {}
    for name in names:
        try:
            spark.read.parquet(f"{source}/{name}.parquet").write.mode("errorifexists").parquet(f"{target}/{name}.parquet")
        except AnalysisException as e:
            raise FileExistsError(f"{target}/{name}.parquet") if "PATH_ALREADY_EXISTS" in str(e) else e from None
        out[name] = spark.read.parquet(f"{target}/{name}.parquet").count()
    return out


def append_predictions(df: DataFrame, path: str, key: str, version: int) -> int:
    """A batch of predictions under ``version``, the same again if it is run again; a key that another version has
    raises ValueError before anything is written.  Returns the rows of the batch."""
    spark = df.sparkSession
    try:
        before = spark.read.parquet(path).filter(F.col("version") != version)
        repeated = df.join(before.select(key).distinct(), key, "left_semi").limit(1).count()
    except AnalysisException:  # the first batch
        repeated = 0
    if repeated:
        raise ValueError("a prediction of the batch is there already")
    df.write.mode("overwrite").parquet(f"{path}/version={version}")
    return spark.read.parquet(f"{path}/version={version}").count()


def transaction(checks: dict[str, DataFrame], write: Callable[[], None]) -> None:
    """``write`` runs if none of ``checks`` has a row; else ValueError names those that do, and nothing is written."""
    broken = [name for name, rows in checks.items() if not rows.isEmpty()]
    if broken:
        raise ValueError(f"not written: {', '.join(broken)}")
    write()


def set_field(df: DataFrame, key: str, value: object, field: str, to: object) -> DataFrame:
    """``df`` with one field of one key's rows set."""
    return df.withColumn(field, F.when(F.col(key) == F.lit(value), F.lit(to)).otherwise(F.col(field)))


def only_row(df: DataFrame, key: str, value: object) -> dict:
    """The one row of a key; LookupError if there is none or another."""
    got = df.filter(F.col(key) == F.lit(value)).limit(2).collect()
    if len(got) != 1:
        raise LookupError(f"{'no' if not got else 'more than one'} row of {key} {value}")
    return got[0].asDict()


def same_resources(published: DataFrame, remote: DataFrame) -> tuple[int, int]:
    """Resources on one side only, ``(missing, unexpected)`` of the remote: a publication is verified at (0, 0)."""
    tagged = published.distinct().withColumn("_s", F.lit(1)).unionByName(remote.distinct().withColumn("_s", F.lit(2)))
    n = tagged.groupBy(*published.columns).agg(F.sum("_s").alias("_s")).agg(F.count_if(F.col("_s") == 1).alias("a"), F.count_if(F.col("_s") == 2).alias("b")).first()
    return n["a"], n["b"]
