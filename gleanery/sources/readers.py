"""Scans: typed JSON lines and CSV that reject what doesn't fit, images, archives, SQLite, configuration."""

from __future__ import annotations

import csv
import hashlib
import re
import sqlite3
import struct
import tomllib
import zipfile
from collections.abc import Callable, Iterator
from io import BytesIO
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleanery.functions.keys import rank_key
from gleanery.functions.normalize import safe_path
from gleanery.functions.rubric import LEVELS, argmax_first, probabilities_consistent
from gleanery.operators.relations import none_in_common

IMAGE_SCHEMA = "format string, width int, height int, problem string"
ARCHIVE_SCHEMA = "archive string, name string, size long, content binary, problem string"


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Typed JSON lines; blank lines are skipped, a line that is no object of the schema fails the scan."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """CSV with a header that must equal the schema's names, quotes doubled, line feeds in quotes.

    An unquoted empty field is null, a quoted one the empty string.  Strict: ragged rows and values that don't parse
    fail the scan; else they come with their text in ``_corrupt``.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    reader = reader.option("enforceSchema", False).option("nullValue", "\x00").option("emptyValue", "")
    if strict:
        return reader.schema(schema).option("mode", "FAILFAST").csv(path)
    fields = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return reader.schema(f"{fields}, _corrupt string").option("enforceSchema", True).option("columnNameOfCorruptRecord", "_corrupt").csv(path)


def check_header(spark: SparkSession, path: str, required: list[str], exact: bool = False) -> None:
    """Raise unless the header holds the required names, or with ``exact`` equals them."""
    first = spark.read.text(path).first()
    names = [] if first is None else next(csv.reader([first[0].removeprefix("\ufeff")]), [])
    if (names != required) if exact else not set(required) <= set(names):
        raise ValueError(f"{path}: header {names} lacks {sorted(set(required) - set(names))} or differs")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and sha256 of files (each up to 2 GB)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def verified(spark: SparkSession, path: str, sha256: str, read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """Read a file only if it has the pinned digest."""
    got = [r["sha256"] for r in file_digests(spark, path).collect()]  # one file
    if got != [sha256]:
        raise ValueError(f"{path}: digest {got} is not the pinned {sha256}")
    return read(spark, path)


def read_images(spark: SparkSession, root: str, pattern: str = "*.{jpg,jpeg,png,webp,gif,bmp}") -> DataFrame:
    """Files below ``root``, undecoded, with digest, length and what their header says."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    kind = probe_images()(F.col("content"))
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("content_hash"), kind.alias("image"), "content").select(
        "path", "size", "content_hash", "image.*", "content"
    )


def probe(data: bytes | None) -> tuple[str | None, int | None, int | None, str | None]:
    """Format, width and height from an image's header, or what is wrong: missing, unknown_format, broken_header."""
    if not data:
        return None, None, None, "missing"
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return ("PNG", *struct.unpack(">II", data[16:24]), None)
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return ("GIF", *struct.unpack("<HH", data[6:10]), None)
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return "BMP", w, abs(h), None
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return ("WEBP", *_webp(data), None)
        if data[:2] == b"\xff\xd8":
            return ("JPEG", *_jpeg(data), None)
    except (struct.error, IndexError):
        return None, None, None, "broken_header"
    return None, None, None, "unknown_format"


def _webp(d: bytes) -> tuple[int, int]:
    if d[12:16] == b"VP8X":
        return 1 + int.from_bytes(d[24:27], "little"), 1 + int.from_bytes(d[27:30], "little")
    if d[12:16] == b"VP8L":
        bits = struct.unpack("<I", d[21:25])[0]
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    w, h = struct.unpack("<HH", d[26:30])
    return w & 0x3FFF, h & 0x3FFF


def _jpeg(d: bytes) -> tuple[int, int]:
    at = 2
    while True:
        if d[at] != 0xFF:
            raise IndexError(at)
        mark = d[at + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", d[at + 5 : at + 9])
            return w, h
        at += 2 + struct.unpack(">H", d[at + 2 : at + 4])[0]


def probe_images():
    """:func:`probe` as a vectorised column function (made when a session exists)."""

    @F.pandas_udf(IMAGE_SCHEMA)
    def run(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([probe(x) for x in content], columns=["format", "width", "height", "problem"])

    return run


def read_archives(spark: SparkSession, path: str, most_entries: int = 10_000, most_bytes: int = 40 << 20) -> DataFrame:
    """Entries of ZIP files, one row each, read where the file lies.

    What is wrong is told in ``problem`` and its content left out: an unsafe path, an entry larger than
    ``most_bytes``, an archive with more entries or that is no ZIP.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                for row in _entries(name, content, most_entries, most_bytes):
                    yield pd.DataFrame([row], columns=["archive", "name", "size", "content", "problem"])

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ARCHIVE_SCHEMA)
    unsafe = F.col("name").isNotNull() & ~safe_path(F.col("name"))
    return rows.withColumn("problem", F.when(unsafe, "unsafe_path").otherwise(F.col("problem"))).withColumn("content", F.when(F.col("problem").isNull(), F.col("content")))


def _entries(archive: str, content: bytes, most_entries: int, most_bytes: int):
    try:
        z = zipfile.ZipFile(BytesIO(content))
    except zipfile.BadZipFile:
        return [(archive, None, None, None, "no_archive")]
    infos = [i for i in z.infolist() if not i.is_dir()]
    if len(infos) > most_entries:
        return [(archive, None, None, None, "too_many_entries")]
    return [(archive, i.filename, i.file_size, *((None, "too_large") if i.file_size > most_bytes else (z.read(i), None))) for i in infos]


def read_sqlite(spark: SparkSession, path: str, name: str, schema: str, parts: int = 4) -> DataFrame:
    """A table of a SQLite file all executors can reach, read only, in ranges of its row ids."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        low, high = c.execute(f'select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from "{name}"').fetchone()
    step = max(1, -(-(high - low + 1) // parts))
    ranges = [(a, a + step) for a in range(low, high + 1, step)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
            for frame in frames:
                for a, b in zip(frame["a"], frame["b"]):
                    yield from pd.read_sql_query(f'select * from "{name}" where rowid >= {a} and rowid < {b}', c, chunksize=10_000)

    if not ranges:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(ranges, "a long, b long").repartition(len(ranges)).mapInPandas(run, schema)


def load_toml(path: str, types: dict[str, type], rules: dict[str, Callable[[dict], bool]] | None = None) -> dict:
    """A TOML file with dotted keys of given types (a bool is no int) and rules across fields; raises on the first breach."""
    config = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    for key, kind in types.items():
        value = config
        for part in key.split("."):
            if not isinstance(value, dict) or part not in value:
                raise ValueError(f"{key} is missing")
            value = value[part]
        if type(value) is not kind:
            raise ValueError(f"{key} must be {kind.__name__}")
    for text, rule in (rules or {}).items():
        if not rule(config):
            raise ValueError(text)
    return config


def config_fingerprint(values: dict) -> str:
    """Digest of the settings that decide the order of a stream; a run goes on only with the same one."""
    from gleanery.functions.keys import canonical_json

    return hashlib.sha256(canonical_json(values).encode()).hexdigest()


# Sources by name; each is called with the session and its options.
SOURCES: dict[str, Callable[..., DataFrame]] = {"jsonl": read_jsonl, "csv": read_csv, "images": read_images, "archives": read_archives, "sqlite": read_sqlite}


def create_source(name: str, spark: SparkSession, **options) -> DataFrame:
    """The source of that name; raises KeyError for an unknown one."""
    return SOURCES[name](spark, **options)


# ---- scans that check what they read ------------------------------------------------------------------------


def checked(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """``df``, which fails when it runs, naming key and rule, at a row that breaks one of
    ``rules`` (false or null), and at a key that is null or there twice."""
    n = df.groupBy(key).agg(F.count("*").alias("_n"))
    error = F.when(F.col(key).isNull(), "no key").when(F.col("_n") > 1, "repeated key")
    for name, ok in rules.items():
        error = error.when(~F.coalesce(ok, F.lit(False)), name)
    rows = df.join(n, key, "left").withColumn("_e", error)
    message = F.concat(F.col("_e"), F.lit(": "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    kind = df.schema[key].dataType
    return rows.withColumn(key, F.when(F.col("_e").isNull(), F.col(key)).otherwise(F.raise_error(message).cast(kind))).select(*df.columns)


def exact_rows(df: DataFrame, n: int) -> DataFrame:
    """``df``, or ValueError unless it has ``n`` rows."""
    got = df.count()
    if got != n:
        raise ValueError(f"{got} rows, not {n}")
    return df


def component_rows(df: DataFrame, component: str) -> DataFrame:
    """Rows of a manifest with the component they are of."""
    return df.withColumn("component", F.lit(component))


def ordered_task(df: DataFrame, order: str, key: str) -> DataFrame:
    """A task whose ``order`` runs 1, 2, ... n with unique keys; fails when it runs at a number out of place."""
    total = df.agg(F.count("*").alias("_t"), F.count_distinct(order).alias("_d"))  # one row
    ok = (F.col(order) >= 1) & (F.col(order) <= F.col("_t")) & (F.col("_d") == F.col("_t"))
    return checked(df.join(F.broadcast(total), F.lit(True)), key, {f"{order} is not 1 to n": ok}).drop("_t", "_d")


def resume_state(manifest: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a collection resumes from: its hashes with ``synchronized``, its sample ids, and the accepted per label.

    A hash or sample id that is there twice fails when it runs."""
    once = lambda df, c: df.groupBy(c).agg(F.count("*").alias("_n"), F.max(F.coalesce("kaggle_synchronized", F.lit(False))).alias("synchronized")).withColumn(
        c, F.when(F.col("_n") == 1, F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"repeated {c}: "), F.col(c))))
    ).drop("_n")
    hashes = once(manifest.filter(F.col("content_hash").isNotNull()), "content_hash")
    ids = once(manifest.filter(F.col("sample_id").isNotNull()), "sample_id").select("sample_id")
    return hashes, ids, manifest.groupBy("normalized_label").agg(F.count("*").alias("accepted"))


def exclusions(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[dict]]:
    """The distinct hashes of exclusion manifests (JSON lines with content_hash and relative_image_path), and the
    provenance of each: path, sha256, hashes.

    Every image beside a manifest must have the hash its line says; a line without a lower-case digest, a repeated hash, a
    path that leaves the folder, a missing image or an empty manifest fails."""
    out, provenance = None, []
    for path in paths:  # the configured list
        rows = read_jsonl(spark, path, "content_hash string, relative_image_path string")
        rows = checked(rows, "content_hash", {"invalid content_hash": F.col("content_hash").rlike("^[0-9a-f]{64}$"), "unsafe path": safe_path(F.col("relative_image_path"))})
        root = path.rsplit("/", 1)[0]
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
        lies = files.select(F.regexp_extract("path", F.lit(".*?" + re.escape(root.removeprefix("file://")) + "/(.*)$"), F.lit(1)).alias("relative_image_path"), F.sha2("content", 256).alias("_is"))
        got = rows.join(lies, "relative_image_path", "left")
        wrong = F.when(F.col("_is").isNull(), "missing image: ").when(F.col("_is") != F.col("content_hash"), "image hash does not match: ")
        got = got.withColumn("content_hash", F.when(wrong.isNull(), F.col("content_hash")).otherwise(F.raise_error(F.concat(wrong, F.col("relative_image_path")))))
        n = got.agg(F.count("content_hash")).first()[0]
        if not n:
            raise ValueError(f"{path} is empty")
        provenance.append({"path": path, "sha256": file_digests(spark, path).first()["sha256"], "hashes": n})
        out = got.select("content_hash") if out is None else out.unionByName(got.select("content_hash"))
    return (out.distinct() if out is not None else spark.createDataFrame([], "content_hash string")), provenance


def predictions(df: DataFrame, human: DataFrame, excluded: DataFrame) -> DataFrame:
    """Prediction rows checked for key, class, label, provenance and probabilities, that fail if one is of a human
    label's image, without those of excluded images."""
    probabilities = [F.col(f"prob_{x}") for x in LEVELS]
    in_range = [p.between(0, 1) & ~F.isnan(p) for p in probabilities]
    rules = {
        "invalid content_hash": F.col("content_hash").rlike("^[0-9a-f]{64}$"), "invalid model prediction": F.col("predicted_sensitivity_level").isin(LEVELS),
        "invalid source label": F.col("source_label").isin("real", "fake"), "missing provenance": (F.col("source_dataset") != "") & (F.col("model_version") != ""),
        "invalid probability": in_range[0] & in_range[1] & in_range[2], "probabilities do not agree": probabilities_consistent(probabilities, F.col("confidence")),
        "predicted class does not match": F.col("predicted_sensitivity_level") == argmax_first(LEVELS, probabilities),
    }
    rows = none_in_common(checked(df, "content_hash", rules), human, "content_hash", "human label")
    keys = excluded.filter(F.col("content_hash").isNotNull()).select("content_hash").distinct()
    return rows.join(keys, "content_hash", "left_anti")


def evaluable(df: DataFrame) -> DataFrame:
    """Rows an evaluation may use: linked, readable, with a verified label and a level."""
    c = F.col
    return df.filter((c("annotation_join_status") == "linked") & (c("file_status") == "readable") & c("normalized_label").isin("real", "fake") & c("sensitivity_level").isin(LEVELS))


def automatic(df: DataFrame) -> DataFrame:
    """Rows labelled automatically: level and path from what is there first, those without either left out."""
    level = F.coalesce(F.nullif(F.btrim("final_label"), F.lit("")), F.nullif(F.btrim("predicted_sensitivity_level"), F.lit("")))
    path = F.get(F.from_json("image_paths", "array<string>"), 0)
    return df.withColumn("sensitivity_level", level).withColumn("image_path", path).filter("sensitivity_level is not null and coalesce(image_path, '') <> ''")


def raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV all of whose fields are texts, empty ones included: nothing is read as null."""
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("nullValue", "\x00").option("emptyValue", "").csv(path).na.fill("")


def shuffled(df: DataFrame, key: str, seed: int | None, buffer: int) -> DataFrame:
    """A stream's order mixed within bounds: rows of ``buffer`` consecutive ``position`` values are ordered among
    themselves by the digest of seed and key, as ``shuffled_position``.  No seed or a buffer of 0: the order stays."""
    if seed is None or buffer <= 0:
        return df.withColumn("shuffled_position", F.col("position"))
    block = F.floor((F.col("position") - 1) / buffer)
    place = F.row_number().over(W.partitionBy("_b").orderBy(rank_key(seed, "shuffle", key), "position"))
    return df.withColumn("_b", block).withColumn("shuffled_position", F.col("_b") * buffer + place).drop("_b")


def allowed_metadata(root: str, name: str, digests: dict[str, str]) -> bytes:
    """The bytes of a metadata file on the list of ``digests``; one that isn't there or differs raises ValueError."""
    if name not in digests:
        raise ValueError(f"{name} is not on the list")
    data = (Path(root) / name).read_bytes()
    if hashlib.sha256(data).hexdigest() != digests[name]:
        raise ValueError(f"{name} differs from its digest")
    return data


def pinned_revision(requested: str, resolved: str | None, before: str | None = None) -> str:
    """The revision a source is read at: the one it was resolved to, else the requested one if that is a commit.

    ValueError if it is none (40 digits), or another than a run ``before`` read."""
    got = resolved or requested
    if not re.fullmatch("[0-9a-f]{40}", got):
        raise ValueError(f"{requested} is no commit")
    if before and before != got:
        raise ValueError("the resolved revision changed since the checkpoint")
    return got


def overrides(values: list[str], quotas: dict[str, int]) -> dict[str, int]:
    """Quotas with ``LABEL=COUNT`` overrides; an unknown label, a repeated one or a count below 1 raises ValueError."""
    out: dict[str, int] = {}
    for v in values:
        label, _, count = v.partition("=")
        if label not in quotas or label in out or not count.isdigit() or int(count) < 1:
            raise ValueError(f"invalid override: {v}")
        out[label] = int(count)
    return quotas | out
