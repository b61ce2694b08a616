"""Joins and set operations with audited outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def audited_join(images: DataFrame, entries: DataFrame, copied: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Annotation entries held against images by content hash: ``(results, joined images, issues)``.

    ``images``: image_id, content_hash, file_status, component, image_path, normalized_label, label_status.
    ``entries``: record_id, content_hash, validation_error (null or empty: none), component, relative_image_path,
    normalized_label and the columns to be ``copied``; an entry twice is one entry.  The first status that applies to a
    hash is that of all its entries and images: unmatched, ambiguous_image (more than one image), image_integrity_problem
    (not readable), invalid_annotation (any entry has an error), conflicting_annotations (more than one entry),
    annotation_metadata_conflict (component, or path that the image's doesn't end with), linked.

    Results are an entry each with the status and the number of images; images have the status (``unannotated`` without
    an entry) and copied values only where it is linked.  An entry's label that contradicts the image's makes the
    image's ``unknown``, its label status ``conflict``, and an issue.  Null hashes: an entry is unmatched, an image
    unannotated.  Both sides are aggregated before they meet, so no pair of a hash's images and entries is formed.
    """
    entries = entries.dropDuplicates(["record_id"])
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    i = images.filter(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(
        F.count("*").alias("images"), F.min(F.struct("file_status", "component", "image_path", "normalized_label")).alias("i")
    )
    kept = ["record_id", "component", "relative_image_path", "normalized_label", *copied]
    e = entries.groupBy("content_hash").agg(
        F.count("*").alias("entries"), F.max(text("validation_error") != "").alias("invalid"), F.min(F.struct(*dict.fromkeys(kept))).alias("e")
    )
    other = (text("e.component") != "") & (F.col("e.component") != text("i.component"))
    elsewhere = (text("e.relative_image_path") != "") & ~text("i.image_path").endswith(F.concat(F.lit("/"), text("e.relative_image_path")))
    status = (
        F.when(F.col("images").isNull(), "unmatched").when(F.col("images") > 1, "ambiguous_image").when(F.col("i.file_status") != "readable", "image_integrity_problem")
        .when(F.col("invalid"), "invalid_annotation").when(F.col("entries") > 1, "conflicting_annotations")
        .when(other | elsewhere, "annotation_metadata_conflict").otherwise("linked")
    )
    hashes = e.join(i, "content_hash", "left").withColumn("status", status)
    known = ("real", "fake")
    contradicts = (F.col("status") == "linked") & F.col("e.normalized_label").isin(*known) & F.col("i.normalized_label").isin(*known)
    hashes = hashes.withColumn("_wrong", F.coalesce(contradicts & (F.col("e.normalized_label") != F.col("i.normalized_label")), F.lit(False)))
    results = entries.select("record_id", "content_hash", "validation_error").join(
        hashes.select("content_hash", "status", "images"), "content_hash", "left"
    ).select("record_id", "content_hash", F.coalesce("status", F.lit("unmatched")).alias("status"), F.coalesce("images", F.lit(0)).alias("images"), "validation_error")
    back = hashes.select("content_hash", "status", "_wrong", F.when(F.col("status") == "linked", F.col("e")).alias("e"))
    wrong = F.coalesce("_wrong", F.lit(False))
    joined = images.join(back, "content_hash", "left").select(
        *[c for c in images.columns if c not in ("normalized_label", "label_status")],
        F.when(wrong, "unknown").otherwise(F.col("normalized_label")).alias("normalized_label"),
        F.when(wrong, "conflict").otherwise(F.col("label_status")).alias("label_status"),
        F.coalesce("status", F.lit("unannotated")).alias("annotation_join_status"), F.col("e.record_id").alias("record_id"), *[F.col(f"e.{c}").alias(c) for c in copied],
    )
    issues = images.join(back.filter("_wrong").select("content_hash"), "content_hash", "left_semi").select(F.lit("annotation_label_conflict").alias("type"), "image_id", "content_hash")
    return results, joined, issues


def none_in_common(left: DataFrame, right: DataFrame, key: str, message: str) -> DataFrame:
    """``left``, which fails when it runs if ``right`` has any of its keys; nulls have no partner."""
    keys = right.filter(F.col(key).isNotNull()).select(key).distinct().withColumn("_r", F.lit(True))
    checked = F.when(F.col("_r").isNull(), F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"{message}: "), F.col(key).cast("string"))))
    return left.join(keys, key, "left").withColumn(key, checked).drop("_r")


def compared_runs(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Two runs over the same items side by side, fields with the suffixes ``_a`` and ``_b``, and ``same``,
    whether all are equal (nulls too).  Items of one run only have nulls on the other side and ``same`` false."""
    side = lambda df, x: df.select(key, *[F.col(f).alias(f"{f}_{x}") for f in fields], F.lit(True).alias(f"_{x}"))
    got = side(a, "a").join(side(b, "b"), key, "full_outer")
    same = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    for f in fields:
        same = same & F.col(f"{f}_a").eqNullSafe(F.col(f"{f}_b"))
    return got.withColumn("same", same).drop("_a", "_b")


def determinism(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Of two runs the items, those in both, those equal in all fields, and per field how many differ."""
    got = compared_runs(a, b, key, fields)
    both = F.col(f"{fields[0]}_a").isNotNull() & F.col(f"{fields[0]}_b").isNotNull()
    differs = [F.count_if(~F.col(f"{f}_a").eqNullSafe(F.col(f"{f}_b"))).alias(f"{f}_differs") for f in fields]
    return got.agg(F.count("*").alias("items"), F.count_if(both).alias("in_both"), F.count_if("same").alias("identical"), *differs)


def with_details(df: DataFrame, details: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A left join of details of unique keys; a key that the details have twice fails when it runs."""
    n = details.groupBy(key).agg(F.count("*").alias("_n"), *[F.first(f).alias(f) for f in fields])
    once = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated key: "), F.col(key).cast("string")))).otherwise(F.col(key))
    return df.join(n.withColumn(key, once).drop("_n"), key, "left")


def has_other(df: DataFrame, others: DataFrame, key: str, owner: str, flag: str) -> DataFrame:
    """Whether ``others`` has a row of the key with another owner.  The inequality needs no pairs: another owner is
    there if and only if the least or the greatest owner of the key differs.  A null owner differs from none."""
    ends = others.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(owner).alias("_lo"), F.max(owner).alias("_hi"))
    differs = (F.col("_lo") != F.col(owner)) | (F.col("_hi") != F.col(owner))
    return df.join(ends, key, "left").withColumn(flag, F.coalesce(differs, F.lit(False))).drop("_lo", "_hi")


def alias_index(df: DataFrame, target: str, aliases: dict[str, Column]) -> DataFrame:
    """``(kind, alias, target, targets)``; an alias that names several targets has none."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("alias")) for k, c in aliases.items()])
    rows = df.select(target, F.explode(pairs).alias("a")).select(target, "a.*").filter("alias is not null")
    got = rows.groupBy("kind", "alias").agg(F.count_distinct(target).alias("targets"), F.min(target).alias("_t"))
    return got.select("kind", "alias", F.when(F.col("targets") == 1, F.col("_t")).alias(target), "targets")


def flagged(df: DataFrame, others: dict[str, DataFrame], key: str) -> DataFrame:
    """A boolean per other table that tells whether it has the row's key; no row is multiplied."""
    for name, other in others.items():
        keys = other.filter(F.col(key).isNotNull()).select(key).distinct().withColumn(name, F.lit(True))
        df = df.join(keys, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return df


def with_default(df: DataFrame, lookup: DataFrame, key: str, value: str, default) -> DataFrame:
    """A column of a lookup of unique keys, or ``default``; small lookups are broadcast by their size."""
    return df.join(lookup.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def merged_one_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """A join that raises, when it runs, if either side has a key twice."""

    def once(df: DataFrame, side: str) -> DataFrame:
        n = F.count("*").over(W.partitionBy(key))
        message = F.concat(F.lit(f"repeated key on the {side}: "), F.col(key).cast("string"))
        return df.withColumn("_n", n).withColumn(key, F.when(F.col("_n") == 1, F.col(key)).otherwise(F.raise_error(message))).drop("_n")

    return once(left, "left").join(once(right, "right"), key, how)


def keyed_difference(old: DataFrame, new: DataFrame, keys: list[str], ignore: list[str] | None = None) -> DataFrame:
    """Per key ``added``, ``removed``, ``changed`` or ``same``; nulls are equal to nulls."""
    cols = [c for c in old.columns if c in new.columns and c not in keys and c not in (ignore or [])]
    pack = lambda d, n: d.select(*keys, F.struct(*[F.col(c) for c in cols]).alias(n))
    change = (
        F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed")
        .when(F.col("_o").eqNullSafe(F.col("_n")), "same").otherwise("changed")
    )
    return pack(old, "_o").join(pack(new, "_n"), keys, "full_outer").select(*keys, change.alias("change"))


def set_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """U03, U04, U05, U06 of two one-column frames as sets: sizes, common, only left, only right, equal.  One shuffle."""
    c = a.columns[0]
    tagged = a.select(c, F.lit(1).alias("s")).unionByName(b.select(F.col(b.columns[0]).alias(c), F.lit(2).alias("s")))
    keys = tagged.groupBy(c).agg(F.bit_or("s").alias("s"))
    n = lambda x: F.count_if(F.col("s") == x)
    return keys.agg(n(3).alias("common"), n(1).alias("only_left"), n(2).alias("only_right")).withColumn(
        "equal", (F.col("only_left") == 0) & (F.col("only_right") == 0)
    )


def union_first(frames: list[DataFrame], key: str) -> DataFrame:
    """Rows of all frames, of each key one of the earliest frame that has it (its least row)."""
    cols = frames[0].columns
    out = frames[0].withColumn("_f", F.lit(0))
    for i, d in enumerate(frames[1:], 1):
        out = out.unionByName(d.select(*cols).withColumn("_f", F.lit(i)))
    rest = [c for c in cols if c != key]
    got = out.groupBy(key).agg(F.min(F.struct("_f", *rest)).alias("m"))
    return got.select(key, *[f"m.{c}" for c in rest], F.col("m._f").alias("source_no"))


def log_prefix(base: DataFrame, longer: DataFrame, position: str, payload: str) -> DataFrame:
    """Whether the log ``base`` is a prefix of ``longer``: one row ``(base_rows, mismatches, is_prefix)``."""
    b, n = base.select(position, F.col(payload).alias("_b")), longer.select(position, F.col(payload).alias("_l"), F.lit(True).alias("_there"))
    got = b.join(n, position, "left")
    bad = F.col("_there").isNull() | ~F.col("_b").eqNullSafe(F.col("_l"))
    return got.agg(F.count("*").alias("base_rows"), F.count_if(bad).alias("mismatches")).withColumn("is_prefix", F.col("mismatches") == 0)


def missing_parents(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose non-null key no parent has (an anti join; never NOT IN)."""
    return child.filter(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")
