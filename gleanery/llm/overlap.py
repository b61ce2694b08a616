"""Records of evaluation splits that stand, exactly or nearly, in the training split.

Records are canonicalised (case, punctuation, white space), hashed, and equal hashes collapse into one
class; hashes of both sides are joined.  For near copies the classes' signatures are joined
(:mod:`gleanery.llm.shingles`) and each candidate is checked by the exact share of common shingles.
Classes, not records, are compared, so a text copied a million times is compared once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.shingles import alike, canonical, canonical_set, fit_order, may_be_alike, signatures
from gleanery.session import materialize


def records(df: DataFrame, *, row_id: str, group: Column, split: Column, key: Column, text: Column, evaluation: list[str], training: list[str]) -> DataFrame:
    """One row per record on a side: ``id, grp, split, train, key, canon, cls``; repeated ids are one record.

    ``cls`` is the digest of the canonical text, null where it is too short for a shingle (then there is
    no likeness).  A split that is null or on neither list is on no side; a null group compares with none.
    """
    rows = df.select(F.col(row_id).alias("id"), group.alias("grp"), split.alias("split"), key.alias("key"), text.alias("text"))
    rows = rows.filter(F.col("split").isin(evaluation + training) & F.col("grp").isNotNull() & F.col("id").isNotNull())
    return rows.dropDuplicates(["id"]).select(
        "id", "grp", "split", F.col("split").isin(training).alias("train"), "key", canonical(F.col("text")).alias("canon")
    ).withColumn("cls", F.unhex(F.md5("canon")))


def alike_classes(rows: DataFrame, cells: int = 1 << 22, rare: int = 16) -> DataFrame:
    """``(grp, cls_e, cls_t)``: classes with evaluation rows and classes with training rows that are alike.

    A class that has rows on both sides is paired with itself.
    """
    classes = materialize(
        rows.filter("cls is not null").groupBy("grp", "cls").agg(
            F.max(~F.col("train")).alias("e"), F.max("train").alias("t"), F.first("canon").alias("canon")
        ).select("grp", "cls", "e", "t", canonical_set(F.col("canon")).alias("set")),
        "classes",
    )
    order = fit_order(classes, "set", cells, ("e", "t"))
    pre = lambda side: signatures(classes.filter(side), ["grp", "cls"], "set", order, rare, skip_zero=True)
    pairs = (
        pre("e").alias("a")
        .join(pre("t").alias("b"), (F.col("a.grp") == F.col("b.grp")) & (F.col("a.s") == F.col("b.s")) & (F.col("a.cls") != F.col("b.cls")))
        .filter(may_be_alike("a", "b"))
        .select("a.grp", F.col("a.cls").alias("cls_e"), F.col("b.cls").alias("cls_t"))
        .distinct()
    )
    side = lambda x: classes.select("grp", F.col("cls").alias(f"cls_{x}"), F.col("set").alias(f"set_{x}"))
    near = pairs.join(side("e"), ["grp", "cls_e"]).join(side("t"), ["grp", "cls_t"]).filter(alike(F.col("set_e"), F.col("set_t")))
    same = classes.filter("e and t").select("grp", F.col("cls").alias("cls_e"), F.col("cls").alias("cls_t"))
    return near.select("grp", "cls_e", "cls_t").unionByName(same)


def _sides(rows: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    take = lambda train, x: rows.filter(F.col("train") == train).select(F.col("id").alias(f"id_{x}"), "grp", F.col(by).alias(f"{by}_{x}")).filter(F.col(f"{by}_{x}").isNotNull())
    return take(False, "e"), take(True, "t")


def overlapping_pairs(rows: DataFrame) -> DataFrame:
    """``(id_e, id_t)`` of all records of the two sides with equal keys or alike texts."""
    rows = materialize(rows, "records")
    ke, kt = _sides(rows, "key")
    exact = ke.join(kt, (ke["grp"] == kt["grp"]) & (ke["key_e"] == kt["key_t"])).select("id_e", "id_t")
    ce, ct = _sides(rows, "cls")
    near = alike_classes(rows).join(ce, ["grp", "cls_e"]).join(ct, ["grp", "cls_t"]).select("id_e", "id_t")
    return exact.unionByName(near).distinct()


def overlap_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Per split and source: evaluation records, those with an equal key, an alike text, or either in training.

    ``labels`` holds ``(id, source)``.  No pair is formed: hashes of one side are looked up among the
    distinct hashes of the other.
    """
    rows = materialize(rows, "records")
    ev = rows.filter("not train")
    keys = rows.filter("train and key is not null").select("grp", "key").distinct().withColumn("exact", F.lit(True))
    hit = alike_classes(rows).select("grp", F.col("cls_e").alias("cls")).distinct().withColumn("near", F.lit(True))
    got = ev.join(keys, ["grp", "key"], "left").join(hit, ["grp", "cls"], "left").join(labels.dropDuplicates(["id"]), "id", "left")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    exact, near = F.col("exact"), F.col("near")
    return got.groupBy("split", "source").agg(
        F.count("*").alias("evaluation_rows"), n(exact).alias("equal_key"), n(near).alias("alike_text"),
        n(F.coalesce(exact, F.lit(False)) | F.coalesce(near, F.lit(False))).alias("overlapping"),
    )
