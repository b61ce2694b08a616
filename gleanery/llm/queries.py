"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.cleaning import cleaned, cleaned_hash
from gleanery.llm import history, overlap, packing, proportions, spans, tokens
from gleanery.llm.sql import SQL  # noqa: F401
from gleanery.session import materialize, table

GOLD, REST = ["gold_development", "gold_test"], ["unassigned"]


def _assignments(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.records(
        table(spark, sf, "assignments"), row_id="assignment_id", group=F.col("split_seed"), split=cleaned("role"),
        key=cleaned_hash("content_hash"), text=F.col("prompt"), evaluation=GOLD, training=REST,
    )


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.overlapping_pairs(_assignments(spark, sf)).select(
        F.least("id_e", "id_t").alias("assignment_id_a"), F.greatest("id_e", "id_t").alias("assignment_id_b")
    )


def p3_overlap_by_split(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "assignments").select(F.col("assignment_id").alias("id"), F.col("source_dataset").alias("source"))
    return overlap.overlap_counts(_assignments(spark, sf), labels)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    _, plan = proportions.sample_plan(table(spark, sf, "predictions"), table(spark, sf, "sample_targets"))
    return plan.filter("shortfall > 0").select("target_id")


def p4_targets(spark: SparkSession, sf: str) -> DataFrame:
    _, plan = proportions.sample_plan(table(spark, sf, "predictions"), table(spark, sf, "sample_targets"))
    return plan.select("target_id", "sample_name", "needed", "available", "quota", "shortfall")


def p4_shortfalls(spark: SparkSession, sf: str) -> DataFrame:
    """What each target needs, what there is, and what is missing."""
    return p4_targets(spark, sf).select("target_id", "sample_name", "needed", "available", "shortfall")


def p4_sample(spark: SparkSession, sf: str) -> DataFrame:
    return proportions.draw(*proportions.sample_plan(table(spark, sf, "predictions"), table(spark, sf, "sample_targets")))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    manifest = table(spark, sf, "collection_manifest")
    sample = F.nullif(F.btrim("sample_id", F.lit(" \t\r\n")), F.lit(""))
    records = history.prepared(
        manifest, row_id=F.col("record_id"), order=[F.col("batch_no"), F.col("stream_position")],
        keys=[history.exact_key("hash", cleaned_hash("content_hash")), history.exact_key("sample", F.col("source_dataset"), sample)],
        text=F.col("prompt"), keep=["batch_no"],
    )
    excluded = table(spark, sf, "exclusion_manifests").select(history.exact_key("hash", cleaned_hash("content_hash")).alias("key"))
    return history.refused_records(records, "batch_no", excluded).select(F.col("rid").alias("record_id"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf, "documents"), "doc_id", "text")


def p6_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Per language: rows, tokens, and texts that don't come back exactly from their ids (none may)."""
    docs = table(spark, sf, "documents")
    ids = materialize(tokens.token_ids(docs, "doc_id", "text"), "ids")
    back = tokens.decoded(ids, "doc_id", "ids").select("doc_id", F.md5("text").alias("back"))
    side = docs.select("doc_id", "lang", F.md5(F.coalesce("text", F.lit(""))).alias("said")).join(back, "doc_id")
    side = side.join(ids.select("doc_id", F.size("ids").alias("n")), "doc_id")
    return side.groupBy(cleaned("lang").alias("lang")).agg(
        F.count("*").alias("documents"), F.sum("n").alias("tokens"), F.count_if(F.col("said") != F.col("back")).alias("changed")
    )


def p6_unchanged(spark: SparkSession, sf: str) -> DataFrame:
    """:func:`p6_roundtrip` without the number of tokens, which SQL can't tell."""
    return p6_roundtrip(spark, sf).drop("tokens")


def _packed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    kinds = [(r[0], r[1]) for r in table(spark, sf, "containers").select("container_kind", "capacity_tokens").collect()]  # a few rows
    sizes = materialize(tokens.token_counts(table(spark, sf, "documents"), "doc_id", "text"), "sizes")
    return packing.pack(sizes, "doc_id", "n_tokens", kinds)


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    packed, _ = _packed(spark, sf)
    return packed.select(
        F.col("kind").alias("container_kind"), "container", "doc_id", "piece", F.col("first").alias("first_token"), F.col("size").alias("n_tokens")
    )


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Per kind and round: partitions, those whose bin count is certified, bins and their lower bound."""
    _, bounds = _packed(spark, sf)
    return bounds.groupBy(F.col("kind").alias("container_kind"), "round").agg(
        F.count("*").alias("partitions"), F.count_if(F.col("bins") == F.col("bound")).alias("certified"),
        F.sum("bins").alias("bins"), F.sum("bound").alias("lower_bound"),
    )


def p7_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Per kind: documents packed, containers that hold more than their capacity, documents divided though they fit, and
    documents whose pieces don't follow one another from the first token on (none of these may be)."""
    packed = materialize(p7_containers(spark, sf), "packed")
    kinds = table(spark, sf, "containers").select("container_kind", "capacity_tokens").distinct()
    full = packed.groupBy("container_kind", "container").agg(F.sum("n_tokens").alias("n")).join(kinds, "container_kind")
    full = full.groupBy("container_kind").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("overfull"))
    docs = packed.groupBy("container_kind", "doc_id").agg(
        F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"), F.min("piece").alias("low"), F.max("piece").alias("high"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end")
    ).join(kinds, "container_kind")
    docs = docs.groupBy("container_kind").agg(
        F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= F.col("capacity_tokens"))).alias("divided_though_fitting"),
        F.count_if((F.col("low") != 0) | (F.col("high") != F.col("pieces") - 1) | (F.col("end") != F.col("n"))).alias("gaps"),
    )
    return docs.join(full, "container_kind")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = spans.sharing_pairs(table(spark, sf, "documents"), "doc_id", "text")
    return pairs.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p8_shared_share(spark: SparkSession, sf: str) -> DataFrame:
    return spans.shared_share(table(spark, sf, "documents"), "doc_id", "text")


QUERIES = {
    "p3_found": p3_found, "p3_overlap_by_split": p3_overlap_by_split,
    "p4_found": p4_found, "p4_targets": p4_targets, "p4_shortfalls": p4_shortfalls, "p4_sample": p4_sample,
    "p5_found": p5_found, "p6_ids": p6_ids, "p6_roundtrip": p6_roundtrip, "p6_unchanged": p6_unchanged, "p7_containers": p7_containers, "p7_invariants": p7_invariants, "p7_fill": p7_fill,
    "p8_found": p8_found, "p8_shared_share": p8_shared_share,
}
