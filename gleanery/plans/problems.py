"""Queries of the general problems: orphan references and the change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.cleaning import cleaned_hash
from gleanery.operators.orphans import Child, Parent, orphans, orphans_by_period
from gleanery.session import table
from gleanery.streaming.changefeed import apply_files, review_sequence


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    images, reviews = table(spark, sf, "images"), table(spark, sf, "reviews")
    return orphans(
        [
            Child("batch_images", table(spark, sf, "batch_images"), c("entry_id"), cleaned_hash("content_hash"), c("added_at"), "images"),
            Child("annotations", table(spark, sf, "annotations"), c("annotation_id"), cleaned_hash("content_hash"), c("recorded_at"), "images"),
            Child("review_imports", table(spark, sf, "review_imports"), c("import_id"), c("master_review_id"), c("imported_at"), "reviews"),
        ],
        [
            Parent("images", images, cleaned_hash("content_hash"), c("loaded_at"), c("deleted_at")),
            Parent("reviews", reviews, c("review_id"), c("loaded_at"), c("deleted_at")),
        ],
    )


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).select("table_name", "row_id")


def p1_orphans_by_month(spark: SparkSession, sf: str) -> DataFrame:
    return orphans_by_period(_orphans(spark, sf))


PAYLOAD = [
    "change_no", "content_hash", "reviewer_key", "reviewer", "review_action", "review_reason", "status",
    "public_relevance", "harm_urgency", "vulnerability",
]


def _reviews(spark: SparkSession, sf: str) -> DataFrame:
    return apply_files(
        spark, f"{sf}/review_changes.parquet", key="review_id", sequence=review_sequence, op=lambda: F.col("change_op"), payload=PAYLOAD
    )


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _reviews(spark, sf).select("review_id", "change_no")


def p2_current_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """The rebuilt table itself; ``content_hash`` in its cleaned form, as deliveries spell it differently."""
    return _reviews(spark, sf).select(
        "review_id", "change_no", cleaned_hash("content_hash").alias("content_hash"), "reviewer_key", "review_action",
        "public_relevance", "harm_urgency", "vulnerability",
    )


_KEY = "nullif(regexp_replace(lower(trim({}, ' \t')), '^sha256:', ''), '')"

_ORPHAN_SQL = f"""
with child as (
  select 'batch_images' as table_name, 'images' as parent, entry_id as row_id, {_KEY.format("content_hash")} as k, added_at as t from batch_images
  union all select 'annotations', 'images', annotation_id, {_KEY.format("content_hash")}, recorded_at from annotations
  union all select 'review_imports', 'reviews', import_id, cast(master_review_id as varchar), imported_at from review_imports),
parent as (
  select 'images' as parent, {_KEY.format("content_hash")} as k, loaded_at, deleted_at from images
  union all select 'reviews', cast(review_id as varchar), loaded_at, deleted_at from reviews),
found as (
  select distinct table_name, parent, row_id, t from child c
  where k is not null and not exists (
    select 1 from parent p where p.parent = c.parent and p.k = c.k and p.loaded_at <= c.t and (p.deleted_at is null or c.t < p.deleted_at)))
"""

_FEED_SQL = f"""
with c as (
  select distinct review_id, change_no, left(lower(trim(change_op)), 1) as op, try_cast(reviewed_at as timestamptz) as t,
         {_KEY.format("content_hash")} as content_hash, reviewer_key, review_action, public_relevance, harm_urgency, vulnerability
  from review_changes
  where review_id is not null and regexp_matches(reviewed_at, '^\\d{{4}}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d:\\d\\d(\\.\\d+)?(Z|[+-]\\d\\d:\\d\\d)$')),
base as (select *, row_number() over (partition by review_id order by t desc, change_no desc) as n from c where op in ('i', 'd')),
image as (select *, row_number() over (partition by review_id order by t desc, change_no desc) as n from c where op in ('i', 'u'))
"""

QUERIES = {"p1_found": p1_found, "p1_orphans_by_month": p1_orphans_by_month, "p2_found": p2_found, "p2_current_reviews": p2_current_reviews}

SQL = {
    "p1_found": _ORPHAN_SQL + "select table_name, row_id from found",
    "p1_orphans_by_month": _ORPHAN_SQL
    + "select table_name, parent, strftime(t at time zone 'UTC', '%Y-%m') as period, count(*) as orphan_rows from found group by all",
    "p2_found": _FEED_SQL
    + "select i.review_id, i.change_no from image i join base b using (review_id) where i.n = 1 and b.n = 1 and b.op = 'i'",
    "p2_current_reviews": _FEED_SQL
    + """select i.review_id, i.change_no, i.content_hash, i.reviewer_key, i.review_action, i.public_relevance, i.harm_urgency, i.vulnerability
from image i join base b using (review_id) where i.n = 1 and b.n = 1 and b.op = 'i'""",
}
