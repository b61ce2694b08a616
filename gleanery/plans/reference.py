"""Queries of the engine's own operators over the project's tables, each with the SQL that checks it.

Names begin with the operator's ID.  Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import keys as K
from gleanery.functions import normalize as N
from gleanery.functions import rubric as R
from gleanery.functions.cleaning import cleaned, cleaned_hash, instant
from gleanery.operators import aggregates as A
from gleanery.operators import fusion as X
from gleanery.operators import integrity as I
from gleanery.operators import metrics as M
from gleanery.operators import relations as J
from gleanery.operators import review as V
from gleanery.operators import sampling as S
from gleanery.session import discard, scratch, table
from gleanery.streaming import collect
from gleanery.streaming.runtime import stream_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col


def query(sql: str | None = None):
    """Register a query under its function's name, and the SQL it must equal."""

    def keep(f: Callable[[Callable[[str], DataFrame], SparkSession], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf: f(lambda name: table(spark, sf, name), spark)
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def key_sql(col: str) -> str:
    return f"nullif(regexp_replace(lower(trim({col}, ' \t')), '^sha256:', ''), '')"


KEY = key_sql("content_hash")
CLEAN = "lower(trim({}, ' \t\r\n'))".format

# ---- projections and predicates -----------------------------------------------------------------------------


@query(
    """select annotation_id, public_relevance + harm_urgency + vulnerability as score,
case when public_relevance + harm_urgency + vulnerability <= 1 then 'low' when public_relevance + harm_urgency + vulnerability <= 3 then 'medium' else 'high' end as level
from annotations where public_relevance between 0 and 2 and harm_urgency between 0 and 2 and vulnerability between 0 and 1"""
)
def p04_rubric_level(t, spark):
    return t("annotations").select("annotation_id", R.score().alias("score"), R.level(R.score()).alias("level")).filter("score is not null")


_BROKEN = f"""case
  when coalesce(content_hash, '') = '' then 'missing_hash' when coalesce(blind_id, '') = '' then 'missing_blind_id'
  when not coalesce(public_relevance between 0 and 2 and harm_urgency between 0 and 2 and vulnerability between 0 and 1, false) then 'axis_out_of_range'
  when sensitivity_score is distinct from public_relevance + harm_urgency + vulnerability then 'score_mismatch'
  when {CLEAN("sensitivity_level")} is distinct from (case when sensitivity_score <= 1 then 'low' when sensitivity_score <= 3 then 'medium' else 'high' end) then 'level_mismatch'
  when length(coalesce(sensitivity_rationale, '')) > 280 then 'rationale_too_long'
  when not coalesce(annotation_confidence in ('low', 'medium', 'high'), false) then 'unknown_confidence'
  when needs_review is null then 'needs_review_missing' when not coalesce(annotation_round >= 1, false) then 'round_not_positive'
  when not coalesce(regexp_matches(annotated_at, '(Z|[+-]\\d\\d:\\d\\d)$'), false) then 'time_without_offset' end"""


@query(f"select {_BROKEN} as validation_error, count(*) as rows from annotations group by 1")
def p05_validation_errors(t, spark):
    error = R.validation_error(cleaned("sensitivity_level"))
    return t("annotations").groupBy(error.alias("validation_error")).agg(F.count("*").alias("rows"))


@query(
    f"""select doc_id, md5(case when regexp_matches(text, '{N.SECRET}') then '{N.REDACTED_SECRET}' when regexp_matches(text, '{N.LOCAL_PATH}') then '{N.REDACTED_PATH}'
 else substr(text, 1, {N.LONGEST_TEXT}) end) as digest, regexp_matches(text, '{N.SECRET}') as secret from documents"""
)
def p07_redaction(t, spark):
    kept = N.redacted(c("text"))
    return t("documents").select("doc_id", F.md5(kept).alias("digest"), c("text").rlike(N.SECRET).alias("secret"))


@query(
    f"""with m as (select record_id, original_label, {CLEAN("original_label")} as k from collection_manifest)
select distinct record_id, case when k in ('real', '0') then 'real' when k in ('fake', '1') then 'fake' end as label,
case when original_label is null then 'missing_label' when k in ('real', '0', 'fake', '1') then null when k = '2' then 'tampered' else 'unsupported_label' end as skip_reason from m"""
)
def p01_label_normalized(t, spark):
    label, reason = N.mapped_label(c("original_label"), {"real": "real", "fake": "fake", "0": "real", "1": "fake"}, {"2": "tampered"})
    return t("collection_manifest").select("record_id", label.alias("label"), reason.alias("skip_reason")).distinct()


@query(
    f"""select distinct record_id, nullif(trim(case when regexp_matches(sample_id, '{N.SECRET}') then '{N.REDACTED_SECRET}' when regexp_matches(sample_id, '{N.LOCAL_PATH}') then '{N.REDACTED_PATH}'
 else substr(sample_id, 1, {N.LONGEST_ID}) end, ' \t\r\n\f\v'), '') as sample_id from collection_manifest"""
)
def p10_sample_id(t, spark):
    return t("collection_manifest").select("record_id", N.sample_id(c("sample_id")).alias("sample_id")).distinct()


@query(
    """select image_format, case upper(image_format) when 'JPEG' then 'jpg' when 'JPEG2000' then 'jp2' when 'PNG' then 'png' when 'WEBP' then 'webp' when 'GIF' then 'gif'
when 'BMP' then 'bmp' when 'TIFF' then 'tiff' else nullif(regexp_replace(lower(image_format), '[^a-z0-9]', '', 'g'), '') end as ext, count(*) as rows
from collection_manifest group by 1, 2"""
)
def p11_extension(t, spark):
    return t("collection_manifest").groupBy("image_format", N.extension(c("image_format")).alias("ext")).agg(F.count("*").alias("rows"))


@query(
    r"""with p as (select case entry_id % 9 when 0 then '../' || original_filename when 1 then '/' || original_filename when 2 then 'c:' || original_filename
  when 3 then 'a//' || original_filename when 4 then 'x/a:' || original_filename when 5 then original_filename || '/' when 6 then 'a\' || original_filename when 7 then './' || original_filename
  else 'a/' || original_filename end as path from batch_images)
select not (path = '' or path like '/%' or contains(path, '\') or contains(path, ':') or len(list_filter(string_split(regexp_replace(path, '/+$', ''), '/'), lambda x: x in ('', '.', '..'))) > 0) as safe,
 lower(nullif(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1), '')) as ext, count(*) as rows from p where path is not null group by 1, 2""".replace("\\\\", "\\")
)
def p15_unsafe_paths(t, spark):
    name, e = c("original_filename"), c("entry_id") % 9
    before = F.element_at(F.array(*[F.lit(x) for x in ("../", "/", "c:", "a//", "x/a:", "", "a\\", "./", "a/")]), (e + 1).cast("int"))
    rows = t("batch_images").select(F.concat(before, name, F.when(e == 5, "/").otherwise("")).alias("path")).filter("path is not null")
    return rows.groupBy(N.safe_path(c("path")).alias("safe"), N.path_parts(c("path"))[2].alias("ext")).agg(F.count("*").alias("rows"))


@query("select content_hash, sha256(image_bytes) as digest, octet_length(image_bytes) as size from images")
def p17_sha256(t, spark):
    return t("images").select("content_hash", F.sha2("image_bytes", 256).alias("digest"), F.length("image_bytes").cast("long").alias("size"))


@query("select json_extract_string(provenance_json, '$.src') as src, lower(json_extract_string(provenance_json, '$.split')) as split, count(*) as rows from batch_images group by 1, 2")
def p20_json_props(t, spark):
    p = c("provenance_json")
    return t("batch_images").groupBy(F.get_json_object(p, "$.src").alias("src"), F.lower(F.get_json_object(p, "$.split")).alias("split")).agg(F.count("*").alias("rows"))


def probs() -> list:
    return [c("prob_low"), c("prob_medium"), c("prob_high")]


@query(
    """select model_version, case when prob_low >= prob_medium and prob_low >= prob_high then 'low' when prob_medium >= prob_high then 'medium' else 'high' end as predicted,
count(*) as rows from predictions where prob_low is not null and prob_medium is not null and prob_high is not null group by 1, 2"""
)
def p22_argmax_class(t, spark):
    rows = t("predictions").select("model_version", R.argmax_first(R.LEVELS, probs()).alias("predicted")).filter("predicted is not null")
    return rows.groupBy("model_version", "predicted").agg(F.count("*").alias("rows"))


@query(
    """select source_dataset, count(*) as rows, count_if(coalesce(abs(prob_low + prob_medium + prob_high - 1) <= 1e-5 and abs(confidence - greatest(prob_low, prob_medium, prob_high)) <= 1e-5, false)) as consistent
from predictions where not isnan(coalesce(confidence, 0)) group by 1"""
)
def p23_probability_checks(t, spark):
    rows = t("predictions").filter(~F.isnan(F.coalesce("confidence", F.lit(0.0))))
    ok = F.coalesce(R.probabilities_consistent(probs(), c("confidence")), F.lit(False))
    return rows.groupBy("source_dataset").agg(F.count("*").alias("rows"), F.count_if(ok).alias("consistent"))


@query(
    """select case when confidence is null or isnan(confidence) then null when confidence < 0.5 then '<0.50' when confidence < 0.7 then '0.50-0.70' when confidence < 0.9 then '0.70-0.90' else '>=0.90' end as band,
count(*) as rows from predictions group by 1"""
)
def p24_confidence_band(t, spark):
    return t("predictions").groupBy(R.confidence_band(c("confidence")).alias("band")).agg(F.count("*").alias("rows"))


_USABLE = "confidence is not null and not isnan(confidence) and prob_low is not null and prob_medium is not null and prob_high is not null"


def _priorities(t):
    """Every usable prediction with its priority ``s``."""
    rows = t("predictions").filter("confidence is not null and not isnan(confidence) and prob_low is not null and prob_medium is not null and prob_high is not null")
    rows = rows.withColumn("d", F.lower(F.trim("source_dataset")))
    f1 = rows.filter("source_dataset is not null").groupBy("d").agg(F.round(F.avg("prob_high"), 3).alias("f1"))
    rows = J.with_default(rows, f1, "d", "f1", 1.0)
    return rows.withColumn("s", R.priority(cleaned("model_prediction"), probs(), c("confidence"), c("f1")))


@query(
    f"""with l as (select lower(trim(source_dataset)) as d, round(avg(prob_high), 3) as f1 from predictions where {_USABLE} and source_dataset is not null group by 1),
x as (select distinct content_hash, model_version, predicted_at, source_dataset, case when lower(trim(model_prediction, ' \t\r\n')) = 'high' then 2.0 else 0.0 end + (1 - confidence) + (1 - (list_sort([prob_low, prob_medium, prob_high])[3] - list_sort([prob_low, prob_medium, prob_high])[2]))
  + 0.25 * (1 - coalesce(f1, 1.0)) as s from predictions left join l on l.d = lower(trim(source_dataset)) where {_USABLE})
select content_hash, model_version, predicted_at, round(s, 6) as priority from x order by s desc, content_hash, model_version limit 50"""
)
def p25_priority_score(t, spark):
    """T02 of P25: the report of the 50 rows of highest priority; ``p25_priority_all`` has every row."""
    got = _priorities(t).select("content_hash", "model_version", "predicted_at", "source_dataset", "s").distinct()
    return got.orderBy(c("s").desc(), "content_hash", "model_version").limit(50).select("content_hash", "model_version", "predicted_at", F.round("s", 6).alias("priority"))


@query(
    f"""with l as (select lower(trim(source_dataset)) as d, round(avg(prob_high), 3) as f1 from predictions where {_USABLE} and source_dataset is not null group by 1)
select content_hash, model_version, predicted_at, source_dataset, round(case when lower(trim(model_prediction, ' \t\r\n')) = 'high' then 2.0 else 0.0 end + (1 - confidence) + (1 - (list_sort([prob_low, prob_medium, prob_high])[3] - list_sort([prob_low, prob_medium, prob_high])[2]))
  + 0.25 * (1 - coalesce(f1, 1.0)), 6) as priority from predictions left join l on l.d = lower(trim(source_dataset)) where {_USABLE}"""
)
def p25_priority_all(t, spark):
    """P25: the priority of every usable row, repeated rows included."""
    return _priorities(t).select("content_hash", "model_version", "predicted_at", "source_dataset", F.round("s", 6).alias("priority"))


@query(
    """with x as (select prob_medium + prob_high as p1, prob_high as p2 from predictions)
select case when p1 < 0.5 then 'low' when least(p1, p2) < 0.44 then 'medium' else 'high' end as decoded, count(*) as rows from x where p1 is not null and p2 is not null group by 1"""
)
def p26_ordinal_decode(t, spark):
    rows = t("predictions").select(R.ordinal_decode(c("prob_medium") + c("prob_high"), c("prob_high"), 0.50, 0.44).alias("decoded"))
    return rows.filter("decoded is not null").groupBy("decoded").agg(F.count("*").alias("rows"))


def _policy_rows(t):
    """One row per usable prediction: the class probabilities, a probability of fake and the true label."""
    rows = t("predictions").filter("confidence between 0 and 1 and not isnan(confidence)").withColumn("label", cleaned("source_label"))
    rows = rows.filter("label in ('real', 'fake') and prob_low is not null and prob_medium is not null and prob_high is not null")
    return rows.select(
        "content_hash", "model_version", c("prob_low").alias("p_low"), c("prob_medium").alias("p_medium"), c("prob_high").alias("p_high"),
        F.when(c("label") == "fake", c("confidence")).otherwise(1 - c("confidence")).alias("p_fake"), (c("label") == "fake").alias("fake"),
        cleaned("model_prediction").alias("level"),
    ).distinct()


_POLICY = f"""with pr as (select distinct content_hash, model_version, prob_low as p_low, prob_medium as p_medium, prob_high as p_high,
  case when {CLEAN("source_label")} = 'fake' then confidence else 1 - confidence end as p_fake, {CLEAN("source_label")} = 'fake' as fake, {CLEAN("model_prediction")} as level
  from predictions where confidence between 0 and 1 and not isnan(confidence) and {CLEAN("source_label")} in ('real', 'fake')
   and prob_low is not null and prob_medium is not null and prob_high is not null)
"""


@query(
    _POLICY
    + """select fake, p_fake >= 0.5 - 0.05 * (0.3 * p_low + 0.5 * p_medium + 0.93 * p_high) as said_fake, count(*) as rows from pr group by 1, 2"""
)
def p27_fusion_decision(t, spark):
    said = R.fused_fake(c("p_fake"), R.prudence((0.3, 0.5, 0.93)), 0.05)
    return _policy_rows(t).groupBy("fake", said.alias("said_fake")).agg(F.count("*").alias("rows"))


@query(
    f"""with h as (select {KEY} as k, arg_max({CLEAN("sensitivity_level")}, (recorded_at, annotation_id)) as lv from annotations where {CLEAN("sensitivity_level")} in ('low', 'medium', 'high') group by 1),
p as (select {KEY} as k, arg_max({CLEAN("model_prediction")}, (predicted_at, {CLEAN("model_prediction")})) as lv from predictions where {CLEAN("model_prediction")} in ('low', 'medium', 'high') group by 1)
select coalesce(h.lv, p.lv) as final_label, case when h.lv is not null then 'human' else 'automatic' end as origin, count(*) as images
from (select * from h where k is not null) h full join (select * from p where k is not null) p on h.k = p.k group by 1, 2"""
)
def p28_final_label(t, spark):
    known = lambda x: x.filter(c("lv").isin(R.LEVELS))
    h = known(t("annotations").select(cleaned_hash("content_hash").alias("k"), cleaned("sensitivity_level").alias("lv"), "recorded_at", "annotation_id"))
    p = known(t("predictions").select(cleaned_hash("content_hash").alias("k"), cleaned("model_prediction").alias("lv"), "predicted_at"))
    h = V.latest(h, "k", ["recorded_at", "annotation_id"], ["lv"]).select("k", c("lv").alias("hl"))
    p = V.latest(p, "k", ["predicted_at", "lv"], ["lv"]).select("k", c("lv").alias("pl"))
    got = h.join(p, "k", "full_outer")
    origin = F.when(c("hl").isNotNull(), "human").otherwise("automatic")
    return got.groupBy(F.coalesce("hl", "pl").alias("final_label"), origin.alias("origin")).agg(F.count("*").alias("images"))


@query(
    """select count(*) as rows, count_if(coalesce(regexp_matches(annotated_at, '^\\d{4}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d:\\d\\d(\\.\\d{1,9})?(Z|[+-]\\d\\d:\\d\\d)$'), false)) as with_offset,
max(case when regexp_matches(annotated_at, '(Z|[+-]\\d\\d:\\d\\d)$') then epoch_us(try_cast(annotated_at as timestamptz)) end) as last_us from annotations"""
)
def p32_timestamps(t, spark):
    at = instant(c("annotated_at"))
    return t("annotations").agg(F.count("*").alias("rows"), F.count(at).alias("with_offset"), F.max(F.unix_micros(at)).alias("last_us"))


@query("select batch_id, count(*) as rows, cast(round_even(count(*) * 0.2, 0) as bigint) as sample from batch_images group by 1")
def p35_half_even(t, spark):
    rows = t("batch_images").groupBy("batch_id").agg(F.count("*").alias("rows"))
    return rows.withColumn("sample", R.half_even(c("rows") * F.lit(0.2)))


@query("select cast(date_trunc('day', added_at at time zone 'UTC') as varchar)[:10] as day, count(*) as rows from batch_images group by 1")
def p36_day_truncated(t, spark):
    return t("batch_images").groupBy(F.date_format(F.date_trunc("day", "added_at"), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("rows"))


@query()
def p18_canonical_json(t, spark):
    return t("batch_images").select("entry_id", K.canonical_json_text("provenance_json").alias("canonical"))


@query("select props, try_cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as rows from events group by 1, 2")
def p21_strict_json(t, spark):
    v = F.try_parse_json("props")
    return t("events").groupBy("props", F.try_variant_get(v, "$.k", "long").alias("k")).agg(F.count("*").alias("rows"))


# ---- joins ---------------------------------------------------------------------------------------------------


_JOINED = f"""with im as (select distinct content_hash, {CLEAN("source_dataset")} as component, loaded_at, sha256(image_bytes) as digest from images where deleted_at is null),
i as (select content_hash as k, count(*) as images, min(component) as ic, bool_and(digest = content_hash) as readable from im group by 1),
s as (select {KEY} as k, min({CLEAN("source_dataset")}) as component from assignments group by 1),
a0 as (select distinct annotation_id, {KEY} as k, {_BROKEN} as validation_error, sensitivity_score from annotations),
a as (select a0.*, component from a0 left join s on s.k = a0.k and a0.k is not null),
g as (select k, count(*) as entries, bool_or(validation_error is not null) as invalid, min(component) as ac, min(sensitivity_score) as score from a where k is not null group by 1),
st as (select g.k, coalesce(images, 0) as images, score, case when images is null then 'unmatched' when images > 1 then 'ambiguous_image' when not readable then 'image_integrity_problem'
 when invalid then 'invalid_annotation' when entries > 1 then 'conflicting_annotations' when coalesce(ac <> ic, false) then 'annotation_metadata_conflict' else 'linked' end as status from g left join i on g.k = i.k)
"""


def _joined(t):
    """Annotations held against the images that are there; what an assignment says of the source stands for the component."""
    im = t("images").filter("deleted_at is null").select("content_hash", cleaned("source_dataset").alias("component"), "loaded_at", F.sha2("image_bytes", 256).alias("digest")).distinct()
    none = F.lit(None).cast("string")
    im = im.select(
        F.concat_ws(":", "content_hash", c("loaded_at").cast("string")).alias("image_id"), "content_hash", F.when(c("digest") == c("content_hash"), "readable").otherwise("hash_mismatch").alias("file_status"),
        "component", F.concat(F.lit("images/"), "content_hash").alias("image_path"), none.alias("normalized_label"), none.alias("label_status"),
    )
    said = t("assignments").groupBy(cleaned_hash("content_hash").alias("k")).agg(F.min(cleaned("source_dataset")).alias("component"))
    ann = t("annotations").select(
        c("annotation_id").alias("record_id"), cleaned_hash("content_hash").alias("k"), R.validation_error(cleaned("sensitivity_level")).alias("validation_error"), "sensitivity_score",
    ).join(said, "k", "left").withColumnRenamed("k", "content_hash").withColumn("relative_image_path", none).withColumn("normalized_label", none)
    return J.audited_join(im, ann, ["sensitivity_score"])


@query(
    _JOINED
    + "select a.annotation_id as record_id, a.k as content_hash, coalesce(status, 'unmatched') as status, coalesce(images, 0) as images, validation_error from a left join st on st.k = a.k"
)
def j01_audited_join(t, spark):
    return _joined(t)[0]


@query(
    _JOINED
    + """select im.content_hash, coalesce(status, 'unannotated') as annotation_join_status, case when status = 'linked' then score end as sensitivity_score, count(*) as images
from im left join st on st.k = im.content_hash group by all"""
)
def j01_image_status(t, spark):
    return _joined(t)[1].groupBy("content_hash", "annotation_join_status", "sensitivity_score").agg(F.count("*").alias("images"))


@query(
    _JOINED
    + """, v as (select im.component, case when digest = im.content_hash then 'readable' else 'hash_mismatch' end as file_status, coalesce(status, 'unannotated') as annotation_join_status from im left join st on st.k = im.content_hash),
x as (select 'component' as statistic, coalesce(component, 'null') as value from v union all select 'component x file_status', coalesce(component, 'null') || ' x ' || file_status from v
 union all select 'component x annotation_join_status', coalesce(component, 'null') || ' x ' || annotation_join_status from v)
select statistic, value, count(*) as n from x group by 1, 2"""
)
def v09_audit_counts(t, spark):
    return A.distributions(_joined(t)[1], ["component"], [("component", "file_status"), ("component", "annotation_join_status")])


@query(
    """with r as (select distinct relative_image_path, sample_id, record_id from collection_manifest),
x as (select 'path' as kind, relative_image_path as alias, record_id from r union all select 'sample', sample_id, record_id from r)
select kind, alias, case when count(distinct record_id) = 1 then min(record_id) end as record_id, count(distinct record_id) as targets from x where alias is not null group by 1, 2"""
)
def j02_alias_lookup(t, spark):
    return J.alias_index(t("collection_manifest"), "record_id", {"path": c("relative_image_path"), "sample": c("sample_id")})


@query(
    f"""select count(*) as kept from (select distinct record_id, {KEY} as k from collection_manifest) m
where not exists (select 1 from exclusion_manifests e where {key_sql("e.content_hash")} = m.k)"""
)
def j03_exclusion_anti(t, spark):
    excluded = t("exclusion_manifests").select(cleaned_hash("content_hash").alias("k")).filter("k is not null").distinct()
    rows = t("collection_manifest").select("record_id", cleaned_hash("content_hash").alias("k")).distinct()
    return rows.join(excluded, "k", "left_anti").agg(F.count("*").alias("kept"))


@query(
    """with i as (select distinct content_hash from images)
select exists (select 1 from annotations a where a.content_hash = i.content_hash) as annotated, exists (select 1 from reviews r where r.content_hash = i.content_hash) as reviewed,
exists (select 1 from predictions p where p.content_hash = i.content_hash) as predicted, count(*) as images from i group by 1, 2, 3"""
)
def j05_exists_flags(t, spark):
    others = {"annotated": t("annotations"), "reviewed": t("reviews"), "predicted": t("predictions")}
    rows = J.flagged(t("images").select("content_hash").distinct(), others, "content_hash")
    return rows.groupBy(*others).agg(F.count("*").alias("images"))


@query(
    """select b.batch_id, count(*) as entries, count(distinct i.source_dataset) as datasets from (select distinct * from batch_images) b join (select distinct content_hash, source_dataset from images) i using (content_hash) group by 1"""
)
def j06_using_join(t, spark):
    images = t("images").select("content_hash", "source_dataset").distinct()
    rows = t("batch_images").select("entry_id", "batch_id", "content_hash").distinct().join(images, "content_hash")
    return rows.groupBy("batch_id").agg(F.count("*").alias("entries"), F.count_distinct("source_dataset").alias("datasets"))


@query(
    f"""with f as (select c_nationkey % 3 as g, 0.5 as f1 from customer where c_nationkey % 3 < 2 group by 1)
select o_orderpriority, round(sum(o_totalprice * coalesce(f.f1, 1.0)), 2) as weighted from orders left join f on f.g = o_custkey % 3 group by 1"""
)
def j10_default_lookup(t, spark):
    f = t("customer").select((c("c_nationkey") % 3).cast("long").alias("g")).filter("g < 2").distinct().withColumn("f1", F.lit(0.5))
    rows = J.with_default(t("orders").withColumn("g", c("o_custkey") % 3), f, "g", "f1", 1.0)
    return rows.groupBy("o_orderpriority").agg(F.round(F.sum(c("o_totalprice") * c("f1")), 2).alias("weighted"))


@query(
    f"""with e as (select {KEY} as k, string_agg(distinct {CLEAN("original_label")}, ',' order by {CLEAN("original_label")}) as evidence from collection_manifest where original_label is not null group by 1)
select i.content_hash, coalesce(e.evidence, '') as evidence from (select distinct content_hash from images) i left join e on e.k = i.content_hash"""
)
def j11_evidence_collect(t, spark):
    e = t("collection_manifest").filter("original_label is not null").groupBy(cleaned_hash("content_hash").alias("content_hash")).agg(
        F.array_join(F.array_sort(F.collect_set(cleaned("original_label"))), ",").alias("evidence")
    )
    return J.with_default(t("images").select("content_hash").distinct(), e, "content_hash", "evidence", "")


@query(
    f"""with o as (select distinct annotation_id, {KEY} as k, sensitivity_level from annotations),
r as (select {KEY} as k, arg_max(lower(trim(action)), (reviewed_at, review_id)) as act from reviews group by 1)
select coalesce(r.act, 'none') as last_action, count(*) as annotations from o left join r on r.k = o.k and o.k is not null group by 1"""
)
def j12_latest_state(t, spark):
    last = V.latest(
        t("reviews").select(cleaned_hash("content_hash").alias("k"), cleaned("action").alias("act"), "reviewed_at", "review_id"), "k", ["reviewed_at", "review_id"], ["act"]
    )
    rows = t("annotations").select("annotation_id", cleaned_hash("content_hash").alias("k")).distinct().join(last.select("k", "act"), "k", "left")
    return rows.groupBy(F.coalesce("act", F.lit("none")).alias("last_action")).agg(F.count("*").alias("annotations"))


_EXPORTS = """with a as (select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey % 11 <> 0),
b as (select o_orderkey, case when o_orderkey % 13 = 0 then o_custkey + 1 else o_custkey end as o_custkey, o_orderstatus from orders where o_orderkey % 7 <> 0),
d as (select case when a.o_orderkey is null then 'added' when b.o_orderkey is null then 'removed'
 when a.o_custkey is not distinct from b.o_custkey and a.o_orderstatus is not distinct from b.o_orderstatus then 'same' else 'changed' end as change from a full join b on a.o_orderkey = b.o_orderkey)
"""


def _exports(t):
    """Two exports of one table: each lacks some rows, and the second has some changed."""
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = F.when(c("o_orderkey") % 13 == 0, c("o_custkey") + 1).otherwise(c("o_custkey"))
    return o.filter("o_orderkey % 11 <> 0"), o.filter("o_orderkey % 7 <> 0").withColumn("o_custkey", new)


@query(_EXPORTS + "select change, count(*) as rows from d group by 1")
def j13_export_diff(t, spark):
    return J.keyed_difference(*_exports(t), ["o_orderkey"]).groupBy("change").agg(F.count("*").alias("rows"))


@query(_EXPORTS + "select count_if(change in ('removed', 'changed')) as broken, count_if(change in ('removed', 'changed')) = 0 as contained from d")
def j14_base_subset(t, spark):
    bad = F.count_if(c("change").isin("removed", "changed"))
    return J.keyed_difference(*_exports(t), ["o_orderkey"]).agg(bad.alias("broken"), (bad == 0).alias("contained"))


@query("select count(*) as orphans from orders where o_custkey is not null and o_custkey not in (select c_custkey from customer where c_custkey % 5 <> 0)")
def j15_fk_orphans(t, spark):
    return J.missing_parents(t("orders"), t("customer").filter("c_custkey % 5 <> 0"), "o_custkey", "c_custkey").agg(F.count("*").alias("orphans"))


# ---- aggregations ----------------------------------------------------------------------------------------------


@query(
    f"""select {CLEAN("source_dataset")} as source, count_if({CLEAN("original_label")} = 'real') as n_real, count_if({CLEAN("original_label")} = 'fake') as n_fake,
count(*) - count_if({CLEAN("original_label")} in ('real', 'fake')) as n_other from collection_manifest group by 1"""
)
def a02_source_label_pivot(t, spark):
    rows = t("collection_manifest").select(cleaned("source_dataset").alias("source"), cleaned("original_label").alias("label"))
    return A.pivot_counts(rows, "source", "label", ["real", "fake"])


@query(f"select count(*) as rows, count(distinct batch_id) as batches, count(distinct {KEY}) as hashes from batch_images")
def a03_distincts(t, spark):
    return t("batch_images").agg(F.count("*").alias("rows"), F.count_distinct("batch_id").alias("batches"), F.count_distinct(cleaned_hash("content_hash")).alias("hashes"))


@query(
    f"""with b as (select distinct batch_id, {KEY} as k from batch_images where {KEY} is not null), an as (select distinct {KEY} as k from annotations), re as (select distinct {KEY} as k from reviews),
f as (select b.*, an.k is not null as annotated, re.k is not null as reviewed from b left join an on an.k = b.k left join re on re.k = b.k)
select batch_id, count(*) as items, count_if(annotated) as annotated, count_if(reviewed) as reviewed, false as is_total from f group by 1
union all select null, count(*), count_if(annotated), count_if(reviewed), true from (select distinct k, annotated, reviewed from f)"""
)
def a05_progress(t, spark):
    keyed = lambda n: t(n).select(cleaned_hash("content_hash").alias("k"))
    rows = t("batch_images").select("batch_id", cleaned_hash("content_hash").alias("k")).filter("k is not null").distinct()
    rows = J.flagged(rows, {"annotated": keyed("annotations"), "reviewed": keyed("reviews")}, "k")
    return A.progress(rows, "batch_id", "k", ["annotated", "reviewed"])


@query(
    f"""with r as (select distinct {KEY} as k, entry_id from batch_images)
select k as content_hash, count(*) as members, min(entry_id) as first_member, max(entry_id) as last_member from r where k is not null group by 1 having count(*) > 1"""
)
def a06_dup_groups(t, spark):
    rows = t("batch_images").select(cleaned_hash("content_hash").alias("content_hash"), "entry_id")
    return A.duplicate_groups(rows, "content_hash", "entry_id")


@query(
    f"""with r as (select distinct {KEY} as k, entry_id from batch_images)
select k as content_hash, count(*) over (partition by k) as members, entry_id as member from r where k is not null qualify members > 1"""
)
def a06_dup_members(t, spark):
    rows = t("batch_images").select(cleaned_hash("content_hash").alias("content_hash"), "entry_id")
    return A.duplicate_members(rows, "content_hash", "entry_id")


@query(
    f"""with e as (select {KEY} as k, case when {CLEAN("original_label")} in ('real', '0') then 'real' when {CLEAN("original_label")} in ('fake', '1') then 'fake' end as l from (select distinct record_id, content_hash, original_label from collection_manifest))
select k as content_hash, case when count(distinct l) = 1 then min(l) else 'unknown' end as label, count(distinct l) as labels, count(l) as evidence,
case when count(distinct l) = 1 then 'verified' when count(distinct l) > 1 then 'conflict' else 'no_evidence' end as status from e where k is not null group by 1"""
)
def a08_resolve_evidence(t, spark):
    label, _ = N.mapped_label(c("original_label"), {"real": "real", "fake": "fake", "0": "real", "1": "fake"})
    rows = t("collection_manifest").select("record_id", "content_hash", "original_label").distinct()
    return A.resolved_label(rows.select(cleaned_hash("content_hash").alias("content_hash"), label.alias("l")), "content_hash", "l", ["real", "fake"])


@query(
    f"""with e as (select {KEY} as k, count(distinct normalized_label) as n from collection_manifest group by 1) select n > 1 as conflict, count(*) as hashes from e where k is not null group by 1"""
)
def a07_label_conflicts(t, spark):
    rows = t("collection_manifest").select(cleaned_hash("content_hash").alias("k"), "normalized_label")
    return A.resolved_label(rows, "k", "normalized_label", ["real", "fake"]).groupBy((c("labels") > 1).alias("conflict")).agg(F.count("*").alias("hashes"))


_EVENTS = "with e as (select event_id, round(least(value / 100.0, 1.0), 1) as p, event_type in ('purchase', 'signup') as truth, user_id % 3 as stratum from events)\n"


def _events(t):
    """Predictions with many ties: p from the value, the truth from the type, a stratum from the user."""
    return t("events").select(
        "event_id", F.round(F.least(c("value") / 100.0, F.lit(1.0)), 1).alias("p"), c("event_type").isin("purchase", "signup").alias("truth"), (c("user_id") % 3).alias("stratum")
    )


_COUNTS = "count_if(p >= 0.5 and truth) as tp, count_if(p >= 0.5 and not truth) as fp, count_if(p < 0.5 and not truth) as tn, count_if(p < 0.5 and truth) as fn"


@query(_EVENTS + f"select {_COUNTS} from e")
def a09_confusion(t, spark):
    return _events(t).agg(*M.confusion(c("p"), c("truth")))


_METRICS = """round((tp + tn) / (tp + fp + tn + fn), 6) as accuracy, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) as balanced_accuracy,
round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1"""


@query(_EVENTS + f", k as (select {_COUNTS} from e) select *, {_METRICS} from k")
def a10_binary_metrics(t, spark):
    return M.binary_metrics(_events(t).agg(*M.confusion(c("p"), c("truth"))))


@query(
    _EVENTS
    + """, r as (select truth, row_number() over (order by p, event_id) as k from e)
select count_if(truth) as positives, count_if(not truth) as negatives, round((sum(k) filter (where truth) - count_if(truth) * (count_if(truth) + 1) / 2) / (count_if(truth) * count_if(not truth)), 6) as auc from r"""
)
def a11_rank_auc(t, spark):
    return M.rank_auc(_events(t), "p", "truth", "event_id")


@query(
    _EVENTS
    + """, h as (select p, count_if(truth) as pos, count_if(not truth) as neg from e group by 1), b as (select *, sum(neg) over (order by p) - neg as below from h)
select sum(pos) as positives, sum(neg) as negatives, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) as auc from b"""
)
def a11_rank_auc_ties(t, spark):
    return M.rank_auc(_events(t), "p", "truth", "event_id", ties="average")


@query(
    _EVENTS
    + f""", k as (select stratum, grouping(stratum) = 1 as is_total, {_COUNTS} from e group by grouping sets ((stratum), ())) select *, {_METRICS} from k"""
)
def a12_stratified(t, spark):
    return M.binary_metrics(M.stratified_confusion(_events(t), c("p"), c("truth"), "stratum"))


def _levels(t):
    """Human level (from the axes) and automatic level of images that have both, as class indices."""
    h = t("annotations").select(cleaned_hash("content_hash").alias("k"), R.level_index(R.level(R.score())).alias("h"), "recorded_at", "annotation_id").filter("h is not null")
    p = t("predictions").select(cleaned_hash("content_hash").alias("k"), R.level_index(cleaned("model_prediction")).alias("p"), cleaned("source_dataset").alias("d"), "predicted_at")
    h = V.latest(h, "k", ["recorded_at", "annotation_id"], ["h"]).select("k", "h")
    p = V.latest(p.filter("p is not null"), "k", ["predicted_at", "p", "d"], ["p", "d"]).select("k", "p", "d")
    return h.join(p, "k")


_LEVELS = f"""with h as (select {KEY} as k, arg_max(case when public_relevance + harm_urgency + vulnerability <= 1 then 0 when public_relevance + harm_urgency + vulnerability <= 3 then 1 else 2 end, (recorded_at, annotation_id)) as h
  from annotations where public_relevance between 0 and 2 and harm_urgency between 0 and 2 and vulnerability between 0 and 1 group by 1),
p0 as (select {KEY} as k, case {CLEAN("model_prediction")} when 'low' then 0 when 'medium' then 1 when 'high' then 2 end as p, {CLEAN("source_dataset")} as d, predicted_at from predictions),
p as (select k, m.p as p, m.d as d from (select k, max({{'a': predicted_at, 'p': p, 'd': d}}) as m from p0 where p is not null group by 1)),
l as (select h.k, h.h, p.p, p.d from h join p on h.k = p.k),
n as (select h as t, p, count(*) as n from l group by 1, 2)
"""


@query(
    _LEVELS
    + """, g as (select i as class, coalesce(sum(n) filter (where t = i and p = i), 0) as tp, coalesce(sum(n) filter (where t = i), 0) as support, coalesce(sum(n) filter (where p = i), 0) as pr from (select unnest([0, 1, 2]) as i) x, n group by 1)
select class, support, coalesce(round(tp / nullif(pr, 0), 6), 0) as precision, coalesce(round(tp / nullif(support, 0), 6), 0) as recall, coalesce(round(2 * tp / nullif(pr + support, 0), 6), 0) as f1 from g"""
)
def a13_multiclass(t, spark):
    return M.per_class(M.contingency(_levels(t), c("h"), c("p")), 3)


@query(
    _LEVELS
    + """, g as (select i as class, coalesce(sum(n) filter (where t = i and p = i), 0) as tp, coalesce(sum(n) filter (where t = i), 0) as s, coalesce(sum(n) filter (where p = i), 0) as pr from (select unnest([0, 1, 2]) as i) x, n group by 1),
f as (select s, coalesce(round(2 * tp / nullif(pr + s, 0), 6), 0) as f1 from g)
select round(avg(f1), 6) as macro_f1, round(sum(f1 * s) / sum(s), 6) as weighted_f1 from f"""
)
def a13_macro_f1(t, spark):
    return M.averaged_f1(M.per_class(M.contingency(_levels(t), c("h"), c("p")), 3))


@query(
    _LEVELS
    + """, a as (select t as i, sum(n) as a from n group by 1), b as (select p as j, sum(n) as b from n group by 1), e as (select sum(abs(i - j) * a * b) as e1, sum((i - j) * (i - j) * a * b) as e2 from a, b),
o as (select sum(n) as total, sum(abs(t - p) * n) as o1, sum((t - p) * (t - p) * n) as o2 from n)
select total as n, round(1 - o1 * total / nullif(e1, 0), 6) as linear_kappa, round(1 - o2 * total / nullif(e2, 0), 6) as quadratic_kappa from o, e"""
)
def a14_kappa(t, spark):
    return M.weighted_kappa(M.contingency(_levels(t), c("h"), c("p")))


_ERRORS = "count(*) as n, round(avg(case when p = h then 1.0 else 0.0 end), 6) as exact, round(avg(abs(p - h)), 6) as mae, count_if(p < h) as too_low, count_if(p > h) as too_high, count_if(abs(p - h) > 1) as two_off"


@query(_LEVELS + f"select {_ERRORS} from l")
def a15_mae(t, spark):
    return M.ordinal_errors(_levels(t), c("h"), c("p"))


@query(_LEVELS + f"select d, {_ERRORS} from l group by 1")
def a16_ordinal_by_source(t, spark):
    return M.ordinal_errors(_levels(t), c("h"), c("p"), ["d"])


@query(
    """with e as (select public_relevance as a, harm_urgency as b, vulnerability as v from annotations), s as (select 'public_relevance' as axis, count_if(a = 2) as n from e union all select 'harm_urgency', count_if(b = 2) from e union all select 'vulnerability', count_if(v = 1) from e)
select axis, n from s where n = (select max(n) from s)"""
)
def a20_argmax_set(t, spark):
    from pyspark.sql import Window as W

    tops = F.array(*[F.struct(F.lit(a).alias("axis"), F.count_if(c(a) == top).alias("n")) for a, top in R.AXES.items()])
    rows = t("annotations").agg(tops.alias("x")).select(F.inline("x"))
    return rows.withColumn("m", F.max("n").over(W.partitionBy(F.lit(0)))).filter("n = m").select("axis", "n")


@query(
    """select level as sensitivity_level, place, coalesce(n, 0) as n from (values ('low', 0), ('medium', 1), ('high', 2), ('extreme', 3)) v(level, place)
left join (select sensitivity_level as l, count(*) as n from annotations group by 1) a on a.l = v.level"""
)
def a19_reindex(t, spark):
    return A.reindexed_counts(t("annotations"), "sensitivity_level", ["low", "medium", "high", "extreme"])


@query(
    _POLICY
    + """, d as (select fake, p_fake >= 0.5 as said, case level when 'low' then 1 when 'medium' then 2 when 'high' then 3 end as w from pr)
select count_if(fake) as fakes, round(count_if(fake and said) / nullif(count_if(fake), 0), 6) as recall, round(sum(w) filter (where fake and said) / nullif(sum(w) filter (where fake), 0), 6) as weighted_recall from d"""
)
def a21_weighted_recall(t, spark):
    return M.weighted_recall(_policy_rows(t), c("fake"), c("p_fake") >= 0.5, R.level_index(c("level")) + 1)


@query(
    """with x as (select 0.3 * prob_low + 0.5 * prob_medium + 0.93 * prob_high as rho from predictions where prob_low is not null and prob_medium is not null and prob_high is not null)
select round(avg(rho), 6) as mean_rho, round(stddev_samp(rho), 6) as std_rho, round(min(rho), 6) as min_rho, round(max(rho), 6) as max_rho, count_if(0.5 - rho < 0) as below_zero from x"""
)
def a23_rho_statistics(t, spark):
    rho = 0.3 * c("prob_low") + 0.5 * c("prob_medium") + 0.93 * c("prob_high")
    rows = t("predictions").select(rho.alias("rho")).filter("rho is not null")
    r6 = lambda x, n: F.round(x, 6).alias(n)
    return rows.agg(r6(F.avg("rho"), "mean_rho"), r6(F.stddev_samp("rho"), "std_rho"), r6(F.min("rho"), "min_rho"), r6(F.max("rho"), "max_rho"), F.count_if(0.5 - c("rho") < 0).alias("below_zero"))


@query(
    """select user_id, count(*) as n, round(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 3) as seconds, round(count(*) / nullif(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 0) * 3600, 4) as per_hour from events group by 1"""
)
def a24_throughput(t, spark):
    us = lambda x: F.unix_micros(x(c("ts").cast("timestamp"))) / 1e6
    span = us(F.max) - us(F.min)
    return t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(span, 3).alias("seconds"), F.round(F.try_divide(F.count("*"), F.nullif(span, F.lit(0.0))) * 3600, 4).alias("per_hour"))


@query(
    """select batch_no, count(record_id) as items, sha256(string_agg(cast(record_id as varchar), chr(10) order by cast(record_id as varchar))) as digest from (select distinct batch_no, record_id from collection_manifest) group by 1"""
)
def a26_digest(t, spark):
    rows = t("collection_manifest").select("batch_no", c("record_id").cast("string").alias("record_id")).distinct()
    return A.ordered_digest(rows, ["batch_no"], "record_id")


@query(
    """with h as (select cast('0x' || substr(sha256(cast(entry_id as varchar) || '|' || coalesce(content_hash, '~')), 1, 12) as bigint) as h from batch_images)
select count(*) as rows, cast(sum(h) as varchar) as hash_sum, bit_xor(h) as hash_xor from h"""
)
def a26_bag_digest(t, spark):
    return A.set_digest(t("batch_images"), F.concat_ws("|", c("entry_id").cast("string"), F.coalesce("content_hash", F.lit("~"))))


def _stat(name: str, value: str) -> str:
    return f"select '{name}' as statistic, {value} as value from m"


def _txt(col: str) -> str:
    return f"coalesce(cast({col} as varchar), 'null')"


@query(
    "with m as (select * from collection_manifest), s as ("
    + " union all ".join(
        [_stat(x, _txt(x)) for x in ("source_dataset", "normalized_label", "image_format", "split", "width")]
        + [_stat(f"{x} x {y}", f"{_txt(x)} || ' x ' || {_txt(y)}") for x, y in (("source_dataset", "normalized_label"), ("split", "image_format"))]
    )
    + ") select statistic, value, count(*) as n from s group by 1, 2"
)
def a27_corpus_stats(t, spark):
    return A.distributions(
        t("collection_manifest"), ["source_dataset", "normalized_label", "image_format", "split", "width"], [("source_dataset", "normalized_label"), ("split", "image_format")]
    )


@query("select round(corr(sensitivity_score, public_relevance), 6) as pearson, count(*) as rows from annotations")
def a29_correlation(t, spark):
    return t("annotations").agg(F.round(F.corr("sensitivity_score", "public_relevance"), 6).alias("pearson"), F.count("*").alias("rows"))


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem group by rollup (l_returnflag, l_linestatus)")
def a30_rollup(t, spark):
    return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


# ---- windows, orders, samples ------------------------------------------------------------------------------------


def _rank_sql(purpose: str, key: str, seed: int = 42) -> str:
    return f"sha256('{seed}:{purpose}:' || cast({key} as varchar))"


@query(
    f"""with r as (select event_type, event_id, row_number() over (partition by event_type order by {_rank_sql("sample", "event_id")}, event_id) as rank_in_stratum from events)
select * from r where rank_in_stratum <= 5"""
)
def w01_hash_rank_topk(t, spark):
    return S.hash_rank_top_k(t("events").select("event_type", "event_id"), ["event_type"], "event_id", 5)


@query(f"select event_id, row_number() over (order by {_rank_sql('blind', 'event_id')}) as position from events")
def w02_blind_order(t, spark):
    return S.numbered(t("events").select("event_id"), [K.rank_key(42, "blind", "event_id")])


@query(
    f"""with r as (select event_type, event_id, row_number() over (partition by event_type order by {_rank_sql("bucket", "event_id")}, event_id) as rank_in_stratum from events)
select *, cast((rank_in_stratum - 1) // 25 as int) as bucket from r where rank_in_stratum <= 100"""
)
def w03_bucket_assign(t, spark):
    return S.bucketed(t("events").select("event_type", "event_id"), ["event_type"], "event_id", 4, 25)


@query(
    f"""with r as (select distinct {KEY} as content_hash, original_filename, entry_id from batch_images)
select content_hash, arg_min(original_filename, (original_filename, entry_id)) as original_filename, arg_min(entry_id, (original_filename, entry_id)) as entry_id, count(distinct entry_id) - 1 as others
from r where content_hash is not null group by 1"""
)
def w05_first_per_hash(t, spark):
    rows = t("batch_images").select(cleaned_hash("content_hash").alias("content_hash"), "original_filename", "entry_id")
    return S.first_of(rows, ["content_hash"], ["original_filename", "entry_id"], [], "others", "entry_id")


@query(
    f"""select event_id, n as position, ['ann', 'ben', 'cyd'][(n - 1) % 3 + 1] as assignee from (select event_id, row_number() over (order by event_type, {_rank_sql("deal", "event_id")}) as n from events)"""
)
def w06_round_robin(t, spark):
    return S.round_robin(t("events").select("event_id", "event_type"), ["event_type", K.rank_key(42, "deal", "event_id")], ["ann", "ben", "cyd"]).drop("event_type")


@query(
    f"""with r as (select distinct * from reviews where deleted_at is null)
select {KEY} as content_hash, arg_max(lower(action), (reviewed_at, review_id)) as action, max((reviewed_at, review_id))[2] as review_id from r where {KEY} is not null group by 1"""
)
def w08_latest_review(t, spark):
    rows = t("reviews").filter("deleted_at is null").select(cleaned_hash("content_hash").alias("content_hash"), F.lower("action").alias("action"), "reviewed_at", "review_id")
    return V.latest(rows, "content_hash", ["reviewed_at", "review_id"], ["action"]).select("content_hash", "action", "review_id")


@query(
    f"""with r as (select {KEY} as k, review_id, min(reviewed_at) as reviewed_at, min(lower(action)) as action, min(coalesce(reason, '')) as reason from reviews group by 1, 2),
w as (select *, lag(reviewed_at) over v as bt, lag(reason) over v as bp, row_number() over v as n from r where k is not null window v as (partition by k order by review_id))
select k as content_hash, count(*) as events, count_if(coalesce(reviewed_at < bt, false)) as time_breaks, count_if(n > 1 and action = 'confirm' and reason is distinct from bp) as payload_breaks from w group by 1"""
)
def w09_chain_check(t, spark):
    rows = t("reviews").groupBy(cleaned_hash("content_hash").alias("content_hash"), "review_id").agg(
        F.min("reviewed_at").alias("reviewed_at"), F.min(F.lower("action")).alias("action"), F.min(F.coalesce("reason", F.lit(""))).alias("reason")
    )
    return V.chain_breaks(rows, "content_hash", ["review_id"], "reviewed_at", "action", c("reason"))


@query(
    """select user_id, event_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as state_bought,
last_value(case when event_type = 'error' then value end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as state_failed from events"""
)
def w09_state_fold(t, spark):
    rows = t("events").select("user_id", "event_id", F.when(c("event_type") == "purchase", c("value")).alias("bought"), F.when(c("event_type") == "error", c("value")).alias("failed"))
    return V.folded(rows, "user_id", ["event_id"], ["bought", "failed"]).drop("bought", "failed")


@query(
    """select batch_no, coalesce(min(stream_position) filter (where not coalesce(kaggle_synchronized, false)), 0) as resume_at from collection_manifest group by 1"""
)
def w10_resume_position(t, spark):
    return I.first_open(t("collection_manifest"), ["batch_no"], "stream_position", "kaggle_synchronized")


@query(
    """select batch_no, count(stream_position) as rows, min(stream_position) as first, max(stream_position) as last, count(distinct stream_position) as places,
min(stream_position) = 1 and max(stream_position) = count(stream_position) and count(distinct stream_position) = count(stream_position) as contiguous from collection_manifest group by 1"""
)
def w11_contiguity(t, spark):
    return I.gaps(t("collection_manifest"), ["batch_no"], "stream_position")


@query(
    f"""with f as (select k, min({{'b': batch_no, 'p': stream_position, 'l': normalized_label}}) as m from (select *, {KEY} as k from collection_manifest where normalized_label in ('real', 'fake')) where k is not null group by 1),
r as (select k, m.b as batch_no, m.p as stream_position, m.l as normalized_label, row_number() over (partition by m.l order by m.b, m.p, k) as n from f)
select batch_no, stream_position, normalized_label from (select * from r where n <= case normalized_label when 'real' then 400 else 500 end order by batch_no, stream_position, k limit 800)"""
)
def w12_quota_prefix(t, spark):
    rows = t("collection_manifest").select(cleaned_hash("content_hash").alias("k"), "normalized_label", "batch_no", "stream_position")
    got = S.quota_prefix(rows, "k", "normalized_label", ["batch_no", "stream_position"], {"real": 400, "fake": 500}, 800)
    return got.select("batch_no", "stream_position", "normalized_label")


@query(
    """with s as (select batch_id as k, count(*) as n from batch_images group by 1), t as (select *, sum(n) over () as total, least(777, sum(n) over ()) as want from s),
b as (select *, cast(n * want // total as bigint) as base, n * want - (n * want // total) * total as rest from t),
r as (select *, row_number() over (order by rest desc, k) as i, want - sum(base) over () as left_over from b)
select k as batch_id, n, base + case when i <= left_over then 1 else 0 end as quota from r"""
)
def x01_largest_remainder(t, spark):
    counts = t("batch_images").groupBy("batch_id").agg(F.count("*").alias("n"))
    return S.largest_remainder(counts, "batch_id", "n", 777)


@query(
    f"""with u as (select k, min(record_id) as record_id, arg_min(source_dataset, record_id) as d from (select distinct record_id, source_dataset, {KEY} as k from collection_manifest) where k is not null
  and k not in (select {KEY} from exclusion_manifests where {KEY} is not null) group by 1),
r as (select *, row_number() over (partition by d order by {_rank_sql("balanced", "record_id")}, record_id) as rank_in_stratum from u)
select d, record_id, rank_in_stratum from r where rank_in_stratum <= 50"""
)
def x02_balanced_selection(t, spark):
    rows = t("collection_manifest").select(cleaned_hash("content_hash").alias("k"), "record_id", c("source_dataset").alias("d"))
    excluded = t("exclusion_manifests").select(cleaned_hash("content_hash").alias("k")).filter("k is not null").distinct()
    one = S.first_of(rows, ["k"], ["record_id", "d"], [], "others", "record_id").join(excluded, "k", "left_anti")
    return S.hash_rank_top_k(one.select("d", "record_id"), ["d"], "record_id", 50, 42, "balanced")


@query(
    f"""with e as (select event_id, event_type, value from events), s as (select event_type as k, count(*) as n from e group by 1), t as (select *, sum(n) over () as total from s),
b as (select *, cast(n * 120 // total as bigint) as base, n * 120 - (n * 120 // total) * total as rest from t),
q as (select k, base + case when row_number() over (order by rest desc, k) <= 120 - sum(base) over () then 1 else 0 end as quota from b),
r as (select event_id, event_type, row_number() over (partition by event_type order by {_rank_sql("quota", "event_id")}, event_id) as n from e),
rep as (select event_id from r join q on q.k = r.event_type where n <= quota),
tg as (select event_id from e where event_id not in (select event_id from rep) order by value desc, {_rank_sql("targeted", "event_id")} limit 80)
select event_id, 'representative' as component from rep union all select event_id, 'targeted' from tg"""
)
def x06_rep_targeted(t, spark):
    return S.representative_and_targeted(t("events").select("event_id", "event_type", "value"), "event_type", "event_id", "value", 200)


@query(
    f"""with r as (select event_type, event_id, row_number() over (partition by event_type order by {_rank_sql("split", "event_id", 7)}, event_id) as n from events)
select event_type, count_if(n <= 9) as development, count_if(n > 9) as holdout from r group by 1"""
)
def x07_split_complement(t, spark):
    rows = t("events").select("event_type", "event_id")
    dev = S.hash_rank_top_k(rows, ["event_type"], "event_id", 9, 7, "split")
    got = J.flagged(rows, {"dev": dev}, "event_id")
    return got.groupBy("event_type").agg(F.count_if("dev").alias("development"), F.count_if(~c("dev")).alias("holdout"))


@query()
def x03_twister_strata(t, spark):
    """Parity mode over all hashes of the manifest that are not of the development set: 50 of each source and label.

    A hash under several strata is in the first of them.
    """
    strata = ["openfake:real", "openfake:fake", "sid-set:real", "sid-set:fake"]
    rows = t("collection_manifest").select(cleaned_hash("content_hash").alias("content_hash"), F.concat_ws(":", cleaned("source_dataset"), cleaned("normalized_label")).alias("s"))
    first = rows.select("content_hash", F.array_position(F.array(*[F.lit(s) for s in strata]), c("s")).alias("i")).filter("content_hash is not null and i > 0").groupBy("content_hash").agg(F.min("i").cast("int").alias("i"))
    dev = t("assignments").filter(cleaned("role") == "gold_development").select(cleaned_hash("content_hash").alias("content_hash")).filter("content_hash is not null").distinct()
    pools = first.join(dev, "content_hash", "left_anti").withColumn("stratum", F.element_at(F.array(*[F.lit(s) for s in strata]), c("i")))
    return S.twister_strata(pools, "stratum", "content_hash", strata, 50, 42)


# ---- search --------------------------------------------------------------------------------------------------------


@query(
    _POLICY
    + """, g as (select i as step, i * 0.5 / 100 as epsilon from range(101) r(i)),
d as (select step, epsilon, fake, p_fake >= 0.5 - epsilon * (0.3 * p_low + 0.5 * p_medium + 0.93 * p_high) as said, p_fake >= 0.5 as base, case level when 'low' then 1 when 'medium' then 2 when 'high' then 3 end as w from pr, g)
select cast(step as int) as step, epsilon, round(avg(case when said = fake then 1.0 else 0.0 end), 6) as accuracy, round(count_if(fake and said) / nullif(count_if(fake), 0), 6) as recall,
round(coalesce(sum(w) filter (where fake and said), 0) / nullif(sum(w) filter (where fake), 0), 6) as weighted_recall, count_if(said = fake and said <> base) as corrections, count_if(said <> fake and said <> base) as regressions from d group by 1, 2"""
)
def x09_eps_grid(t, spark):
    return X.policies(_policy_rows(t), (0.3, 0.5, 0.93), X.epsilon_grid(spark), R.level_index(c("level")) + 1)


@query(
    _POLICY
    + """, g as (select l, m, e, l / 20::double as wl, m / 20::double as wm, e / 200::double as epsilon from range(0, 21) a(l), range(0, 21) b(m), range(0, 31) d(e) where l <= m),
d as (select l, m, e, wl, wm, epsilon, fake, p_fake >= 0.5 as base, p_fake >= 0.5 - epsilon * (wl * p_low + wm * p_medium + p_high) as said from pr, g),
s as (select l, m, e, wl, wm, epsilon, count(*) as n, count_if(fake and said) as tp, count_if(fake and not said) as fn, count_if(not fake and said) as fp, count_if(not fake and not said) as tn,
 count_if(said <> base and said <> fake) as regressions, count_if(base = fake) as right0, count_if(base and fake) as tp0 from d group by all),
f as (select *, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 12) as f1, round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 12) as f,
 100 * (right0 - tp - tn) <= 3 * n and tp >= tp0 as feasible from s)
select wl as w_low, wm as w_medium, epsilon, round((tp + tn) / n, 6) as accuracy, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(f, 6) as macro_f1, round(f1, 6) as fake_f1, regressions, feasible,
row_number() over (order by feasible desc, tp desc, f desc, regressions, f1 desc, e, (3 * l - 20) * (3 * l - 20) + (3 * m - 40) * (3 * m - 40), l + m, l, m) as place from f"""
)
def x10_joint_search(t, spark):
    return X.joint_search(_policy_rows(t), range(0, 21), range(0, 21), range(0, 31), 20, 200)


@query(
    _POLICY
    + """, b as (select round((0.5 - p_fake) / nullif(0.3 * p_low + 0.5 * p_medium + 0.93 * p_high, 0), 9) as lower from pr),
g as (select lower, count(*) as changed from b where lower >= 0 and lower < 0.5 group by 1)
select lower, changed, coalesce(lead(lower) over (order by lower), 0.5) as upper from g"""
)
def x11_breakpoints(t, spark):
    return X.breakpoints(_policy_rows(t), (0.3, 0.5, 0.93))


@query()
def x11_exact_breakpoints(t, spark):
    from fractions import Fraction

    rows = _policy_rows(t).withColumn("key", F.concat_ws(":", "content_hash", "model_version"))
    return X.exact_breakpoints(rows, (Fraction(1, 3), Fraction(2, 3), Fraction(1)), "key")


@query(
    _POLICY
    + """, k as (select *, content_hash || ':' || coalesce(model_version, '~') || ':' || cast(p_fake as varchar) as key0 from pr),
u as (select min(p_fake) as p_fake, min(p_low) as p_low, min(p_medium) as p_medium, min(p_high) as p_high, bool_and(fake) as fake, content_hash || ':' || coalesce(model_version, '~') as key from pr group by content_hash, model_version),
f as (select *, (row_number() over (order by fake, sha256('20:fold:' || key), key) - 1) % 5 as fold from u where key is not null),
g as (select i as i, i * 0.5 / 20 as epsilon from range(21) r(i)),
d as (select fold, i, epsilon, fake, p_fake >= 0.5 - epsilon * (0.3 * p_low + 0.5 * p_medium + 0.93 * p_high) as said from f, g),
p as (select fold, i, epsilon, count_if(said = fake) as ri, count_if(fake and said) as tp, count_if(fake) as fa, count(*) as n from d group by all),
e as (select i, sum(ri) as ari, sum(tp) as atp, sum(fa) as afa, sum(n) as an from p group by 1),
c as (select p.*, row_number() over (partition by fold order by (atp - tp) / nullif(afa - fa, 0) desc, (ari - ri) / nullif(an - n, 0) desc, epsilon) as r from p join e using (i))
select cast(fold as int) as fold, epsilon, n as rows, round(coalesce(ri / n, 0), 6) as accuracy, round(coalesce(tp / nullif(fa, 0), 0), 6) as recall from c where r = 1"""
)
def x13_fold_stability(t, spark):
    """One row per image and model version: the least of its values, as a repeated prediction is one."""
    rows = _policy_rows(t).groupBy("content_hash", "model_version").agg(*[F.min(x).alias(x) for x in ("p_fake", "p_low", "p_medium", "p_high", "fake")])
    rows = rows.withColumn("key", F.concat("content_hash", F.lit(":"), F.coalesce("model_version", F.lit("~")))).filter("key is not null")
    return X.fold_stability(rows, "key", (0.3, 0.5, 0.93), [i * 0.5 / 20 for i in range(21)])


@query(
    f"""with h as (select {KEY} as k, arg_max(case when public_relevance + harm_urgency + vulnerability <= 1 then 0 when public_relevance + harm_urgency + vulnerability <= 3 then 1 else 2 end, (recorded_at, annotation_id)) as h
  from annotations where public_relevance between 0 and 2 and harm_urgency between 0 and 2 and vulnerability between 0 and 1 group by 1),
p as (select k, m.p1 as p1, m.p2 as p2 from (select {KEY} as k, max({{'a': predicted_at, 'p1': prob_medium + prob_high, 'p2': prob_high}}) as m from predictions where prob_medium is not null and prob_high is not null group by 1)),
g as (select a as i, b as j, round(0.3 + a * 0.02, 2)::double as t1, round(0.3 + b * 0.02, 2)::double as t2 from range(21) x(a), range(21) y(b)),
d as (select i, j, t1, t2, h as t, case when p1 < t1 then 0 when least(p1, p2) < t2 then 1 else 2 end as p from h join p using (k), g),
m as (select i, j, t1, t2, c, count_if(t = c and p = c) as hit, count_if(t = c) + count_if(p = c) as either from d, (select unnest([0, 1, 2]) as c) group by all),
f as (select t1, t2, i, j, round((sum(coalesce(2 * hit / nullif(either, 0), 0) order by c)) / 3, 12) as f from m group by all)
select t1, t2, round(f, 6) as macro_f1, (abs(i - 10) + abs(j - 10)) / 50 as distance, row_number() over (order by f desc, abs(i - 10) + abs(j - 10), i, j) as place from f"""
)
def x14_threshold_search(t, spark):
    """The human level of an image against its latest prediction, as in A13."""
    h = t("annotations").select(cleaned_hash("content_hash").alias("k"), R.level_index(R.level(R.score())).alias("t"), "recorded_at", "annotation_id").filter("t is not null")
    p = t("predictions").select(cleaned_hash("content_hash").alias("k"), (c("prob_medium") + c("prob_high")).alias("p1"), c("prob_high").alias("p2"), "predicted_at")
    p = V.latest(p.filter("p1 is not null"), "k", ["predicted_at", "p1", "p2"], []).select("k", "p1", "p2")
    return X.threshold_search(V.latest(h, "k", ["recorded_at", "annotation_id"], ["t"]).select("k", "t").join(p, "k"))


@query(
    _POLICY
    + """, g as (select i as step, i * 0.5 / 100 as epsilon from range(101) r(i)),
d as (select step, epsilon, fake, p_fake >= 0.5 - epsilon * (0.3 * p_low + 0.5 * p_medium + 0.93 * p_high) as said from pr, g),
m as (select cast(step as int) as step, epsilon, round(avg(case when said = fake then 1.0 else 0.0 end), 6) as accuracy, round(count_if(fake and said) / nullif(count_if(fake), 0), 6) as recall from d group by 1, 2),
b as (select accuracy as a0, recall as r0 from m where step = 0)
select step, epsilon, accuracy, recall from m, b where accuracy >= a0 - 0.03 and recall >= r0 order by recall desc, accuracy desc, epsilon limit 1"""
)
def x15_veto_select(t, spark):
    """The policy of highest recall that keeps accuracy within 0.03 and recall at or above the base."""
    rows = X.policies(_policy_rows(t), (0.3, 0.5, 0.93), X.epsilon_grid(spark), F.lit(1)).select("step", "epsilon", "accuracy", "recall")
    base = rows.filter("step = 0").select(c("accuracy").alias("a0"), c("recall").alias("r0"))
    got = rows.join(F.broadcast(base), F.lit(True))  # one row
    ok = (c("accuracy") >= c("a0") - 0.03) & (c("recall") >= c("r0"))
    return X.best(got, ok, [c("recall").desc(), c("accuracy").desc(), c("epsilon")]).select("step", "epsilon", "accuracy", "recall")


# ---- order, sets -----------------------------------------------------------------------------------------------------


@query(
    """select annotation_id, row_number() over (order by sensitivity_score desc nulls last, annotated_at nulls first, annotation_id) as position from (select distinct annotation_id, sensitivity_score, annotated_at from annotations)"""
)
def t01_mixed_sort(t, spark):
    rows = t("annotations").select("annotation_id", "sensitivity_score", "annotated_at").distinct()
    return S.numbered(rows, [c("sensitivity_score").desc_nulls_last(), c("annotated_at").asc_nulls_first(), c("annotation_id")]).select("annotation_id", "position")


@query(
    """with r as (select distinct review_id from reviews) select i.batch_id, i.original_filename, i.entry_id from (select distinct b.*, exists (select 1 from annotations a where a.content_hash = b.content_hash) as drafted from batch_images b) i
order by drafted desc, content_hash nulls last, entry_id limit 1"""
)
def t03_flag_first(t, spark):
    rows = J.flagged(t("batch_images"), {"drafted": t("annotations").select("content_hash")}, "content_hash")
    return rows.orderBy(c("drafted").desc(), c("content_hash").asc_nulls_last(), "entry_id").limit(1).select("batch_id", "original_filename", "entry_id")


@query("select event_id, event_type, round(abs(value - 100), 6) as error, row_number() over (order by abs(value - 100) desc, event_id) as rank from events order by rank limit 15")
def t06_top_errors(t, spark):
    got = M.largest_errors(t("events").select("event_id", "event_type", "value"), F.abs(c("value") - 100), ["event_id"], 15)
    return got.select("event_id", "event_type", F.round("error", 6).alias("error"), "rank")


@query(
    f"""with a as (select distinct {KEY} as k, 0 as f, batch_id as b from batch_images), b as (select distinct {KEY} as k, 1 as f, source_dataset as b from collection_manifest),
m as (select k, min({{'f': f, 'b': b}}) as m from (select * from a union all select * from b) where k is not null group by 1)
select k, m.b as b, m.f as source_no from m"""
)
def u01_union_distinct(t, spark):
    k = cleaned_hash("content_hash").alias("k")
    return J.union_first([t("batch_images").select(k, c("batch_id").alias("b")).filter("k is not null"), t("collection_manifest").select(k, c("source_dataset").alias("b")).filter("k is not null")], "k")


@query(f"select count(*) as hashes from (select {KEY} as k from exclusion_manifests union select {KEY} from annotations) where k is not null")
def u02_union_exclusions(t, spark):
    k = cleaned_hash("content_hash").alias("k")
    return t("exclusion_manifests").select(k).union(t("annotations").select(k)).filter("k is not null").distinct().agg(F.count("*").alias("hashes"))


_SETS = f"""with a as (select distinct {KEY} as k from annotations), b as (select distinct {KEY} as k from reviews),
s as (select count_if(a.k is not null and b.k is not null) as common, count_if(b.k is null) as only_left, count_if(a.k is null) as only_right from (select * from a where k is not null) a full join (select * from b where k is not null) b on a.k = b.k)
select common, only_left, only_right, only_left = 0 and only_right = 0 as equal from s"""


@query(_SETS)
def u05_set_report(t, spark):
    side = lambda n: t(n).select(cleaned_hash("content_hash").alias("k")).filter("k is not null")
    return J.set_report(side("annotations"), side("reviews"))


@query(
    f"""select split_seed, count(*) as leaked from (select distinct split_seed, {KEY} as k from assignments where {CLEAN("role")} in ('gold_development', 'gold_test')
 intersect select distinct split_seed, {KEY} from assignments where {CLEAN("role")} = 'unassigned') where k is not null group by 1"""
)
def u03_leakage(t, spark):
    rows = t("assignments").select("split_seed", cleaned_hash("content_hash").alias("k"), cleaned("role").alias("role")).filter("k is not null")
    gold, rest = rows.filter(c("role").isin("gold_development", "gold_test")), rows.filter("role = 'unassigned'")
    return gold.select("split_seed", "k").intersect(rest.select("split_seed", "k")).groupBy("split_seed").agg(F.count("*").alias("leaked"))


@query(f"select count(*) as missing from (select {KEY} as k from batch_images where {KEY} is not null except select content_hash from images)")
def u04_except(t, spark):
    rows = t("batch_images").select(cleaned_hash("content_hash").alias("k")).filter("k is not null")
    return rows.subtract(t("images").select("content_hash")).agg(F.count("*").alias("missing"))


@query(
    """with b as (select l_orderkey as pos, sum(l_quantity) as q from lineitem group by 1), t as (select max(l_orderkey) as top from lineitem),
n as (select pos, case when pos % 501 = 7 then q + 1 else q end as q from b union all select pos + top, q from b, t)
select count(*) as base_rows, count_if(n.pos is null or b.q is distinct from n.q) as mismatches, count_if(n.pos is null or b.q is distinct from n.q) = 0 as is_prefix from b left join n on b.pos = n.pos"""
)
def u07_log_whole(t, spark):
    """The log of all orders against one with changed positions and as many appended behind its last."""
    rows = t("lineitem").select(c("l_orderkey").alias("pos"), c("l_quantity").alias("q"))
    base = rows.groupBy("pos").agg(F.sum("q").alias("q"))
    top = F.broadcast(rows.agg(F.max("pos").alias("top")))  # one row
    changed = base.withColumn("q", F.when(c("pos") % 501 == 7, c("q") + 1).otherwise(c("q")))
    longer = changed.unionByName(base.join(top, F.lit(True)).select((c("pos") + c("top")).alias("pos"), "q"))
    return J.log_prefix(base, longer, "pos", "q")


# ---- histories -----------------------------------------------------------------------------------------------------------


@query(
    f"""with n as (select distinct batch_no, record_id, {KEY} as k from collection_manifest), o as (select distinct {KEY} as k from batch_images)
select batch_no, count_if(o.k is null) as fresh, count_if(o.k is not null) as repeated from n left join o on n.k = o.k group by 1"""
)
def r15_import_batches(t, spark):
    rows = t("collection_manifest").select("batch_no", "record_id", cleaned_hash("content_hash").alias("k")).distinct()
    got = J.flagged(rows, {"old": t("batch_images").select(cleaned_hash("content_hash").alias("k"))}, "k")
    return got.groupBy("batch_no").agg(F.count_if(~c("old")).alias("fresh"), F.count_if("old").alias("repeated"))


@query(
    """with p as (select * from predictions), n as (select count(*) as n from p)
select 'confidence_in_range' as rule, n.n as rows, count_if(not coalesce(confidence between 0 and 1 and not isnan(confidence), false)) as broken from p, n group by 1, 2
union all select 'hash_is_digest', n.n, count_if(not coalesce(regexp_matches(content_hash, '^[0-9a-f]{64}$'), false)) from p, n group by 1, 2
union all select 'class_known', n.n, count_if(not coalesce(lower(trim(model_prediction)) in ('low', 'medium', 'high'), false)) from p, n group by 1, 2"""
)
def r16_validation(t, spark):
    return I.checks(
        t("predictions"),
        {
            "confidence_in_range": c("confidence").between(0, 1) & ~F.isnan("confidence"),
            "hash_is_digest": c("content_hash").rlike("^[0-9a-f]{64}$"),
            "class_known": cleaned("model_prediction").isin(R.LEVELS),
        },
    )


@query("""select content_hash, sensitivity_level, count(*) as n from annotations group by 1, 2 having count(*) > 1""")
def s11_repeated_keys(t, spark):
    return I.repeated_keys(t("annotations"), ["content_hash", "sensitivity_level"])


@query("select distinct assignment_id, case when needs_review is null then null when needs_review then 'true' else 'false' end as text from (select a.annotation_id as assignment_id, a.needs_review from annotations a)")
def z07_row_text(t, spark):
    return t("annotations").select(c("annotation_id").alias("assignment_id"), c("needs_review").cast("string").alias("text")).distinct()


# ---- streams --------------------------------------------------------------------------------------------------------------


def _r03(spark: SparkSession, sf: str) -> DataFrame:
    return collect.distinct_keys(stream_files(spark, f"{sf}/events.parquet"), ["user_id", "event_type"])


def _r04(spark: SparkSession, sf: str, stages: int = 5) -> DataFrame:
    """The manifest arrives in ``stages`` runs of batches; the stream is resumed after each from its checkpoint, and
    goes on from what the micro-batches before accepted."""
    rows = table(spark, sf, "collection_manifest").select(cleaned_hash("content_hash").alias("k"), "normalized_label", "batch_no", "stream_position")
    numbers = sorted(r[0] for r in rows.select("batch_no").distinct().collect() if r[0] is not None)  # the list of batches
    source, out, checkpoint = scratch(spark, "arrived"), scratch(spark, "collected"), scratch(spark, "checkpoint")
    size = max(1, -(-len(numbers) // stages))
    for i in range(0, max(1, len(numbers)), size):
        now = c("batch_no").isin(numbers[i : i + size])
        rows.filter(now if i else now | c("batch_no").isNull()).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        collect.collect_stream(
            stream, out, key="k", label="normalized_label", order=["batch_no", "stream_position"], quotas={"real": 400, "fake": 500}, target=800, checkpoint=checkpoint
        )
    discard(source)
    discard(checkpoint)
    return spark.read.parquet(out).select("batch_no", "stream_position", "normalized_label")


def _r17(spark: SparkSession, sf: str, stages: int = 5) -> DataFrame:
    """The events arrive in ``stages`` runs in order of time; the stream is resumed after each, its windows go on."""
    rows = table(spark, sf, "events").withColumn("ts", c("ts").cast("timestamp")).select("ts", "event_type", "value")
    ends = rows.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b")).first()
    source, out, checkpoint = scratch(spark, "events"), scratch(spark, "windows"), scratch(spark, "checkpoint")
    step = max(1, ((ends["b"] or 0) - (ends["a"] or 0)) // stages + 1)
    for i in range(stages):
        rows.filter(F.floor((F.unix_micros("ts") - (ends["a"] or 0)) / step) == i).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        got = collect.latest_windows(collect.window_counts(stream, "ts", "1 hour", ["event_type"], "value", "10 minutes"), ["event_type"], out, checkpoint)
    discard(source)
    discard(checkpoint)
    return got.select(c("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


SQL |= {
    "r03_stream_dedup": "select distinct user_id, event_type from events",
    "r04_stream_quota": SQL["w12_quota_prefix"],
    "r17_window_counts": "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
}
QUERIES |= {"r03_stream_dedup": _r03, "r04_stream_quota": _r04, "r17_window_counts": _r17}
