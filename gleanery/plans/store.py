"""Queries of the annotation store and the collection's run, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import normalize as N
from gleanery.functions import rubric as R
from gleanery.functions.cleaning import cleaned, cleaned_hash
from gleanery.operators import aggregates as A
from gleanery.operators import metrics as M
from gleanery.operators import relations as J
from gleanery.operators import review as V
from gleanery.plans.reference import _LEVELS, CLEAN, KEY, _levels, query
from gleanery.streaming import collect

c = F.col


@query()
def r10_lease_replay(t, spark):
    """A log of requests from the events: by the user's number eight queues and forty people; a request other than to
    reserve names the person's last reservation.  Each depends on all before it in its queue, so there is no SQL."""
    e = t("events").select("event_id", (c("user_id") % 8).cast("string").alias("queue"), (c("user_id") % 40).cast("string").alias("person"), F.unix_micros(c("ts").cast("timestamp")).alias("us"), "event_type")
    op = F.when(c("event_type") == "purchase", "complete").when(c("event_type") == "error", "release").when(c("event_type") == "signup", "renew").otherwise("reserve")
    e = e.select("event_id", "queue", "person", (c("us") / 1e6).alias("at"), op.alias("op"))
    e = e.withColumn("token", F.when(c("op") != "reserve", F.last(F.when(c("op") == "reserve", c("event_id")), ignorenulls=True).over(V.W.partitionBy("queue", "person").orderBy("at", "event_id"))))
    items = t("images").select(F.pmod(F.xxhash64("content_hash"), F.lit(8)).cast("string").alias("queue"), c("content_hash").alias("item")).distinct()
    return V.lease_replay(e, items, 900)


_MODEL_EVENTS = """with e as (select event_id, user_id as k, event_id % 3 as person, case event_type when 'view' then 'initial' when 'click' then 'final' else 'complete' end as op,
 case when value < 20 then 'low' when value < 60 then 'medium' when value < 200 then 'high' else 'none' end as label, ['low', 'medium', 'high'][user_id % 3 + 1] as prediction from events),
i as (select *, coalesce(label in ('low', 'medium', 'high'), false) as valid, first_value(case when op = 'initial' and label in ('low', 'medium', 'high') then label end ignore nulls)
  over (partition by k, person order by event_id rows unbounded preceding) as initial from e),
f as (select k, min(event_id) as done from i where op = 'complete' and valid and initial is not null group by 1),
o as (select i.*, case when not valid then 'bad_label' when initial is null then 'no_initial' when op = 'initial' and label <> initial then 'initial_fixed'
 when op = 'complete' and event_id is distinct from done then 'already_completed' when op = 'complete' then 'completed' else 'saved' end as outcome from i left join f using (k))
"""


def _model_events(t):
    """A log of blind model reviews: the user is the image, three people, the label by the value."""
    op = F.when(c("event_type") == "view", "initial").when(c("event_type") == "click", "final").otherwise("complete")
    label = F.when(c("value") < 20, "low").when(c("value") < 60, "medium").when(c("value") < 200, "high").otherwise("none")
    said = F.element_at(F.array(*[F.lit(x) for x in R.LEVELS]), (c("user_id") % 3 + 1).cast("int"))
    return t("events").select("event_id", c("user_id").alias("k"), (c("event_id") % 3).alias("person"), op.alias("op"), label.alias("label"), said.alias("prediction"))


@query(_MODEL_EVENTS + "select event_id, outcome, initial from o")
def r11_model_review(t, spark):
    return V.model_review_fold(_model_events(t), "k", "person", ["event_id"], "prediction").select("event_id", "outcome", "initial")


@query(
    _MODEL_EVENTS
    + "select k, person, initial as human_initial_label, label as human_final_label, initial = prediction as agreement_initial, label = prediction as agreement_final from o where outcome = 'completed'"
)
def v04_model_review_export(t, spark):
    got = V.model_review_fold(_model_events(t), "k", "person", ["event_id"], "prediction").filter("outcome = 'completed'")
    return got.select("k", "person", c("initial").alias("human_initial_label"), c("label").alias("human_final_label"), "agreement_initial", "agreement_final")


_FIRST = f"""first as (select {KEY} as k, arg_min(annotator_key, annotation_id) as annotator_key, min(annotation_id) as annotation_id from annotations group by 1)"""


def _originals(t):
    rows = t("annotations").select(cleaned_hash("content_hash").alias("k"), "annotation_id", "annotator_key").filter("k is not null")
    return rows.groupBy("k").agg(F.min(F.struct("annotation_id", "annotator_key")).alias("m")).select("k", "m.annotation_id", "m.annotator_key")


@query(
    f"""with {_FIRST}, r as (select distinct review_id, {KEY} as k, reviewer_key, {CLEAN("action")} as action, reason from reviews)
select review_id, case when f.k is null then 'no_annotation' when coalesce(f.annotator_key = reviewer_key, false) then 'self_review' when not coalesce(action in ('confirm', 'correct'), false) then 'unknown_action'
 when action = 'correct' and trim(coalesce(reason, ''), ' \t\r\n') = '' then 'missing_reason' end as error, count(*) as rows from r left join first f on f.k = r.k group by all"""
)
def r12_review_errors(t, spark):
    rows = t("reviews").select("review_id", cleaned_hash("content_hash").alias("k"), "reviewer_key", cleaned("action").alias("action"), "reason").distinct()
    return V.review_errors(rows, _originals(t), "k").groupBy("review_id", "error").agg(F.count("*").alias("rows"))


@query(
    f"""with im as (select snapshot_id, local_review_id, min(event_sha256) as event_sha256, max(event_sha256) as last_sha256, min(case when import_id % 13 = 0 then 'changed' else event_sha256 end) as current_sha256 from review_imports group by 1, 2),
ret as (select snapshot_id, local_review_id, cast(null as varchar) as content_hash, case when local_review_id % 17 = 0 then 'other' else event_sha256 end as event_sha256 from im
 union all select distinct 'new', annotation_id, {KEY}, 'sha' || annotation_id from annotations),
m as (select distinct {KEY} as h from reviews where deleted_at is null), rs as (select distinct {KEY} as h from assignments where {CLEAN("role")} = 'unassigned'),
p as (select r.snapshot_id, r.local_review_id, case when im.snapshot_id is not null then case when coalesce(im.event_sha256 = r.event_sha256 and im.last_sha256 = r.event_sha256 and im.current_sha256 = r.event_sha256, false) then 'identical' else 'conflict_changed' end
 when m.h is not null then 'conflict_reviewed' when rs.h is not null then 'conflict_reserved' else 'pending' end as plan
 from ret r left join im on im.snapshot_id = r.snapshot_id and im.local_review_id = r.local_review_id left join m on m.h = r.content_hash left join rs on rs.h = r.content_hash)
select snapshot_id, plan, count(*) as rows from p group by 1, 2"""
)
def r13_snapshot_plan(t, spark):
    """Returned events: those imported before, some altered since or in the master, and one for each annotation."""
    im = t("review_imports").groupBy("snapshot_id", "local_review_id").agg(
        F.min("event_sha256").alias("event_sha256"), F.max("event_sha256").alias("last_sha256"), F.min(F.when(c("import_id") % 13 == 0, "changed").otherwise(c("event_sha256"))).alias("current_sha256")
    )
    imports = im.select("snapshot_id", "local_review_id", "current_sha256", F.explode(F.array("event_sha256", "last_sha256")).alias("event_sha256"))
    old = im.select("snapshot_id", "local_review_id", F.lit(None).cast("string").alias("content_hash"), F.when(c("local_review_id") % 17 == 0, "other").otherwise(c("event_sha256")).alias("event_sha256"))
    new = t("annotations").select(F.lit("new").alias("snapshot_id"), c("annotation_id").alias("local_review_id"), cleaned_hash("content_hash").alias("content_hash"), F.concat(F.lit("sha"), "annotation_id").alias("event_sha256")).distinct()
    k = cleaned_hash("content_hash").alias("content_hash")
    plan = V.snapshot_plan(old.unionByName(new), imports, t("reviews").filter("deleted_at is null").select(k), t("assignments").filter(cleaned("role") == "unassigned").select(k))
    return plan.groupBy("snapshot_id", "plan").agg(F.count("*").alias("rows"))


_BAG = "count(*) as rows, cast(sum(h) as varchar) as hash_sum, bit_xor(h) as hash_xor"
_STATE = {"annotations": ("annotation_id", "annotator_key"), "batch_images": ("entry_id", "batch_id"), "reviews": ("review_id", "reviewer_key"), "images": ("content_hash", "source_dataset")}


@query(
    " union all ".join(
        f"select '{name}' as table_name, {_BAG} from (select cast('0x' || substr(sha256(coalesce(cast({a} as varchar), '~') || '|' || coalesce(cast({b} as varchar), '~')), 1, 12) as bigint) as h from {name})"
        for name, (a, b) in _STATE.items()
    )
)
def v06_state_digest(t, spark):
    """A digest of each table as a bag of rows: equal states have equal digests, in whatever order their rows lie."""
    out = None
    for name, (a, b) in _STATE.items():
        text = lambda x: F.coalesce(c(x).cast("string"), F.lit("~"))
        got = A.set_digest(t(name), F.concat(text(a), F.lit("|"), text(b))).withColumn("table_name", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out


@query(
    f"""with {_FIRST}, r as (select {KEY} as k, arg_max(lower(action), review_id) as action, max(review_id) as review_id, count(distinct review_id) as reviews from reviews where deleted_at is null group by 1)
select f.k as content_hash, f.annotation_id, coalesce(r.action, 'original') as action, r.review_id, coalesce(r.reviews, 0) as reviews, coalesce(r.action = 'confirm', false) as confirmed
from first f left join r on r.k = f.k where f.k is not null"""
)
def v03_current_export(t, spark):
    """Each annotated image with its last review, if any; ``confirmed`` marks the confirmed export."""
    r = t("reviews").filter("deleted_at is null").select(cleaned_hash("content_hash").alias("k"), "review_id", F.lower("action").alias("action"))
    last = r.filter("k is not null").groupBy("k").agg(F.max(F.struct("review_id", "action")).alias("m"), F.count_distinct("review_id").alias("reviews"))
    got = _originals(t).join(last, "k", "left")
    return got.select(
        c("k").alias("content_hash"), "annotation_id", F.coalesce("m.action", F.lit("original")).alias("action"), "m.review_id",
        F.coalesce("reviews", F.lit(0)).alias("reviews"), F.coalesce(c("m.action") == "confirm", F.lit(False)).alias("confirmed"),
    )


@query(
    f"""with {_FIRST}, h as (select k as content_hash, 0 as step, annotation_id as id from first where k is not null union all select distinct {KEY}, 1, review_id from reviews where {KEY} is not null and {KEY} in (select k from first))
select content_hash, step, id, row_number() over (partition by content_hash order by step, id) as place from h"""
)
def v03_history_export(t, spark):
    first = _originals(t)
    r = t("reviews").select(cleaned_hash("content_hash").alias("k"), F.lit(1).alias("step"), c("review_id").alias("id")).distinct().join(first.select("k"), "k", "left_semi")
    rows = first.select("k", F.lit(0).alias("step"), c("annotation_id").alias("id")).unionByName(r)
    place = F.row_number().over(V.W.partitionBy("k").orderBy("step", "id"))
    return rows.select(c("k").alias("content_hash"), "step", "id", place.alias("place"))


@query(
    f"""with i as (select distinct content_hash as k from images), a as (select distinct {KEY} as k from annotations), r as (select distinct {KEY} as k from reviews)
select (select count(k) from i) as images, (select count(k) from a) as annotated, (select count(k) from r) as reviewed, (select count(k) from i) - (select count(k) from a) as unannotated, (select count(k) from a) - (select count(k) from r) as awaiting_review"""
)
def a28_snapshot_summary(t, spark):
    k = cleaned_hash("content_hash").alias("k")
    return V.snapshot_summary(t("images").select(c("content_hash").alias("k")), t("annotations").select(k), t("reviews").select(k), "k")


@query(
    f"""with b as (select distinct {KEY} as k, entry_id from batch_images), o as (select {KEY} as k, min(annotator_key) as lo, max(annotator_key) as hi from annotations group by 1)
select entry_id, coalesce(lo <> 'ann' or hi <> 'ann', false) as by_other from b left join o on o.k = b.k"""
)
def j16_other_annotator(t, spark):
    """Entries whose image somebody else than the asking person has annotated."""
    rows = t("batch_images").select(cleaned_hash("content_hash").alias("k"), "entry_id").distinct().withColumn("annotator_key", F.lit("ann"))
    others = t("annotations").select(cleaned_hash("content_hash").alias("k"), "annotator_key")
    return J.has_other(rows, others, "k", "annotator_key", "by_other").select("entry_id", "by_other")


@query(
    f"""with p as (select {KEY} as k, model_version as v, arg_max({CLEAN("model_prediction")}, (predicted_at, {CLEAN("model_prediction")})) as m from predictions where {KEY} is not null group by 1, 2),
v as (select min(v) as lo, max(v) as hi from p), a as (select p.* from p, v where p.v = lo), b as (select p.* from p, v where p.v = hi)
select count(*) as items, count_if(a.m is not null and b.m is not null) as in_both, count_if(a.k is not null and b.k is not null and a.m is not distinct from b.m) as identical, count_if(a.m is distinct from b.m) as m_differs from a full join b on a.k = b.k"""
)
def a25_determinism(t, spark):
    """The first and the last model version as two runs over the same images."""
    p = t("predictions").select(cleaned_hash("content_hash").alias("k"), c("model_version").alias("v"), cleaned("model_prediction").alias("m"), "predicted_at").filter("k is not null and v is not null")
    p = p.groupBy("k", "v").agg(F.max(F.struct("predicted_at", "m")).alias("x")).select("k", "v", "x.m")
    ends = F.broadcast(p.agg(F.min("v").alias("lo"), F.max("v").alias("hi")))  # one row
    p = p.join(ends, F.lit(True))
    return J.determinism(p.filter("v = lo").select("k", "m"), p.filter("v = hi").select("k", "m"), "k", ["m"])


@query(
    _LEVELS
    + """, d as (select unnest([0, 1, 2]) as distance), s as (select t, sum(n) as s, coalesce(sum(n) filter (where t = p), 0) as tp from n group by 1)
select distance, coalesce((select sum(n) from n where abs(t - p) = distance), 0) as n, (select round(avg(tp / s), 6) from s) as balanced_accuracy from d"""
)
def a16_error_distances(t, spark):
    return M.error_distances(M.contingency(_levels(t), c("h"), c("p")), 3)


@query(
    f"""with p as (select {KEY} as k, arg_max(case {CLEAN("model_prediction")} when 'low' then 0 when 'medium' then 1 when 'high' then 2 else -1 end, (predicted_at, coalesce({CLEAN("model_prediction")}, ''))) as p from predictions where {KEY} is not null group by 1),
h as (select {KEY} as k, arg_max(case when public_relevance + harm_urgency + vulnerability <= 1 then 0 when public_relevance + harm_urgency + vulnerability <= 3 then 1 else 2 end, (recorded_at, annotation_id)) as h
  from annotations where public_relevance between 0 and 2 and harm_urgency between 0 and 2 and vulnerability between 0 and 1 group by 1), j as (select h, p from h join p using (k))
select count_if(h = 2) as support, count_if(h = 2 and p = 2) as hits, count_if(h = 2 and p = -1) as unparsed, round(count_if(h = 2 and p = 2) / nullif(count_if(h = 2), 0), 6) as recall from j"""
)
def a17_top_recall(t, spark):
    """The last prediction of an image counts, a class that is none as one that failed to parse."""
    h = t("annotations").select(cleaned_hash("content_hash").alias("k"), R.level_index(R.level(R.score())).alias("h"), "recorded_at", "annotation_id").filter("h is not null")
    h = V.latest(h, "k", ["recorded_at", "annotation_id"], ["h"]).select("k", "h")
    p = t("predictions").select(cleaned_hash("content_hash").alias("k"), F.coalesce(cleaned("model_prediction"), F.lit("")).alias("m"), "predicted_at")
    p = V.latest(p, "k", ["predicted_at", "m"], []).select("k", R.level_index(c("m")).alias("p"))
    return M.top_recall(h.join(p, "k"), c("h"), c("p"), 2)


@query(
    f"""with r as (select distinct {KEY} as u, annotator_key as r, sensitivity_level as v from annotations where {KEY} is not null and annotator_key is not null and sensitivity_level is not null),
cells as (select u, v, count(*) as n from r group by 1, 2), un as (select u, sum(n) as m, sum(n * n) as q from cells group by 1 having sum(n) > 1),
s as (select sum(m) as total, sum((m * m - q) / (m - 1)) as o, count(*) as units from un), x as (select sum(n * n) as s from (select v, sum(n) as n from cells where u in (select u from un) group by 1))
select units, total as ratings, round(1 - o / nullif((total * total - x.s) / nullif(total - 1, 0), 0), 6) as alpha from s, x"""
)
def a29_krippendorff(t, spark):
    rows = t("annotations").withColumn("u", cleaned_hash("content_hash"))
    return M.krippendorff(rows, "u", "annotator_key", c("sensitivity_level"))


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem group by cube (l_returnflag, l_linestatus)")
def a30_cube(t, spark):
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(
    """select entry_id, entry_id % 3 = 1 and original_filename not in ('', '.', '..') and not contains(original_filename, '/') and not contains(original_filename, ':')
 and not contains(original_filename, chr(92)) as contained from batch_images where original_filename is not null"""
)
def p16_contained(t, spark):
    e = c("entry_id") % 3
    path = F.when(e == 0, F.concat(F.lit("/images/"), "original_filename")).when(e == 1, F.concat(F.lit("images/"), "original_filename")).otherwise(F.concat(F.lit("images/a/"), "original_filename"))
    rows = t("batch_images").filter("original_filename is not null")
    return rows.select("entry_id", N.contained_path(path, "images").alias("contained"))


@query(
    f"""select annotation_id, case {CLEAN("sensitivity_level")} when 'low' then 0 when 'medium' then 1 when 'high' then 2 end - (case when s <= 1 then 0 when s <= 3 then 1 else 2 end) as error,
 abs(case {CLEAN("sensitivity_level")} when 'low' then 0 when 'medium' then 1 when 'high' then 2 end - (case when s <= 1 then 0 when s <= 3 then 1 else 2 end)) as distance
from (select *, public_relevance + harm_urgency + vulnerability as s from annotations where public_relevance between 0 and 2 and harm_urgency between 0 and 2 and vulnerability between 0 and 1)"""
)
def p30_level_error(t, spark):
    e, d = R.signed_error(cleaned("sensitivity_level"), R.level(R.score()))
    return t("annotations").filter(R.score().isNotNull()).select("annotation_id", e.alias("error"), d.alias("distance"))


@query()
def r02_record_outcomes(t, spark):
    """What becomes of each record of the manifest under quotas; one after the other, so it is tested against a loop."""
    label, reason = N.mapped_label(c("original_label"), {"real": "real", "fake": "fake", "0": "real", "1": "fake"}, {"2": "tampered"})
    ex = t("exclusion_manifests").select(cleaned_hash("content_hash").alias("k")).filter("k is not null").distinct().withColumn("excluded", F.lit(True))
    rows = t("collection_manifest").select("record_id", "batch_no", "stream_position", cleaned_hash("content_hash").alias("k"), N.sample_id(c("sample_id")).alias("s"), label.alias("label"), reason.alias("problem"), "width").distinct()
    rows = rows.join(ex, "k", "left").withColumn("broken", ~F.coalesce(c("width") > 0, F.lit(False)) | c("k").isNull())
    got = collect.collected(rows, [c("s"), c("k")], "label", ["batch_no", "stream_position", "record_id"], {"real": 400, "fake": 500}, 800)
    return got.select("record_id", "outcome")

