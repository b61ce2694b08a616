"""SQL, run by another engine, of the queries that it can express."""

_KEY = "nullif(regexp_replace(lower(trim({}, ' \t')), '^sha256:', ''), '')"
_WORDS = "regexp_extract_all(lower(prompt), '[a-z0-9]+')"
_SHINGLES = "list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"

_OVERLAP = f"""
with r as (
  select distinct assignment_id as id, split_seed as grp, lower(trim(role)) as split, source_dataset as source,
         {_KEY.format("content_hash")} as k, {_WORDS} as w from assignments),
s as (select id, grp, split, source, k, case when len(w) >= 3 then {_SHINGLES} end as sh from r),
pairs as (
  select e.id as id_e, t.id as id_t, e.k = t.k as exact,
         5 * len(list_intersect(e.sh, t.sh)) >= 3 * (len(e.sh) + len(t.sh) - len(list_intersect(e.sh, t.sh))) as near
  from s e join s t on e.grp = t.grp and e.split in ('gold_development', 'gold_test') and t.split = 'unassigned'),
hits as (select * from pairs where exact or near)
"""

_TARGETS = f"""
with u as (
  select {_KEY.format("content_hash")} as h, lower(trim(source_dataset)) as d, lower(trim(source_label)) as l, lower(trim(model_prediction)) as m, predicted_at
  from predictions where confidence between 0 and 1 and not isnan(confidence) and lower(trim(source_label)) in ('real', 'fake')
    and lower(trim(model_prediction)) in ('low', 'medium', 'high') and trim(source_dataset) <> ''),
one as (select h, arg_max((d, l, m), (predicted_at, d, l, m)) as c from u where h is not null group by h),
have as (select c, count(*) as available from one group by c),
t as (
  select target_id, sample_name, greatest(min_count, cast(round(target_share * sample_size) as bigint)) as needed, coalesce(available, 0) as available
  from sample_targets left join have on c = (lower(trim(source_dataset)), lower(trim(source_label)), lower(trim(model_prediction))))
"""

_RUNS = """
with d as (select doc_id, text, length(text) as n from documents where length(text) >= 120),
w as (select distinct doc_id, substr(text, i, 120) as k from (select doc_id, text, unnest(range(1, n - 118)) as i from d))
"""

_SHARES = """
with d as (select distinct doc_id, text, length(text) as n from documents),
w as (select doc_id, pos, substr(text, pos + 1, 120) as k from (select doc_id, text, unnest(range(0, n - 119)) as pos from d where n >= 120)),
s as (select k from w group by k having count(distinct doc_id) > 1),
p as (select distinct doc_id, pos from w where k in (select k from s)),
c as (select doc_id, least(coalesce(lead(pos) over (partition by doc_id order by pos) - pos, 120), 120) as c from p),
t as (select doc_id, sum(c) as c from c group by 1)
select d.doc_id, d.n as n_chars, case when d.n is not null then coalesce(t.c, 0) end as shared_chars, case when d.n > 0 then coalesce(t.c, 0) / d.n end as shared_share from d left join t using (doc_id)
"""

SQL = {
    "p8_shared_share": _SHARES,
    "p4_shortfalls": _TARGETS + "select target_id, sample_name, needed, available, greatest(0, needed - available) as shortfall from t",
    "p6_unchanged": "select lower(trim(lang, ' \t\r\n')) as lang, count(*) as documents, 0 as changed from documents group by 1",
    "p7_invariants": "select container_kind, (select count(distinct doc_id) from documents) as documents, 0 as divided_though_fitting, 0 as gaps, 0 as overfull from containers",
    "p8_found": _RUNS + "select distinct a.doc_id as doc_id_a, b.doc_id as doc_id_b from w a join w b on a.k = b.k and a.doc_id < b.doc_id",
    "p4_found": _TARGETS + "select target_id from t where available < needed",
    "p3_found": _OVERLAP + "select least(id_e, id_t) as assignment_id_a, greatest(id_e, id_t) as assignment_id_b from hits",
    "p3_overlap_by_split": _OVERLAP
    + """, h as (select id_e, coalesce(bool_or(exact), false) as exact, coalesce(bool_or(near), false) as near from hits group by 1)
select s.split, s.source, count(*) as evaluation_rows, count_if(coalesce(h.exact, false)) as equal_key,
       count_if(coalesce(h.near, false)) as alike_text, count(h.id_e) as overlapping
from s left join h on h.id_e = s.id where s.split in ('gold_development', 'gold_test') group by all""",
}
