"""SQL for the queries that SQL can state, over whole tables."""

from __future__ import annotations

from siftwell.plans.sqltext import fold, tokens, words

P1_PAIRS = f"""
with d as (select distinct doc_id, stratum, text from candidates),
w as (select doc_id, stratum, {words('text')} as ws from d),
g as (select distinct doc_id, stratum, unnest(list_transform(range(1, greatest(2, len(ws) - 3)), lambda i: array_to_string(ws[i:i + 4], ' '))) as sh from w),
n as (select doc_id, count(*) as n from g group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as common from g a join g b on a.sh = b.sh and a.stratum = b.stratum and a.doc_id < b.doc_id group by 1, 2)
select c.a as doc_id_a, c.b as doc_id_b from c join n na on na.doc_id = c.a join n nb on nb.doc_id = c.b
where 7 * c.common >= 3 * (na.n + nb.n)
"""

# Classes of equal sets, links between classes, and the smallest id that links reach.
P1_GROUPS = f"""
with recursive d as (select distinct doc_id, stratum, text from candidates),
w as (select doc_id, stratum, {words('text')} as ws from d),
s as (select doc_id, stratum, list_sort(list_distinct(list_transform(range(1, greatest(2, len(ws) - 3)), lambda i: array_to_string(ws[i:i + 4], ' ')))) as sh from w),
m as (select doc_id, min(doc_id) over (partition by stratum, sh) as class_id from s),
h as (select doc_id, stratum, sh, len(sh) as n from s where doc_id in (select class_id from m)),
g as (select doc_id, stratum, n, unnest(sh) as sh from h),
l as (select a.doc_id as a, b.doc_id as b from g a join g b on a.sh = b.sh and a.stratum = b.stratum and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 7 * count(*) >= 3 * (a.n + b.n)),
e as (select a, b from l union all select b, a from l),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on e.a = r.b),
c as (select a, least(a, min(b)) as group_id from r group by a),
k as (select a, count(*) as n_links from e group by a)
select m.doc_id, m.class_id, coalesce(c.group_id, m.class_id) as group_id, coalesce(k.n_links, 0) as n_links from m left join c on c.a = m.class_id left join k on k.a = m.class_id
"""

_CATEGORIES = f"""
d as (select doc_id, min(stratum) as stratum, min(meta) as meta from candidates where stratum in (select stratum from sample_targets) group by doc_id),
k as (select stratum, min(meta_key) as meta_key from sample_targets group by stratum),
r as (select d.doc_id, d.stratum, case when json_valid(d.meta) then {fold("json_extract_string(case when json_valid(d.meta) then d.meta else '{}' end, '$.' || k.meta_key)")} end as category from d join k using (stratum)),
z as (select stratum, floor(count(*) / 2) as size from r group by stratum),
a as (select stratum, category, count(*) as available from r where category is not null group by 1, 2)
"""

P3_FOUND = f"""
with {_CATEGORIES}
select t.stratum, t.category from sample_targets t left join z using (stratum) left join a on a.stratum = t.stratum and a.category = t.category
where coalesce(a.available, 0) < greatest(t.min_docs, t.target_share * coalesce(z.size, 0))
"""

P3_NEEDS = f"""
with {_CATEGORIES}
select t.stratum, t.category, z.size::bigint as size, coalesce(a.available, 0) as available, greatest(t.min_docs, t.target_share * z.size) as needed, coalesce(a.available, 0) < greatest(t.min_docs, t.target_share * z.size) as short
from sample_targets t join z using (stratum) left join a on a.stratum = t.stratum and a.category = t.category
"""

# What a stratum's categories hold is drawn until its size is reached; no category beyond what it holds.
P3_TOTALS = f"""
with {_CATEGORIES}, n as (select t.stratum, sum(coalesce(a.available, 0)) as available from sample_targets t left join a on a.stratum = t.stratum and a.category = t.category group by 1)
select stratum, size::bigint as size, least(size, available)::bigint as drawn, least(size, available)::bigint as records from z join n using (stratum)
"""

_RANKED = f"""
q as (select doc_id, arg_max(quality, rated_at) as quality from doc_quality where quality is not null and not isnan(quality) group by doc_id),
d as (select doc_id, min(stratum) as stratum, min({fold('source_doc_id')}) as contributor from candidates group by doc_id),
r as (select d.doc_id, d.stratum, d.contributor, row_number() over (partition by d.stratum, d.contributor order by q.quality desc nulls last, d.doc_id) as place from d left join q using (doc_id) where d.contributor is not null)
"""

P4_FOUND = f"with {_RANKED} select doc_id from r where place > 5"

P4_KEPT = f"with {_RANKED} select c.* from candidates c where c.doc_id not in (select doc_id from r where place > 5)"

P4_SHARE = f"""
with {_RANKED}, n as (select stratum, greatest(1, floor(count(*) * 0.01)) as cap from d group by stratum)
select doc_id from r join n using (stratum) where place > cap
"""

_ITEMS = """
i as (select instance, item_id, arg_max(group_name, run_id) as group_name, arg_max(score, run_id) as score from scores where score is not null and not isnan(score) group by 1, 2),
o as (select *, row_number() over (partition by instance, group_name order by score) as place, count(*) over (partition by instance, group_name) as items from i),
c as (select o.instance, o.group_name, t.keep_fraction, any_value(o.items) as items, min(o.score) as cutoff from o join keep_targets t using (instance, group_name) where o.place >= t.keep_fraction * o.items group by 1, 2, 3)
"""

P5_FOUND = f"with {_ITEMS} select i.instance, i.item_id from i join c using (instance, group_name) where i.score > c.cutoff"

P5_REPORT = f"""
with {_ITEMS}
select c.instance, c.group_name, c.keep_fraction, c.items, c.cutoff, count(*) as kept, count(*) / c.items as kept_share
from c join i on i.instance = c.instance and i.group_name = c.group_name and i.score <= c.cutoff group by 1, 2, 3, 4, 5
"""


def _runs_of(table: str, key: str) -> str:
    return f"(select {key}, unnest(list_transform(range(1, greatest(1, len(ws) - 10)), lambda i: array_to_string(ws[i:i + 11], ' '))) as run from (select {key}, {words('text')} as ws from {table}))"


P6_FOUND = f"""
with d as {_runs_of('documents', 'doc_id')}, e as {_runs_of('eval_items', 'item_id')}
select distinct d.doc_id, e.item_id from d join e using (run)
"""

# Equal runs of twelve words at consecutive places on one diagonal are one longer run.
P6_RUNS = f"""
with d as (select doc_id, i - 1 as p, array_to_string(ws[i:i + 11], ' ') as run from (select doc_id, ws, unnest(range(1, greatest(1, len(ws) - 10))) as i from (select doc_id, {words('text')} as ws from documents))),
e as (select item_id, i - 1 as q, array_to_string(ws[i:i + 11], ' ') as run from (select item_id, ws, unnest(range(1, greatest(1, len(ws) - 10))) as i from (select item_id, {words('text')} as ws from eval_items))),
h as (select doc_id, item_id, p, q, p - row_number() over (partition by doc_id, item_id, p - q order by p) as island from d join e using (run))
select doc_id::varchar as doc_id, item_id::varchar as item_id, min(p)::int as doc_word, min(q)::int as item_word, (count(*) + 11)::int as n_words from h group by doc_id, item_id, p - q, island
"""

P7_FOUND = f"""
with n as (select source, sum({tokens('text')}) as tokens from documents group by source), t as (select sum(tokens) as total from n)
select m.source from mix_targets m left join n using (source), t where m.max_repeats * coalesce(n.tokens, 0) < m.weight * t.total
"""

P8_FOUND = f"select d.doc_id from documents d join split_limits l using (source) where {tokens('d.text')} > l.max_tokens"

# Slots of 256 tokens by weight, held to what the source's blocks allow, rounded by largest remainders.
P7_SLOTS = f"""
with n as (select source, sum({tokens('text')}) as tokens from documents group by source), t as (select sum(tokens) as total, ceil(sum(tokens) / 256) as slots from n),
x as (select m.source, m.weight, coalesce(n.tokens, 0)::bigint as tokens, m.weight * t.total as wanted, m.max_repeats, least(m.weight * t.slots, m.max_repeats * ceil(coalesce(n.tokens, 0) / 256)) as exact from mix_targets m left join n using (source), t),
y as (select *, floor(exact) as base, row_number() over (order by floor(exact) - exact, source) as place, floor(round(sum(exact) over (), 6)) - sum(floor(exact)) over () as spare from x)
select source, tokens, round(wanted, 6) as wanted, (base + (place <= spare)::int)::bigint as slots, max_repeats * tokens < wanted as short from y
"""

P8_CHECKS = f"select d.doc_id, {tokens('d.text')}::int as doc_tokens, true as fits, true as covers, true as overlaps from documents d join split_limits l using (source) where {tokens('d.text')} > l.max_tokens"

SQL = {
    "p1_found": P1_PAIRS,
    "p1_groups": P1_GROUPS,
    "p3_found": P3_FOUND,
    "p3_needs": P3_NEEDS,
    "p3_totals": P3_TOTALS,
    "p4_found": P4_FOUND,
    "p4_kept": P4_KEPT,
    "p4_share": P4_SHARE,
    "p5_found": P5_FOUND,
    "p5_report": P5_REPORT,
    "p6_found": P6_FOUND,
    "p6_runs": P6_RUNS,
    "p7_found": P7_FOUND,
    "p7_slots": P7_SLOTS,
    "p8_found": P8_FOUND,
    "p8_checks": P8_CHECKS,
}
