"""DuckDB SQL for the queries of this subpackage that SQL can express.

Derived from the definitions, not from the Spark code: near-duplicate pairs
are found by comparing everything, repeated windows by numbering them, spans
by splitting the text around its matches, and quantiles by ranks of the
bucketed values.
"""

from __future__ import annotations

from .quality_rules import GAMMA, LEAST_ROWS, METRICS
from .secret_scan import RULES

_COMPONENTS = """
reach(v, r) as (
  select v, v from nodes
  union
  select l.b, reach.r from reach join links l on l.a = reach.v)"""

OP1 = f"""
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95),
nodes as (select vec_id as v from embeddings),
{_COMPONENTS},
component as (select v, min(r) as component_id from reach group by v),
n as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join component c on c.v = e.vec_id left join n on n.a = e.vec_id
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _metric_sql() -> str:
    return " union all ".join(
        f"select doc_id, lang, source, '{m.name}' as metric, ({m.value.replace(' div ', ' // ')}) as v, {m.spread} as spread, {m.reach} as reach, {str(m.both).lower()} as both_sides from counts"
        for m in METRICS)


def _quartile(keys: str, name: str) -> str:
    on = f"{keys}," if keys else ""
    return f"""
{name} as (
  select {on} metric, max(total) as n_rows, min(value) filter (4 * upto >= total) as q1, min(value) filter (4 * upto >= 3 * total) as q3
  from (select {on} metric, bucket, case when bucket = 0 then 0 else pow({GAMMA}, bucket - 1) end as value,
          sum(count(*)) over (partition by {on} metric order by bucket) as upto, sum(count(*)) over (partition by {on} metric) as total
        from bucketed group by {on} metric, bucket)
  group by {on} metric)"""


OP2 = f"""
with w as (select doc_id, lang, source, coalesce(text, '') as t, {_WORDS} as ws from documents),
win as (
  select doc_id, i, list_slice(ws, i, i + 7) as win from (select doc_id, ws, unnest(generate_series(1, len(ws) - 7)) as i from w where len(ws) >= 8)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as n from win) where n >= 2),
covered as (select doc_id, count(*) as n from (select distinct doc_id, i + unnest(generate_series(0, 7)) as j from rep) group by doc_id),
lines as (
  select doc_id, count(*) as n_lines, count(*) - count(distinct line) as dup
  from (select doc_id, unnest(string_split(t, chr(10))) as line from w) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
counts as (
  select w.doc_id, lang, source, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(lines.dup, 0)::bigint as n_dup_lines,
    coalesce(covered.n, 0)::bigint as n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g'))::bigint as n_upper,
    coalesce(lines.n_lines, 0)::bigint as n_lines
  from w left join covered on covered.doc_id = w.doc_id left join lines on lines.doc_id = w.doc_id),
vals as ({_metric_sql()}),
bucketed as (select *, case when v <= 0 then 0 else 1 + ceil(ln(v::double) / ln({GAMMA}))::int end as bucket from vals),
{_quartile("lang, source", "fine")}, {_quartile("lang", "mid")}, {_quartile("", "top")},
fence as (
  select f.lang, f.source, f.metric, case when f.n_rows >= {LEAST_ROWS} then f.q1 when m.n_rows >= {LEAST_ROWS} then m.q1 else t.q1 end as q1,
    case when f.n_rows >= {LEAST_ROWS} then f.q3 when m.n_rows >= {LEAST_ROWS} then m.q3 else t.q3 end as q3
  from fine f join mid m on m.lang is not distinct from f.lang and m.metric = f.metric join top t on t.metric = f.metric),
bad as (
  select v.doc_id, count(*) as n from vals v join fence f on f.lang is not distinct from v.lang and f.source is not distinct from v.source and f.metric = v.metric
  where v.v > f.q3 + v.reach * greatest(f.q3 - f.q1, v.spread::double)
    or (v.both_sides and v.v < f.q1 - v.reach * greatest(f.q3 - f.q1, v.spread::double)) group by v.doc_id),
judged as (
  select c.*, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, coalesce(bad.n, 0) as n_bad from counts c left join bad on bad.doc_id = c.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and n_bad = 0 as kept from judged
"""

OP4 = f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select distinct doc_id, sh from (
    select doc_id, list_slice(ws, i, i + 4) as sh from (select doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) as i from w where len(ws) > 0))),
size as (select doc_id, count(*) as n from s group by doc_id),
both_ as (select a.doc_id as a, b.doc_id as b, count(*) as n from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
links as (
  select x.a, x.b from both_ x join size p on p.doc_id = x.a join size q on q.doc_id = x.b where 100 * x.n >= 75 * (p.n + q.n - x.n)),
nodes as (select doc_id as v from documents),
{_COMPONENTS},
component as (select v, min(r) as component_id from reach group by v)
select d.doc_id, coalesce(z.n, 0)::bigint as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d join component c on c.v = d.doc_id left join size z on z.doc_id = d.doc_id
"""


def _spans(number: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
  select doc_id, {number} as k, '{kind}' as kind, base + sum(gap) over w + coalesce(sum(size) over before, 0) as s, size, held >= {least} as ok from (
    select doc_id, 0 as base, unnest(range(1, len(found) + 1)) as i, unnest(list_transform(gaps[:len(found)], lambda x: length(x))) as gap,
      unnest(list_transform(found, lambda x: length(x))) as size, unnest(list_transform(held, lambda x: length(x))) as held
    from (select doc_id, regexp_extract_all(t, '{p}') as found, regexp_extract_all(t, '{p}', {group}) as held, regexp_split_to_array(t, '{p}') as gaps from d))
  window w as (partition by doc_id order by i), before as (partition by doc_id order by i rows between unbounded preceding and 1 preceding)"""


OP8 = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
found as ({" union all ".join(_spans(i, r.kind, r.pattern, r.group, r.least) for i, r in enumerate(RULES))}),
spans as (select doc_id, k, kind, s::bigint as s, (s + size)::bigint as e from found where ok),
joined as (
  select doc_id, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, k) filter (k < 3), '') as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, k) as spans
  from spans group by doc_id)
select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join joined on joined.doc_id = d.doc_id
"""

OP12 = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words from d),
f as (
  select doc_id, part, case when len(words) < 200 then 'A' else '' end || case when 100 * len(list_distinct(words)) < 50 * len(words) then 'B' else '' end
    || case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) then 'C' else '' end
    || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
    || case when doc_id > min(doc_id) over (partition by t) then 'E' else '' end as fails
  from w),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
cells as (
  select part, fails, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
  from f left join l on l.doc_id = f.doc_id group by part, fails),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as l),
orders as (
  select a.l || b.l || c.l || d.l || e.l as o from x a join x b on b.l <> a.l join x c on c.l not in (a.l, b.l)
    join x d on d.l not in (a.l, b.l, c.l) join x e on e.l not in (a.l, b.l, c.l, d.l)),
steps as (select o, s, substr(o, s, 1) as own, substr(o, 1, s - 1) as before from orders, (select unnest(range(1, 6)) as s)),
seen as (
  select part, o, s, own, n, good, toxic, fails, contains(fails, own) as failing, translate(fails, before, '') = fails as there from steps, cells),
summed as (
  select part, o as filter_order, s::int as step, own, sum(case when there and not failing then n else 0 end) as kept,
    sum(case when there and failing then n else 0 end) as removed, sum(case when failing and not there then n else 0 end) as redundant,
    sum(case when fails = own then n else 0 end) as unique_fails, sum(case when there and failing then good else 0 end) as good_lost,
    sum(case when there and failing then toxic else 0 end) as toxic_lost
  from seen group by all)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley
from summed
"""

ORACLE: dict[str, str] = {
    "op1_embedding_near_dedup": OP1,
    "op2_quality_rules": OP2,
    "op4_minhash_near_dedup": OP4,
    "op8_secret_scan": OP8,
    "op12_filter_audit": OP12,
}
