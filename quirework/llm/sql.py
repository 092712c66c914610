"""DuckDB SQL for the rows of the queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MIXING = r"""
with d as (
  select doc_id, source, length(text) as whole, text,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(concat_ws('|', 'mix', coalesce(doc_id::varchar, 'null'), length(text)::varchar)), 1, 12))::bigint as r
  from documents),
k as (
  select doc_id, source, size,
         -ln((r::double + 0.5::double) / 281474976710656::double)
         / case when whole > 0 then 0.1::double + 0.9::double
             * length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&*|<>{}[]=_', ''))::double / whole::double
           else 1::double end as key
  from d),
s as (select source, sum(size)::bigint as source_size from k group by source),
w as (select *, [1, 2, 3][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight, 3 * source_size as cap from s),
f as (select *, sum(source_size) over () as total,
             coalesce(sum(cap) over (order by cap::double / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as before,
             sum(weight) over (order by cap::double / weight, source nulls last rows between current row and unbounded following) as others
      from w),
g as (select *, cap::hugeint * others < weight * (total - before) as stopped from f),
h as (select *, total - sum(case when stopped then cap else 0 end) over () as pool,
             sum(case when stopped then 0 else weight end) over () as share from g),
t as (select source, source_size, case when stopped then cap::double else weight::double * pool::double / share::double end as target from h),
o as (select k.doc_id, k.size, t.source_size, t.target,
             coalesce(sum(k.size) over (partition by k.source order by k.key, k.doc_id rows between unbounded preceding and 1 preceding), 0) as before
      from k join t on k.source is not distinct from t.source),
e as (select *, floor(target)::bigint as budget,
             case when source_size > 0 then floor(floor(target) / source_size)::bigint else 0 end as epochs from o)
select doc_id, size, source_size, target,
       (epochs * size + least(greatest(budget - epochs * source_size - before, 0), size))::bigint as taken
from e
"""

NEAR_VECTORS = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      where list_cosine_similarity(a.e, b.e) >= 0.95),
r(node, other) as (select vec_id, vec_id from embeddings union select p.b, r.other from r join p on p.a = r.node),
c as (select node, min(other) as component_id from r group by node),
n as (select a, count(*) as n from p group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings join c on vec_id = node left join n on vec_id = a
"""

NGRAM_JOIN = rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') as ws from documents),
g as (
  select distinct doc_id, unnest(case when len(ws) >= 5 then list_transform(range(len(ws) - 4), lambda i: array_to_string(ws[i + 1:i + 5], ' '))
                                      when len(ws) > 0 then [len(ws) || ' ' || array_to_string(ws, ' ')] else [] end) as s from w),
n as (select doc_id, count(*) as n from g group by doc_id),
k as (select a.doc_id as a, b.doc_id as b, count(*) as k from g a join g b on a.s = b.s and a.doc_id < b.doc_id group by all),
e as (select a, b from k join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
l as (select a, b from e union all select b, a from e),
r(node, other) as (select doc_id, doc_id from documents union select l.b, r.other from r join l on l.a = r.node)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(r.other) as component_id
from documents d join r on r.node = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id
"""

FILTER_AUDIT = r"""
with recursive d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
f as (select text, min(doc_id) as first from d group by text),
c as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
         [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws),
          100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 2 * length(d.text),
          regexp_matches(d.text, '[#$%&*|]'), coalesce(d.doc_id > first, false)] as fails
  from d join f on f.text = d.text left join l on l.doc_id = d.doc_id),
m as (select part, good, toxic, fails, count(*) as n from c group by all),
o(filter_order) as (select '' union all
  select filter_order || x from o, (select unnest(['A', 'B', 'C', 'D', 'E']) as x) where not contains(filter_order, x)),
s as (select filter_order, i::int as step, ascii(filter_order[i]) - 64 as letter,
             [ascii(y) - 64 for y in string_split(filter_order[1:i - 1], '') if y <> ''] as earlier
      from o, range(1, 6) r(i) where length(filter_order) = 5),
a as (
  select part, filter_order, step, letter, n, good, toxic, fails[letter] as here,
         len([e for e in earlier if fails[e]]) > 0 as gone, len([b for b in fails if b]) = 1 as alone
  from m, s),
t as (
  select part, filter_order, step, letter,
         coalesce(sum(n) filter (not here and not gone), 0)::bigint as kept,
         coalesce(sum(n) filter (here and not gone), 0)::bigint as removed,
         coalesce(sum(n) filter (here and gone), 0)::bigint as redundant,
         coalesce(sum(n) filter (here and alone), 0)::bigint as unique_fails,
         coalesce(sum(n * good) filter (here and not gone), 0)::bigint as good_lost,
         coalesce(sum(n * toxic) filter (here and not gone), 0)::bigint as toxic_lost
  from a group by part, filter_order, step, letter)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) over (partition by part, letter)::bigint as shapley
from t
"""
