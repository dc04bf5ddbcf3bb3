"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

from verbena.llm.url_filter import EXAMPLE_ENTRIES

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = f"""
with item as (select item_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
win as (select distinct item_id, w[i:i+9] as g, len(w[i:i+9]) as k from item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) where len(w) > 0),
sizes as (select distinct k from win),
doc as (select doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
gram as (select doc_id, k, i, w[i:i+k-1] as g from doc, sizes, unnest(range(1, len(w) - k + 2)) t(i) where len(w) >= k),
hit as (select doc_id, gram.k, i, item_id from gram join win using (g)),
words as (select doc_id, count(distinct p) as n_hit from hit, unnest(range(i, i + k)) t(p) group by 1),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hit group by 1)
select doc.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join words using (doc_id) left join items using (doc_id)"""

JACCARD = f"""
with recursive doc as (select doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+') as w from documents),
gram as (select distinct doc_id, w[i:i+2] as g from doc, unnest(range(1, greatest(len(w) - 2, 1) + 1)) t(i) where len(w) > 0),
size as (select doc_id, count(*) as n from gram group by 1),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as shared_n from gram a join gram b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from shared join size x on x.doc_id = a join size y on y.doc_id = b where 100 * shared_n >= 90 * (x.n + y.n - shared_n)),
edge as (select a, b from link union all select b, a from link),
reach as (select a as x, b as y from edge union select x, b from reach join edge on y = a)
select doc.doc_id, coalesce(n, 0)::bigint as n_shingles, least(doc.doc_id, coalesce(low, doc.doc_id)) as component_id
from doc left join size using (doc_id) left join (select x as doc_id, min(y) as low from reach group by 1) using (doc_id)"""

REPEATS = """
with doc as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
win as (select r, i, md5(substr(h, 2 * i - 1, 800)) as g from doc, unnest(range(1, n - 398)) t(i) where n >= 400),
twice as (select g from win group by 1 having count(*) > 1),
mark as (select r, i, case when i <= lag(i) over (partition by r order by i) + 400 then 0 else 1 end as fresh from win semi join twice using (g)),
span as (select r, min(i) as s, max(i) + 399 as e from (select *, sum(fresh) over (partition by r order by i) as k from mark) group by r, k),
gap as (select r, coalesce(lag(e) over (partition by r order by s), 0) + 1 as a, s - 1 as b from span union all select r, max(e) + 1, null from span group by 1),
kept as (select r, string_agg(substr(h, 2 * a - 1, 2 * (coalesce(b, n) - a + 1)), '' order by a) as text from gap join doc using (r) where a <= coalesce(b, n) group by 1),
told as (select r, sum(e - s + 1)::bigint as n_removed, count(*) as n_spans from span group by 1)
select doc_id, n::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(case when n_spans is null then h else coalesce(kept.text, '') end)) as kept_sha256
from doc left join told using (r) left join kept using (r)"""

_ENTRIES = ", ".join(f"('{k}', date '{d}', '{a}')" for k, d, a in EXAMPLE_ENTRIES)
_RANK = "case action when 'block' then 3 when 'allow' then 2 else 1 end"

URL_FILTER = f"""
with entry as (select key, valid_from, max({_RANK}) as rank from (values {_ENTRIES}) t(key, valid_from, action) group by 1, 2),
span as (select key, valid_from, lead(valid_from) over (partition by key order by valid_from) as valid_to, rank from entry),
page as (select page_id, url, (date '2024-01-01' + ((page_id * 37) % 366)::int)::date as day,
  rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1), '.') as host,
  list_filter(string_split(regexp_extract(url, '^[^:]*://[^/?#]*(/[^?#]*)?', 1), '/'), lambda s: s <> '') as seg from pages),
host as (select page_id, day, seg, array_to_string(string_split(host, '.')[i:], '.') as h from page, unnest(range(1, len(string_split(host, '.')) + 1)) t(i) where host <> ''),
probe as (select page_id, day, h || case when j > 0 then '/' || array_to_string(seg[1:j], '/') else '' end as key from host, unnest(range(0, len(seg) + 1)) t(j)),
found as (select page_id, max_by(struct_pack(r := rank, k := span.key, f := valid_from, t := valid_to), struct_pack(n := length(span.key), k := span.key)) as m
  from probe join span on probe.key = span.key and valid_from <= day and (valid_to is null or day < valid_to) where rank > 1 group by 1)
select page_id, host, day as fetched_on, case m.r when 3 then 'block' when 2 then 'allow' else 'none' end as verdict, m.k as matched_key, m.f as valid_from, m.t as valid_to
from page left join found using (page_id)"""

EMBEDDINGS = """
with recursive vec as (select vec_id, embedding::double[] as e, sqrt(list_inner_product(embedding::double[], embedding::double[])) as n from embeddings),
link as (select a.vec_id as a, b.vec_id as b from vec a join vec b on a.vec_id < b.vec_id where list_inner_product(a.e, b.e) >= 0.95 * a.n * b.n),
edge as (select a, b from link union all select b, a from link),
low as (select a as vec_id, a as c from edge union select edge.b, low.c from low join edge on low.vec_id = edge.a where low.c < edge.b)
select vec.vec_id, (select count(*) from edge where a = vec.vec_id)::bigint as n_links, least(vec.vec_id, coalesce(c, vec.vec_id)) as component_id, coalesce(c, vec.vec_id) >= vec.vec_id as kept
from vec left join (select vec_id, min(c) as c from low group by 1) using (vec_id)"""
