"""The same results in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from loomwright.llm.licenses import TEMPLATES, THRESHOLD
from loomwright.llm.secret_scan import RULES

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_SPANS = []
for _i, _r in enumerate(RULES):
    _p = _r.pattern.replace("'", "''")
    _SPANS.append(f"""
  select doc_id, {_i} as k, '{_r.name}' as kind, unnest(range(1, len(whole) + 1)) as i, whole, sized, gaps from (
    select doc_id, regexp_extract_all(t, '{_p}', 0) as whole, regexp_extract_all(t, '{_p}', {_r.group}) as sized,
           string_split_regex(t, '{_p}') as gaps
    from (select doc_id, coalesce(text, '') as t from documents)) where len(whole) > 0""")

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_PLACES = ", ".join(f"({i}, '{n}', '{t.replace(chr(39), chr(39) * 2)}')" for i, (n, t) in enumerate(TEMPLATES))
_BIGRAMS = "list_distinct(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))"

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": f"""
with t as (select i, name, {_BIGRAMS} as g from (select i, name, {_WORDS} as w from (values {_PLACES}) v(i, name, text))),
u as (select doc_id, unnest(list_concat([text], string_split_regex(text, '\n\n+'), string_split(text, chr(10)))) as text from documents where text is not null),
b as (select row_number() over () as k, doc_id, {_BIGRAMS} as g from (select doc_id, {_WORDS} as w from (select distinct doc_id, text from u))),
d as (select k, doc_id, i, name, 2.0 * len(list_intersect(b.g, t.g)) / (len(b.g) + len(t.g)) as dice
      from b, t where len(b.g) > 0 and 2.0 * least(len(b.g), len(t.g)) >= {THRESHOLD} * (len(b.g) + len(t.g))),
o as (select * from d where dice >= {THRESHOLD} qualify row_number() over (partition by k order by dice desc, i) = 1),
m as (select doc_id, name, max(dice) as dice from o group by doc_id, name),
f as (select doc_id, count(*) as n, string_agg(name, ',' order by name) as names, max(dice) as best from m group by doc_id)
select doc_id, coalesce(n, 0) as n_licenses, coalesce(names, '') as licenses, round(coalesce(best, 0.0)::double, 6) as best_dice
from documents left join f using (doc_id)""",
    "op1_decontamination": f"""
with i as (select item_id, {_WORDS} as w from benchmark where item_id is not null),
p as (select distinct item_id, least(10, len(w)) as m, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') as g
      from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as k from i where len(w) > 0)),
d as (select doc_id, {_WORDS} as w from documents),
x as (select doc_id, k, m, array_to_string(w[k:k + m - 1], ' ') as g
      from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as k from d, (select distinct m from p))),
h as (select doc_id, k, x.m, item_id from x join p on x.m = p.m and x.g = p.g),
n as (select doc_id, count(distinct word) as n_hit from (select doc_id, unnest(range(k, k + m)) as word from (select distinct doc_id, k, m from h)) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct doc_id, item_id::varchar as item_id from h) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from d left join n using (doc_id) left join t using (doc_id)""",
    "op3_secret_scan": f"""
with m as ({" union all ".join(_SPANS)}),
s as (
  select doc_id, k, kind, length(sized[i]) as size, length(whole[i]) as len,
         list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i-1], lambda x: length(x))), 0) as start
  from m),
f as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
         string_agg(concat(kind, ':', start::bigint, ':', (start + len)::bigint), ',' order by start, k) as spans
  from s where size >= case kind when 'assign' then 6 when 'access' then 20 else 24 end group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join f using (doc_id)""",
    "op7_warc": """
with p as (select page_id, coalesce(html, '') as html, max(page_id) over (partition by coalesce(html, '')) as first from pages),
h as (select *, sha1(html) as hex from p)
select page_id, strlen(html)::bigint as payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
         1 + ((('0x' || hex[(i // 4) * 5 + 1:(i // 4) * 5 + 5])::bigint >> (15 - 5 * (i % 4))) & 31)::int]), 'string_agg', '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id = first then null else first end as refers_to
from h""",
    "op8_exact_dedup": """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))""",
}
