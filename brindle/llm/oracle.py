"""SQL (DuckDB) for those of the ten queries that SQL can express."""

from __future__ import annotations

OP1 = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b)::bigint as n, upper(sha1(b)) as h from p),
e as (select page_id, n, array_to_string(flatten(list_transform(range(8), lambda j: list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, 5 * j::int + 1, 5))::int >> s) & 31) + 1)::int, 1)))), '') as digest from d),
m as (select *, max(page_id) over (partition by digest) as last from e)
select page_id, n as payload_bytes, digest as payload_digest, case when page_id = last then 'response' else 'revisit' end as record_type,
    case when page_id <> last then last end as refers_to
from m
"""

OP2 = """
with recursive x as materialized (select vec_id, embedding::double[] as v, sqrt(list_dot_product(embedding::double[], embedding::double[])) as norm from embeddings),
link as materialized (select a.vec_id as a, b.vec_id as b from x a, x b
    where a.vec_id <> b.vec_id and a.norm > 0 and b.norm > 0 and list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95),
reach as (select a, b from link union select r.a, l.b from reach r join link l on l.a = r.b),
root as (select a, min(b) as least from reach group by a),
degree as (select a, count(*) as n from link group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(root.least, vec_id))::bigint as component_id, vec_id <= coalesce(root.least, vec_id) as kept
from x left join root on root.a = vec_id left join degree on degree.a = vec_id
"""

#: Targets by water-filling, queues in order of MD5 tickets, copies by finish time as long as their words fit the budget.
OP3 = r"""
with docs as materialized (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
per as (select source, sum(size)::bigint as source_size from docs group by source),
w as (select *, [1.0, 2.0, 3.0][((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1)::int]::double as weight, 3 * source_size as cap from per),
lv as (select *, ((sum(source_size) over () - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0))::double
    / sum(weight) over (o rows between current row and unbounded following)) as level from w window o as (order by cap / weight, encode(source) nulls last)),
st as (select *, (select arg_min(level, (cap / weight, coalesce(source, chr(1114111)))) from lv where cap >= weight * level) as fixed from lv),
t as (select source, source_size, least(cap::double, weight * coalesce(fixed, 'infinity'::double)) as target from st),
q as (select d.*, t.source_size, t.target, md5('20240607:' || d.doc_id) as ticket from docs d join t on t.source is not distinct from d.source),
s as (select *, sum(size) over (partition by source order by ticket, doc_id, size rows unbounded preceding) as done from q),
c as (select *, unnest([0, 1, 2]) as pass_no from s where size > 0),
f as (select *, (done + pass_no * source_size)::double / target as finish from c),
r as (select *, sum(size) over (order by finish, source nulls last, ticket, doc_id, pass_no, size rows unbounded preceding) as ran from f),
sent as (select doc_id, sum(size)::bigint as taken from r where ran <= (select round(sum(target)) from t) group by doc_id)
select q.doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken from q left join sent using (doc_id)
"""

OP9 = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(14 + length(regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g')) + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')))::bigint as formatted_chars
from turns group by conv_id
"""

OP10 = """
with x as materialized (select vec_id, list_transform(embedding, lambda c: floor(c::double * 64)) as v from embeddings),
s as (select q.vec_id as query_id, x.vec_id, list_dot_product(q.v, x.v)::bigint as score from x as q, x where q.vec_id % 20 = 0 and x.vec_id <> q.vec_id),
r as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""

SQL = {"op1_warc": OP1, "op2_near_vectors": OP2, "op3_mix_sources": OP3, "op9_chat_format": OP9, "op10_top_k": OP10}
