"""DuckDB texts of the operators on conversations and pages."""

ORACLES: dict[str, str] = {}


def crc32(text: str) -> str:
    """SQL of the CRC-32 of an ASCII text, a bit at a time: each byte is followed by eight shifts (-1)."""
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [cast(ascii(substr({text}, cast(i as int), 1)) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "case when s >= 0 then xor(c, s) when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    return f"xor(list_reduce(list_concat([cast(4294967295 as bigint)], {steps}), lambda c, s: {step}), 4294967295)"


def add(state: str, cost: str | int, letters: str) -> str:
    """SQL of a state's least string with an edit put in front."""
    return f"lpad(cast(cast(substr({state}, 1, 10) as bigint) + {cost} as varchar), 10, '0') || '{letters}' || substr({state}, 11)"


# The audit of a conversation's last rows is known before that of one more row: rows are taken from the last to the first, with the least
# (cost, audit) for each state of the grammar, the cost written in ten digits so that the least string is the answer.
ORACLES["op11_conversation_repair"] = rf"""
with recursive src as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32('name')} % 20 as k
  from (select *, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as name from conversations)),
rows as (
  select conv_id, turn, copy, case when k = 4 then 'user' else role end as role,
    case when k = 1 then '' when k = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from src, unnest(case when k = 0 then [] when k = 3 then [0, 1] else [0] end) as t(copy)),
seen as (
  select *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as solid,
    row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as pos,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth from rows),
fault as materialized (
  select conv_id, turn, role, text, pos, substr(role, 1, 1) as i, solid = '' as blank, solid <> '' and nth > 1 as dup,
    solid <> '' and nth = 1 and right(solid, 1) not in ('.', '!', '?') as trunc from seen),
ids as (select distinct conv_id from conversations),
n as (select ids.conv_id, count(pos) as n from ids left join fault using (conv_id) group by all),
dp(conv_id, pos, q0, q1, q2, q3) as (
  select conv_id, n, '0000000000', '0000000004II', '0000000002I', '0000000000' from n
  union all
  select conv_id, pos - 1, least(b0, {add('b2', '2', 'I')}, {add('b3', '4', 'II')}), least(b1, {add('b2', '2', 'I')}, {add('b3', '4', 'II')}),
    least(b2, {add('b3', '2', 'I')}), least(b3, {add('b2', '2', 'I')})
  from (select dp.conv_id, dp.pos,
      least({add('q0', '3', 'D')}, case when must then null when i = 's' then {add('q1', 't', 'K')} when i = 'u' then {add('q2', 't', 'K')} end, case when not must then {add('q2', '2 + t', 'R')} end) as b0,
      least({add('q1', '3', 'D')}, case when must then null when i = 'u' then {add('q2', 't', 'K')} end, case when not must then {add('q2', '2 + t', 'R')} end) as b1,
      least({add('q2', '3', 'D')}, case when must then null when i = 'a' then {add('q3', 't', 'K')} end, case when not must then {add('q3', '2 + t', 'R')} end) as b2,
      least({add('q3', '3', 'D')}, case when must then null when i = 'u' then {add('q2', 't', 'K')} end, case when not must then {add('q2', '2 + t', 'R')} end) as b3
    from dp join (select *, blank or dup as must, cast(trunc as int) as t from fault) f on f.conv_id = dp.conv_id and f.pos = dp.pos)),
best as (select conv_id, cast(substr(q0, 1, 10) as bigint) as cost, substr(q0, 11) as audit from dp where pos = 0),
letter as (
  select conv_id, audit, j, substr(audit, j, 1) as e from best, unnest(range(1, length(audit) + 1)) as u(j)),
placed as (
  select *, count(*) filter (where e <> 'I') over w as pos, count(*) filter (where e <> 'D') over w as m
  from letter window w as (partition by conv_id order by j)),
lined as (
  select p.conv_id, p.j, p.e, p.m, f.role, f.text, max(case when p.m = 1 and p.e = 'K' and f.i = 's' then 1 else 0 end) over (partition by p.conv_id) as off
  from placed p left join fault f on p.e <> 'I' and f.conv_id = p.conv_id and f.pos = p.pos),
text as (
  select conv_id, string_agg(case e when 'K' then role || ':' || text else case when (m - off) % 2 = 1 then 'user:' else 'assistant:' end
    || case when e = 'R' then text else '' end end, chr(10) order by j) as body from lined where e <> 'D' group by conv_id),
pair as (select conv_id, i || lead(i) over (partition by conv_id order by pos) as p from fault),
bad as (select conv_id, count(*) filter (where p not in ('su', 'ua', 'au')) as illegal from pair group by conv_id),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where blank) as blank,
    count(*) filter (where dup) as duplicate, count(*) filter (where trunc) as truncated from fault group by conv_id)
select conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, cost, audit, sha256(coalesce(body, '')) as repaired_sha256
from best left join counts using (conv_id) left join bad using (conv_id) left join text using (conv_id)
"""

ORACLES["op12_prefix_trie"] = rf"""
with turn as materialized (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos
  from conversations where conv_id is not null),
conv as (select conv_id, conv_id - conv_id % 20 as base, case when conv_id % 20 = 0 then 0 else {crc32('name')} % 4 end as h
  from (select distinct conv_id, cast(conv_id as varchar) as name from turn)),
rebuilt as (
  select c.conv_id, 0 as part, t.pos, t.role, t.text from conv c join turn t on t.conv_id = c.base and t.pos <= c.h
  union all select c.conv_id, 1, t.pos, t.role, t.text from conv c join turn t on t.conv_id = c.conv_id and t.pos > c.h),
path as (
  select conv_id, row_number() over w as depth, string_agg(sha256(strlen(role) || ':' || role || text), '/') over w as node,
    len(regexp_extract_all(text, '[^ 	-
]+')) as words
  from rebuilt window w as (partition by conv_id order by part, pos)
  union all select conv_id, 0, '', 0 from conv),
step as materialized (
  select conv_id, depth, node, words, depth = max(depth) over (partition by conv_id) as ends, lag(node) over (partition by conv_id order by depth) as parent from path),
node as materialized (
  select node, min(depth) as depth, min(parent) as parent, min(conv_id) as conv_id, count(*) as n_convs, min(words) as words,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ends), '')) as ends_sha256
  from step group by node),
child as (select parent as node, count(*) as n_children from node where parent is not null group by parent),
above as (select distinct d.node as below, a.node as node from step a join step d on a.conv_id = d.conv_id and a.depth <= d.depth),
total as (
  select above.node, count(*) filter (where n_children is null) as n_leaves, cast(sum((n_convs - 1) * words) as bigint) as saved_tokens
  from above join node b on b.node = below left join child c on c.node = below group by above.node)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, n_leaves, saved_tokens, n.ends_sha256
from node n join total t on t.node = n.node left join child c on c.node = n.node left join node p on p.node = n.parent
"""

ORACLES["op13_warc"] = rf"""
with page as (select page_id, coalesce(html, '') as html from pages),
page_group as (select html, max(page_id) as top, sha1(html) as hex from page group by html)
select p.page_id, strlen(p.html) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast((cast('0x' || substr(hex, cast(5 * (i // 4) + 1 as bigint), 5) as bigint) >> cast(15 - 5 * (i % 4) as bigint)) & 31 as bigint) + 1, 1)), '') as payload_digest,
  case when p.page_id = top then 'response' else 'revisit' end as record_type, case when p.page_id <> top then top end as refers_to
from page p join page_group g on g.html = p.html
"""
