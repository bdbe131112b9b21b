"""DuckDB SQL for the queries of this folder that SQL can express, over whole tables.

Missing: op2 and op4 (a tokenizer), op3 and op8 (fitted models). The tests hold these against brute force.
"""

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

OP1 = rf"""
with recursive w as (
  select doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w
  from documents),
s as (
  select doc_id, case when len(w) = 0 then []
    when len(w) = 1 then [w[1]]
    else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s
  from w),
e as (select doc_id, len(s) as n, unnest(s) as x from s),
shared as (
  select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as n
  from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from shared where 100 * n >= 80 * (na + nb - n)),
both_ways as (select a, b from links union select b, a from links),
reach as (
  select doc_id as node, doc_id as root from documents
  union
  select b.b, r.root from reach r join both_ways b on b.a = r.node where r.root < b.b),
c as (select node, min(root) as component_id from reach group by node)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, c.component_id, s.doc_id = c.component_id as kept
from s join c on c.node = s.doc_id
"""

OP5 = r"""
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as line
  from documents where text is not null),
f as (
  select doc_id, line, content, row_number() over (partition by doc_id order by line) as i, trim(content, ' ') as t
  from l where regexp_matches(content, '[^\x20\x09-\x0D]')),
p as (
  select *, lead(t) over (partition by doc_id order by i) as t2 from f),
m as (
  select *, min((doc_id, i)) over (partition by t, t2) as first from p where t2 is not null),
starts as (select doc_id, i from m where first < (doc_id, i)),
gone as (select doc_id, i from starts union select doc_id, i + 1 from starts),
dead as (select g.doc_id, f.line from gone g join f on f.doc_id = g.doc_id and f.i = g.i),
n as (select doc_id, count(*) as n_lines from f group by doc_id),
r as (select doc_id, count(*) as n_removed from dead group by doc_id),
k as (
  select l.doc_id, string_agg(l.content, chr(10) order by l.line) as kept
  from l anti join dead d on d.doc_id = l.doc_id and d.line = l.line group by l.doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed,
  case when d.text is not null then sha256(coalesce(kept, '')) end as kept_sha256
from documents d left join n using (doc_id) left join r using (doc_id) left join k using (doc_id)
"""

# One shard per source, as at up to 2,048 documents a source.
OP6 = rf"""
with d as (
  select doc_id, source, cast(len({WORDS.format("coalesce(text, '')")}) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (
  select *, 1.0 + (row_number() over (order by source is null, source) - 1) % 3 as weight, 3.0 * source_size as cap from s),
o as (
  select *, cap / weight as level,
    (sum(source_size) over () - coalesce(sum(cap) over rising, 0))
      / (sum(weight) over () - coalesce(sum(weight) over rising, 0)) as share
  from w window rising as (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding)),
rate as (select max(share) as rate from o where share <= level),
t as (select o.source, source_size, cap, cast(least(cap, rate * weight) as double) as target from o, rate),
blocks as (select cast(floor(sum(source_size) / 32.0 + 0.5) as bigint) as n from t),
quotients as (
  select source, target, unnest(range(0, cast(ceil(target / 32.0) + 20 as bigint))) as k from t where target > 0),
won as (
  select source from (
    select source, row_number() over (order by target / (2 * k + 1) desc, source is null, source) as place from quotients)
  where place <= (select n from blocks)),
q as (select source, count(*) as n from won group by source),
quota as (
  select t.source, source_size, target, least(32 * coalesce(q.n, 0), 3 * source_size) as words
  from t left join q on q.source is not distinct from t.source),
placed as (
  select d.doc_id, d.size, u.source_size, u.target, u.words, d.source,
    coalesce(sum(d.size) over (
      partition by d.source order by md5('17:' || d.doc_id), d.doc_id rows between unbounded preceding and 1 preceding), 0) as start
  from d join quota u on u.source is not distinct from d.source)
select doc_id, size, source_size, target, source,
  case when source_size = 0 then 0 else cast(
    (words // source_size) * size + greatest(0, least(size, words % source_size - start)) as bigint) end as taken
from placed
"""

OP7 = rf"""
with w as (select doc_id, {WORDS.format("coalesce(text, '')")} as w from documents),
g as (
  select doc_id, unnest(range(1, len(w) - 11)) as i, w from w where len(w) >= 13),
k as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as x from g),
f as (select x, min(doc_id) as first from k group by x),
starts as (select k.doc_id, k.i from k join f using (x) where f.first < k.doc_id),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as i from starts),
each as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from w),
kept as (
  select each.doc_id, string_agg(x, ' ' order by each.i) as kept
  from each anti join gone on gone.doc_id = each.doc_id and gone.i = each.i group by each.doc_id),
n as (select doc_id, count(*) as n from gone group by doc_id)
select w.doc_id, cast(len(w) as bigint) as n_words, coalesce(n.n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join kept using (doc_id) left join n using (doc_id)
"""

KEYWORD = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
)
ASSIGN = KEYWORD + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _matches(kind: str, number: int, pattern: str, group: int, least: int) -> str:
    return f"""
  select doc_id, source, '{kind}' as kind, {number} as number, unnest(regexp_extract_all(text, '{pattern}')) as m,
    unnest(regexp_extract_all(text, '{pattern}', {group})) as v, {least} as least,
    unnest(string_split_regex(text, '{pattern}')[:-2]) as gap,
    generate_subscripts(regexp_extract_all(text, '{pattern}'), 1) as i
  from documents where regexp_matches(text, '{pattern}')"""


OP9 = f"""
with found as ({" union all ".join((
    _matches("assign", 0, ASSIGN, 2, 6),
    _matches("access", 1, "AKIA[A-Z0-9]+", 0, 20),
    _matches("hex", 2, "[0-9a-f]+", 0, 24),
    _matches("mixed", 3, "[A-Za-z0-9+/_-]{32,}", 0, 32),
))}),
ends as (
  select *, cast(sum(length(gap) + length(m)) over (partition by doc_id, kind order by i) as bigint) as stop from found),
hits as (
  select doc_id, source, kind, number, v, stop - length(m) as start, stop from ends
  where length(v) >= least and (kind <> 'mixed' or (regexp_matches(v, '[A-Z]') and regexp_matches(v, '[a-z]') and regexp_matches(v, '[0-9]')))),
spread as (
  select v, count(distinct coalesce(source, '')) <= 2 and count(distinct doc_id) <= 3 as owned from hits group by v),
judged as (select h.*, owned, kind || ':' || start || ':' || stop as span from hits h join spread using (v)),
r as (
  select doc_id,
    count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    coalesce(string_agg(span, ',' order by start, number) filter (kind <> 'mixed'), '') as base,
    coalesce(string_agg(span, ',' order by start, number) filter (kind <> 'mixed' or owned), '') as spans,
    count(*) filter (owned) as n_owned, count(*) filter (not owned) as n_copied
  from judged group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_owned, 0) as n_owned, coalesce(n_copied, 0) as n_copied
from documents d left join r using (doc_id)
"""

OP10 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
ranked as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

OP11 = r"""
with t as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as w,
    sha256('1:' || doc_id) as h from documents),
r as (
  select *, len(w) as n, [cast('0x' || substr(h, 8 * i + 1, 8) as bigint) for i in range(4)] as g from t),
c as (
  select *, least(g[1] % (n + 1), g[2] % (n + 1)) as a, greatest(g[1] % (n + 1), g[2] % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or g[3] % 100 >= 90 then 'plain'
      when g[4] % 100 < 20 then 'spm' else 'psm' end as form from r),
p as (
  select *, array_to_string(w[1:a], '') as prefix, array_to_string(w[a + 1:b], '') as middle, array_to_string(w[b + 1:], '') as suffix
  from c)
select doc_id, cast(n as bigint) as n, form,
  case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""

# CRC-32 bit by bit. The repair goes through the grammar's states turn by turn: 3 nothing written, 2 after the system turn,
# 1 a user's turn written, 0 an assistant's; per state the cheapest and then least audit is kept.
OP13 = rf"""
with recursive named as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as name
  from conversations),
hashed as (
  select *, xor(list_reduce(
    list_transform(string_split(name, ''), lambda c: cast(ascii(c) as bigint)),
    lambda crc, byte: list_reduce([cast(i as bigint) for i in range(8)],
      lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(crc, byte)), cast(4294967295 as bigint)), 4294967295) % 20 as kind
  from named),
rows as (
  select conv_id, turn, case kind when 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from hashed, unnest(case kind when 0 then [] when 3 then [1, 2] else [1] end) as copies(copy)),
numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text)) as i from rows),
placed as (
  select *, row_number() over (partition by conv_id, role, text order by i) > 1 as again,
    not regexp_matches(text, '[^ 	-
]') as blank,
    right(regexp_replace(text, '[ 	-
]+$', ''), 1) not in ('.', '!', '?') as cut
  from numbered),
marked as (
  select *, left(role, 1) as initial, lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) as pair,
    blank or again as gone, not blank and not again and cut as truncated
  from placed),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
    count(*) filter (again and not blank) as duplicate, count(*) filter (truncated) as truncated,
    count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, max(i) as n
  from marked group by conv_id),
moves(state, inserted, next, written) as (values
  (3, '', 3, ''), (3, 'I', 1, chr(10) || 'user:'), (3, 'II', 0, chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, '', 2, ''), (2, 'I', 1, chr(10) || 'user:'), (2, 'II', 0, chr(10) || 'user:' || chr(10) || 'assistant:'),
  (0, '', 0, ''), (0, 'I', 1, chr(10) || 'user:'), (1, '', 1, ''), (1, 'I', 0, chr(10) || 'assistant:')),
edits(before, edit, after) as (values
  (3, 'D', 3), (2, 'D', 2), (1, 'D', 1), (0, 'D', 0), (3, 'S', 2), (3, 'W', 1), (2, 'W', 1), (0, 'W', 1), (1, 'W', 0)),
steps as (
  select conv_id, 0 as i, 3 as state, {{'cost': 0, 'audit': '', 'text': ''}} as best from counts
  union all
  select s.conv_id, s.i + 1, e.after, min({{
    'cost': s.best.cost + 3 * length(m.inserted) + case edit when 'D' then 4 when 'S' then 0
      else case when r.initial = case e.before when 1 then 'a' else 'u' end then 0 else 3 end end
      + case when edit <> 'D' and truncated then 3 else 0 end,
    'audit': s.best.audit || m.inserted || case edit when 'D' then 'D' when 'S' then 'K'
      else case when r.initial = case e.before when 1 then 'a' else 'u' end then 'K' else 'R' end end,
    'text': s.best.text || m.written || case edit when 'D' then '' when 'S' then chr(10) || r.role || ':' || r.text
      else chr(10) || case when r.initial = case e.before when 1 then 'a' else 'u' end then r.role
        when e.before = 1 then 'assistant' else 'user' end || ':' || r.text end}})
  from steps s join marked r on r.conv_id is not distinct from s.conv_id and r.i = s.i + 1
    join moves m on m.state = s.state join edits e on e.before = m.next
  where (edit = 'D' or not gone) and (edit <> 'S' or r.initial = 's')
  group by s.conv_id, s.i, e.after),
ends as (
  select s.conv_id, min({{'cost': s.best.cost + 3 * length(m.inserted), 'audit': s.best.audit || m.inserted,
    'text': s.best.text || m.written}}) as best
  from steps s join counts c on c.conv_id is not distinct from s.conv_id and c.n = s.i join moves m on m.state = s.state
  where m.next in (0, 3) group by s.conv_id)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cast(coalesce(best.cost, 0) as bigint) as cost,
  coalesce(best.audit, '') as audit, sha256(coalesce(substr(best.text, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) o
  left join counts c on c.conv_id is not distinct from o.conv_id left join ends e on e.conv_id is not distinct from o.conv_id
"""

ORACLES = {
    "op1_near_dedup": OP1,
    "op5_line_dedup": OP5,
    "op6_mixing": OP6,
    "op7_substrings": OP7,
    "op9_secrets": OP9,
    "op10_top_k": OP10,
    "op11_fill_middle": OP11,
    "op13_conversations": OP13,
}
