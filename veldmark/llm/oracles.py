"""SQL for the results of queries that SQL can express, to be run on small tables."""

from __future__ import annotations

from .decontamination import UNITS

# Every window of 35 words that occurs twice, and the words under it.
SUBSTRING_DEDUP = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
starts as (select r, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35),
win as (select r, i, array_to_string(list_slice(w, i, i + 34), ' ') as words from starts),
rep as (select r, i from win qualify count(*) over (partition by words) > 1),
gone as (select distinct r, i + k as j from rep, range(0, 35) as t(k)),
word as (select r, unnest(w) as x, generate_subscripts(w, 1) as j from d),
kept as (select r, count(*) as n, string_agg(x, ' ' order by j) as s from word anti join gone using (r, j) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(s, '')) as kept_sha256
from d left join kept using (r)
"""

# All pairs that share a shingle, counted; components by closure of the links.
JACCARD_JOIN = r"""
with recursive d as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
starts as (select r, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0),
s as (select distinct r, array_to_string(list_slice(w, i, i + 4), ' ') as x from starts),
n as (select r, count(*) as n from s group by r),
common as (select a.r as a, b.r as b, count(*) as m from s a join s b on a.x = b.x and a.r <> b.r group by 1, 2),
link as (select a, b from common join n na on na.r = a join n nb on nb.r = b where 100 * m >= 75 * (na.n + nb.n - m)),
reach(a, b) as (select r, r from d union select reach.a, link.b from reach join link on link.a = reach.b),
least as (select a as r, min(doc_id) as component_id from reach join d on d.r = reach.b group by a)
select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id from d left join n using (r) join least using (r)
"""

# A pair parts at one of its assistant turns; what both sides share is told by comparing turn after turn.
PREFERENCE_FORMAT = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
o as (select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from t),
p as (select conv_id, i, row_number() over (partition by conv_id order by i) - 1 as j from o where role = 'assistant'),
n as (select conv_id, count(*) as n from p group by 1),
k as (select a.conv_id, b.conv_id as other, (a.conv_id >> 1) % a.n as j, least((a.conv_id >> 1) % a.n, b.n - 1) as oj from n a join n b on (a.conv_id >> 1) = (b.conv_id >> 1) and a.conv_id <> b.conv_id),
cut as (select k.conv_id, other, p.i as cut_at, q.i as go_on from k join p on p.conv_id = k.conv_id and p.j = k.j join p q on q.conv_id = other and q.j = oj),
side as (
  select 'c' as side, cut.conv_id, i, role, text from cut join o using (conv_id)
  union all select 'r', cut.conv_id, i, role, text from cut join o using (conv_id) where i < cut_at
  union all select 'r', cut.conv_id, i - go_on + cut_at, role, text from cut join o on o.conv_id = other where i >= go_on),
differ as (
  select conv_id, min(i) as i from (select * from side where side = 'c') c full join (select * from side where side = 'r') r using (conv_id, i)
  where c.role is distinct from r.role or c.text is distinct from r.text group by 1),
x as (
  select s.*, d.i - 1 as shared, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as rendered, length(role) + 5 as head, length(role) + length(text) + 13 as len,
    case when role = 'assistant' then ':1' else ':0' end as train from side s join differ d using (conv_id)),
y as (select *, sum(len) over (partition by conv_id, side, i > shared order by i) - len as start from x),
z as (select *, start || ':' || start + head || ':0,' || start + head || ':' || start + len || train as mask from y)
select conv_id, cast(max(shared) as integer) as n_shared, coalesce(string_agg(rendered, '' order by i) filter (where side = 'c' and i <= shared), '') as prompt,
  coalesce(string_agg(rendered, '' order by i) filter (where side = 'c' and i > shared), '') as chosen_completion, coalesce(string_agg(mask, ',' order by i) filter (where side = 'c' and i > shared), '') as chosen_mask,
  coalesce(string_agg(rendered, '' order by i) filter (where side = 'r' and i > shared), '') as rejected_completion, coalesce(string_agg(mask, ',' order by i) filter (where side = 'r' and i > shared), '') as rejected_mask
from z group by conv_id
"""

# The base patterns of secrets: pieces between matches and the matches tell where each lies.
SECRET_SPANS = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
f as (
  select r, t, 'assign' as kind, 0 as k, string_split_regex(t, '(?i)(password|passwd|secret|token|api_?key)["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)') as p,
    regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)') as v from d
  union all select r, t, 'access', 1, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') from d
  union all select r, t, 'hex', 2, string_split_regex(t, '[0-9a-f]{24,}'), regexp_extract_all(t, '[0-9a-f]{24,}') from d),
m as (select r, kind, k, p, v, unnest(range(1, len(v) + 1)) as i from f where len(v) > 0),
s as (
  select r, kind, k, v[i] as x, list_sum(list_transform(list_slice(p, 1, i), lambda y: length(y))) + coalesce(list_sum(list_transform(list_slice(v, 1, i - 1), lambda y: length(y))), 0) as start from m),
g as (
  select *, start + length(x) as stop from s
  where case kind when 'assign' then length(regexp_extract(x, '(?i)(password|passwd|secret|token|api_?key)["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)', 2)) >= 6 when 'access' then length(x) >= 20 else true end),
a as (
  select r, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
    string_agg(kind || ':' || cast(start as bigint) || ':' || cast(stop as bigint), ',' order by start, k) as spans from g group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(spans, '')) as base_sha256 from d left join a using (r)
"""

# The counts of the quality rules and what the base rules make of them.
QUALITY_COUNTS = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents),
starts as (select r, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3),
again as (select r, i from (select r, i, array_to_string(list_slice(w, i, i + 2), ' ') as x from starts) qualify count(*) over (partition by r, x) > 1),
covered as (select r, count(distinct i + k) as n from again, range(0, 3) as t(k) group by r),
c as (
  select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars, cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(coalesce(n, 0) as bigint) as n_repeat_words from d left join covered using (r))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c
"""

# Targets of sources: none above three times its size, the rest by weight.
MIXING_TARGETS = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
s as (select source, sum(size) as source_size from d group by 1),
w as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight, sum(source_size) over () as total from s),
f as (select *, row_number() over (order by 3.0 * source_size / weight, source nulls last) as rank from w),
l as (select *, (total - coalesce(sum(3 * source_size) over (order by rank rows between unbounded preceding and 1 preceding), 0)) / cast(sum(weight) over (order by rank rows between current row and unbounded following) as double) as level from f),
t as (select *, (select level from l where level <= 3.0 * source_size / weight order by rank limit 1) as last from l)
select doc_id, cast(size as bigint) as size, cast(source_size as bigint) as source_size, round(least(3.0 * source_size, last * weight), 3) as target from d join t on d.source is not distinct from t.source
"""

# Windows of 8 tokens of items that have so many (in the driver's tables all have): joined, laid on their documents, and judged run by run.
DECONTAMINATION = r"""
with docs as (select row_number() over () as r, doc_id, text from (select distinct doc_id, text from documents)),
texts as (select 'd' as side, r, text from docs union all select 'i', item_id, text from benchmark),
words as (select side, r, regexp_extract_all(regexp_replace(coalesce(text, ''), '[\x01.,;:!?"\x27()\[\]{}…«»“”‘’`]', '', 'g'), '[^\x20\x09-\x0D]+') as w from texts),
word as (select side, r, unnest(w) as w, generate_subscripts(w, 1) as i from words),
kind as (select *, case when regexp_matches(w, '^\p{Lu}\p{Ll}') then '@' when regexp_matches(w, '^[^\p{L}\p{N}]{0,3}[0-9]') then '#' end as k from word),
tok as (
  select side, r, i, lower(w) as v, case when k is not null then chr(1) || k when lag(k) over (partition by side, r order by i) = '#' and regexp_matches(w, '^(?i:UNITS)$') then chr(1) || '%' else lower(w) end as t from kind),
lists as (select side, r, list(t order by i) as ts, list(v order by i) as vs from tok group by 1, 2),
starts as (select side, r, ts, vs, unnest(range(1, len(ts) - 6)) as q from lists where len(ts) >= 8),
win as (select side, r, q, list_slice(ts, q, q + 7) as wt, list_slice(vs, q, q + 7) as wv from starts),
iw as (
  select r as item, q, wt, wv, len(list_distinct(list_filter(wt, lambda x: not contains(x, chr(1))))) >= 4 as said, len(list_distinct(wv)) >= 4 as told,
    list_filter(list_transform(range(1, 9), lambda j: case when contains(wt[j], chr(1)) then wv[j] end), lambda x: x is not null) as slots from win where side = 'i'),
keys as (
  select item, q, 't' as kind, array_to_string(wt, ' ') as key, array_to_string(list_transform(slots, lambda x: cast(list_position(slots, x) as varchar)), ',') as pattern from iw where said
  union all select item, q, 'v', array_to_string(wv, ' '), '' from iw where told),
own as (select * from keys qualify row_number() over (partition by kind, key, pattern order by item, q) = 1),
dw as (select r, q, 't' as kind, array_to_string(wt, ' ') as key from win where side = 'd' union all select r, q, 'v', array_to_string(wv, ' ') from win where side = 'd'),
laid as (select distinct dw.r, item, dw.q - own.q as shift from dw join own using (kind, key)),
al as (
  select l.r, l.item, l.shift, a.i as x, a.t, a.v, b.v as dv, a.t = b.t as st, a.v = b.v as sv from laid l join tok a on a.side = 'i' and a.r = l.item join tok b on b.side = 'd' and b.r = l.r and b.i = a.i + l.shift where a.t = b.t or a.v = b.v),
run as (select *, x - row_number() over (partition by r, item, shift order by x) as g from al),
pure as (
  select *, sum(cast(st as int)) over f as nt, sum(cast(sv as int)) over f as nv from run window f as (partition by r, item, shift, g order by x rows between current row and 7 following)),
seen as (select p.*, coalesce(said and nt = 8, false) as is_t, coalesce(told and nv = 8, false) as is_v from pure p left join iw on iw.item = p.item and iw.q = p.x),
judged as (
  select r, item, shift, g, count(*) as matched, count(*) filter (is_t or is_v) as n_windows, count(distinct (v, dv)) filter (contains(t, chr(1))) as n_slots, count(distinct v) filter (contains(t, chr(1))) as n_values, bool_and(sv) as equal, bool_or(is_v) as verbatim
  from seen group by 1, 2, 3, 4 having count(*) filter (is_t or is_v) > 0),
j as (select *, n_slots = n_values as consistent, equal or (n_slots <> n_values and verbatim) as exact from judged),
p as (select r, item, shift, sum(n_windows) as n_windows, max(matched) as matched, sum(n_slots) as n_slots, bool_or(exact) as exact, bool_or(consistent) as consistent from j group by 1, 2, 3)
select doc_id, item as item_id, cast(sum(n_windows) as bigint) as n_windows, cast(max(matched) as bigint) as n_matched, round(max(matched / len(ts)), 6) as coverage, cast(max(n_slots) as bigint) as n_slots, bool_or(exact) as exact, bool_or(consistent) as consistent
from p join docs using (r) join lists on side = 'i' and lists.r = item group by docs.r, doc_id, item
""".replace("UNITS", UNITS)
