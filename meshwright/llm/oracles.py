"""SQL (DuckDB) that gives the same rows as the queries that SQL can express whole."""

from __future__ import annotations

from meshwright.llm import quotation

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Near duplicates by 2-word shingles: classes of equal texts, links between classes by shared shingles, components by closure.
OP2 = rf"""
with recursive d as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as t from documents),
texts as (select row_number() over () as c, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from (select distinct t from d)),
shingles as (
    select distinct c, case when len(w) = 1 then [w[1]] else [w[i], w[i + 1]] end as s
    from (select c, w, unnest(range(1, greatest(len(w), 2))) as i from texts where len(w) > 0)
),
sizes as (select c, count(*) as n from shingles group by c),
common as (select a.c as x, b.c as y, count(*) as k from shingles a join shingles b on a.s = b.s and a.c < b.c group by 1, 2),
links as (select x, y from common join sizes p on p.c = x join sizes q on q.c = y where 100 * k >= 80 * (p.n + q.n - k)),
both_ways as (select x, y from links union all select y, x from links),
reach as (select c as x, c as y from sizes union select r.x, l.y from reach r join both_ways l on l.x = r.y),
least as (select t.c, min(d.doc_id) as doc_id from d join texts t on t.t = d.t group by t.c),
roots as (select x as c, min(doc_id) as root from reach join least on least.c = y group by x)
select d.doc_id, coalesce(s.n, 0) as n_shingles, coalesce(r.root, d.doc_id) as component_id, d.doc_id = coalesce(r.root, d.doc_id) as kept
from d join texts t on t.t = d.t left join sizes s on s.c = t.c left join roots r on r.c = t.c
"""


def _normal(x: str) -> str:
    plain = rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    return rf"case when {plain} <> '' then {plain} else regexp_replace({x}, '[ \t\n\x0B\f\r]+', '', 'g') end"


_ATTRIBUTION = quotation.ATTRIBUTION.replace("'", "''")

#: Quotation linking: lines, passages, the latest earlier message with each quoted passage, the best of these, threads.
OP3 = rf"""
with recursive m as (select row_number() over () as rid, conv_id, cast(turn as bigint) as turn, role, coalesce(text, '') as t from conversations),
cut as (select rid, conv_id, turn, unnest(a) as x, generate_subscripts(a, 1) as i from (select rid, conv_id, turn, regexp_split_to_array(t, '\r?\n') as a from m)),
l as (
    select rid, conv_id, turn, i, length(regexp_replace(regexp_extract(x, '{quotation.MARKS}', 1), '[^>]', '', 'g')) as level, regexp_replace(x, '{quotation.MARKS}', '') as body from cut
),
f as (select rid, i, level, body, row_number() over (partition by rid order by i) as at from l where trim(body) <> ''),
nxt as (select l.rid, l.i, arg_min(f.level, f.i) as level from l join f on f.rid = l.rid and f.i between l.i + 1 and l.i + 3 where l.level = 0 and regexp_matches(trim(l.body), '{_ATTRIBUTION}') group by 1, 2),
own as (select l.* from l left join nxt on nxt.rid = l.rid and nxt.i = l.i where l.level = 0 and not coalesce(nxt.level > 0, false)),
bodies as (select rid, string_agg(body, chr(10) order by i) as b from own group by rid),
sides as (select true as said, rid, conv_id, turn, i, 0 as level, body from own where trim(body) <> '' union all select false, rid, conv_id, turn, i, level, body from l where trim(body) <> ''),
steps as (select *, count(*) over (partition by said, rid) as n, case when lag(level) over (partition by said, rid order by i) = level then 0 else 1 end as new from sides),
runs as (select *, sum(new) over (partition by said, rid order by i) as run from steps),
pieces as (
    select said, conv_id, turn, level, body from runs
    union all
    select said, conv_id, turn, level, string_agg(body, ' ' order by i) from runs where n > 1 group by said, rid, conv_id, turn, level, run
),
passages as (select said, conv_id, turn, level, {_normal("body")} as p from pieces where conv_id is not null and turn is not null),
quotes as (select conv_id, turn, level, p, count(*) as n from passages where not said and level > 0 and p <> '' group by all),
says as (select distinct conv_id, turn, p from passages where said and p <> ''),
origins as (select q.conv_id, q.turn, q.level, q.p, q.n, max(s.turn) as origin from quotes q join says s on s.conv_id = q.conv_id and s.p = q.p and s.turn < q.turn group by all),
score as (
    select conv_id, turn, origin,
        coalesce(sum(n) filter (where level = 1 and length(p) >= {quotation.LEAST_CHARS}), 0) as near, coalesce(sum(n) filter (where level = 1 and length(p) < {quotation.LEAST_CHARS}), 0) as near_short,
        coalesce(sum(n) filter (where length(p) >= {quotation.LEAST_CHARS}), 0) as far, coalesce(sum(n) filter (where length(p) < {quotation.LEAST_CHARS}), 0) as far_short
    from origins group by all
),
replies as (
    select conv_id, turn, origin as reply_to from score
    qualify row_number() over (partition by conv_id, turn order by near desc, case when near = 0 then near_short else 0 end desc, far desc, case when far = 0 then far_short else 0 end desc, origin desc) = 1
),
up as (
    select conv_id, turn, reply_to as thread, cast(1 as bigint) as depth from replies
    union all
    select u.conv_id, u.turn, r.reply_to, u.depth + 1 from up u join replies r on r.conv_id = u.conv_id and r.turn = u.thread
),
tops as (select conv_id, turn, arg_max(thread, depth) as thread, max(depth) as depth from up group by all),
counts as (select rid, cast(count(*) filter (where level > 0) as bigint) as n_quoted from l group by rid)
select m.conv_id, m.turn, m.role, r.reply_to, coalesce(t.depth, 0) as depth, coalesce(t.thread, m.turn) as thread, c.n_quoted,
    regexp_replace(regexp_replace(coalesce(b.b, ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \t\n]+|[ \t\n]+$', '', 'g') as text
from m left join bodies b on b.rid = m.rid left join counts c on c.rid = m.rid
left join replies r on r.conv_id = m.conv_id and r.turn = m.turn left join tops t on t.conv_id = m.conv_id and t.turn = m.turn
"""

#: Archives: digests in base32, the largest page_id of each payload.
OP13 = """
with d as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as x from pages),
m as (select x, max(page_id) as original from d group by x),
j as (select d.*, case when page_id is null or page_id < original then original end as refers_to from d join m on m.x = d.x)
select page_id, payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(x, 1 + 5 * (i // 4), 5) as int) >> cast(15 - 5 * (i % 4) as int)) & 31), 1)), '') as payload_digest,
    case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to
from j
"""

#: Source divergence: all pairs of a language's groups over all its kept terms.
OP11 = rf"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as t from documents),
w as (select r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term, count(*) as n_lang from w group by 1, 2 having count(distinct r) >= 30),
langs as (select lang, count(*) as v, cast(sum(n_lang) as bigint) as n_kept from kept group by 1),
groups as (select distinct lang, source from d),
n as (select lang, source, term, count(*) as n from w join kept using (lang, term) group by all),
totals as (select g.lang, g.source, cast(coalesce(sum(n.n), 0) as bigint) + 5 * coalesce(any_value(l.v), 0) as total from groups g left join n using (lang, source) left join langs l on l.lang = g.lang group by 1, 2),
p as (
    select lang, source, term, coalesce(n.n, 0) as n, 1 + cast((cast(1000000000 as hugeint) * (coalesce(n.n, 0) + 5)) // total as bigint) as p,
        1 + cast((cast(1000000000 as hugeint) * (n_lang + 5)) // (n_kept + 5 * v) as bigint) as q
    from totals join kept using (lang) join langs using (lang) left join n using (lang, source, term)
),
sums as (select a.lang, a.source, b.source as item, cast(sum(abs(a.p - b.p)) as bigint) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pairs as (select a.lang, a.source, b.source as item, coalesce(s.value, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
parts as (
    select lang, source, 'pair' as part, item, value from pairs
    union all
    select lang, source, 'term' as part, term as item, p - q as value from p where n > 0 and p > q
),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from parts)
select * from ranked where part = 'pair' or rank <= 50
"""

#: Spelling variants: CRC-32 byte by byte, then all pairs of near words by wildcards and deletions.
OP12 = rf"""
with recursive steps as (select i, i as c, 0 as k from range(256) t(i) union all select i, case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, k + 1 from steps where k < 8),
crc as (select i, c from steps where k = 8),
runs as (select coalesce(cast(doc_id as varchar), '') as d, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) as run from documents),
pairs as (select d, run, count(*) as n from runs where length(run) >= 6 group by 1, 2),
numbered as (select row_number() over () as r, run, n, hex(encode(d || ':' || run)) as x from pairs),
bytes as (
    select r, x, 0 as k, 4294967295 as h from numbered
    union all
    select r, x, k + 1, xor(c, h >> 8) from bytes join crc on i = xor(h, cast('0x' || substr(x, 2 * k + 1, 2) as bigint)) & 255 where 2 * k < length(x)
),
hashed as (select r, xor(h, 4294967295) as h from bytes where 2 * k = length(x)),
words as (
    select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, cast(sum(n) as bigint) as n
    from numbered join hashed using (r) group by 1
    having length(word) >= 6 and sum(n) >= 5
),
places as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
wild as (select word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) as k from places),
fewer as (select distinct word, n, substr(word, 1, i - 1) || substr(word, i + 1) as k from places),
links as (
    select a.word, b.word as other, b.n as m from wild a join wild b on a.k = b.k and a.word <> b.word
    union all select f.word, w.word, w.n from fewer f join words w on w.word = f.k
    union all select w.word, f.word, f.n from fewer f join words w on w.word = f.k
),
best as (select word, count(*) as n_near, arg_min(other, (-m, other)) as other, max(m) as m from links group by 1),
forms as (select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when m >= 5 * n then other end as form, case when m >= 5 * n then m end as form_n from words w left join best b on b.word = w.word),
up as (select word, form as root, 1 as k from forms where form is not null union all select u.word, f.form, k + 1 from up u join forms f on f.word = u.root where f.form is not null),
tops as (select word, arg_max(root, k) as root from up group by 1)
select f.word, form, coalesce(t.root, f.word) as root, n, n_near, form_n from forms f left join tops t on t.word = f.word
"""
