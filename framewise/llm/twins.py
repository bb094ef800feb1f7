"""The conversation repair and the Merkle manifest in DuckDB's SQL, by plain recursion."""

from __future__ import annotations

from . import repair


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text of ASCII characters, bit by bit."""
    bits = "list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda z: cast(0 as bigint))), lambda x, z: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)"
    return f"xor(list_reduce(list_concat([cast(4294967295 as bigint)], list_transform(string_split({text}, ''), lambda t: cast(ascii(t) as bigint))), lambda c, b: {bits}), 4294967295)"


def _arcs_sql() -> str:
    """Every edit of a row with what is inserted before it: the place before, the place after, edits, cost, and the initial
    that the row must have for it to be kept."""
    rows = []
    for place in range(4):
        for n, p in repair.inserted(place):
            cost = n * repair.INSERT
            rows.append(f"({place}, {p}, '{'I' * n}D', {cost + repair.DELETE}, null)")
            rows += [f"({place}, {to[p]}, '{'I' * n}K', {cost}, '{initial}')" for initial, to in repair.LEADS.items() if p in to]
            rows += [f"({place}, {repair.LEADS[r][p]}, '{'I' * n}R', {cost + repair.REROLE}, null)" for r in "ua" if p in repair.LEADS[r]]
    return ", ".join(rows)


OP11 = f"""with recursive raw as (select conv_id, turn, {crc32_sql("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as lot, coalesce(role, ' ') as role, coalesce(text, ' ') as text from conversations),
dam as (select conv_id, turn, case when lot = 4 then 'user' else role end as role, case when lot = 1 then '' when lot = 2 then translate(text, '.!?', '') else text end as text, unnest(range(case when lot = 0 then 0 when lot = 3 then 2 else 1 end)) as copy from raw),
num as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as again, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as core from dam),
flt as (select *, left(role, 1) as ini, case when core = '' then 'blank' when again then 'duplicate' when right(core, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault from num),
arcs(p, q, edits, cost, ini) as (values {_arcs_sql()}),
best as (select conv_id, max(i) as i, p, any_value(cost) as cost, any_value(audit) as audit from flt, (values (0, 0, ''), (1, {2 * repair.INSERT}, 'II'), (2, {repair.INSERT}, 'I'), (3, 0, '')) as e(p, cost, audit) group by conv_id, p
 union all select conv_id, i - 1, p, m.c, m.a from (select f.conv_id, f.i, a.p, min({{'c': b.cost + a.cost + case when f.fault = 'truncated' and right(a.edits, 1) <> 'D' then {repair.CUT_OFF} else 0 end, 'a': a.edits || b.audit}}) as m
 from best b join flt f on f.conv_id is not distinct from b.conv_id and f.i = b.i join arcs a on a.q = b.p and (right(a.edits, 1) = 'D' or f.fault not in ('blank', 'duplicate')) and (a.ini is null or a.ini = f.ini) group by 1, 2, 3)),
won as (select conv_id, cost, audit from best where i = 0 and p = 0),
let as (select conv_id, audit, unnest(string_split(audit, '')) as letter, unnest(range(1, length(audit) + 1)) as k from won where audit <> ''),
pos as (select *, count(*) filter (letter in ('D', 'K', 'R')) over (partition by conv_id order by k) as i, count(*) filter (letter <> 'D') over (partition by conv_id order by k) - 1 as j, count(*) filter (letter <> 'D') over (partition by conv_id) % 2 as opened from let),
fix as (select l.conv_id, string_agg(case when letter = 'K' then f.role when (j - opened) % 2 = 0 then 'user' else 'assistant' end || ':' || case when letter = 'I' then '' else f.text end, chr(10) order by k) as said
 from pos l left join flt f on f.conv_id is not distinct from l.conv_id and f.i = l.i where letter <> 'D' group by 1),
adj as (select conv_id, ini, lag(ini) over (partition by conv_id order by i) as before, turn, fault from flt),
cnt as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated, count(*) filter (before is not null and before || ini not in ('su', 'ua', 'au')) as illegal from adj group by 1)
select o.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cast(coalesce(cost, 0) as bigint) as cost, coalesce(w.audit, '') as audit, sha256(coalesce(said, '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join cnt c on c.conv_id is not distinct from o.conv_id left join won w on w.conv_id is not distinct from o.conv_id left join fix x on x.conv_id is not distinct from o.conv_id"""


def _field(value: str) -> str:
    return f"coalesce(strlen(cast({value} as varchar)) || ':' || {value}, '-')"


_REST = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
#: A leaf's way up has its steps in its source's tree, then those in the tree of the sources; ``fold`` walks both.
OP12 = f"""with recursive lot as (select *, case when {crc32_sql("cast(doc_id as varchar)")} % 5 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as shown from documents),
hashed as (select doc_id, source, sha256({_REST} || {_field("text")}) as leaf, sha256({_REST} || {_field("shown")}) as shown from lot),
leaf as (select *, dense_rank() over (order by source nulls first) - 1 as g, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i, row_number() over () as id from hashed),
low(g, level, i, h, n) as (select g, 0, i, leaf, count(*) over (partition by g) from leaf union all select g, level + 1, i // 16, sha256(string_agg(h, '' order by i)), (n + 15) // 16 from low where n > 1 group by g, level, i // 16, n),
sub as (select g, h from low where n = 1),
high(level, i, h, n) as (select 0, g, h, count(*) over () from sub union all select level + 1, i // 16, sha256(string_agg(h, '' order by i)), (n + 15) // 16 from high where n > 1 group by level, i // 16, n),
step as (select id, level, string_agg(h, '' order by o.i) filter (o.i < a) as before, string_agg(h, '' order by o.i) filter (o.i > a) as after from (select id, l.g, level, l.i // cast(pow(16, level) as bigint) as a from leaf l join (select distinct g, level from low where n > 1) d on d.g = l.g) l join low o using (g, level) where o.n > 1 and o.i // 16 = a // 16 group by id, level
 union all select id, 100 + level, string_agg(h, '' order by o.i) filter (o.i < a), string_agg(h, '' order by o.i) filter (o.i > a) from (select id, level, g // cast(pow(16, level) as bigint) as a from leaf, (select distinct level from high where n > 1)) l join high o using (level) where o.n > 1 and o.i // 16 = a // 16 group by id, level),
way as (select id, coalesce(before, '') as before, coalesce(after, '') as after, row_number() over (partition by id order by level) as k from step),
proof as (select id, sha256(string_agg(before || after, '' order by k)) as proof from way group by 1),
fold(id, k, h) as (select id, cast(0 as bigint), shown from leaf union all select f.id, f.k + 1, sha256(before || h || after) from fold f join way w on w.id = f.id and w.k = f.k + 1)
select l.doc_id, l.leaf, s.h as subroot, r.h as root, coalesce(p.proof, sha256('')) as proof_sha256, f.folded as folded_root, f.folded = r.h as verified
from leaf l join sub s using (g) join (select h from high where n = 1) r on true left join proof p using (id) join (select id, arg_max(h, k) as folded from fold group by 1) f using (id)"""
