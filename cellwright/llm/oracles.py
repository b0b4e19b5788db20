"""DuckDB SQL for the queries that SQL can express, over the same whole tables."""

from __future__ import annotations

from . import lines, manifest, mixing, quality

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINES = f"""
with docs as (select row_number() over () as rid, doc_id, coalesce(source, chr(1)) as site, text from documents),
pieces as (select rid, doc_id, site, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from docs where text is not null),
marked as (select *, trim(line, {_SPACES}) as t from pieces),
spread as (select t, min(doc_id) as first_doc from marked where t <> '' group by t having count(distinct site) >= {lines.MIN_SITES}),
firsts as (select m.t, m.doc_id, min(m.pos) as pos from marked m join spread s on m.t = s.t and m.doc_id = s.first_doc group by 1, 2),
judged as (select m.*, s.t is not null and not (m.doc_id = s.first_doc and m.pos = f.pos) as gone from marked m left join spread s on m.t = s.t left join firsts f on f.t = m.t)
select d.doc_id, coalesce(j.n_lines, 0) as n_lines, coalesce(j.n_removed, 0) as n_removed, sha256(coalesce(j.kept, '')) as text_sha256
from docs d left join (
  select rid, count(*) filter (t <> '') as n_lines, count(*) filter (gone) as n_removed, string_agg(line, chr(10) order by pos) filter (not gone) as kept from judged group by rid
) j on j.rid = d.rid
"""

_WEIGHTS = "[" + ", ".join(f"{float(w)}" for w in mixing.WEIGHTS) + "]"
_FORTY_EIGHT = "cast('0x' || substr(md5({}), 1, 12) as bigint)"

MIX = f"""
with sized as (select doc_id, source, cast(len({_WORDS}) as bigint) as size, md5(coalesce(text, '')) as text_key from documents),
per as (select source, sum(size)::bigint as source_size from sized group by source),
named as (select *, {_WEIGHTS}[cast((row_number() over (order by source nulls last) - 1) % {len(mixing.WEIGHTS)} + 1 as int)] as weight, {float(mixing.MOST_COPIES)}::double * source_size as cap from per),
leveled as (select *, ({mixing.TOTAL_SHARE}::double * (sum(source_size) over ())::double - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0::double)) / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level from named),
target as (select source, source_size, least(cap, coalesce((select arg_min(level, cap / weight) from leveled where cap >= level * weight) * weight, cap)) as target from leveled),
keyed as (select *, {_FORTY_EIGHT.format(f"'{mixing.SEED}:' || coalesce(doc_id::varchar, '-') || ':' || text_key")} as h, length(bin(greatest(size, 1))) - 1 as width from sized),
stepped as (select *, width * {1 << mixing.STEP_BITS} + (((size << {mixing.STEP_BITS}) >> width) & {(1 << mixing.STEP_BITS) - 1}) as step from keyed),
ranked as (select *, row_number() over (partition by source order by step, h, doc_id, text_key) as nth from stepped),
rated as (select r.*, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0 end as rate, {_FORTY_EIGHT.format(f"'{mixing.SEED}/' || coalesce(r.source, '')")} / {float(1 << 48)!r}::double as u from ranked r join target t on r.source is not distinct from t.source),
copied as (select *, cast(least({mixing.MOST_COPIES}, floor(nth * rate + u) - floor((nth - 1) * rate + u)) as int) as copies from rated)
select doc_id, size, source_size, target, cast(copies * size as bigint) as taken, copies from copied
"""


def _left(text: str, taken: int) -> str:
    for one in quality.CLASSES[:taken]:
        text = f"regexp_replace({text}, '{one.replace(chr(39), chr(39) * 2)}', '', 'g')"
    return text


def _term(p: str, q: str) -> str:
    part = lambda x: f"(case when {x} > 0 then {x} * log2({x} / (({p} + {q}) / 2)) else 0 end)"
    return f"({part(p)} + {part(q)}) / 2"


_KNOWN = ", ".join(f"'{lang}'" for lang in quality.COMMON_WORDS)
_VOCABULARY = ", ".join("'" + w.replace("'", "''") + "'" for w in quality.VOCABULARY)
_N = len(quality.CLASSES)

QUALITY = f"""
with docs as (select row_number() over () as rid, doc_id, lang, coalesce(text, '') as text from documents),
lengths as (select *, {_WORDS} as words, [{', '.join(f'length({_left("text", i)})' for i in range(_N + 1))}] as lens from docs),
based as (select rid, doc_id, case when lang in ({_KNOWN}) then lang end as ref, text, words, len(words) as n_words, lens[1] as n_all, [{', '.join(f'lens[{i + 1}] - lens[{i + 2}]' for i in range(_N))}, lens[{_N + 1}]] as chars from lengths),
windows as (select rid, unnest(range(len(words) - {quality.WINDOW - 1})) as nth, words from based where len(words) > {quality.WINDOW}),
keyed as (select rid, nth, count(*) over (partition by rid, array_to_string(words[nth + 1 : nth + {quality.WINDOW}], ' ')) as times from windows),
covered as (select rid, count(distinct pos) as n from (select rid, unnest(range(nth, nth + {quality.WINDOW})) as pos from keyed where times > 1) group by 1),
failing as (select b.rid from based b left join covered c on c.rid = b.rid where b.n_words < {quality.MIN_WORDS_BASE} or 100 * coalesce(c.n, 0) > {quality.REPEAT_PERCENT} * b.n_words),
tokens as (select rid, lower(unnest(words)) as w from based),
commons as (select rid, 'w' || w as bin, count(*)::double as n from tokens where w in ({_VOCABULARY}) group by 1, 2),
bins as (
  select rid, bin, n from commons
  union all select b.rid, 'w', (b.n_words - coalesce(c.n, 0))::double from based b left join (select rid, sum(n) as n from commons group by 1) c on c.rid = b.rid
  union all select rid, 'c' || unnest(range({_N + 1})), unnest(chars)::double from based
),
whole as (select b.ref, k.bin, sum(k.n) as n from bins k join based b on b.rid = k.rid where b.n_words >= {quality.MIN_WORDS} and b.rid not in (select rid from failing) and b.ref is not null group by 1, 2
  union all select '*', k.bin, sum(k.n) from bins k join based b on b.rid = k.rid where b.n_words >= {quality.MIN_WORDS} and b.rid not in (select rid from failing) group by 2),
shares as (select ref, left(bin, 1) as kind, bin, n / greatest(sum(n) over (partition by ref, left(bin, 1)), 1) as q from whole),
limits as (select r.ref, {quality.WORD_SHARE**2!r}::double * ({_term('1.0::double', 'q')} + (1 - q) / 2) as square from (select u.ref, coalesce(s.q, 0::double) as q from (select distinct ref from shares) u left join shares s on s.ref = u.ref and s.bin = 'w') r),
compared as (
  select b.rid, left(k.bin, 1) as kind, k.n / greatest(case when left(k.bin, 1) = 'w' then b.n_words else b.n_all end, 1) as p, coalesce(s.q, 0) as q
  from bins k join based b on b.rid = k.rid left join shares s on s.ref = coalesce(b.ref, '*') and s.bin = k.bin
),
distances as (select rid, kind, sqrt(greatest(sum({_term('p', 'q')}) + (1 - sum(q)) / 2, 0)) as d from compared group by 1, 2),
lined as (select rid, count(*) - count(distinct line) as n from (select rid, unnest(string_split(text, chr(10))) as line from docs) where trim(line, {_SPACES}) <> '' group by 1),
told as (
  select b.doc_id, b.n_words, length(array_to_string(b.words, '')) as word_chars, b.chars[{_N}] as n_symbols, coalesce(l.n, 0) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words,
    case when b.n_words >= {quality.MIN_WORDS} and b.n_all >= {quality.MIN_CHARS} then dc.d end as char_distance, sqrt(m.square + {quality.SAMPLING!r}::double / b.n_words) as word_limit, case when b.n_words >= {quality.MIN_WORDS} and b.n_all >= {quality.MIN_CHARS} then dw.d end as word_distance
  from based b left join lined l on l.rid = b.rid left join covered c on c.rid = b.rid left join distances dc on dc.rid = b.rid and dc.kind = 'c' left join distances dw on dw.rid = b.rid and dw.kind = 'w' left join limits m on m.ref = coalesce(b.ref, '*')
),
failed as (select *, n_words < {quality.MIN_WORDS_BASE} or 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words as base_failed from told)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(char_distance <= {quality.MAX_CHAR_DISTANCE}, true) and coalesce(word_distance <= word_limit, true) as kept,
  round(char_distance, 6) as char_distance, round(word_distance, 6) as word_distance
from failed
"""

#: Levels that the SQL spells out: 8^8 nodes of a tree, 16.8 million.
_DEEP = 8
_LEN = lambda v: f"case when {v} is null then '-' else strlen({v}::varchar) || ':' || ({v})::varchar end"
_LEAF = lambda text: "sha256(" + " || ".join(_LEN(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, bottom: str) -> str:
    """Tables ``name``0 to ``name``_DEEP of nodes (tree, pos, n, node) and ``name``r0... of their runs of eight."""
    out = [f"{name}0 as materialized ({bottom})"]
    for l in range(_DEEP):
        out.append(f"{name}r{l} as materialized (select tree, pos // 8 as run, any_value(n) as n, list(node order by pos) as nodes from {name}{l} group by 1, 2)")
        out.append(f"{name}{l + 1} as materialized (select tree, run as pos, (n + 7) // 8 as n, case when n = 1 then nodes[1] else sha256(array_to_string(nodes, '')) end as node from {name}r{l})")
    return ", ".join(out)


def _fold(name: str, tree: str, rows: str) -> str:
    """Tables ``name``0 to ``name``_DEEP: rows (tree, pos, folded, proof, ...) taken up a level at a time."""
    out = [f"{name}0 as materialized ({rows})"]
    for l in range(_DEEP):
        left, right = "array_to_string(r.nodes[1 : d.pos % 8], '')", "array_to_string(r.nodes[d.pos % 8 + 2 :], '')"
        out.append(f"{name}{l + 1} as materialized (select d.* replace (d.pos // 8 as pos, case when r.n = 1 then folded else sha256({left} || folded || {right}) end as folded, case when r.n = 1 then proof else proof || {left} || {right} end as proof) from {name}{l} d join {tree}r{l} r on r.tree = d.tree and r.run = d.pos // 8)")
    return ", ".join(out)


MANIFEST = f"""
with polynomial as (select list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
crcs as (select *, doc_id::varchar as id from documents),
leaves as materialized (select doc_id, lang, coalesce('=' || lang, '') as tree, {_LEAF("text")} as leaf,
  {_LEAF(f"translate(text, '{manifest.UPPER}', '{manifest.LOWER}')")} as lowered,
  xor(list_reduce([4294967295] || list_transform(string_split(id, ''), lambda c: ascii(c)::bigint), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0 as hit
  from crcs, polynomial),
placed as materialized (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as n from leaves),
{_tree("a", "select tree, pos, n, leaf as node from placed")},
subroots as (select tree as of, node as subroot, row_number() over (order by tree) - 1 as pos, count(*) over () as n from a{_DEEP}),
{_tree("b", "select '' as tree, pos, n, subroot as node from subroots")},
{_fold("f", "a", "select tree, pos, case when hit then lowered else leaf end as folded, '' as proof, doc_id, leaf from placed")},
{_fold("g", "b", f"select '' as tree, s.pos, folded, proof, doc_id, leaf, subroot from f{_DEEP} f join subroots s on s.of = f.tree")}
select doc_id, leaf, subroot, (select node from b{_DEEP}) as root, sha256(proof) as proof_sha256, folded as folded_root, folded = (select node from b{_DEEP}) as verified from g{_DEEP}
"""
ORACLES = {"op1_line_dedup": LINES, "op2_source_mix": MIX, "op10_quality_rules": QUALITY, "op11_manifest": MANIFEST}
