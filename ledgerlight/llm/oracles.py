"""SQL for DuckDB that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from ledgerlight.llm.quality_rules import MEASURES

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

_RATES = {"symbol_rate": "n_symbols * 1000", "repeat_rate": "n_repeat_words * 1000", "dup_word_rate": "n_dup_words * 1000", "upper_rate": "n_upper * 1000", "word_length": "word_chars * 100"}
_HIGH = ", ".join(f"max(q3 + (q3 - q1) * 3 + {width}) filter (measure = '{m}') as {m}_high" for m, width in MEASURES.items())
_COLS = [*[f"{m}_high" for m in MEASURES], "word_length_low"]

OP2 = rf"""
with w as (select doc_id, lang, source, coalesce(text, '') as text, {WORDS.format(text="coalesce(text, '')")} as ws from documents),
win as (select doc_id, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] as k from w, unnest(generate_series(1, len(ws) - 2)) as t(i)),
twice as (select doc_id, k from win group by all having count(*) > 1),
rep as (select doc_id, count(distinct i + o) as n_repeat_words from win join twice using (doc_id, k), (values (0), (1), (2)) as v(o) group by 1),
li as (select doc_id, l, count(*) as c, len({WORDS.format(text="l")}) as nw from (select doc_id, unnest(string_split(text, chr(10))) as l from w) where regexp_matches(l, '[^\x20\x09-\x0D]') group by all),
dup as (select doc_id, sum(c - 1) as n_dup_lines, sum((c - 1) * nw) as n_dup_words from li group by 1),
m0 as (select doc_id, lang, source, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_dup_words, 0)::bigint as n_dup_words,
 coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(list_filter(ws, lambda x: length(x) > 1 and upper(x) = x and lower(x) <> x)) as n_upper from w left join rep using (doc_id) left join dup using (doc_id)),
m as (select *, {", ".join(f"case when n_words > 0 then ({a}) // n_words else 0 end as {n}" for n, a in _RATES.items())} from m0),
long as (select doc_id, lang, source, unnest([{", ".join(f"'{n}'" for n in MEASURES)}]) as measure, unnest([{", ".join(MEASURES)}])::bigint as v from m),
b as (select lang, source, measure, (v >> greatest(0, length(bin(v)) - 6)) << greatest(0, length(bin(v)) - 6) as low from long),
lv as (select unnest([0, 1, 2]) as level, * from b), g as (select level, case when level < 2 then lang end as lang, case when level < 1 then source end as source, measure, low, count(*) as n from lv group by all),
cum as (select *, sum(n) over (partition by level, lang, source, measure order by low) as seen, sum(n) over (partition by level, lang, source, measure) as total from g),
q as (select level, lang, source, measure, max(total) as total, min(low) filter (seen >= 0.25::double * total) as q1, min(low) filter (seen >= 0.75::double * total) as q3 from cum group by all),
f as (select level, lang, source, max(total) as total, {_HIGH}, max(q1 - (q3 - q1) * 3 - {MEASURES["word_length"]}) filter (measure = 'word_length') as word_length_low from q group by all),
lim as (select o.lang, o.source, {", ".join(f"case when o.total >= 200 then o.{c} when l.total >= 200 then l.{c} else a.{c} end as {c}" for c in _COLS)} from (select * from f where level = 0) o left join (select * from f where level = 1) l on o.lang is not distinct from l.lang, (select * from f where level = 2) a),
j as (select m.*, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, list_filter([{", ".join(f"case when m.{n} > {n}_high then '{n}' end" for n in MEASURES)}, case when m.word_length < word_length_low then 'word_length' end], lambda x: x is not null) as over from m join lim on m.lang is not distinct from lim.lang and m.source is not distinct from lim.source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and len(over) = 0 as kept, array_to_string(over, ',') as reasons from j"""

OP7 = rf"""
with recursive w as (select doc_id, {WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 2], chr(1)) as k from w, unnest(generate_series(1, greatest(1, len(ws) - 2))) as t(i) where len(ws) > 0),
n as (select doc_id, count(*) as n from s group by 1), p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.k = b.k and a.doc_id <> b.doc_id group by all),
links as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * shared >= 90 * (x.n + y.n - shared)),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join links l on r.b = l.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, (select min(b) from reach where a = d.doc_id) as component_id from documents d left join n using (doc_id)"""

OP9 = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where embedding is not null and label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.98::double),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join links l on r.b = l.a)
select vec_id, (select count(*) from links where a = vec_id) as n_links, (select min(b) from reach where a = vec_id) as component_id, vec_id = (select min(b) from reach where a = vec_id) as kept from embeddings"""

OP11 = """
with t as (select doc_id, coalesce(text, '') as text, sha256('1:' || doc_id::varchar) as h from documents),
k as (select *, length(text) as n, (('0x' || h[1:8])::bigint) as h1, (('0x' || h[9:16])::bigint) as h2, (('0x' || h[17:24])::bigint) as h3, (('0x' || h[25:32])::bigint) as h4 from t),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b, case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from k),
o as (select *, substring(text, 1, a) as p, substring(text, a + 1, b - a) as m, substring(text, b + 1) as s from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
 sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(case when form = 'plain' then text else p || m || s end) as restored_sha256 from o"""

SQL = {"op2_quality_rules": OP2, "op7_jaccard_join": OP7, "op9_vector_dedup": OP9, "op11_fill_middle": OP11}
