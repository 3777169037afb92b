"""DuckDB SQL of those queries of this subpackage that SQL can express."""

_FOLD = "strip_accents(lower(trim({})))"

_LINES = r"""
with keyed as (
  select seq, nullif(regexp_replace(lower(trim(fuente)), '[^\x00-\x7f]+', '?', 'g'), '') as src, string_split(texto, chr(10)) as ls
  from noticias where fuente is not null and lower(trim(fuente)) not in ('', 'nan', 'none', 'null')
), each as (
  select seq, src, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as linea from keyed
), rested as (
  select *, regexp_replace(lower(line), '[\s\x0b\x{85}\p{Z}0-9]+', '', 'g') as rest from each
), parts as (
  select *, regexp_replace(rest, '[\x00-\x7f]+', '', 'g') as foreign_, length(regexp_replace(rest, '[^a-z]+', '', 'g')) as own from rested
), hashed as (
  select seq, src, line, linea,
    case when regexp_replace(line, '[\s\x0b\x{85}\p{Z}]+', '', 'g') = '' then null when foreign_ <> '' and (length(regexp_replace(foreign_, '[^\p{L}]+', '', 'g')) > own or own = 0) then 'b' || rest
         else 'a' || regexp_replace(rest, '[^\x21-\x7e]+', '', 'g') end as k
  from parts
), sizes as (select src, count(*) as n from keyed group by src),
found as (
  select h.src, h.k from hashed h join sizes s using (src) where h.k is not null
  group by h.src, h.k, s.n having count(distinct h.seq) >= 15 and count(distinct h.seq) >= 0.05 * s.n
)
"""

_ELIGIBLE = f"""
with a as (
  select campo, categoria, target_share, min_rows, {_FOLD.format("categoria")} as k from cuotas_muestra
), s as (
  select 'sentimiento' as campo, {_FOLD.format("arg_max(coalesce(sentimiento, ''), coalesce(fecha_anotacion, '') || '|' || coalesce(sentimiento, ''))")} as k from anotaciones
  where trim(annotation_id) <> '' group by annotation_id
), e as (
  select 'dominant_topic' as campo, {_FOLD.format("max(dominant_topic)")} as k from eventos_operativos where trim(event_id) <> '' group by event_id
), pool as (select campo, k, count(*) as n from (select * from s union all select * from e) join (select distinct campo, k from a) using (campo, k) group by campo, k),
total as (select campo, sum(n) / 2.0 as half from pool group by campo),
asked as (
  select a.*, coalesce(p.n, 0) as n, greatest(min_rows, target_share * coalesce(t.half, 0)) as need
  from a left join pool p using (campo, k) left join total t using (campo)
)
"""

_WORDS = r"string_split(trim(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')"

SQL = {
    "p2_found": _LINES + "select distinct h.seq, h.linea::int as linea from hashed h join found f on h.src = f.src and h.k = f.k",
    "p2_cleaned": _LINES
    + """, gone as (select h.seq, list(h.linea) as g from hashed h join found f on h.src = f.src and h.k = f.k group by h.seq)
select n.seq, case when g.g is null then n.texto
  else coalesce(array_to_string([x for x, i in string_split(n.texto, chr(10)) if not list_contains(g.g, i)], chr(10)), '') end as texto
from noticias n left join gone g using (seq)""",
    "p5_found": _ELIGIBLE + "select campo, categoria from asked where n < need",
    "p8_found": f"""
with i as (select item_id, {_WORDS} as w from eval_items), d as (select doc_id, {_WORDS} as w from documents),
k as (select item_id, least(12, len(w)) as k, w from i where w <> ['']),
g as (select distinct item_id, k, array_to_string(w[s:s + k - 1], ' ') as gram from (select *, unnest(range(1, len(w) - k + 2)) as s from k)),
h as (select doc_id, k, array_to_string(w[s:s + k - 1], ' ') as gram
      from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as s from d, (select distinct k from k)))
select distinct doc_id, item_id from h join g using (k, gram)""",
    "p9_found": r"""
with d as (select source, len([x for x in string_split_regex(coalesce(text, ''), '[\s\p{Z}]+') if x <> '']) as n from documents),
t as (select sum(n) / 2.0 as half from d), s as (select source, sum(n) as size from d where source is not null group by source)
select m.source from mezcla_fuentes m left join s using (source), t where m.max_repeats * coalesce(s.size, 0) < m.target_share * t.half""",
}
