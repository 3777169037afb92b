"""DuckDB SQL of the queries, written independently of the Spark plans.  RE2 has no look-around and ASCII word
boundaries, so words are found as tokens of letters, digits and underscores."""

from __future__ import annotations

from quipu.functions import lexicon

_NOW = "timestamptz '2026-02-01 00:00:00+00'"
_SPACE = r"[\s\x0b\x{85}\p{Z}]+"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _norm(e: str) -> str:
    return f"trim(regexp_replace(coalesce({e}, ''), '{_SPACE}', ' ', 'g'))"


def _lower(e: str) -> str:
    return _norm(f"lower(coalesce({e}, ''))")


def _iso(e: str) -> str:
    form = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s?(Z|[+-]\d{2}:?\d{2})?)?$"
    plain = rf"regexp_replace(replace(trim({e}), 'T', ' '), '([+-]\d{{2}})(\d{{2}})$', '\1:\2')"
    full = f"case when regexp_matches({plain}, '(Z|[+-]\\d{{2}}:\\d{{2}})$') then {plain} when length({plain}) = 10 then {plain} || ' 00:00:00+00:00' else {plain} || '+00:00' end"
    return f"case when regexp_matches(trim({e}), '{form}') then try_cast({full} as timestamptz) end"


def _r2(e: str) -> str:
    return f"floor(({e}) * 100 + 0.5) / 100.0"


def _pct(a: str, b: str) -> str:
    return f"case when {b} > 0 then {_r2(f'{a} / {b}::double * 100')} else 0.0 end"


def _missing(e: str) -> str:
    return f"case when lower(trim({e})) not in ('', 'nan') then {e} end"


_ISO_OUT = "strftime({} at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ')"


def _dated(hours: float) -> str:
    return f"""
base as (select *, {_iso("fecha")} as p, {_iso("collected_at")} as c from noticias),
marked as (select *, coalesce(epoch_us(p) > epoch_us({_NOW}) + 21600000000, false) as fut from base),
eff as (select *, case when p is not null and not fut then p else c end as e from marked),
dated as (
  select *, (epoch_us({_NOW}) - epoch_us(e)) / 3.6e9 as age, {_r2(f"(epoch_us({_NOW}) - epoch_us(e)) / 3.6e9")} as age_hours,
    {_ISO_OUT.format("p")} as published_at, {_ISO_OUT.format("c")} as collected_at_normalized, {_ISO_OUT.format("e")} as effective_at,
    case when fut then 'invalid_future' when p is not null then 'published' when c is not null then 'inferred_collected' else 'missing' end as date_quality,
    case when fut then 'future_date' when e is null then 'missing_date' when (epoch_us({_NOW}) - epoch_us(e)) / 3.6e9 < 0 then 'future_effective_date'
      when (epoch_us({_NOW}) - epoch_us(e)) / 3.6e9 > {hours} then 'outside_operational_window' else 'recent' end as temporal_exclusion_reason
  from eff)"""


def _score(w: tuple[float, ...], total: str, per: int, most: int, rounded: bool) -> str:
    ratio = "(cur + 1) / (prev + 1)::double"
    told = _r2(ratio) if rounded else ratio
    return f"""
select name, {_r2(f"({w[0]} * least(1, cur / greatest({total}, 1)::double) + {w[1]} * least(1, sources / greatest(least(cur * {per}, {most}), 1)::double) + {w[2]} * coalesce(recency, 0) + {w[3]} * greatest(0, least(1, coalesce(stress, 0) / 100.0)) + {w[4]} * greatest(0, least(1, (log2({ratio}) + 2) / 4))) * 100")} as score,
  cur as count, prev as previous_count, sources, {_r2("coalesce(stress, 0)")} as average_stress, {_r2(ratio)} as momentum_ratio,
  case when {told} >= 1.5 then 'emergente' when {told} <= 0.70 then 'en descenso' else 'estable' end as momentum
from stats order by score desc, count desc, sources desc, name"""


def _rank_documents(labels: str, hours: float, limit: int) -> str:
    return f"""with {_dated(72.0)},
win as (select *, case when age_hours >= 0 and age_hours <= {hours} then 'c' when age_hours > {hours} and age_hours <= {2 * hours} then 'p' end as per from dated),
rows_ as (select unnest({labels}) as name, per, age_hours, {_missing("trim(fuente)")} as src, stress_score::double as st from win where per is not null),
stats as (select name, count(*) filter (per = 'c') as cur, count(*) filter (per = 'p') as prev, count(distinct src) filter (per = 'c') as sources,
  avg(exp(-age_hours / {hours})) filter (per = 'c') as recency, avg(st) filter (per = 'c') as stress,
  (select count(*) from win where per = 'c') as total from rows_ group by name having count(*) filter (per = 'c') > 0)
{_score((0.35, 0.20, 0.15, 0.10, 0.20), "total", 1, 5, False)} limit {limit}"""


def _rank_events(current: str, previous: str | None, age: str, hours: float) -> str:
    before = "0" if previous is None else f"(select count(*) from eventos_operativos v where ({previous}) and trim(v.dominant_topic) = r.name)"
    return f"""with ev as (select *, {age} as age from eventos_operativos),
cur_ as (select * from ev where {current}),
r as (select {_missing("trim(dominant_topic)")} as name, age, average_stress, [trim(x) for x in coalesce(try_cast(sources as varchar[]), []) if trim(x) <> ''] as ss, sources as raw from cur_),
s2 as (select r.name, count(*) as cur, avg(case when age is not null then exp(-greatest(age, 0) / {hours}) end) as recency, avg(average_stress) as stress from r where name is not null group by name),
u as (select name, count(distinct s) as sources from (select name, unnest(from_json(raw, '["VARCHAR"]')) as s from r where name is not null) where trim(s) <> '' group by name),
stats as (select r.name, r.cur, {before} as prev, coalesce(u.sources, 0) as sources, r.recency, r.stress, (select count(*) from cur_) as total from s2 r left join u using (name))
{_score((0.30, 0.25, 0.15, 0.10, 0.20), "total", 2, 6, True)} limit 10"""


def _age(e: str) -> str:
    return f"(epoch_us({_NOW}) - epoch_us({e})) / 3.6e9"


_LEVEL = "case when {0} >= 75 then 'crítico' when {0} >= 60 then 'alto' when {0} >= 40 then 'moderado' when {0} is not null then 'bajo' end"
_LV = f"lv as (select *, {_LEVEL.format('stress_score')} as stress_nivel from noticias)"
_CONTENT = "concat_ws('. ', titulo, texto)"
_TOKENS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+')"


def _uses(tokens: str, normal: str, term: str) -> str:
    if " " in term:
        return f"((length({normal}) - length(replace({normal}, {_q(term)}, ''))) // {len(term)})"
    return f"len([1 for t in {tokens} if t = {_q(term)}])"


def _weighed(weights: dict[str, int]) -> str:
    return " + ".join(f"{w} * {_uses('tk', 'nt', t)}" for t, w in weights.items())


def _texts(e: str) -> str:
    return f"tx as (select seq, {e} as raw, {_lower(e)} as nt from noticias), tt as (select *, {_TOKENS.format('nt')} as tk from tx)"


def _holds(term: str) -> str:
    return f"list_contains(tk, {_q(term)})" if len(term) <= 3 and term.isalpha() else f"contains(nt, {_q(term)})"


def _mentions(terms: dict[str, list[str]], column: str) -> str:
    def held(name: str) -> str:
        if name == lexicon.CAPITALS_ONLY:
            return "(list_contains(" + _TOKENS.format("raw") + ", 'SIN') or " + " or ".join(_holds(t) for t in terms[name] if t != "sin") + ")"
        return "(" + " or ".join(_holds(t) for t in terms[name]) + ")"

    cases = ", ".join(f"case when {held(n)} then {_q(n)} end" for n in terms)
    return f"with {_texts(_CONTENT)} select seq, {column} from (select seq, unnest([{cases}]) as {column} from tt) where {column} is not null"


def _held_terms(terms: list[str]) -> str:
    return " + ".join(f"contains(nt, {_q(t)})::int" for t in terms)


_URL = f"regexp_replace(split_part({_norm('url')}, '#', 1), '/+$', '')"
_KEY = "trim(regexp_replace(lower(coalesce(titulo, '')), '[^a-záéíóúüñ0-9]+', ' ', 'g'))"
_HOST = r"lower(nullif(regexp_extract(trim(url), '(?i)^[a-z][a-z0-9+.-]*://([^/?#@]*@)?([^/?#:]+)', 2), ''))"
_ORDER = "sha256('42|' || {})"

_EXACT = "'" + "','".join(lexicon.EXCLUDED_TITLES) + "'"
_PAT = "|".join(lexicon.EXCLUDED_PATTERNS).replace(r"\b", "")
_EXCLUDED = f"(nt in ({_EXACT}) or regexp_matches(nt, '(^|[^\\p{{L}}\\p{{N}}_])({_PAT})($|[^\\p{{L}}\\p{{N}}_])'))"
_GKEY = f"trim(regexp_replace(regexp_replace(nt, '(?i)\\s*[|–-]\\s*(banco central de bolivia|bcb|ine).*$', ''), '{_SPACE}', ' ', 'g'))"
_GENERIC = f"({_GKEY} in ('" + "','".join(lexicon.GENERIC_TITLES) + f"') or regexp_matches({_GKEY}, '" + "|".join(lexicon.GENERIC_PATTERNS) + "'))"

_FIX = f"""fx as (select seq, lote, id, {_norm("titulo")} as titulo, {_norm("texto")} as texto, {_norm("fuente")} as fuente, {_URL} as url,
  coalesce(trunc(economic_score)::int, 0) as economic_score, case when source_weight is null or isnan(source_weight) then 0.5 else least(1, greatest(0, source_weight)) end as source_weight,
  coalesce(nullif({_norm("source_type")}, ''), 'unknown') as source_type from noticias)"""
_QUALITY = "length(texto) desc, economic_score desc, length(titulo) desc, source_weight desc, seq"

_CLEAN = f"""sc as (select n.*, {_held_terms(lexicon.CLEAN_TERMS)} as score_recalculado from (select *, {_lower("concat_ws(' ', titulo, texto)")} as nt from noticias) n
  where length(titulo) >= 20 and length(texto) >= 250),
ok as (select * from (select * replace ({_lower("titulo")} as nt) from sc) where score_recalculado >= 2 and not {_EXCLUDED}),
u1 as (select * from ok qualify row_number() over (partition by url order by seq) = 1),
c1 as (select * from u1 qualify row_number() over (partition by {_KEY} order by seq) = 1)"""

_CLASSIC = r"[t for t in regexp_extract_all({c}, '[a-záéíóúüñ]+|\d+%?') if t not in ({stop})]"


def _clean_text(e: str) -> str:
    c = f"trim(lower(coalesce({e}, '')))"
    for pattern, by in ((r"https?://\S+|www\.\S+", " "), (r"\S+@\S+\.\S+", " "), (r"@[\p{L}\p{N}_]+", " "), (r"#([\p{L}\p{N}_]+)", r"\1"), (r"(^|[^\p{L}\p{N}_])bs\.?", r"\1 bob ")):
        if "bs" in pattern:
            # a boundary after: checked by the next character, which is put back
            c = rf"regexp_replace(regexp_replace({c}, '(^|[^\p{{L}}\p{{N}}_])bs(\.[\p{{L}}\p{{N}}_]|[^\p{{L}}\p{{N}}_.]|\.|$)', '\1 bob \2', 'g'), ' bob \.', ' bob ', 'g')"
        else:
            c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')"
    return _norm(f"regexp_replace({c}, '[^a-záéíóúüñ0-9%$\\s]', ' ', 'g')")


_NB_TERMS = r"""nb as (select seq, tono_consolidado as label, [t for t in string_split({classic}, ' ') if length(t) >= 2] as ws from noticias where tono_consolidado is not null and titulo is not null),
ng as (select seq, unnest(list_concat(ws, [ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))])) as term from nb),
tf as (select seq, term, count(*) as tf from ng group by seq, term),
nn as (select count(distinct seq) as n from tf),
vc as (select term, ln((1 + n) / (1 + count(*))::double) + 1 as idf from tf, nn group by term, n having count(*) >= 2 and count(*) <= 0.95 * n order by sum(tf) desc, term limit 30000),
rw as (select seq, term, (1 + ln(tf)) * idf as w from tf join vc using (term)),
nm as (select seq, sqrt(sum(w * w)) as norm from rw group by seq),
vv as (select seq, term, w / norm as w from rw join nm using (seq)),
vs as (select count(distinct term) as v from vv),
cw as (select label, sum(w) as whole from vv join nb using (seq) group by label),
ct as (select label, term, sum(w) as c from vv join nb using (seq) group by label, term),
th as (select label, term, ln((c + 0.5) / (whole + 0.5 * v)) as theta from ct join cw using (label), vs)""".replace(
    "{classic}", "array_to_string(" + _CLASSIC.format(c=_clean_text("titulo"), stop=", ".join(_q(s) for s in lexicon.STOPWORDS)) + ", ' ')"
)

_JUDGED = "jd as (select tono_consolidado as label, case when stress_score >= 60 then 'desfavorable' when stress_score < 45 then 'favorable' else 'neutral' end as said from noticias where tono_consolidado is not null and stress_score is not null)"
_CLASSES = f"""{_JUDGED}, k as (select unnest(['favorable', 'neutral', 'desfavorable']) as label),
s as (select k.label, (select count(*) from jd where jd.label = k.label and said = k.label) as hit, (select count(*) from jd where said = k.label) as sd, (select count(*) from jd where jd.label = k.label) as support from k),
pr as (select label, case when sd > 0 then hit / sd::double else 0 end as precision, case when support > 0 then hit / support::double else 0 end as recall, support from s),
rep as (select label, precision, recall, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1, support from pr)"""

_OP = f"op as (select * from dated where temporal_exclusion_reason = 'recent')"
_CLUSTER_TEXT = f"""trim(regexp_replace(regexp_replace(regexp_replace(lower(concat_ws(' ', titulo, titulo, texto)), 'https?://\\S+', ' ', 'g'), '[^a-záéíóúüñ0-9%$\\s]', ' ', 'g'), '{_SPACE}', ' ', 'g'))"""
_TFIDF = rf"""dw as (select seq, [t for t in regexp_extract_all({_CLUSTER_TEXT}, '[\p{{L}}\p{{N}}_]+') if length(t) >= 2] as w from op),
dg as (select seq, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) as term from dw),
dt as (select seq, term, count(*) as tf from dg group by seq, term),
dv as (select term, ln((1 + (select count(*) from op)) / (1 + count(*))::double) + 1 as idf from dt group by term order by sum(tf) desc, term limit 8000),
dr as (select seq, term, (1 + ln(tf)) * idf as w from dt join dv using (term)),
dn as (select seq, sqrt(sum(w * w)) as norm from dr group by seq),
ve as (select seq, term, w / norm as w from dr join dn using (seq))"""
_CLUSTERS = f"""{_TFIDF},
pe as (select a.seq as a, b.seq as b from ve a join ve b using (term) where a.seq < b.seq group by a.seq, b.seq having sum(a.w * b.w) >= 0.48),
ed as (select pe.a, pe.b from pe join op x on x.seq = pe.a join op y on y.seq = pe.b where x.e is null or y.e is null or abs(epoch_us(date_trunc('second', x.e)) - epoch_us(date_trunc('second', y.e))) <= 3 * 86400000000
  union select a.seq, b.seq from op a join op b on a.seq < b.seq and {_CLUSTER_TEXT.replace("titulo", "a.titulo").replace("texto", "a.texto")} = {_CLUSTER_TEXT.replace("titulo", "b.titulo").replace("texto", "b.texto")} and date_trunc('second', a.e) is not distinct from date_trunc('second', b.e)),
both_ as (select a, b from ed union select b, a from ed),
walk as (select seq as node, seq as root from op union select b.b, w.root from walk w join both_ b on b.a = w.node),
rt as (select node as seq, min(root) as root from walk group by node),
cl as (select op.*, rt.root from op join rt using (seq)),
ei as (select root, 'evt-' || substr(sha1(array_to_string(list_sort(flatten(list([coalesce(url, ''), coalesce(titulo, ''), coalesce(effective_at, '')]))), '|')), 1, 12) as event_id, count(*) as event_size from cl group by root)"""

SQL: dict[str, str] = {
    "rank_documents_topics": _rank_documents(f"case when lower(trim(tema)) not in ('', 'nan') then [trim(tema)] else [] end", 720.0, 10),
    "rank_documents_indicators": _rank_documents("indicadores", 720.0, 15),
    "rank_events_unwindowed": _rank_events("true", None, "null::double", 72.0),
    "rank_events_windowed": _rank_events("age >= 0 and age <= 2160", f"{_age(_iso('v.effective_at'))} > 2160 and {_age(_iso('v.effective_at'))} <= 4320", _age(_iso("effective_at")), 2160.0),
    "leader_topic": "select name, (count >= 2 and sources >= 2) as eligible from (" + _rank_documents("case when lower(trim(tema)) not in ('', 'nan') then [trim(tema)] else [] end", 720.0, 10) + ") order by eligible desc, score desc, count desc, sources desc, name limit 1",
    "temporal_policy": f"with {_dated(72.0)} select seq, published_at, collected_at_normalized, effective_at, age_hours, date_quality, temporal_exclusion_reason = 'recent' as is_recent, temporal_exclusion_reason from dated",
    "temporal_audit": f"with {_dated(72.0)} select 'date_quality' as measure, date_quality as value, count(*) as documents from dated group by value union all select 'temporal_exclusion_reason', temporal_exclusion_reason, count(*) from dated group by 2",
    "operational_top": f"with {_dated(720.0)} select seq, effective_at, stress_score from dated where temporal_exclusion_reason = 'recent' order by effective_at desc nulls last, stress_score desc nulls last, seq limit 30",
    "range_filter": f"select seq, p between timestamptz '2025-09-01 00:00:00+00' and {_NOW} as inside from (select seq, {_iso('fecha')} as p from noticias) where p is not null",
    "monthly_macro_score": f"""with {_LV}, m as (select strftime({_iso("fecha")} at time zone 'UTC', '%Y-%m') as period, * from lv),
g as (select period, count(*) as documents, avg(stress_score) as av, count(*) filter (tono_consolidado = 'desfavorable') as unf, count(*) filter (stress_nivel in ('alto', 'crítico')) as high from m where period is not null group by period having count(*) >= 2)
select period, documents, {_r2("av")} as stress_average, {_pct("unf", "documents")} as unfavorable_percentage, {_pct("high", "documents")} as high_stress_percentage, 0.0 as model_disagreement_percentage,
case when av is not null then {_r2(f"greatest(0, least(100, av * 0.5 + ({_pct('unf', 'documents')}) * 0.3 + ({_pct('high', 'documents')}) * 0.1))")} end as index_score from g""",
    "macro_score": f"""with {_LV}, g as (select count(*) as documents, coalesce(avg(stress_score), 0) as av, count(*) filter (tono_consolidado = 'desfavorable') as unf, count(*) filter (stress_nivel in ('alto', 'crítico')) as high from lv),
s as (select documents, {_r2("av")} as average_stress, {_r2(f"greatest(0, least(100, ({_r2('av')}) * 0.5 + unf * 100.0::double / documents * 0.3 + high * 100.0::double / documents * 0.1))")} as macro_score from g)
select *, {_LEVEL.format("macro_score")} as level from s""",
    "optimism_index": f"""with {_texts("concat_ws(' ', titulo, texto)")}, {_LV}, g as (select count(*) as documents, {_r2("avg(" + _weighed(lexicon.OPTIMISM) + ")")} as lexical_average, count(*) filter (tono_consolidado = 'favorable') as fav, count(*) filter (stress_nivel in ('bajo', 'moderado')) as low from tt join lv using (seq)),
s as (select documents, lexical_average, {_r2(f"least(lexical_average * 6, 100) * 0.5 + ({_pct('fav', 'documents')}) * 0.35 + ({_pct('low', 'documents')}) * 0.15")} as optimism from g)
select *, case when optimism >= 70 then 'alto' when optimism >= 45 then 'moderado' when optimism >= 25 then 'limitado' else 'bajo' end as level from s""",
    "frequency_table": f"select tono_consolidado as value, count(*) as count, {_pct('count(*)', '(select count(*) from noticias)')} as percentage from noticias where tono_consolidado is not null group by 1",
    "indicator_frequency": f"select value, count(*) as count, {_pct('count(*)', '(select count(*) from noticias)')} as percentage from (select unnest(indicadores) as value from noticias) group by 1",
    "entity_top": f"select value, count(*) as count, {_pct('count(*)', '(select count(*) from noticias)')} as percentage from (select unnest(entidades) as value from noticias) group by 1 order by count desc, value limit 5",
    "json_label_frequency": f"""select value, count(*) as count, {_pct('count(*)', '(select count(*) from anotaciones)')} as percentage from (select trim(unnest(from_json(indicadores, '["VARCHAR"]'))) as value from anotaciones where json_valid(indicadores) and json_type(indicadores) = 'ARRAY') where value <> '' group by 1""",
    "source_breakdown": f"with {_LV} select fuente, count(*) as documents, count(*) filter (tono_consolidado = 'desfavorable') as unfavorable, count(*) filter (tono_consolidado = 'favorable') as favorable, count(*) filter (stress_nivel in ('alto', 'crítico')) as high_stress, {_r2('avg(stress_score)')} as stress_average from lv where fuente is not null group by fuente",
    "history_upsert": f"""with d as (select strftime({_iso("collected_at")} at time zone 'UTC', '%Y-%m-%d') as date, * from noticias),
o as (select date, count(*) as documents from d where date is not null and lote <= 200 group by date), n as (select date, count(*) as documents, count(distinct fuente) as sources from d where date is not null and lote > 150 group by date)
select * from n union all select date, documents, null from o where date not in (select date from n)""",
    "title_keys": rf"select seq, {_KEY} as title_key, {_lower('titulo')} as simple_key, " + _norm(r"regexp_replace(lower(coalesce(titulo, '')), '[^\p{L}\p{M}\p{Nd}\p{Pc}áéíóúüñ ]+', '', 'g')") + " as annotation_key from noticias",
    "url_keys": f"select seq, {_URL} as url_key, {_HOST} as host from noticias",
    "economic_scores": f"with {_texts(_CONTENT)} select seq, {_held_terms(lexicon.CLEAN_TERMS)} as clean_score, {_held_terms(lexicon.COLLECT_TERMS)} as collect_score from tt",
    "lexical_stress": f"with {_texts(_CONTENT)}, s as (select seq, {_weighed(lexicon.RISK)} as risk, {_weighed(lexicon.RELIEF)} as relief from tt), z as (select *, greatest(0, least(100, 50 + risk - relief)) as stress from s) select *, {_LEVEL.format('stress')} as level from z",
    "optimism_terms": f"with {_texts(chr(99) + 'oncat_ws(' + chr(39) + ' ' + chr(39) + ', titulo, texto)')} select term, uses from (" + " union all ".join(f"select {_q(t)} as term, sum({_uses('tk', 'nt', t)}) as uses from tt" for t in lexicon.OPTIMISM) + ") where uses > 0",
    "entity_mentions": _mentions(lexicon.ENTITIES, "entity"),
    "indicator_mentions": _mentions(lexicon.INDICATORS, "indicator"),
    "excluded_titles": f"with tx as (select seq, {_lower('titulo')} as nt from noticias) select seq, {_EXCLUDED} as excluded, {_GENERIC} as generic from tx",
    "stable_ids": "select seq, substr(sha256(concat_ws('|', coalesce(fuente, ''), coalesce(url, ''), coalesce(titulo, ''))), 1, 20) as document_id, 'ann-' || substr(sha256(id), 1, 12) as annotation_id from noticias",
    "event_ids": "select lote, 'evt-' || substr(sha1(array_to_string(list_sort(flatten(list([coalesce(url, ''), coalesce(titulo, ''), coalesce(fecha, '')]))), '|')), 1, 12) as event_id from noticias group by lote",
    "corpus_merge": f"""with {_FIX}, f as (select * from fx where length(titulo) >= 10 and length(texto) >= 100),
u as (select * from f where url <> '' qualify row_number() over (partition by url order by {_QUALITY}) = 1), b as (select * from u union all select * from f where url = ''),
t as (select * from b qualify row_number() over (partition by {_KEY} order by (url <> '') desc, {_QUALITY}) = 1)
select seq, coalesce({_missing("id")}, substr(sha256(concat_ws('|', fuente, url, titulo)), 1, 20)) as id, url, economic_score, source_weight, source_type from t""",
    "clean_dedup": f"with {_CLEAN} select seq, score_recalculado from c1",
    "best_by_title": rf"select seq, source_weight, economic_score from noticias qualify row_number() over (partition by " + _norm(r"regexp_replace(lower(coalesce(titulo, '')), '[^\p{L}\p{M}\p{Nd}\p{Pc}áéíóúüñ ]+', '', 'g')") + " order by source_weight desc nulls last, economic_score desc nulls last, seq) = 1",
    "backfill_metadata": f"""with m as (select {_lower("name")} as k, * from fuentes qualify row_number() over (partition by k order by fuente_id) = 1),
j as (select n.seq, n.source_type, n.department, n.scope, n.source_weight, m.source_type as mt, m.department as md, m.scope as ms, m.source_weight as mw,
 m.k is not null and (coalesce(trim(n.source_type), '') in ('', 'unknown', 'nan') or coalesce(trim(n.department), '') in ('', 'No especificado', 'nan') or coalesce(trim(n.scope), '') in ('', 'unknown', 'nan')) as use
 from noticias n left join m on m.k = {_lower("n.fuente")})
select seq, case when use then mt else source_type end as source_type, case when use then md else department end as department, case when use then ms else scope end as scope, case when use then mw else source_weight end as source_weight from j""",
    "unknown_sources": f"select distinct fuente from noticias where {_lower('fuente')} not in (select {_lower('name')} from fuentes)",
    "union_evolve": "select seq, fuente, tema, null::varchar as lang from noticias union all select doc_id, source, null, lang from documents",
    "anti_join": "select seq, id from noticias where id is null or id not in (select id from anotaciones where id is not null)",
    "semi_join": "select seq, id from noticias where id in (select id from anotaciones)",
    "per_source_cap": "select fuente, seq from noticias where fuente is not null qualify row_number() over (partition by fuente order by seq) <= 20",
    "tfidf_weights": f"with {_dated(240.0)}, {_OP}, {_TFIDF} select seq, count(*) as terms, {_r2('sum(w) * 100')} as weight from ve group by seq",
    "event_clusters_corpus": f"with recursive {_dated(240.0)}, op as (select * from dated where e is not null), {_CLUSTERS} select cl.seq, ei.event_id, ei.event_size from cl join ei using (root)",
    "event_clusters": f"with recursive {_dated(240.0)}, {_OP}, {_CLUSTERS} select cl.seq, ei.event_id, ei.event_size from cl join ei using (root)",
    "event_payload": f"select sum(greatest(documents, 1)) as documents, count(*) as events, {_r2('(1 - count(*) / sum(greatest(documents, 1))::double) * 100')} as compression_ratio, count(*) filter (unique_sources >= 2) as multi_source_events, max(documents) as largest_event from eventos_operativos",
    "dominant_topic": f"select fuente, tema from (select fuente, {_missing('trim(tema)')} as tema, count(*) as n, min(seq) as f from noticias where fuente is not null group by 1, 2) where tema is not null qualify row_number() over (partition by fuente order by n desc, f) = 1",
    "representative_documents": f"""with b as (select *, epoch_us({_iso("collected_at")}) as ats from noticias), s as (select *, coalesce(stress_score, 0) * 0.35 + least(length(coalesce(titulo, '')), 180) / 180.0::double * 20 + least(length(coalesce(texto, '')), 3000) / 3000.0::double * 25 + coalesce(ats / (max(ats) over (partition by lote))::double, 0) * 20 as sc from b)
select lote::varchar as event_id, seq from s qualify row_number() over (partition by lote order by sc desc, seq) = 1""",
    "quota_sample": f"""with c as (select fuente, count(*) as n from noticias where fuente is not null group by fuente), x as (select *, n * 200 / (sum(n) over ())::double as exact from c),
y as (select *, least(n, floor(exact)) as base from x), z as (select *, row_number() over (order by (base < n) desc, exact - floor(exact) desc, fuente) as rn, 200 - sum(base) over () as rest from y),
q as (select fuente, base + (rn <= rest and base < n)::int as quota from z)
select fuente, seq from noticias join q using (fuente) qualify row_number() over (partition by fuente order by {_ORDER.format("seq")}, seq) <= any_value(quota) over (partition by fuente)""",
    "stratified_split": f"""with p as (select seq, (row_number() over (partition by tono_consolidado order by {_ORDER.format("seq")}, seq) - 1) / (count(*) over (partition by tono_consolidado))::double as place from noticias where tono_consolidado is not null)
select seq, case when place < 0.70 then 'train' when place < 0.70 + 0.15 then 'validation' else 'test' end as split from p""",
    "annotation_status": f"with a as (select lower(trim(sentimiento)) as s, duda from anotaciones) select count(*) as total, count(*) filter (s in ('positivo', 'neutral', 'negativo')) as annotated, count(*) - count(*) filter (s in ('positivo', 'neutral', 'negativo')) as pending, count(*) filter (duda = 1) as doubtful, {_pct(chr(99) + 'ount(*) filter (s in (' + chr(39) + 'positivo' + chr(39) + ', ' + chr(39) + 'neutral' + chr(39) + ', ' + chr(39) + 'negativo' + chr(39) + '))', 'count(*)')} as progress, count(*) filter (s = 'positivo') as positivo, count(*) filter (s = 'neutral') as neutral, count(*) filter (s = 'negativo') as negativo from a",
    "annotation_pending": "select annotation_id, id, sentimiento from anotaciones where coalesce(lower(trim(sentimiento)) not in ('positivo', 'neutral', 'negativo'), true)",
    "annotation_page": "select distinct annotation_id, id from anotaciones order by annotation_id, id limit 50 offset 25",
    "annotation_update": "select annotation_id, id, case when annotation_id = 'ann-000000010' then 'negativo' else sentimiento end as sentimiento, case when annotation_id = 'ann-000000010' then 1 else duda end as duda, fecha_anotacion from anotaciones",
    "nb_parameters": f"with {_NB_TERMS} select label, term, {_r2('theta')} as theta from th",
    "confusion_matrix": f"with {_JUDGED}, k as (select unnest(['favorable', 'neutral', 'desfavorable']) as x) select a.x as label, b.x as predicted, (select count(*) from jd where label = a.x and said = b.x) as count from k a, k b",
    "class_report": f"with {_CLASSES} select * from rep",
    "macro_report": f"with {_CLASSES} select (select avg((label = said)::int) from jd) as accuracy, (select count(*) from jd) as rows, avg(precision) as macro_precision, avg(recall) as macro_recall, avg(f1) as macro_f1 from rep",
    "consolidated_tone": "with a as (select annotation_id, id, lower(trim(sentimiento)) as s, case when duda = 0 then lower(trim(sentimiento)) end as t from anotaciones) select annotation_id, id, coalesce(s, t) as etiqueta_consolidada, s = t as coincidencia_modelos, case coalesce(s, t) when 'positivo' then 'favorable' when 'neutral' then 'neutral' when 'negativo' then 'desfavorable' end as tono_consolidado from a",
    "catalogue_violations": "select fuente_id::varchar as id, 'weight_out_of_range' as rule from fuentes where source_weight is null or source_weight not between 0 and 1 union all select fuente_id::varchar, 'no_homepage' from fuentes where trim(coalesce(homepage, '')) = '' union all select fuente_id::varchar, 'unknown_source_type' from fuentes where trim(coalesce(source_type, '')) <> '' and source_type not in ('official', 'newspaper', 'television', 'agency', 'business', 'regional')",
    "collected_violations": f"""with c as (select seq::varchar as id, fuente as name, source_type, department, scope, source_weight, {_lower('fuente')} as k from noticias)
select id, 'missing_name' as rule from c where trim(coalesce(name, '')) = '' union all select id, 'missing_source_type' from c where trim(coalesce(source_type, '')) = ''
union all select id, 'missing_department' from c where trim(coalesce(department, '')) = '' union all select id, 'missing_scope' from c where trim(coalesce(scope, '')) = ''
union all select id, 'unknown_source_type' from c where trim(coalesce(source_type, '')) <> '' and source_type not in ('official', 'newspaper', 'television', 'agency', 'business', 'regional')
union all select id, 'weight_out_of_range' from c where source_weight is null or isnan(source_weight) or source_weight not between 0 and 1
union all select id, 'duplicate_id' from c qualify count(*) over (partition by id) > 1 union all select id, 'duplicate_name' from c qualify count(*) over (partition by k) > 1""",
    "service_batch_report": """with ok as (select * from noticias where texto is not null)
select 'outcome' as kind, case when texto is null then 'failed' else 'processed' end as value, count(*) as count from noticias group by 1, 2
union all select 'sentiment', tono_consolidado, count(*) from ok where tono_consolidado is not null group by 2 union all select 'topic', tema, count(*) from ok where tema is not null group by 2
union all select 'entity', x, count(*) from (select unnest(entidades) as x from ok) where x is not null group by 2 union all select 'indicator', x, count(*) from (select unnest(indicadores) as x from ok) where x is not null group by 2""",
    "collected_top": "select seq, fuente, economic_score from noticias order by fuente nulls first, economic_score desc nulls last, titulo nulls first, seq limit 50",
    "relevant_items": f"""with {_texts("concat_ws(' ', titulo, texto)")}, s as (select seq, {_held_terms(lexicon.COLLECT_TERMS)} as economic_score from tt), g as (select seq, {_GENERIC} as generic from (select seq, {_lower('titulo')} as nt from noticias))
select seq, s.economic_score from s join g using (seq) join noticias n using (seq) where not g.generic and {_lower('n.titulo')} <> '' and length(n.texto) >= 250 and s.economic_score >= 2""",
    "labelled_texts": f"""select texto, sentimiento from (select trim(regexp_replace(coalesce(titulo, ''), '{_SPACE}', ' ', 'g')) as texto, lower(trim(sentimiento)) as sentimiento from anotaciones)
where sentimiento in ('positivo', 'neutral', 'negativo') and length(texto) >= 10""",
    "softmax_argmax": """with e as (select vec_id, [x::double for x in embedding] as v from embeddings), p as (select vec_id, v, list_sum([exp(x - list_max(v)) for x in v]) as s from e)
select vec_id, (list_position(v, list_max(v)) - 1)::int as label, floor(1 / s * 100 * 100 + 0.5) / 100.0 as confidence from p""",
    "date_columns": "select 'all' as of, 'fecha' as column union all select 'collected', 'collected_at'",
    "collection_report": f"select name, (select count(*) from noticias n where {_lower('n.fuente')} = {_lower('f.name')}) as documents from fuentes f",
    "pipeline_gate": f"""with tx as (select fuente, {_lower("titulo")} as nt from noticias), g as (select count(*)::double as n, count(distinct fuente)::double as s, avg({_GENERIC}::int) as gen from tx), c as (select count(*)::double as c from noticias where length(titulo) >= 20)
select 'operational_rows' as check, n as value, 1.0 as threshold, n >= 1 as passed from g union all select 'missing_metadata_columns', 0.0, 0.0, true union all select 'distinct_sources', s, 3.0, s >= 3 from g union all select 'generic_title_ratio', gen, 0.05, gen <= 0.05 from g union all select 'clean_rows', c, 30.0, c >= 30 from c""",
    "service_events": "select event_id, unique_sources, documents, maximum_stress, effective_at from (select distinct * from eventos_operativos) where unique_sources >= 2 order by unique_sources desc nulls last, documents desc nulls last, maximum_stress desc nulls last, effective_at desc nulls last, event_id limit 50",
}
SQL["service_emerging"] = (
    "select * from (select 'tema' as dimension, name, score from (" + SQL["rank_documents_topics"] + ") where momentum = 'emergente' union all "
    "select 'indicadores', name, score from (" + _rank_documents("indicadores", 720.0, 10) + ") where momentum = 'emergente') order by score desc, dimension, name limit 20"
)

_CLEANED = _clean_text("texto")
SQL |= {
    "clean_top": f"with {_CLEAN} select seq, score_recalculado from c1 order by score_recalculado desc, fuente nulls first, titulo nulls first, seq limit 50",
    "complete_rows": "select seq from noticias where titulo is not null and texto is not null and tema is not null",
    "point_lookup": "select annotation_id, id, sentimiento from anotaciones where annotation_id = 'ann-000000010'",
    "momentum_values": "select distinct event_id, documents as now, unique_sources as before, greatest(0, least(1, (log2((documents + 1) / (unique_sources + 1)::double) + 2) / 4)) as momentum, (documents + 1) / (unique_sources + 1)::double as ratio, case when (documents + 1) / (unique_sources + 1)::double >= 1.5 then 'emergente' when (documents + 1) / (unique_sources + 1)::double <= 0.70 then 'en descenso' else 'estable' end as label from eventos_operativos",
    "number_coercion": "select seq, case when isnan(coalesce(try_cast(fecha as double), -1)) then -1.0 else coalesce(try_cast(fecha as double), -1) end as as_number, case when source_weight is null or isnan(source_weight) then 0.5 else greatest(0, least(0.75, source_weight)) end as weight from noticias",
    "plain_texts": f"select seq, translate({_norm("regexp_replace(regexp_replace(lower(coalesce(titulo, '')), 'https?://[^ ]+|www[.][^ ]+', ' ', 'g'), '[^a-záéíóúüñ ]', ' ', 'g')")}, 'áéíóúüñ', 'aeiouun') as plain from noticias",
    "absolute_urls": "select seq, case when regexp_matches(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*:') then trim(url) when trim(url) like '//%' then 'https:' || trim(url) when trim(url) like '/%' then 'https://www.x.example' || trim(url) else 'https://www.x.example/a/' || regexp_replace(trim(url), '^[.]/', '') end as absolute from noticias where url is not null and trim(url) <> ''",
    "label_shares": f"select fuente, count(*) as total, {_pct("count(*) filter (lower(trim(sentimiento)) = 'negativo')", 'count(*)')} as negative_share from anotaciones where fuente is not null group by fuente",
    "token_counts": f"""with c as (select seq, regexp_extract_all({_CLEANED}, '[a-záéíóúüñ]+|\\d+%?') as tk from noticias)
select seq, len(tk) as tokens, length(array_to_string([t for t in tk if t not in ({", ".join(_q(s) for s in lexicon.STOPWORDS)})], ' ')) as classic_length,
length(array_to_string([t for t in tk if t not in ({", ".join(_q(s) for s in lexicon.TOPIC_STOPWORDS)}) and not regexp_matches(t, '[0-9]') and length(t) >= 3], ' ')) as topic_length from c""",
    "nb_predictions": f"""with {_NB_TERMS}, pr as (select label, ln(count(*) / (select count(*) from nb)::double) as prior, ln(0.5 / (any_value(whole) + 0.5 * any_value(v))) as unseen from nb join cw using (label), vs group by label),
kv as (select * from vv where term in (select term from th)), ms as (select seq, sum(w) as mass from kv group by seq),
se as (select kv.seq, pr.label, sum(kv.w * (th.theta - pr.unseen)) as s from kv join th using (term) join pr on pr.label = th.label group by kv.seq, pr.label),
sc as (select ms.seq, pr.label, pr.prior + ms.mass * pr.unseen + coalesce(se.s, 0) as score from ms cross join pr left join se on se.seq = ms.seq and se.label = pr.label),
tp as (select *, max(score) over (partition by seq) as top from sc)
select seq, arg_max(label, score) as label, {_r2("1 / sum(exp(score - top))")} as probability from tp group by seq""",
    "service_analyze": f"""with tx as (select doc_id as seq, text as raw, {_lower("text")} as nt, length(trim(text)) as n from documents), tt as (select *, {_TOKENS.format("nt")} as tk from tx),
s as (select case when n is null or n < 10 or n > 20000 then 1 end as err, greatest(0, least(100, 50 + ({_weighed(lexicon.RISK)}) - ({_weighed(lexicon.RELIEF)}))) as st from tt)
select count(*) as documents, count(err) as errors, avg(case when err is null then st end) as average_stress, count(*) filter (err is null and st >= 75) as critical, count(*) filter (err is null and st >= 60 and st < 75) as high,
count(*) filter (err is null and st >= 40 and st < 60) as moderate, count(*) filter (err is null and st < 40) as low from s""",
}
