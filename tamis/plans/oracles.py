"""DuckDB twins of the operators, as chains of common table expressions.

They are written another way than the operators on purpose: islands by window sums instead of array functions,
one step a priority instead of a fold, and joins instead of arrays of weights.
"""

from __future__ import annotations

from tamis import fixed
from tamis.plans.wrapping import FILES, LOG_LINES, NARRATIVES, TICKETS, duck


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case(value: str, names: dict) -> str:
    return f"case {value} " + " ".join(f"when {q(k)} then {q(v)}" for k, v in names.items()) + " end"


def chain(*parts: str, last: str) -> str:
    return "with recursive " + ",\n".join(parts) + "\n" + last


NARRATIVE_CTE = f"src as materialized (select ticket_id, text from ({duck(NARRATIVES)}))"
TICKET_CTE = f"tickets as materialized ({duck(TICKETS)})"

_NORM = "trim(rtrim(trim(lower(strip_accents(regexp_replace(line, '\\s+', ' ', 'g')))), ':'))"
BLOCK_CTES = f"""
lines as materialized (
  select ticket_id, unnest(string_split(raw_text, chr(10))) as line, generate_subscripts(string_split(raw_text, chr(10)), 1) as i from tickets),
typed as (
  select *, (line not like '%->%' and regexp_full_match(line, '\\s*[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ\\s]{{2,40}}?\\s*:?\\s*') and {_NORM} in ({", ".join(map(q, fixed.BLOCKS))})) as head, line like '%->%' as fld from lines),
blocked as (select *, sum(head::int) over (partition by ticket_id order by i) as block_no from typed),
fielded as materialized (select *, sum((fld and not head)::int) over (partition by ticket_id, block_no order by i) as field_no from blocked where block_no > 0),
blocks as materialized (select ticket_id, block_no, {_NORM} as block from fielded where head),
fields as materialized (
  select f.ticket_id, f.block_no, any_value(b.block) as block, f.field_no,
         max(case when f.fld then trim(split_part(f.line, '->', 1)) end) as key,
         coalesce(string_agg(nullif(case when f.fld then trim(substr(f.line, strpos(f.line, '->') + 2)) else trim(f.line) end, ''), ' ' order by f.i), '') as value
  from fielded f join blocks b using (ticket_id, block_no) where f.field_no > 0 group by f.ticket_id, f.block_no, f.field_no)"""
ANALYSIS_CTES = f"""
first_details as (select ticket_id, min(block_no) as block_no from blocks where block = 'detalhes' group by ticket_id),
details as (
  select d.ticket_id, arg_min(f.value, f.field_no) filter (where lower(f.key) = 'detalhe1') as told, string_agg(nullif(f.value, ''), chr(10) order by f.field_no) as vals
  from first_details d left join fields f using (ticket_id, block_no) group by d.ticket_id),
src as materialized (
  select t.ticket_id, case when d.told is not null then trim(d.told) when coalesce(trim(d.vals), '') <> '' then trim(d.vals) else trim(t.raw_text, ' ' || chr(10)) end as text
  from tickets t left join details d using (ticket_id))"""


def entity_ctes() -> str:
    """accepted(ticket_id, prio, s, e, kind, confidence) and masked(ticket_id, masked) from src(ticket_id, text)."""
    out, codes = [], ", ".join(map(q, fixed.AREA_CODES))
    for prio, kind, conf, before, body, after, any_case, check in fixed.ENTITY_RULES:
        pattern = f"{'(?i)' if any_case else ''}({before})({body}){after}"
        raw = "p[i]"
        phone = f"(substr({raw}, 1, 2) in ({codes}) and ((length({raw}) = 11 and substr({raw}, 3, 1) = '9') or (length({raw}) = 10 and substr({raw}, 3, 1) in ('2', '3', '4', '5'))))"
        guard = {None: "true", "phone": phone, "not phone": f"not {phone}"}[check]
        out.append(f"""c{prio} as materialized (
  select ticket_id, {prio} as prio, s, s + length(p[i]) as e, {q(kind)} as kind, {q(conf)} as confidence from (
    select ticket_id, p, i, coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x))), 0) as s from (
      select ticket_id, p, unnest(range(2, len(p) + 1, 2)) as i from (
        select ticket_id, string_split(regexp_replace(text, {q(pattern)}, '\\1' || chr(1) || '\\2' || chr(1), 'g'), chr(1)) as p from src)))
  where p[i] <> '' and {guard})""")
    before = ""
    for prio, *_ in fixed.ENTITY_RULES:
        keep = f"select * from c{prio}" if not before else f"select * from {before} union all select c.* from c{prio} c where not exists (select 1 from {before} a where a.ticket_id = c.ticket_id and a.s < c.e and c.s < a.e)"
        out.append(f"a{prio} as materialized ({keep})")
        before = f"a{prio}"
    tokens = "case kind " + " ".join(f"when {q(k)} then {q(v)}" for k, v in fixed.MASKS.items()) + " end"
    out.append(f"accepted as materialized (select ticket_id, prio, cast(s as integer) as s, cast(e as integer) as e, kind, confidence from {before})")
    out.append(f"""hidden as (
  select a.ticket_id, s, e, substr(text, cast(coalesce(lag(e) over w, 0) as integer) + 1, s - coalesce(lag(e) over w, 0)) || {tokens} as piece
  from accepted a join src using (ticket_id) where kind not in ({", ".join(map(q, fixed.VISIBLE_KINDS))}) window w as (partition by a.ticket_id order by s))""")
    out.append("""masked as materialized (
  select src.ticket_id, coalesce(h.pieces || substr(text, h.upto + 1), text) as masked
  from src left join (select ticket_id, string_agg(piece, '' order by s) as pieces, max(e) as upto from hidden group by ticket_id) h using (ticket_id))""")
    return ",\n".join(out)


_ANCHORS = "anchors(anchor, label, text) as (values " + ", ".join(f"({i}, {q(label)}, {q(text)})" for i, (label, text) in enumerate(fixed.ANCHORS)) + ")"


def _grams(source: str, key: str, text: str) -> str:
    return f"""(
    select {key}, substr(w, i, n) as gram, sum(k) as tf from (
      select {key}, w, k, n, unnest(range(1, length(w) - n + 2)) as i from (
        select {key}, ' ' || word || ' ' as w, count(*) as k from (select {key}, unnest(regexp_split_to_array(strip_accents(lower({text})), '\\s+')) as word from {source}) where word <> '' group by all), (values (3), (4), (5)) v(n) where n <= length(w))
    group by all)"""


def model_ctes(anchors: str, many: str) -> str:
    """weights(anchor, gram, w) and idf(gram, idf) of anchors(anchor, label, text), of which there are so many."""
    return f"""{anchors},
anchor_grams as materialized (select * from {_grams("anchors", "anchor", "text")}),
idf as materialized (select gram, ln((1 + {many}) / (1 + count(*))) + 1 as idf from anchor_grams group by gram),
raw_weights as (select anchor, gram, (1 + ln(tf)) * idf as w from anchor_grams join idf using (gram)),
weights as materialized (select anchor, gram, w / sqrt(sum(w * w) over (partition by anchor)) as w from raw_weights)"""


MODEL_CTES = model_ctes(_ANCHORS, str(len(fixed.ANCHORS)))


def cosine_ctes(source: str, text: str) -> str:
    """cosines(ticket_id, anchor, label, score) of source(ticket_id, text), scores as they are ranked."""
    return f"""
tfq as materialized (select ticket_id, gram, (1 + ln(tf)) * idf as qw from {_grams(source, "ticket_id", text)} join idf using (gram)),
norms as (select ticket_id, sqrt(sum(qw * qw)) as norm from tfq group by ticket_id),
cosines as (
  select ticket_id, anchor, label, round(dot / norm, 9) as score
  from (select ticket_id, anchor, sum(qw * w) as dot from tfq join weights using (gram) group by all) join norms using (ticket_id) join anchors using (anchor))"""


def inference_ctes(source: str, text: str) -> str:
    """inferred(ticket_id, symptom, confidence) from source(ticket_id, text)."""
    labels = ", ".join(f"({q(x)})" for x in sorted({label for label, _ in fixed.ANCHORS}))
    return f"""{MODEL_CTES},
tfq as materialized (select ticket_id, gram, (1 + ln(tf)) * idf as qw from {_grams(source, "ticket_id", text)} join idf using (gram)),
norms as (select ticket_id, sqrt(sum(qw * qw)) as norm from tfq group by ticket_id),
cosines as (select ticket_id, label, max(dot / norm) as score from (select ticket_id, anchor, sum(qw * w) as dot from tfq join weights using (gram) group by all) join norms using (ticket_id) join anchors using (anchor) group by ticket_id, label),
ranks as materialized (
  select s.ticket_id, l.label, coalesce(c.score, 0) as score, row_number() over (partition by s.ticket_id order by coalesce(c.score, 0) desc, l.label) as r
  from {source} s cross join (values {labels}) l(label) left join cosines c on c.ticket_id = s.ticket_id and c.label = l.label),
inferred as materialized (
  select s.ticket_id,
         case when length(trim(s.{text})) < 5 then {q(fixed.TOO_SHORT)} when r.label <> {q(fixed.UNKNOWN)} and r.score >= 0.12 then r.label else {q(fixed.UNKNOWN)} end as symptom,
         case when length(trim(s.{text})) < 5 then 0.0 else round(r.score, 4) end as confidence
  from {source} s join ranks r on r.ticket_id = s.ticket_id and r.r = 1)"""


_TIME = q("(?i)" + fixed.TIME_PATTERN)
_ARTIFACT = q(rf"(?i)\b(?:{'|'.join(fixed.ARTIFACT_WORDS)})\b")
def verdict_ctes(artifact: str = "false") -> str:
    """verdicts(ticket_id, symptom, confidence, masked, status, missing); artifact: what counts as one beside the text."""
    return f"""
checks as (
  select i.ticket_id, i.symptom, i.confidence, m.masked, regexp_matches(m.masked, {_TIME}) as has_time, (regexp_matches(m.masked, {_ARTIFACT}) or {artifact}) as has_artifact,
         exists (select 1 from accepted a where a.ticket_id = i.ticket_id and a.kind = 'TELEFONE' and a.confidence = 'ALTA') as has_phone
  from inferred i join masked m using (ticket_id)),
verdicts as (
  select *, case when (symptom = {q(fixed.AUDIO)} and not (has_time and has_phone)) or (symptom = {q(fixed.UX)} and not has_artifact) or (symptom = {q(fixed.QUEUE)} and not has_time) then 'BLOQUEADO'
                 when symptom in ({q(fixed.UNKNOWN)}, {q(fixed.TOO_SHORT)}) then 'ATENCAO' else 'APROVADO' end as status,
         concat_ws('; ', case when symptom in ({q(fixed.AUDIO)}, {q(fixed.QUEUE)}) and not has_time then {q(fixed.ITEM_TIME)} end, case when symptom = {q(fixed.AUDIO)} and not has_phone then {q(fixed.ITEM_PHONE)} end, case when symptom = {q(fixed.UX)} and not has_artifact then {q(fixed.ITEM_ARTIFACT)} end) as missing
  from checks)"""

_SIG = " union all ".join(f"select ticket_id, line_number, line, {i} as o, {q(s)} as symptom, {q(label)} as label, regexp_extract(line, {q(f'(?i)^(.*?){p}')}, 1) as lead from log_lines where regexp_matches(line, {q(f'(?i){p}')})" for i, (s, label, p) in enumerate(fixed.SIGNATURES))
LOG_CTES = f"""log_lines as materialized ({duck(LOG_LINES)}),
found as (select *, row_number() over (partition by ticket_id, line_number order by length(lead), o) as r from ({_SIG})),
hits as materialized (select ticket_id, line_number, line, symptom, label from found where r = 1)"""
FILE_CTE = f"files as ({duck(FILES)})"
ROLE_SQL = """case when regexp_matches(lower(split_part(name, '/', -1)), '^.+\\.(txt|log|csv|json|out)$') then 'log'
       when regexp_matches(lower(split_part(name, '/', -1)), '^.+\\.(png|jpg|jpeg|gif|bmp|pdf)$') then 'visual' else 'other' end"""
