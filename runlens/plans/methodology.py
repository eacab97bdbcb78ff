"""Queries on the markdown artifacts of products."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.operators import methodology as ops
from runlens.plans.query import Catalog, Source
from runlens.plans.views import View, VIEWS, duck
from runlens.registry import ROUTE_VARIANTS, ROUTES
from runlens.session import fresh_path
from runlens.sources.workspace import artifact_route, file_facts, load_workspace, write_workspace

catalog = Catalog()

VIEWS["v_gate_files"] = View(
    "documents",
    (
        "doc_id div 17 as product",
        VIEWS["v_workspace"].columns[1],
        "case doc_id % 17 when 5 then concat(text, case when doc_id % 3 = 0 then ' [NEEDS CLARIFICATION: срок]' else '' end) "
        "when 6 then replace(text, '. ', '\n### ') "
        "when 7 then concat('- дрейф 1\n', case when doc_id % 2 = 0 then '- дрейф 2\n- дрейф 3\n' else '' end, text) "
        "when 10 then replace(text, ' ', case when doc_id % 2 = 0 then '\n' else ' ' end) "
        "else concat('**Уровень:** ', case when doc_id % 8 = 0 then 'Технический' else 'Продуктовый' end, '\n', text) end as text",
    ),
)

MARK = r"\[(?:NEEDS CLARIFICATION|НУЖНО УТОЧНИТЬ):\s*([^\]]*)\]"


def label(x: str, name: str) -> str:
    return rf"trim(regexp_extract({x}, '(?m)^\*\*{name}:\*\*[ \t]*([^\n]*)$', 1))"


@catalog.add("clarification_markers", duck("v_contracts", rf"""
, parts as (
  select doc_id, unnest(string_split_regex(concat('\n', draft), '\n## ')) as section,
    unnest(range(len(string_split_regex(concat('\n', draft), '\n## ')))) as section_no from v_contracts
), found as (
  select doc_id, section_no, regexp_extract(section, '^Блок ([A-E])\.', 1) as block,
    regexp_extract_all(section, '{MARK}', 1) as qs from parts
)
select doc_id, cast(section_no as int) as section_no, cast(unnest(range(len(qs))) as int) as marker_no, block, unnest(qs) as question
from found""".replace("'\\n", "E'\\n")))
def _(s: Source):
    return ops.clarification_markers(s.contracts)


@catalog.add("contract_lint", duck("v_contracts", rf"""
, d as (
  select *, coalesce(list_filter(string_split(draft, E'\n## '), lambda p: starts_with(p, 'Блок D.'))[1], '') as part from v_contracts
), c as (
  select doc_id, draft, len(list_filter(string_split(part, E'\n'), lambda l: regexp_matches(l, '^[ \t]*[-*][ \t]+[^\n]'))) as limit_items from d
)
select doc_id, concat({', '.join(f"case when contains(concat(E'{chr(92)}n', draft), E'{chr(92)}n## Блок {b}.') then '' else '{b}' end" for b in 'ABCDE')}) as missing_blocks,
  limit_items, limit_items >= 5 as enough_limits, len(regexp_extract_all(draft, '{MARK}')) as open_questions from c"""))
def _(s: Source):
    return ops.contract_lint(s.contracts)


@catalog.add("unresolved_markers", duck("v_contracts", rf"""
, q as (
  select distinct doc_id, unnest(regexp_extract_all(draft, '{MARK}', 1)) as question,
    regexp_extract_all(final, '{MARK}', 1) as kept from v_contracts
)
select doc_id, question, case when list_contains(kept, question) then 'unresolved' else 'resolved' end as state from q"""))
def _(s: Source):
    return ops.unresolved_markers(s.contracts)


RQ = rf"""
, blocks as (
  select doc_id, unnest(string_split(concat(E'\n', text), E'\n### RQ-')[2:]) as b from v_briefs
), q as (
  select doc_id, concat('RQ-', regexp_extract(b, '^([0-9]+)', 1)) as rq, trim(regexp_extract(b, '^[0-9]+:([^\n]*)', 1)) as title,
    case left({label('b', 'Приоритет')}, 1) when '🔴' then 1 when '🟡' then 2 when '🟢' then 3 else 9 end as rank,
    contains(b, '**Способ проверки:**') as has_method
  from blocks
)"""


@catalog.add("rq_priority", duck("v_briefs", RQ + """
select doc_id, cast(row_number() over (partition by doc_id order by rank, rq, title) - 1 as int) as place, cast(rank as int) as rank,
  rq, title, has_method from q"""))
def _(s: Source):
    return ops.rq_priority(s.briefs)


@catalog.add("rq_flags", duck("v_briefs", RQ + """
select doc_id, count(*) as questions, count(*) filter (where not has_method) as without_method,
  not bool_or(rank = 1) as none_critical, count(*) > 15 as too_many from q group by doc_id"""))
def _(s: Source):
    return ops.rq_flags(s.briefs)


TASKS = rf"""
, cut as (
  select doc_id, string_split_regex(concat(E'\n', text), '\n#{{2,4}} ') as bs from v_backlogs
), blocks as (
  select doc_id, unnest(list_filter(bs, lambda b: regexp_matches(b, '^T-[0-9]{{3}}:'))) as b from cut
), tasks as (
  select doc_id, left(b, 5) as task, trim(regexp_extract(b, '^T-[0-9]+:([^\n]*)', 1)) as title, {label('b', 'Эпик')} as epic,
    regexp_extract({label('b', 'Размер')}, '^([A-Z]+)', 1) as size,
    regexp_extract_all({label('b', 'Зависимости')}, 'T-[0-9]{{3}}') as needs,
    regexp_extract_all({label('b', 'Можно параллельно с')}, 'T-[0-9]{{3}}') as beside,
    len(regexp_extract_all(regexp_extract(b, '(?s)\*\*Definition of Done:\*\*(.*?)(\n\*\*|$)', 1), '(?m)^- \[[ xX]\]')) as done_items,
    regexp_extract_all({label('b', 'Связано с ADR')}, 'ADR-[0-9]{{3}}') as decisions
  from blocks
), needs as (select distinct doc_id, task, unnest(needs) as need from tasks)"""


@catalog.add("backlog_tasks", duck("v_backlogs", TASKS + """
select doc_id, task, title, epic, size, array_to_string(needs, ',') as needs, array_to_string(beside, ',') as beside,
  done_items, array_to_string(decisions, ',') as decisions from tasks"""))
def _(s: Source):
    tasks = ops.backlog_tasks(s.backlogs).drop("place")
    return tasks.withColumns({c: F.array_join(c, ",") for c in ("needs", "beside", "decisions")})


@catalog.add("backlog_lint", duck("v_backlogs", TASKS + """
select doc_id, task, 'too_large' as problem from tasks where size not in ('S', 'M', 'L')
union all select doc_id, task, 'no_definition_of_done' from tasks where done_items = 0
union all select doc_id, task, 'needs_itself' from tasks where list_contains(needs, task)
union all select doc_id, task, 'looks_like_epic' from tasks where regexp_matches(title, '^(Реализовать модуль|Сделать |Запилить |Интегрировать )')
union all select n.doc_id, n.task, concat('needs_missing ', need) from needs n
  where not exists (select 1 from tasks t where t.doc_id = n.doc_id and t.task = n.need)"""))
def _(s: Source):
    return ops.backlog_lint(s.backlogs)


@catalog.add("backlog_waves", duck("v_backlogs", TASKS + """
, edges as (select n.* from needs n join tasks t on t.doc_id = n.doc_id and t.task = n.need)
, reach as (
  select doc_id, task, need as above from edges
  union select e.doc_id, e.task, r.above from edges e join reach r on r.doc_id = e.doc_id and r.task = e.need
), looped as (
  select doc_id, task from reach where task = above
), stuck as (
  select doc_id, task from looped
  union select r.doc_id, r.task from reach r join looped l on l.doc_id = r.doc_id and l.task = r.above
), depth as (
  select t.doc_id, t.task, 1 as wave from tasks t
  union select e.doc_id, e.task, d.wave + 1 from edges e join depth d on d.doc_id = e.doc_id and d.task = e.need where d.wave < 9
)
select d.doc_id, d.task, case when s.task is null then cast(max(wave) as int) end as wave
from depth d left join stuck s on s.doc_id = d.doc_id and s.task = d.task group by d.doc_id, d.task, s.task""", recursive=True))
def _(s: Source):
    return ops.backlog_waves(s.backlogs)


@catalog.add("epic_rollup", duck("v_backlogs", TASKS + """
, e as (
  select doc_id, epic, count(*) as tasks, coalesce(sum(case size when 'S' then 0 when 'M' then 1 when 'L' then 2 end), 0) as least_hours,
    coalesce(sum(case size when 'S' then 1 when 'M' then 2 when 'L' then 3 end), 0) as most_hours,
    count(*) filter (where size not in ('S', 'M', 'L')) as unsized
  from tasks group by doc_id, epic
), u as (
  select * from e union all
  select doc_id, 'Итого', sum(tasks), sum(least_hours), sum(most_hours), sum(unsized) from e group by doc_id
)
select doc_id, epic, cast(tasks as bigint) as tasks, cast(least_hours as bigint) as least_hours,
  cast(most_hours as bigint) as most_hours, cast(unsized as bigint) as unsized from u"""))
def _(s: Source):
    return ops.epic_rollup(ops.backlog_tasks(s.backlogs))


INDEX = rf"""
, idx as (
  select product, file_no, cast(regexp_extract(text, '^# ADR-([0-9]+):', 1) as int) as number,
    trim(regexp_extract(text, '^# ADR-[0-9]+:([^\n]*)', 1)) as title, {label('text', 'Дата')} as dated,
    {label('text', 'Статус')} as status, {label('text', 'Уровень')} as level, {label('text', 'Связано с')} as related,
    not contains(text, E'\n## Альтернативы') as no_alternatives, not contains(text, E'\n## Когда пересмотреть') as no_review
  from v_adr_files
)"""


@catalog.add("adr_index", duck("v_adr_files", INDEX + "select * from idx"))
def _(s: Source):
    return ops.adr_index(s.adr_files)


@catalog.add("adr_levels", duck("v_adr_files", INDEX + """
select product, level, count(*) as records, count(*) filter (where no_alternatives) as without_alternatives,
  count(*) filter (where no_review) as without_review from idx group by product, level"""))
def _(s: Source):
    return ops.adr_levels(ops.adr_index(s.adr_files))


@catalog.add("adr_links", duck("v_adr_files", INDEX + """
, e as (
  select product, number, 'replaced_by' as kind, cast(unnest(regexp_extract_all(status, 'ADR-([0-9]{3})', 1)) as int) as target from idx
  union all select product, number, 'related', cast(unnest(regexp_extract_all(related, 'ADR-([0-9]{3})', 1)) as int) from idx
)
select product, number, kind, target, exists (select 1 from idx i where i.product = e.product and i.number = e.target) as known from e"""))
def _(s: Source):
    return ops.adr_links(ops.adr_index(s.adr_files))


@catalog.add("drift_split", duck("v_sync_checks v_adr_files", INDEX + r"""
, part as (
  select product, check_no, string_split(string_split(text, E'\n## ')[2], E'\n') as lines from v_sync_checks
), items as (
  select product, check_no, list_filter(lines, lambda l: starts_with(l, '- ')) as ls from part
), flat as (
  select product, check_no, cast(unnest(range(len(ls))) as int) as place, unnest(ls)[3:] as item from items
)
select product, check_no, place, item, case when exists (
  select 1 from idx i where i.product = f.product and i.number = try_cast(regexp_extract(item, 'ADR-([0-9]{3})', 1) as int))
  then 'evolution' else 'drift' end as kind from flat f"""))
def _(s: Source):
    return ops.drift_split(s.sync_checks, ops.adr_index(s.adr_files))


@catalog.add("stage_gates", duck("v_gate_files", rf"""
, c as (
  select product,
    cast(coalesce(sum(case when file_name = '06-faq.md' then len(regexp_extract_all(text, '(?m)^### ')) end), 0) as bigint) as faq,
    count(*) filter (where starts_with(file_name, 'adr/0') and regexp_matches(text, '(?m)^\*\*Уровень:\*\*[ \t]*Продуктовый')) as decisions,
    max(case when file_name = '09-CLAUDE.md' then length(text) - length(replace(text, E'\n', '')) + 1 end) as context_lines,
    cast(coalesce(sum(case when file_name = '06-vision-contract-final.md' then len(regexp_extract_all(text, '{MARK}')) end), 0) as bigint) as open_markers,
    count(*) filter (where file_name = '06-vision-contract-final.md') as finals,
    cast(coalesce(sum(case when file_name = '07-story-sync-check.md' then len(regexp_extract_all(text, '(?m)^- дрейф')) end), 0) as bigint) as drifts
  from v_gate_files group by product
)
select product, faq, decisions, context_lines, open_markers, drifts, faq >= 10 as faq_ready, decisions between 3 and 5 as decisions_ready,
  coalesce(context_lines <= 100, false) as context_ready, open_markers = 0 and finals > 0 as contract_ready, drifts >= 3 as go_back from c"""))
def _(s: Source):
    return ops.stage_gates(s.gate_files)


@catalog.add("load_workspace", duck("v_workspace", r"""
select product, file_name, text,
  case when regexp_matches(file_name, '^[0-9]{2}-[^/]+\.md$') then 'step'
    when regexp_matches(file_name, '^adr/[0-9]{3}-[^/]+\.md$') then 'decision' else 'other' end as kind,
  try_cast(regexp_extract(file_name, '^([0-9]{2})-[^/]+\.md$', 1) as int) as step_no,
  try_cast(regexp_extract(file_name, '^adr/([0-9]{3})-[^/]+\.md$', 1) as int) as decision_no
from v_workspace"""))
def _(s: Source):
    return file_facts(s.workspace)


@catalog.add("read_workspace", duck("v_workspace", r"""
select cast(product as varchar) as product, file_name, text, case when starts_with(file_name, 'adr/') then 'decision' else 'step' end as kind,
  try_cast(regexp_extract(file_name, '^([0-9]{2})-[^/]+\.md$', 1) as int) as step_no,
  try_cast(regexp_extract(file_name, '^adr/([0-9]{3})-[^/]+\.md$', 1) as int) as decision_no
from v_workspace where file_name like '%.md'"""))
def _(s: Source):
    """The trees are written and read back; only markdown files are looked at."""
    root = fresh_path(s.spark, "workspaces")
    write_workspace(s.workspace, root)
    return load_workspace(s.spark, root).withColumn("text", F.expr("left(text, char_length(text) - 1)"))


def _routes() -> str:
    rows = [(v, f, d) for v, own in ROUTE_VARIANTS.items() for f, d in [*own, *ROUTES]]
    return ", ".join(f"('{v}', '{f}', {'null' if d is None else repr(d)})" for v, f, d in rows)


@catalog.add("artifact_route", duck("v_workspace", f"""
, routes as (select * from (values {_routes()}) as r(variant, name, destination))
select v.variant, w.product, w.file_name,
  case when starts_with(w.file_name, 'adr/') then w.file_name else r.destination end as destination,
  case when r.name is null then 'unmapped' when r.destination is null then 'stays' else 'moves' end as fate
from v_workspace w cross join (values ('status'), ('docs')) as v(variant)
left join routes r on r.variant = v.variant
  and r.name = case when starts_with(w.file_name, 'adr/') then 'adr/' else w.file_name end"""))
def _(s: Source):
    each = [artifact_route(s.workspace, v).withColumn("variant", F.lit(v)) for v in ROUTE_VARIANTS]
    return reduce(DataFrame.unionByName, each)
