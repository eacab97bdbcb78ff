"""Queries on steps, artifacts, decisions, documents and tool calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions import text as rules
from runlens.operators import documents as docs
from runlens.operators import steps as ops
from runlens.plans import rules_sql as sql
from runlens.plans.query import Catalog, Source
from runlens.plans.views import View, VIEWS, duck
from runlens.registry import PIPELINES

catalog = Catalog()

VIEWS["v_prompts"] = View(
    "documents",
    (
        "doc_id",
        "concat(text, case doc_id % 5 when 0 then ' Задай 5-7 уточняющих вопросов.' "
        "when 1 then ' предложи им 3 – 4 метафоры' when 2 then ' Задавай вопросы по одному. 5-7 вопросов' else '' end) as prompt",
    ),
)
VIEWS["v_pairs"] = View(
    "events",
    (
        "event_id",
        "case event_id % 4 when 0 then 'full' when 1 then 'lite' when 2 then 'spec_only' else 'pro' end as version",
        "concat(case when event_id % 4 = 1 then 'L' else 'F' end, 1 + user_id % 12) as step_id",
    ),
)


def _values(rows) -> str:
    quoted = lambda x: "null" if x is None else str(x) if isinstance(x, int) else "'" + x + "'"
    return "(values " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ")"


STEPS = ", steps as (select * from " + _values(
    [(v, p, s[0], s[2]) for v, steps in PIPELINES.items() for p, s in enumerate(steps)]
) + " as t(version, pos, step_id, title))"
NEEDS = STEPS + """
, needs as (select s.id as session_id, s.version, s.current_step, t.pos, t.step_id, t.title
  from v_sessions s join steps t on s.version = t.version)
, saved as (select distinct session_id, step_id from v_artifact_writes)
, prog as (select n.session_id, n.pos, n.step_id, n.title, v.step_id is not null as done, n.step_id = n.current_step as current
  from needs n left join saved v on v.session_id = n.session_id and v.step_id = n.step_id)"""
CURRENT = """
, current as (select * from (
    select *, row_number() over (partition by session_id, step_id order by write_no desc) as k from v_artifact_writes)
  where k = 1)"""


def artifacts(s: Source):
    return ops.artifact_upsert(s.artifact_writes)


@catalog.add("progress", duck("v_sessions v_artifact_writes", NEEDS + """
select session_id, cast(pos as int) as pos, step_id, title, done, current from prog"""))
def _(s: Source):
    return ops.progress(s.sessions, s.artifact_writes)


@catalog.add("can_finish", duck("v_sessions v_artifact_writes", NEEDS + """
select session_id, bool_and(done) as complete, count(*) filter (where done) as saved from prog group by session_id"""))
def _(s: Source):
    return ops.can_finish(s.sessions, s.artifact_writes)


@catalog.add("missing_steps", duck("v_sessions v_artifact_writes", NEEDS + """
select session_id, step_id from needs except select session_id, step_id from saved"""))
def _(s: Source):
    return ops.missing_steps(s.sessions, s.artifact_writes)


@catalog.add("step_lookup", duck("v_pairs", STEPS + """
select p.event_id, p.version, p.step_id, cast(coalesce(t.pos, -1) as bigint) as pos,
  (select step_id from steps f where f.version = p.version and f.pos = 0) as first_step,
  (select step_id from steps n where n.version = p.version and n.pos = t.pos + 1) as next_step
from v_pairs p left join steps t on t.version = p.version and t.step_id = p.step_id"""))
def _(s: Source):
    return ops.step_lookup(s.pairs)


@catalog.add("artifact_upsert", duck("v_artifact_writes", CURRENT + """
select session_id, step_id, write_no, markdown from current"""))
def _(s: Source):
    return artifacts(s)


@catalog.add("artifact_bytes", duck("v_artifact_writes", CURRENT + """
select session_id, cast(sum(strlen(markdown)) as bigint) as total_bytes, max(strlen(markdown)) as largest,
  count(*) filter (where strlen(markdown) > 20000) as oversized, sum(strlen(markdown)) > 12000 as over_cap
from current group by session_id"""))
def _(s: Source):
    return ops.artifact_bytes(s.artifact_writes, max_session=12_000)


@catalog.add("adr_counts", duck("v_adrs", """
select session_id, count(*) as adrs, max(n) + 1 as next_n from v_adrs group by session_id"""))
def _(s: Source):
    return ops.adr_counts(s.adrs)


@catalog.add("adr_numbering", duck("v_adrs", """
select session_id, id, title, row_number() over (partition by session_id order by id) as n from v_adrs"""))
def _(s: Source):
    return ops.adr_numbering(s.adrs)


@catalog.add("adr_list", duck("v_adrs", "select session_id, n, id, title from v_adrs order by 1, 2, 3"))
def _(s: Source):
    return ops.adr_list(s.adrs)


@catalog.add("last_finished", duck("v_sessions", """
select tg_user_id, id, slug, version, consumed from (
  select *, row_number() over (partition by tg_user_id order by id desc) as k from v_sessions where status = 'finished')
where k = 1"""))
def _(s: Source):
    return ops.last_finished(s.sessions).select("tg_user_id", "id", "slug", "version", "consumed")


def write_fold(max_artifact: int, max_session: int) -> str:
    return duck("v_artifact_writes", STEPS + f"""
, sized as (
  select w.session_id, w.write_no, strlen(w.markdown) as bytes, t.pos, n.steps, w.write_no % 31 = 0 as blocked,
    row_number() over (partition by w.session_id order by w.write_no) as rn
  from v_artifact_writes w left join steps t on t.version = w.version and t.step_id = w.step_id
  join (select version, count(*) as steps from steps group by version) n on n.version = w.version
), r as (
  select distinct session_id, cast(null as bigint) as write_no, cast(0 as bigint) as rn, cast(0 as bigint) as pointer,
    [0::bigint, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0] as sizes, cast(null as varchar) as outcome from sized
  union all
  select session_id, write_no, rn, pointer + case when outcome = 'advanced' then 1 else 0 end,
    case when outcome in ('advanced', 'overwritten')
      then list_concat(list_concat(sizes[1:pos], [bytes]), sizes[pos + 2:]) else sizes end, outcome
  from (
    select e.session_id, e.write_no, e.rn, r.pointer, r.sizes, e.pos, e.bytes,
      case when e.blocked then 'question_open' when e.pos is null then 'unknown_step'
        when e.bytes > {max_artifact} then 'too_large'
        when r.pointer < e.steps and e.pos > r.pointer then 'skip_ahead'
        when list_sum(r.sizes) - r.sizes[e.pos + 1] + e.bytes > {max_session} then 'session_full'
        when e.pos = r.pointer then 'advanced' else 'overwritten' end as outcome
    from r join sized e on e.session_id = r.session_id and e.rn = r.rn + 1)
)
select session_id, write_no, outcome, pointer from r where rn > 0""", recursive=True)


def writes(s: Source):
    return s.artifact_writes.select(
        "session_id", "write_no", "version", "step_id",
        F.octet_length("markdown").cast("bigint").alias("bytes"), (F.col("write_no") % 31 == 0).alias("blocked"),
    )


@catalog.add("step_progression", write_fold(20_000, 200_000))
def _(s: Source):
    return ops.step_progression(writes(s))


@catalog.add("step_progression_small_caps", write_fold(6_000, 9_000))
def _(s: Source):
    return ops.step_progression(writes(s), 6_000, 9_000)


@catalog.add("version_change", duck("v_tool_calls", """
, ev as (
  select session_id, seq, name, json_extract_string(args, '$.version') as version,
    json_extract_string(args, '$.step_id') as step_id, row_number() over (partition by session_id order by seq) as rn
  from v_tool_calls where name in ('set_version', 'save_artifact')
), r as (
  select distinct session_id, cast(null as bigint) as seq, cast(0 as bigint) as rn, 'lite' as now, false as has,
    cast(null as varchar) as version, cast(null as varchar) as outcome from ev
  union all
  select e.session_id, e.seq, e.rn,
    case when e.name = 'set_version' and not r.has and e.version in ('lite', 'full', 'spec_only') then e.version else r.now end,
    r.has or (e.name = 'save_artifact' and e.step_id = case r.now when 'lite' then 'L1' when 'full' then 'F1' else 'F8' end),
    e.version,
    case when e.name = 'set_version' then case when e.version not in ('lite', 'full', 'spec_only') then 'unknown_version'
      when r.has then 'has_artifacts' else 'changed' end end
  from r join ev e on e.session_id = r.session_id and e.rn = r.rn + 1
)
select session_id, seq, version, outcome from r where outcome is not null""", recursive=True))
def _(s: Source):
    arg = lambda name: F.get_json_object("args", f"$.{name}").alias(name)
    calls = s.tool_calls.filter("name in ('set_version', 'save_artifact')").select(
        "session_id", "seq", "name", arg("version"), arg("step_id"),
        F.octet_length(F.get_json_object("args", "$.markdown")).alias("bytes"),
    )
    return ops.version_change(calls)


AUDIT = """
, typed as (
  select session_id, seq, turn_id, name, args, reply,
    json_type(args, '$.step_id') as k_step, json_type(args, '$.markdown') as k_md, json_type(args, '$.version') as k_ver,
    json_type(args, '$.name') as k_name, json_type(args, '$.question') as k_q, json_type(args, '$.verdict') as k_say,
    json_type(args, '$.title') as k_title, json_extract_string(args, '$.step_id') as step_id,
    json_extract_string(args, '$.markdown') as md, json_extract_string(args, '$.version') as ver,
    json_extract_string(args, '$.name') as pname, json_extract_string(args, '$.question') as q,
    json_extract_string(args, '$.verdict') as say, json_extract_string(args, '$.title') as title
  from v_tool_calls
), audit as (
  select *, case name
    when 'save_artifact' then case when coalesce(k_step, 'NULL') = 'NULL' then 'missing_step_id'
      when k_step <> 'VARCHAR' then 'type_step_id' when coalesce(k_md, 'NULL') = 'NULL' then 'missing_markdown'
      when k_md <> 'VARCHAR' then 'type_markdown' else 'ok' end
    when 'set_version' then case when ver not in ('lite', 'full', 'spec_only') then 'value_version' else 'ok' end
    when 'set_product_name' then case when coalesce(k_name, 'NULL') = 'NULL' then 'missing_name' else 'ok' end
    when 'ask_question' then case when k_q = 'VARCHAR' then 'ok' else 'missing_question' end
    when 'assess_answer' then case when say not in ('answer', 'partial', 'offtopic') then 'value_verdict' else 'ok' end
    when 'create_adr' then case when k_title is null then 'missing_title' when k_md is null then 'missing_markdown' else 'ok' end
    when 'finish' then 'ok' else 'unknown_tool' end as verdict from typed
)"""


@catalog.add("tool_args_audit", duck("v_tool_calls", AUDIT + "select session_id, seq, name, verdict from audit"))
def _(s: Source):
    return ops.tool_args_audit(s.tool_calls).select("session_id", "seq", "name", "verdict")


IDS = "case version when 'lite' then {lite} when 'full' then {full} else {spec_only} end".format(
    **{v: str([x[0] for x in steps]) for v, steps in PIPELINES.items()}
)
QT = sql.strip(sql.marks("q"))


REPLAY = f"""
, ready as (
  select *, verdict = 'ok' and case name
      when 'ask_question' then <<ask>>
      when 'set_product_name' then {sql.strip('pname')} <> '' and length({sql.strip('pname')}) <= 120
        and length({sql.slug('pname')}) >= 3 and {sql.slug('pname')} <> 'product'
      when 'create_adr' then title <> '' and md <> '' else true end as fine,
    {sql.slug("coalesce(pname, '')")} as made, <<offered>> as option, {sql.dont_know(sql.plain_reply('reply'))} as unknown,
    row_number() over (partition by session_id order by seq) as rn
  from audit
)<<choice>>, r as (
  select distinct session_id, cast(0 as bigint) as rn, 'lite' as version, cast(0 as bigint) as pointer,
    cast([] as bigint[]) as kept, false as open, cast(0 as bigint) as spent, cast(null as varchar) as verdict,
    cast(0 as bigint) as adrs, cast(null as varchar) as slug, 'active' as status, cast(-1 as bigint) as turn_id,
    true as judged, false as stopped from chosen
  union all
  select session_id, rn,
    case when act = 'set_version' and len(kept) = 0 then ver else version end,
    case when act = 'set_version' and len(kept) = 0 then 0 when saves and spot = pointer + 1 then pointer + 1 else pointer end,
    case when saves then list_distinct(list_append(kept, spot)) else kept end,
    case when act = 'ask_question' then true when closes then false else open end,
    case when closes then 0 when act = 'assess_answer' then spent + 1 else spent end,
    case when act = 'assess_answer' then say else verdict end,
    case when act = 'create_adr' then adrs + 1 else adrs end,
    case when act = 'set_product_name' then made else slug end,
    case when act = 'finish' and pointer >= len(ids) then 'finished' else status end,
    turn_id, judged or act = 'assess_answer', stopped or act = 'ask_question'
  from (
    select *, act = 'save_artifact' and not open and bytes <= 20000 and spot > 0 and (pointer >= len(ids) or spot <= pointer + 1) as saves,
      act = 'assess_answer' and (unknown or open and picked or say = 'answer' or spent >= 2) as closes
    from (
      select *, {IDS} as ids, coalesce(list_position({IDS}, step_id), 0) as spot,
        case when fine and not stopped and (judged or name = 'assess_answer') then name else 'none' end as act
      from (
        select e.session_id, e.rn, e.turn_id, e.name, e.fine, e.ver, e.step_id, e.say, e.made, e.unknown, e.picked, octet_length(encode(e.md)) as bytes,
          r.version, r.pointer, r.kept, r.open, r.spent, r.verdict, r.adrs, r.slug, r.status,
          case when e.turn_id <> r.turn_id then not r.open else r.judged end as judged,
          case when e.turn_id <> r.turn_id then false else r.stopped end as stopped
        from r join chosen e on e.session_id = r.session_id and e.rn = r.rn + 1)))
)
select session_id, version, status, slug, verdict, open, spent, len(kept) as artifacts, adrs,
  coalesce(({IDS})[pointer + 1], '_finish') as current_step
from (select *, row_number() over (partition by session_id order by rn desc) as k from r) where k = 1"""


PLAIN = {
    "ask": f"{sql.question(QT, 'q')} = 'ok' and {sql.rendered(QT)} = 'ok'", "offered": "null",
    "choice": ", chosen as (select *, false as picked from ready)",
}
LED = sql.strip(sql.marks("case when json_type(args, '$.preamble') = 'VARCHAR' then json_extract_string(args, '$.preamble') end"))
SHOWN = f"case when {LED} = '' then {QT} else concat({LED}, chr(10), chr(10), {QT}) end"
RICH = {
    "ask": f"{sql.preamble(LED)} = 'ok' and {sql.question(QT, 'q')} = 'ok' and {sql.rendered(f'({SHOWN})')} = 'ok'",
    "offered": """case when json_type(args, '$.options') = 'ARRAY' then list_transform(
      list_filter(json_extract(args, '$.options[*]'), lambda o: json_type(o) = 'VARCHAR'), lambda o: json_extract_string(o, '$')) end""",
    # the options of the last question that passed the rules, found in the reply as whole words
    "choice": f""", before as (
  select *, last_value(case when name = 'ask_question' and fine then struct_pack(o := option) end ignore nulls) over (
    partition by session_id order by seq rows between unbounded preceding and 1 preceding) as offer, {sql.plain_reply('reply')} as t from ready
), chosen as (
  select *, coalesce(len(list_filter(offer.o, lambda o: contains(concat(' ', t, ' '), concat(' ', {sql.plain_reply('o')}, ' ')))) > 0, false) as picked
  from before
)""",
}


def replay_sql(rules_sql: dict[str, str]) -> str:
    found = REPLAY
    for name, text in rules_sql.items():
        found = found.replace(f"<<{name}>>", text)
    return found


@catalog.add("tool_replay", duck("v_tool_calls", AUDIT + replay_sql(PLAIN), recursive=True))
def _(s: Source):
    return ops.tool_replay(s.tool_calls)


RICH_AUDIT = AUDIT.replace("v_tool_calls", "v_rich_calls")


@catalog.add("tool_replay_choices", duck("v_rich_calls", RICH_AUDIT + replay_sql(RICH), recursive=True))
def _(s: Source):
    """Options that decide, lead-ins that are refused, artifacts over the cap."""
    return ops.tool_replay(s.rich_calls)


ALLOWED = " ".join(f"when '{v}' then step_id in ({', '.join(repr(x[0]) for x in steps)})" for v, steps in PIPELINES.items())


@catalog.add("tool_schema_audit", duck("v_rich_calls", f"""
, t as (
  select *, json_extract_string(args, '$.step_id') as step_id, json_type(args, '$.preamble') as k_pre, json_type(args, '$.options') as k_opt,
    json_type(args, '$.missing') as k_miss, json_extract_string(args, '$.version') as ver from v_rich_calls
)
select session_id, seq, coalesce(nullif(concat_ws(',',
  case when name = 'save_artifact' and not case version {ALLOWED} end then 'value_step_id' end,
  case when name = 'set_version' and ver not in ('lite', 'full', 'spec_only') then 'value_version' end,
  case when name = 'ask_question' and k_pre <> 'VARCHAR' then 'type_preamble' end,
  case when name = 'ask_question' and k_opt <> 'ARRAY' then 'type_options'
    when name = 'ask_question' and len(list_filter(json_extract(args, '$.options[*]'), lambda o: json_type(o) <> 'VARCHAR')) > 0 then 'item_options' end,
  case when name = 'assess_answer' and k_miss <> 'VARCHAR' then 'type_missing' end), ''), 'ok') as problems
from t"""))
def _(s: Source):
    return ops.tool_schema_audit(s.rich_calls).select("session_id", "seq", "problems")


def spec_sql(runs: str) -> str:
    return STEPS + CURRENT + f"""
, runs as ({runs})
, blocks as (
  select id as session_id, -1 as place, 0 as id, concat('# ', slug, ' — Product Spec\n\n_Сгенерировано автоматически (версия: ', version, ')._') as block from runs
  union all
  select c.session_id, t.pos, 0, concat('## ', t.step_id, '. ', t.title, '\n\n', {sql.strip('c.markdown')})
  from current c join runs r on r.id = c.session_id join steps t on t.version = r.version and t.step_id = c.step_id
  where c.markdown <> ''
  union all select distinct session_id, 100, 0, '## Решения (ADR)' from v_adrs where session_id in (select id from runs)
  union all select session_id, 1000 + n, id, concat('### ADR-', n, ': ', title, '\n\n', {sql.strip('markdown')})
  from v_adrs where session_id in (select id from runs)
)"""


@catalog.add("assemble_spec", duck("v_sessions v_artifact_writes v_adrs", spec_sql(
    "select id, slug, version from v_sessions") + "select session_id, cast(place as bigint) as place, cast(id as bigint) as id, block from blocks"))
def _(s: Source):
    return docs.assemble_spec(s.sessions, artifacts(s), s.adrs)


REDELIVERY = duck("v_sessions v_artifact_writes v_adrs", spec_sql("""
select tg_user_id, id, slug, version from (
  select *, row_number() over (partition by tg_user_id order by id desc) as k from v_sessions where status = 'finished')
where k = 1""") + """
select tg_user_id, session_id, concat(slug, '-spec.md') as file_name, cast(place as bigint) as place, cast(blocks.id as bigint) as id, block
from blocks join runs on runs.id = blocks.session_id""")


@catalog.add("spec_redelivery", REDELIVERY)
def _(s: Source):
    return docs.spec_redelivery(s.sessions, artifacts(s), s.adrs)


@catalog.add("write_specs", REDELIVERY)
def _(s: Source):
    from runlens.session import fresh_path
    from runlens.sources.workspace import read_specs, write_specs

    path = fresh_path(s.spark, "specs")
    write_specs(docs.spec_redelivery(s.sessions, artifacts(s), s.adrs), path)
    return read_specs(s.spark, path)


@catalog.add("write_spec_texts", f"""
select session_id, file_name, concat(regexp_replace(string_agg(block, E'\\n\\n' order by place, id), '\\s+$', ''), E'\\n') as spec
from ({REDELIVERY}) group by session_id, file_name""")
def _(s: Source):
    from runlens.session import fresh_path
    from runlens.sources.workspace import read_spec_texts, write_spec_texts

    path = fresh_path(s.spark, "spec-texts")
    write_spec_texts(docs.spec_redelivery(s.sessions, artifacts(s), s.adrs), path)
    return read_spec_texts(s.spark, path)


@catalog.add("slugs", duck("v_names", f"select doc_id, {sql.slug('name')} as slug from v_names"))
def _(s: Source):
    return s.names.select("doc_id", rules.slug(F.col("name")).alias("slug"))


@catalog.add("slug_collisions", duck("v_names", f"""
select {sql.slug('name')} as slug, count(*) as times from v_names group by 1 having count(*) > 1"""))
def _(s: Source):
    return docs.slug_collisions(s.names)


@catalog.add("product_names", duck("v_names", f"""
, g as (select *, {sql.slug('name')} as s, {sql.strip('name')} as raw from v_names)
, v as (select *, raw <> '' and length(raw) <= 120 and length(s) >= 3 and s <> 'product' as good from g)
select user_id, coalesce(arg_max(s, doc_id) filter (where good), concat('product-', user_id)) as slug,
  count(*) filter (where not good) as refused from v group by user_id"""))
def _(s: Source):
    return docs.product_names(s.names)


@catalog.add("redact_events", duck("v_error_events", """
select doc_id, doc_id % 11 = 0 as malformed, case when doc_id % 11 = 0 then '«REDACTED»' else
  concat('{"message": "boom «REDACTED» and «REDACTED»x", "extra": {"bot_token": "«REDACTED»", ',
  '"user": {"Password": "«REDACTED»"}, "text": "«REDACTED»", "tags": ["«REDACTED»d", ',
  '{"dsn": "«REDACTED»", "API-key": "«REDACTED»", "caption": "«REDACTED»"}], "n": ', doc_id, '}}') end as event from v_error_events"""))
def _(s: Source):
    return docs.redact_events(s.error_events)


NAME = "[A-Za-z0-9_-]*"
SECRET = rf"(?i)({NAME}(?:token|secret|password|api[_-]?key|authorization|dsn){NAME}\"?\s*[=:]\s*\"?)([^\s\",;]+)"
KINDS = {"token": "token", "secret": "secret", "password": "password", "api_key": "api[_-]?key",
         "authorization": "authorization", "dsn": "dsn"}


@catalog.add("redact_text", "select doc_id, regexp_replace(text, '"
             + SECRET + r"', '\1«REDACTED»', 'g') as text, " + ", ".join(
    rf"len(regexp_extract_all(text, '(?i){k}{NAME}\"?\s*[=:]\s*\"?[^\s\",;]+')) as {n}" for n, k in KINDS.items())
    + " from documents")
def _(s: Source):
    text = F.col("text")
    hidden = s.table("documents").select(
        "doc_id", rules.redact_text(text).alias("text"), rules.secret_names(text).alias("names")
    )
    return hidden.withColumns(rules.secret_kinds(F.col("names"))).drop("names")


VIEWS["v_markdown"] = View(
    "documents",
    (
        "doc_id",
        "concat('  ## ', source, ' <', lang, '> \n\n- *first* & **bold ', lang, '** word\n* _second_ `x_y`, 2*3 a_b_c\n\n', "
        "text, '\n### \"end\"  ') as text",
    ),
)
HTML = "text"
for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
    HTML = f"replace({HTML}, '{sign}', '{entity}')"
for pattern, tag in (
    (r"\*\*(.+?)\*\*", r"<b>\1</b>"),
    (r"(?m)^\s{0,3}#{1,6}\s*(.+?)\s*$", r"<b>\1</b>"),
    (r"(?m)^(\s*)[-*]\s+", r"\1• "),
    (r"\*([^*\s][^*\n]*?)\*", r"<i>\1</i>"),
    (rf"(^|[^{sql.WORD}])_([^_\s][^_\n]*?)_($|[^{sql.WORD}])", r"\1<i>\2</i>\3"),
    (r"`([^`\n]+?)`", r"<code>\1</code>"),
):
    HTML = f"regexp_replace({HTML}, '{pattern}', '{tag}', 'g')"


@catalog.add("md_to_html", duck("v_markdown", f"select doc_id, {HTML} as html from v_markdown"))
def _(s: Source):
    return s.markdown.select("doc_id", rules.md_to_html(F.col("text")).alias("html"))


# texts without tags: lines are cut at 4048 characters and put together as long as they fit
CHUNKS = """with recursive lines as (
  select doc_id, unnest(string_split(text, E'\\n')) as line, unnest(range(len(string_split(text, E'\\n')))) as line_no
  from documents where length(text) > 4096
), pieces as (
  select doc_id, line_no, cut, substring(line, cut * 4048 + 1, 4048) as piece
  from (select *, unnest(range(greatest(1, (length(line) + 4047) // 4048))) as cut from lines)
), numbered as (
  select *, length(piece) as size, row_number() over (partition by doc_id order by line_no, cut) as rn from pieces
), packed as (
  select distinct doc_id, cast(0 as bigint) as rn, cast(0 as bigint) as held, cast(0 as bigint) as chunk_no, '' as piece, false as kept
  from numbered
  union all
  select n.doc_id, n.rn,
    case when p.held > 0 and p.held + 1 + n.size <= 4048 then p.held + 1 + n.size else n.size end,
    case when p.held > 0 and p.held + 1 + n.size > 4048 then p.chunk_no + 1 else p.chunk_no end,
    n.piece, n.size > 0 or (p.held > 0 and p.held + 1 + n.size <= 4048)
  from packed p join numbered n on n.doc_id = p.doc_id and n.rn = p.rn + 1
)
select doc_id, cast(chunk_no as int) as chunk_no, string_agg(piece, E'\\n' order by rn) as chunk
from packed where kept group by doc_id, chunk_no
union all select doc_id, 0, text from documents where length(text) <= 4096"""


@catalog.add("chunk_documents", CHUNKS)
def _(s: Source):
    return docs.chunk_documents(s.table("documents"))


# marked-up texts: a long line is cut before a tag that the cut would fall into; tags open at a chunk's end are closed and opened again
CHUNK_HTML = f"""
, marked as (select doc_id, {HTML} as text from v_markdown)
, lines as (
  select doc_id, unnest(string_split(text, E'\\n')) as line, unnest(range(len(string_split(text, E'\\n')))) as line_no
  from marked where length(text) > 4096
), cuts as (
  select doc_id, line_no, cast(0 as bigint) as cut, cast(null as varchar) as piece, line as rest from lines
  union all
  select doc_id, line_no, cut + 1, left(rest, reach), substring(rest, reach + 1) from (
    select *, case when length(rest) <= 4048 then length(rest) when opened > closed and opened > 1 then opened - 1 else 4048 end as reach from (
      select *, case when contains(part, '<') then 4049 - strpos(reverse(part), '<') else 0 end as opened,
        case when contains(part, '>') then 4049 - strpos(reverse(part), '>') else 0 end as closed
      from (select *, left(rest, 4048) as part from cuts where rest <> '' or cut = 0)))
), numbered as (
  select *, length(piece) as size, row_number() over (partition by doc_id order by line_no, cut) as rn from cuts where cut > 0
), packed as (
  select distinct doc_id, cast(0 as bigint) as rn, cast(0 as bigint) as held, cast(0 as bigint) as chunk_no, '' as piece, false as kept
  from numbered
  union all
  select n.doc_id, n.rn,
    case when p.held > 0 and p.held + 1 + n.size <= 4048 then p.held + 1 + n.size else n.size end,
    case when p.held > 0 and p.held + 1 + n.size > 4048 then p.chunk_no + 1 else p.chunk_no end,
    n.piece, n.size > 0 or (p.held > 0 and p.held + 1 + n.size <= 4048)
  from packed p join numbered n on n.doc_id = p.doc_id and n.rn = p.rn + 1
), bodies as (
  select doc_id, chunk_no, string_agg(piece, E'\\n' order by rn) as body from packed where kept group by doc_id, chunk_no
), tagged as (
  select *, list_transform(regexp_extract_all(body, '</?[a-zA-Z0-9]+[^>]*>'), lambda t:
    [case when starts_with(t, '</') then '/' else '' end || lower(regexp_extract(t, '^</?([a-zA-Z0-9]+)', 1))]) as tags from bodies
), balanced as (
  select distinct doc_id, cast(-1 as bigint) as chunk_no, '' as chunk, cast([] as varchar[]) as open from bodies
  union all
  select doc_id, chunk_no, concat(array_to_string(list_transform(carried, lambda t: '<' || t || '>'), ''), body,
    array_to_string(list_transform(list_reverse(open), lambda t: '</' || t || '>'), '')), open
  from (
    select t.doc_id, t.chunk_no, t.body, b.open as carried, list_reduce(list_concat([b.open], t.tags), lambda held, tag:
      case when not starts_with(tag[1], '/') then list_concat(held, tag)
        when not list_contains(held, tag[1][2:]) then held
        else list_concat(held[1:len(held) - list_position(list_reverse(held), tag[1][2:])],
          held[len(held) - list_position(list_reverse(held), tag[1][2:]) + 2:len(held)]) end) as open
    from balanced b join tagged t on t.doc_id = b.doc_id and t.chunk_no = b.chunk_no + 1)
)
select doc_id, cast(chunk_no as int) as chunk_no, chunk from balanced where chunk_no >= 0
union all select doc_id, 0, text from marked where length(text) <= 4096"""


@catalog.add("chunk_html", duck("v_markdown", CHUNK_HTML, recursive=True))
def _(s: Source):
    marked = s.markdown.select("doc_id", rules.md_to_html(F.col("text")).alias("text"))
    return docs.chunk_documents(marked)


@catalog.add("registry_lint", duck("v_prompts", """
select doc_id, regexp_matches(prompt, '(?i)(зада(й|вай)|спроси|предложи)[^.]{0,40}?\\d+\\s*[-–—]\\s*\\d+\\s*[^.]{0,20}?(вопрос|метафор)') as asks_many
from v_prompts"""))
def _(s: Source):
    return s.prompts.select("doc_id", F.col("prompt").rlike(rules.MULTI_ASK).alias("asks_many"))
