"""Queries on transcripts, questions and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions import text as rules
from runlens.operators import dialogue as ops
from runlens.plans import rules_sql as sql
from runlens.plans.query import Catalog, Source
from runlens.plans.views import View, VIEWS, duck

catalog = Catalog()

VIEWS["v_asked"] = View(
    "events",
    (
        "user_id as session_id",
        "event_id as id",
        "case when event_type = 'click' then 'user' else 'assistant' end as role",
        "case when event_type = 'error' then 'Понял, идём дальше.' "
        "else concat('Хорошо. 2) Что у вас за  **', event_type, '** процесс? Ещё?') end as text",
    ),
)
VIEWS["v_rendered"] = View(
    "conversations",
    (
        "conv_id as session_id",
        "turn as id",
        "case when turn % 2 = 0 then concat('  Понял про ', role, case when conv_id % 9 = 0 then '?' else '.' end, ' ') "
        "when turn % 3 = 0 then ' ' end as preamble",
        "case when conv_id % 4 = 0 then text else concat(text, '⁇') end as question",
    ),
)
VIEWS["v_gate_calls"] = View(
    "events",
    (
        "user_id div 4 as session_id",
        "event_id div 7 as turn_id",
        "event_id as seq",
        "case event_type when 'signup' then 'assess_answer' when 'click' then 'ask_question' else 'save_artifact' end as name",
        "event_id % 3 <> 0 as accepted",
        "event_id div 7 % 2 = 0 as owed",
    ),
)


def tail(limit: int) -> str:
    return f"""
, tail as (
  select * from (select *, row_number() over (partition by session_id order by id desc) as k from v_messages)
  where k <= {limit}
)"""


def history(raw: int, keep: int) -> str:
    return duck("v_messages", tail(raw) + f"""
, marked as (
  select *, case when lag(role) over w is distinct from role then 1 else 0 end as turned from tail
  window w as (partition by session_id order by id)
), runs as (
  select *, sum(turned) over (partition by session_id order by id) as run from marked
), merged as (
  select session_id, run, any_value(role) as role, min(id) as first_id, string_agg(text, '\n\n' order by id) as content,
    row_number() over (partition by session_id order by run desc) as back
  from runs group by session_id, run
), kept as (select * from merged where back <= {keep})
select session_id, role, first_id, content from kept k
where run >= (select min(run) from kept u where u.session_id = k.session_id and u.role = 'user')""")


@catalog.add("append_messages", duck("v_messages", "select session_id, id, role, text from v_messages"))
def _(s: Source):
    from runlens.session import fresh_path
    from runlens.sources.tables import append_messages

    path = fresh_path(s.spark, "messages")
    append_messages(s.messages.filter("id < 3"), path)
    append_messages(s.messages.filter("id >= 3"), path)
    return s.spark.read.parquet(path).select("session_id", "id", "role", "text")


@catalog.add("transcript_tail", duck("v_messages", tail(3) + "select session_id, id, role, text from tail"))
def _(s: Source):
    return ops.transcript_tail(s.messages, 3)


@catalog.add("trim_history", duck("v_messages", tail(40) + "select session_id, id, role, text from tail"))
def _(s: Source):
    return ops.transcript_tail(s.messages)


@catalog.add("trim_history_short", duck("v_messages", tail(5) + "select session_id, id, role, text from tail"))
def _(s: Source):
    """A limit that sessions do reach."""
    return ops.transcript_tail(s.messages, 5)


@catalog.add("normalize_history", history(40, 40))
def _(s: Source):
    return ops.normalize_history(s.messages)


@catalog.add("normalize_history_short", history(6, 3))
def _(s: Source):
    return ops.normalize_history(s.messages, 6, 3)


@catalog.add("double_user_rows", duck("v_messages", """
select session_id, id from (
  select *, lag(role) over (partition by session_id order by id) as prev from v_messages)
where role = 'user' and prev = 'user'"""))
def _(s: Source):
    return ops.double_user_rows(s.messages)


@catalog.add("verbatim_reask", duck("v_asked", f"""
, q as (select session_id, id, {sql.first_question('text')} as question from v_asked where role = 'assistant')
select session_id, id, question from (
  select *, lag(question) over (partition by session_id order by id) as prev from q where question is not null)
where question = prev"""))
def _(s: Source):
    return ops.verbatim_reask(s.asked)


@catalog.add("unanswered_tail", duck("v_messages v_sessions", f"""
, last as (
  select * from (select *, row_number() over (partition by session_id order by id desc) as k from v_messages) where k = 1
), state as (
  select l.session_id, l.id as last_id, case when role = 'user' then 'no_reply'
    when not contains({sql.marks('text')}, '?') and status = 'active' and current_question is null
    then 'nothing_asked' end as state
  from last l left join v_sessions s on s.id = l.session_id
)
select * from state where state is not null"""))
def _(s: Source):
    return ops.unanswered_tail(s.messages, s.sessions)


@catalog.add("turn_rollup", duck("v_pieces", f"""
select session_id, turn_id, string_agg(text, '\n\n' order by seq) as text
from v_pieces where {sql.strip('text')} <> '' group by session_id, turn_id"""))
def _(s: Source):
    return ops.turn_rollup(s.pieces)


T = sql.strip(sql.marks("text"))
LINT = f"""
, t as (select *, {T} as t from v_messages)
, lint as (select session_id, id, role, {sql.question('t', 'text')} as question, {sql.prose('t')} as prose,
  {sql.preamble('t')} as preamble, {sql.rendered('t')} as rendered, {sql.count('t', '?')} as marks from t)"""


@catalog.add("question_lint", duck("v_messages", LINT + "select session_id, id, question, marks from lint"))
def _(s: Source):
    return ops.question_lint(s.messages).select("session_id", "id", "question", "marks")


@catalog.add("prose_lint", duck("v_messages", LINT + "select session_id, id, prose from lint"))
def _(s: Source):
    return ops.question_lint(s.messages).select("session_id", "id", "prose")


@catalog.add("preamble_lint", duck("v_messages", LINT + "select session_id, id, preamble from lint"))
def _(s: Source):
    return ops.question_lint(s.messages).select("session_id", "id", "preamble")


@catalog.add("rendered_lint", duck("v_rendered", f"""
, r as (select *, case when {sql.strip("coalesce(preamble, '')")} = '' then {sql.strip('question')}
    else concat({sql.strip('preamble')}, '\n\n', {sql.strip('question')}) end as shown from v_rendered)
, n as (select *, {sql.strip(sql.marks('shown'))} as t from r)
select session_id, id, shown, {sql.rendered('t')} as verdict from n"""))
def _(s: Source):
    shown = rules.rendered(F.col("preamble"), F.col("question"))
    return s.rendered.select("session_id", "id", shown.alias("shown")).withColumn(
        "verdict", rules.rendered_verdict(rules.cleaned(F.col("shown")))
    )


@catalog.add("normalize_marks", duck("v_messages", f"""
select session_id, id, {sql.marks('text')} as text from v_messages"""))
def _(s: Source):
    return s.messages.select("session_id", "id", rules.normalize_marks(F.col("text")).alias("text"))


@catalog.add("first_question", duck("v_messages", f"""
select session_id, id, {sql.first_question('text')} as question from v_messages"""))
def _(s: Source):
    return s.messages.select("session_id", "id", rules.first_question(F.col("text")).alias("question"))


@catalog.add("discipline_rates", duck("v_messages", LINT + """
select session_id, role, count(*) as n, max(marks) as max_marks,
  count(*) filter (where question <> 'ok') / count(*) as question_share,
  count(*) filter (where prose <> 'ok') / count(*) as prose_share,
  count(*) filter (where preamble <> 'ok') / count(*) as preamble_share,
  count(*) filter (where rendered <> 'ok') / count(*) as rendered_share
from lint group by session_id, role"""))
def _(s: Source):
    return ops.discipline_rates(s.messages)


OPTIONS = "array('скорость', 'регулярность', 'результат')"


def answers(s: Source):
    return s.answers.withColumn("options", F.expr(f"if(has_options, {OPTIONS}, null)"))


ANSWERS = f"""
, n as (select *, {sql.plain_reply('reply')} as t from v_answers)
, c as (select *, {sql.dont_know('t')} as unknown, case when has_options then
    list_filter(['скорость', 'регулярность', 'результат'], lambda o: contains(concat(' ', t, ' '), concat(' ', o, ' ')))[1] end as value from n)"""


@catalog.add("dont_know", duck("v_answers", ANSWERS + "select session_id, seq, unknown from c"))
def _(s: Source):
    return s.answers.select("session_id", "seq", rules.is_dont_know(F.col("reply")).alias("unknown"))


@catalog.add("choice_match", duck("v_answers", ANSWERS + "select session_id, seq, value from c"))
def _(s: Source):
    return answers(s).select(
        "session_id", "seq", rules.match_choice(F.col("reply"), F.col("options")).alias("value")
    )


def resolution(budget: int, skips: str = "skipped") -> str:
    return duck("v_answers", ANSWERS + f"""
, ev as (
  select session_id, seq, verdict, value, row_number() over (partition by session_id order by seq) as rn,
    case when {skips} then 'user_skip' when unknown then 'user_said_unknown'
      when value is not null then 'deterministic_choice_match' when verdict = 'answer' then 'llm_answer' end as hard
  from c
), r as (
  select distinct session_id, cast(null as bigint) as seq, cast(0 as bigint) as rn, cast(0 as bigint) as clarify_count,
    false as terminal, cast(null as varchar) as reason, cast(null as varchar) as status, cast(null as varchar) as value
  from ev
  union all
  select e.session_id, e.seq, e.rn,
    case when e.hard is not null or r.clarify_count >= {budget} then 0 else r.clarify_count + 1 end,
    e.hard is not null or r.clarify_count >= {budget},
    coalesce(e.hard, case when r.clarify_count >= {budget} then 'clarify_budget_exhausted' else 'need_clarify' end),
    case when e.hard = 'user_skip' then 'skipped' when e.hard = 'user_said_unknown' then 'unknown'
      when e.hard is not null then 'complete'
      when r.clarify_count >= {budget} then case when e.verdict in ('partial', 'offtopic') then e.verdict else 'unknown' end end,
    case when e.hard = 'deterministic_choice_match' then e.value end
  from r join ev e on e.session_id = r.session_id and e.rn = r.rn + 1
)
select session_id, seq, terminal, reason, status, value, clarify_count from r where rn > 0""", recursive=True)


@catalog.add("answer_resolution", resolution(2, "false"))
def _(s: Source):
    return ops.answer_resolution(answers(s).withColumn("skipped", F.lit(False)))


@catalog.add("skip_handling", resolution(2))
def _(s: Source):
    return ops.answer_resolution(answers(s))


@catalog.add("order_gate", duck("v_gate_calls", """
, a as (
  select *, (select min(seq) from v_gate_calls x where x.session_id = c.session_id and x.turn_id = c.turn_id
      and x.name = 'assess_answer' and x.accepted) as judged_at from v_gate_calls c
), g as (
  select *, owed and name <> 'assess_answer' and seq < coalesce(judged_at, seq + 1) as gated from a
), q as (
  select *, min(case when name = 'ask_question' and accepted and not gated then seq end)
    over (partition by session_id, turn_id) as asked_at from g
)
select session_id, turn_id, seq, name, accepted, owed,
  case when seq > coalesce(asked_at, seq) then 'skipped' when gated then 'gated' else 'executed' end as fate from q"""))
def _(s: Source):
    return ops.order_gate(s.gate_calls)


# the loop itself, round after round
@catalog.add("turn_outcomes", duck("v_rounds", f"""
, j as (
  select *, coalesce(stop_reason = 'max_tokens', false) as cut, {sql.prose(sql.strip(sql.marks('text')))} as prose,
    row_number() over (partition by turn_id order by round) as rn
  from v_rounds where round < 6
), r as (
  select distinct turn_id, cast(0 as bigint) as rn, 0 as cuts, 0 as breaches, false as said, false as did_ask, cast(null as varchar) as failed,
    false as done, false as on_now, false as open_now from j
  union all
  select turn_id, rn, cuts + case when cut then 1 else 0 end, breaches + case when breach then 1 else 0 end,
    said or (not cut and not breach and coalesce(text, '') <> '' and prose = 'ok'), did_ask or (not cut and not breach and asked),
    case when cut and cuts = 1 then 'truncated' when breach and breaches = 1 then 'violation' end,
    (cut and cuts = 1) or (breach and breaches = 1) or (not cut and not breach and (tools = 0 or asked)), active, open
  from (
    select r.*, j.rn as next_rn, j.cut, j.prose, j.text, j.tools, j.asked, j.active, j.open, not j.cut and not j.asks and coalesce(j.text, '') <> '' and j.prose <> 'ok' as breach
    from r join j on j.turn_id = r.turn_id and j.rn = r.rn + 1 where not r.done) x(turn_id, old_rn, cuts, breaches, said, did_ask, failed, done, on_now,
      open_now, rn, cut, prose, text, tools, asked, active, open, breach)
)
select turn_id, rn as rounds, case when failed is not null then failed when not said and not did_ask then 'silent'
    when not did_ask and on_now and not open_now then 'stranded' when did_ask then 'asked' else 'said' end as outcome,
  cuts > 0 as retried_cut, breaches > 0 as retried_breach
from (select *, row_number() over (partition by turn_id order by rn desc) as k from r) where k = 1 and rn > 0""", recursive=True))
def _(s: Source):
    return ops.turn_outcomes(s.rounds)
