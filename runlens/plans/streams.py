"""Streaming queries, run over the files of the tables until they are drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions.text import question_marks
from runlens.operators.ledger import dedup_payments
from runlens.plans.dialogue import catalog as dialogue
from runlens.plans.money import catalog as money
from runlens.plans.money import folded
from runlens.plans.query import Catalog, Source
from runlens.plans.rules_sql import marks
from runlens.plans.telemetry import catalog as telemetry
from runlens.plans.steps import catalog as steps
from runlens.plans.telemetry import CLASS, FLAGGED, windows
from runlens.plans.views import TABLES, VIEWS, duck
from runlens.session import fresh_path
from runlens.streaming import live, replay, watermarks

catalog = Catalog()


def stream(s: Source, view: str):
    source = VIEWS[view].source
    return VIEWS[view].over(live.table_stream(s.spark, s.sf_dir, source, TABLES[source]))


@catalog.add("stream_append_messages", dialogue.oracles["append_messages"])
def _(s: Source):
    return live.drained(stream(s, "v_messages"), "append", "messages").drop("batch")


def transcript(s: Source):
    marks = question_marks(F.col("text")).alias("marks")
    rows = stream(s, "v_messages").select(
        "session_id", F.lit(0).cast("bigint").alias("us"), F.col("id").alias("event_id"), F.col("role").alias("kind"), marks
    )
    return live.live_messages(rows)


@catalog.add("stream_double_users", dialogue.oracles["double_user_rows"])
def _(s: Source):
    found = transcript(s).filter("result = 'double_user'")
    return found.select("session_id", F.col("event_id").alias("id"))


@catalog.add("live_messages", duck("v_messages v_sessions", f"""
, seen as (
  select *, lag(role) over w as before, row_number() over (partition by session_id order by id desc) as back
  from v_messages window w as (partition by session_id order by id)
), tails as (
  select case when m.role = 'user' then 'no_reply' when not contains({marks('text')}, '?')
    and s.status = 'active' and s.current_question is null then 'nothing_asked' end as detector, m.session_id, m.id
  from seen m left join v_sessions s on s.id = m.session_id where m.back = 1
)
select 'double_user' as detector, session_id, id from seen where role = 'user' and before = 'user'
union all select * from tails where detector is not null"""))
def _(s: Source):
    return live.live_detectors(transcript(s), s.sessions)


@catalog.add("stream_dedup_payments", money.oracles["dedup_payments"])
def _(s: Source):
    paid = live.payments_of(live.drained(live.live_payments(stream(s, "v_payments_raw")), "update", "payments"))
    return paid.withColumn("stars", F.col("stars").cast("bigint"))


@catalog.add("stream_entitlement_ledger", folded("select event_id, us, user_id, kind, outcome from led where rn > 0"))
def _(s: Source):
    credited = dedup_payments(s.payments_raw).select("event_id", F.lit(True).alias("credited"))
    owners = s.owners.withColumn("owner", F.lit(True))
    events = (
        stream(s, "v_run_events")
        .join(credited, "event_id", "left")
        .filter("kind <> 'pay' or credited")
        .join(owners, "user_id", "left")
        .select("user_id", "us", "event_id", "kind", F.coalesce("owner", F.lit(False)).alias("owner"))
    )
    found = live.live_ledger(events)
    return found.select("event_id", "us", "user_id", "kind", F.col("result").alias("outcome"))


@catalog.add("stream_pending_choice", money.oracles["pending_choice"])
def _(s: Source):
    found = live.live_choice(stream(s, "v_updates"))
    return found.filter("kind = 'message'").select("event_id", "user_id", F.col("result").alias("version"))


@catalog.add("stream_alert_no_replicas", telemetry.oracles["alert_no_replicas"])
def _(s: Source):
    found = live.drained(live.live_metrics(stream(s, "v_metrics"), "5 minutes", "1 minute"), "update", "replicas")
    return live.latest(found, ["app", "start"]).filter("low < 400").select("app", "start", "low")


@catalog.add("stream_alert_cpu_mem", duck("v_metrics", f"""
select app, start, cast(total as bigint) as total, n from (
  {windows('v_metrics', 600, 300, 'sum(cents) as total, count(*) as n')}) where total > 8000 * n"""))
def _(s: Source):
    found = live.drained(live.live_metrics(stream(s, "v_metrics"), "10 minutes", "5 minutes"), "update", "load")
    return live.latest(found, ["app", "start"]).filter("total > 8000 * n").select("app", "start", "total", "n")


@catalog.add("stream_alert_logs", duck("v_logs", FLAGGED + f"""
select 'system_failures' as rule, app, start, total from (
  {windows('flagged', 300, 60, 'count(*) as total, count(*) filter (where hard) as hard')}) where hard > 0 or total >= 10
union all select 'console_errors', app, start, total from ({windows('critical', 900, 300, 'count(*) as total')}) where total >= 3"""))
def _(s: Source):
    failures = live.drained(live.live_failures(stream(s, "v_logs")), "update", "failures")
    critical = live.drained(live.live_critical(stream(s, "v_logs")), "update", "critical")
    hard = live.latest(failures, ["app", "start"]).filter("hard > 0 or total >= 10")
    many = live.latest(critical, ["app", "start"]).filter("total >= 3")
    return hard.select(F.lit("system_failures").alias("rule"), "app", "start", "total").unionByName(
        many.select(F.lit("console_errors").alias("rule"), "app", "start", "total")
    )


# --- over several micro-batches: rows arrive in files, keyed state and watermarks carry over ----------------------------

PARTS = 5
HOUR_MS = 3_600_000


def arriving(s: Source, rows, place: str, mixed: float = 0.0):
    return replay.in_files(rows, fresh_path(s.spark, "arriving"), place, PARTS, mixed)


def results(stream, mode: str, name: str):
    """All results of a stream over rows that are there."""
    spark = stream.sparkSession
    return replay.run(stream, mode, fresh_path(spark, name), fresh_path(spark, f"{name}-progress"))


def quarter(rows, place: str) -> int:
    """A lateness that covers what neighbouring files overlap."""
    return (rows.agg(F.max(place) - F.min(place)).first()[0] or 0) // 4


@catalog.add("live_money_chain", money.oracles["entitlement_ledger"])
def _(s: Source):
    payments = arriving(s, s.payments_raw, "us")
    events = arriving(s, s.run_events, "us", 0.8)
    chain = replay.money_chain(payments, events, s.owners, quarter(s.run_events, "us"))
    found = live.latest(results(chain, "append", "chain"), ["event_id"])
    return found.select("event_id", "us", "user_id", "kind", "outcome")


@catalog.add("live_tool_replay", steps.oracles["tool_replay"])
def _(s: Source):
    calls = arriving(s, s.tool_calls, "seq", 0.8)
    return replay.session_ends(results(replay.live_replay(calls, quarter(s.tool_calls, "seq")), "update", "replay"))


@catalog.add("live_pending_choice", money.oracles["pending_choice"])
def _(s: Source):
    updates = arriving(s, s.updates, "us", 0.8)
    found = live.latest(results(replay.keyed_choice(updates, quarter(s.updates, "us")), "update", "picks"), ["event_id"])
    return found.filter("kind = 'message' and not late").select("event_id", "user_id", "version")


@catalog.add("live_transcript", dialogue.oracles["double_user_rows"])
def _(s: Source):
    rows = s.messages.select("session_id", "id", F.col("role").alias("kind"), question_marks(F.col("text")).alias("marks"))
    told = results(replay.keyed_messages(arriving(s, rows, "id", 0.8), quarter(rows, "id") + 1), "update", "transcripts")
    return live.latest(told, ["session_id", "id"]).filter("result = 'double_user'").select("session_id", "id")


@catalog.add("live_append_messages", dialogue.oracles["append_messages"])
def _(s: Source):
    """Started twice on one checkpoint: the second start finds nothing new and adds nothing."""
    path, progress = fresh_path(s.spark, "log"), fresh_path(s.spark, "log-progress")
    messages = arriving(s, s.messages, "id")
    replay.run(messages, "append", path, progress)
    return replay.run(messages, "append", path, progress).drop("batch")


@catalog.add("live_bounded_payments", money.oracles["dedup_payments"])
def _(s: Source):
    """With a lateness of years nothing is forgotten and nothing is late, so the result is that of the batch."""
    path = fresh_path(s.spark, "bounded")
    credited, late = watermarks.bounded_payments(arriving(s, s.payments_raw, "us"), 20 * 365 * 86_400, path, f"{path}-progress")
    found = credited.unionByName(late).drop("batch")
    return found.withColumn("stars", F.col("stars").cast("bigint"))


def closed(body: str, rows: str, end: str) -> str:
    """The rows of a query whose end, in milliseconds, the watermark of one hour has passed."""
    return f"select * from ({body}) where {end} <= (select max(us) // 1000 - {HOUR_MS} from {rows})"


@catalog.add("live_no_replicas", duck("v_metrics", closed(
    f"select * from ({windows('v_metrics', 300, 60, 'min(cents) as low')}) where low < 400", "v_metrics", "(start + 300) * 1000")))
def _(s: Source):
    return results(watermarks.live_no_replicas(arriving(s, s.metrics, "us"), 400), "append", "replicas").drop("batch")


@catalog.add("live_cpu_mem", duck("v_metrics", closed(f"""
select app, start, rule, cast(total as bigint) as total, n
from ({windows('v_metrics', 600, 300, 'sum(cents) as total, count(*) as n')}), (values ('cpu', 8000), ('memory', 12000)) as r(rule, most)
where total > most * n""", "v_metrics", "(start + 600) * 1000")))
def _(s: Source):
    return results(watermarks.live_averages(arriving(s, s.metrics, "us"), {"cpu": 8000, "memory": 12000}), "append", "load").drop("batch")


@catalog.add("live_logs", duck("v_logs", FLAGGED + closed(f"""
select 'system_failures' as rule, app, start, total from (
  {windows('flagged', 300, 60, 'count(*) as total, count(*) filter (where hard) as hard')}) where hard > 0 or total >= 10""",
    "flagged", "(start + 300) * 1000") + " union all " + closed(f"""
select 'console_errors' as rule, app, start, total from ({windows('critical', 900, 300, 'count(*) as total')}) where total >= 3""",
    "critical", "(start + 900) * 1000")))
def _(s: Source):
    logs = arriving(s, s.logs, "us")
    failures = results(watermarks.live_system_failures(logs), "append", "failures")
    return failures.unionByName(results(watermarks.live_console_errors(logs), "append", "critical")).drop("batch")


@catalog.add("live_restarts", duck("v_metrics", ", w as (" + closed(windows('v_metrics', 900, 300, 'max(cents) as peak'), "v_metrics", "(start + 900) * 1000") + """)
, c as (select *, peak > 9000 as high, lag(peak > 9000, 1, false) over (partition by app order by start) as before from w)
select app, start, peak, case when high then 'fired' else 'resolved' end as state from c where high <> before"""))
def _(s: Source):
    return results(watermarks.live_restarts(arriving(s, s.metrics, "us"), 9000), "append", "restarts").drop("batch")


@catalog.add("live_bursts", duck("v_attempts", CLASS + """
, g as (
  select *, case when us - lag(us) over w <= 7200000000 then 0 else 1 end as opens
  from classed where class = 'retryable' window w as (partition by service order by us, attempt_id)
), b as (select *, sum(opens) over (partition by service order by us, attempt_id) as burst from g)
select service, started, ended, failures from (
  select service, min(us) as started, max(us) as ended, count(*) as failures from b group by service, burst having count(*) >= 3)
where ended + 7200000000 <= ((select max(us) from g) // 1000 - 3600000) * 1000"""))
def _(s: Source):
    return results(watermarks.live_bursts(arriving(s, s.attempts, "us"), 7200, 3), "append", "bursts").drop("batch")
