"""Queries on attempts, logs and metrics."""

from __future__ import annotations

from runlens.operators import telemetry as ops
from runlens.plans.query import Catalog, Source
from runlens.plans.views import duck

catalog = Catalog()

CLASS = """
, classed as (
  select *, case when status_code between 200 and 299 and error is null then 'ok'
    when error = 'TimeoutError' then 'retryable'
    when status_code is not null then case when status_code = 429 or status_code // 100 = 5 then 'retryable' else 'fatal' end
    when error in ('APITimeoutError', 'APIConnectionError') then 'retryable' else 'fatal' end as class
  from v_attempts
)"""


@catalog.add("retryable_attempts", duck("v_attempts", CLASS + "select attempt_id, turn_id, class from classed"))
def _(s: Source):
    return ops.retryable_attempts(s.attempts).select("attempt_id", "turn_id", "class")


@catalog.add("attempt_summary", duck("v_attempts", CLASS + """
select turn_id, count(*) as attempts, count(*) filter (where class = 'retryable') as retryable,
  case arg_max(class, attempt_id) when 'ok' then 'ok' when 'fatal' then 'fatal' else 'overloaded' end as outcome,
  cast(sum(wait_s) as bigint) as waited, sum(wait_s) > 120 as over_budget, count(*) > 6 as over_attempts,
  count(*) filter (where retry_after > 30) as long_requests
from classed group by turn_id"""))
def _(s: Source):
    return ops.attempt_summary(s.attempts)


@catalog.add("truncated_turns", duck("v_turns", """
select version, count(*) as turns, count(*) filter (where stop_reason = 'max_tokens') as cut,
  count(*) filter (where stop_reason = 'max_tokens') / count(*) as share from v_turns group by version"""))
def _(s: Source):
    return ops.truncated_turns(s.turns)


def any_of(terms: list[str]) -> str:
    return f"regexp_matches(lower(log), '(^|[^a-z0-9])({'|'.join(terms)})([^a-z0-9]|$)')"


FLAGGED = f"""
, flagged as (
  select *, lower(reason) in ('revisionfailed', 'containerfailed', 'failed')
      or {any_of(['revision failed', 'container failed'])} as hard from v_logs
  where lower(reason) in ('probefailed', 'revisionfailed', 'containerfailed', 'failed')
    or {any_of(['probe failed', 'revision failed', 'container failed', 'failed startup probe'])}
), critical as (
  select * from v_logs where {any_of(['critical', 'traceback', 'telegramconflicterror', 'terminated by other getupdates', 'sentry'])}
)"""


@catalog.add("system_failures_kql", duck("v_logs", FLAGGED + """
select * from (select count(*) as total, count(*) filter (where hard) as hard from flagged where app like 'app1%')
where hard > 0 or total >= 10"""))
def _(s: Source):
    return ops.system_failures(s.logs, "app1")


@catalog.add("console_errors_kql", duck("v_logs", FLAGGED + """
select * from (select count(*) as c from critical where app like 'app2%') where c >= 3"""))
def _(s: Source):
    return ops.console_errors(s.logs, "app2")


def windows(rows: str, size: int, slide: int, values: str) -> str:
    return (
        f"select app, (us // {slide * 1000000} - back) * {slide} as start, {values} "
        f"from (select *, unnest(range({size // slide})) as back from {rows}) group by all"
    )


@catalog.add("alert_no_replicas", duck("v_metrics", f"""
select * from ({windows('v_metrics', 300, 60, 'min(cents) as low')}) where low < 400"""))
def _(s: Source):
    return ops.alert_no_replicas(s.metrics, 400)


@catalog.add("alert_restarts", duck("v_metrics", f"""
, w as ({windows('v_metrics', 900, 300, 'max(cents) as peak')})
, c as (select *, peak > 9000 as high, lag(peak > 9000, 1, false) over (partition by app order by start) as before from w)
select app, start, peak, case when high then 'fired' else 'resolved' end as state from c where high <> before"""))
def _(s: Source):
    return ops.alert_restarts(s.metrics, 9000)


@catalog.add("alert_cpu_mem", duck("v_metrics", f"""
, w as ({windows('v_metrics', 600, 300, 'sum(cents) as total, count(*) as n')})
select app, start, rule, cast(total as bigint) as total, n
from w, (values ('cpu', 8000), ('memory', 12000)) as r(rule, most) where total > most * n"""))
def _(s: Source):
    return ops.alert_averages(s.metrics, {"cpu": 8000, "memory": 12000})


@catalog.add("alert_logs", duck("v_logs", FLAGGED + f"""
select 'system_failures' as rule, app, start, total from (
  {windows('flagged', 300, 60, 'count(*) as total, count(*) filter (where hard) as hard')}) where hard > 0 or total >= 10
union all select 'console_errors', app, start, total from ({windows('critical', 900, 300, 'count(*) as total')}) where total >= 3"""))
def _(s: Source):
    return ops.alert_logs(s.logs)


@catalog.add("overload_bursts", duck("v_attempts", CLASS + """
, g as (
  select *, case when us - lag(us) over w <= 7200000000 then 0 else 1 end as opens
  from classed where class = 'retryable' window w as (partition by service order by us, attempt_id)
), b as (select *, sum(opens) over (partition by service order by us, attempt_id) as burst from g)
select service, min(us) as started, max(us) as ended, count(*) as failures from b group by service, burst having count(*) >= 3"""))
def _(s: Source):
    return ops.overload_bursts(s.attempts, 7200, 3)
