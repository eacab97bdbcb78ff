"""Queries on payments, entitlements, access and run status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.operators import access, audits, ledger
from runlens.plans.query import Catalog, Source
from runlens.plans.views import duck
from runlens.session import fresh_path, settle
from runlens.sources import tables

catalog = Catalog()

VALID = """
, valid as (
  select * from v_payments_raw
  where currency = 'XTR' and amount = 100 and payload = concat('run:', user_id)
), credited as (
  select * from (
    select *, row_number() over (partition by charge_id order by us, event_id) as k from valid
  ) where k = 1
)"""

FOLD = (
    VALID
    + """
, ev as (
  select e.user_id, e.event_id, e.us, e.kind, o.user_id is not null as owner,
         row_number() over (partition by e.user_id order by e.us, e.event_id) as rn
  from v_run_events e
  left join v_owners o on o.user_id = e.user_id
  left join credited c on c.event_id = e.event_id
  where e.kind in ('start', 'finish', 'abandon') or c.event_id is not null
), led as (
  select distinct user_id, cast(0 as bigint) as rn, cast(0 as bigint) as f, cast(0 as bigint) as p,
         cast(null as varchar) as bucket, cast(0 as bigint) as run_no, cast(null as varchar) as outcome,
         cast(null as varchar) as kind, cast(null as bigint) as event_id, cast(null as bigint) as us
  from ev
  union all
  select e.user_id, e.rn,
    case when e.kind = 'start' and l.bucket is null and not e.owner and l.f < 1 then l.f + 1
         when e.kind = 'abandon' and l.bucket = 'free' then l.f - 1 else l.f end,
    case when e.kind = 'pay' then l.p + 1
         when e.kind = 'start' and l.bucket is null and not e.owner and l.f >= 1 and l.p > 0 then l.p - 1
         when e.kind = 'abandon' and l.bucket = 'paid' then l.p + 1 else l.p end,
    case when e.kind = 'start' and l.bucket is null then
           case when e.owner then 'none' when l.f < 1 then 'free' when l.p > 0 then 'paid' end
         when e.kind in ('finish', 'abandon') then null else l.bucket end,
    case when e.kind = 'start' and l.bucket is null and (e.owner or l.f < 1 or l.p > 0) then l.run_no + 1
         else l.run_no end,
    case e.kind
      when 'pay' then 'credited'
      when 'start' then case when l.bucket is not null then 'resumed' when e.owner then 'owner'
        when l.f < 1 then 'free' when l.p > 0 then 'paid' else 'needs_payment' end
      when 'finish' then case when l.bucket is null then 'ignored' else 'delivered' end
      else case l.bucket when 'free' then 'refunded_free' when 'paid' then 'refunded_paid'
        when 'none' then 'no_refund' else 'ignored' end end,
    e.kind, e.event_id, e.us
  from led l join ev e on e.user_id = l.user_id and e.rn = l.rn + 1
), bal as (
  select user_id, f as free_used, p as paid_credits, bucket as open_bucket
  from (select *, row_number() over (partition by user_id order by rn desc) as k from led) where k = 1
), runs as (
  select user_id, run_no,
    max(case outcome when 'owner' then 'none' when 'free' then 'free' when 'paid' then 'paid' end) as consumed,
    max(case when outcome in ('owner', 'free', 'paid') then event_id end) as opened_by,
    max(case when kind in ('finish', 'abandon') and outcome <> 'ignored' then event_id end) as closed_by,
    coalesce(max(case when kind = 'finish' and outcome <> 'ignored' then 'finished'
                      when kind = 'abandon' and outcome <> 'ignored' then 'abandoned' end), 'active') as status
  from led where outcome in ('owner', 'free', 'paid', 'delivered', 'refunded_free', 'refunded_paid', 'no_refund')
  group by user_id, run_no
)"""
)
LEDGER_VIEWS = "v_run_events v_owners v_payments_raw"


def folded(body: str, extra: str = "") -> str:
    return duck(f"{LEDGER_VIEWS} {extra}", f"{FOLD} {body}", recursive=True)


def parts(s: Source):
    return s.run_events, ledger.dedup_payments(s.payments_raw), s.owners


@catalog.add("valid_payments", duck("v_payments_raw", VALID + """
select event_id, user_id, charge_id,
  case when currency <> 'XTR' then 'currency' when amount <> 100 then 'amount'
       when payload <> concat('run:', user_id) then 'payload' else 'ok' end as verdict
from v_payments_raw"""))
def _(s: Source):
    return ledger.payment_verdicts(s.payments_raw).select("event_id", "user_id", "charge_id", "verdict")


@catalog.add("dedup_payments", duck("v_payments_raw", VALID + """
select charge_id, event_id, us, user_id, cast(amount as bigint) as stars from credited"""))
def _(s: Source):
    paid = ledger.dedup_payments(s.payments_raw)
    return paid.withColumn("stars", F.col("stars").cast("bigint"))


@catalog.add("entitlement_ledger", folded("select event_id, us, user_id, kind, outcome from led where rn > 0"))
def _(s: Source):
    return ledger.entitlement_ledger(*parts(s))


@catalog.add("ledger_balances", folded("select user_id, free_used, paid_credits, open_bucket from bal"))
def _(s: Source):
    return ledger.ledger_balances(*parts(s))


@catalog.add("session_lifecycle", folded("""
select user_id, run_no, consumed, opened_by, closed_by, status, status = 'abandoned' as refunded from runs"""))
def _(s: Source):
    return ledger.session_lifecycle(*parts(s))


@catalog.add("illegal_transitions", duck("v_run_events", """
select user_id, ord, status from (
  select user_id, event_id as ord, status, lag(status) over (partition by user_id, run_no order by event_id) as prev
  from (select user_id, event_id div_ 500 as run_no, event_id,
          case kind when 'start' then 'active' when 'finish' then 'finished' when 'abandon' then 'abandoned' end as status
        from v_run_events where kind in ('start', 'finish', 'abandon')))
where not (prev is null and status = 'active' or coalesce(prev, '') = 'active' and status in ('finished', 'abandoned'))
""".replace("div_", "//")))
def _(s: Source):
    changes = s.run_events.filter("kind in ('start', 'finish', 'abandon')").selectExpr(
        "user_id",
        "event_id div 500 as run_no",
        "event_id as ord",
        "case kind when 'start' then 'active' when 'finish' then 'finished' else 'abandoned' end as status",
    )
    return ledger.illegal_transitions(changes).select("user_id", "ord", "status")


@catalog.add("billing_snapshot", folded("""
select u.user_id, coalesce(b.free_used, 0) as free_used, coalesce(b.paid_credits, 0) as paid_credits
from v_users u left join (select * from bal where user_id % 4 <> 0) b using (user_id)""", "v_users"))
def _(s: Source):
    stored = ledger.ledger_balances(*parts(s)).filter("user_id % 4 <> 0")
    return ledger.billing_snapshot(s.users, stored)


@catalog.add("ledger_reconcile", folded("""
, stored as (
  select user_id, free_used + case when user_id % 9 = 0 then 1 else 0 end as stored_free, paid_credits as stored_paid
  from bal where user_id % 8 <> 0
), want as (
  select user_id, sum(fr) as expected_free, sum(pa) as expected_paid from (
    select user_id, case when consumed = 'free' and status <> 'abandoned' then 1 else 0 end as fr,
           case when consumed = 'paid' and status <> 'abandoned' then -1 else 0 end as pa from runs
    union all select user_id, 0, 1 from credited) group by user_id
)
select user_id, cast(expected_free as bigint) as expected_free, cast(expected_paid as bigint) as expected_paid,
  stored_free, stored_paid,
  expected_free is not distinct from stored_free and expected_paid is not distinct from stored_paid
    and expected_paid >= 0 as matches
from want full outer join stored using (user_id)"""))
def _(s: Source):
    events, credited, owners = parts(s)
    credited = settle(credited)  # the payments are read once, for the ledger and for what was bought
    rows = ledger.settled_ledger(events, credited, owners)
    stored = ledger.balances_of(rows).filter("user_id % 8 <> 0").withColumn("free_used", F.expr("free_used + if(user_id % 9 = 0, 1, 0)"))
    return ledger.ledger_reconcile(ledger.lifecycle_of(rows), credited, stored)


@catalog.add("run_funnel", folded("""
select consumed, status, status = 'abandoned' as refunded, count(*) as runs from runs group by all"""))
def _(s: Source):
    return ledger.run_funnel(ledger.session_lifecycle(*parts(s)), ["consumed", "status", "refunded"])


@catalog.add("step_funnel", duck("v_sessions", """
select version, status, consumed, refunded, current_step, count(*) as runs from v_sessions group by all"""))
def _(s: Source):
    return ledger.run_funnel(s.sessions, ["version", "status", "consumed", "refunded", "current_step"])


@catalog.add("pending_choice", duck("v_updates", """
, u as (
  select *, count(*) filter (where kind in ('message', 'reset')) over (
    partition by user_id order by us, event_id rows between unbounded preceding and 1 preceding) as stretch
  from v_updates where kind <> 'pick' or version in ('lite', 'full', 'spec_only'))
select m.event_id, m.user_id, (
  select arg_max(p.version, p.event_id) from u p
  where p.kind = 'pick' and p.user_id = m.user_id and p.stretch = m.stretch and p.us < m.us) as version
from u m where m.kind = 'message'"""))
def _(s: Source):
    return ledger.pending_choice(access.known_versions(s.updates, keep="kind <> 'pick'"))


@catalog.add("access_gate", duck("v_users v_owners v_beta", """
select user_id, user_id in (select user_id from v_owners) or user_id in (select user_id from v_beta) as admitted
from v_users"""))
def _(s: Source):
    return access.access_gate(s.users, s.owners, s.beta)


@catalog.add("access_gate_open", duck("v_users", "select user_id, true as admitted from v_users"))
def _(s: Source):
    return access.access_gate(s.users, s.owners, s.beta.filter("user_id < 0"))


@catalog.add("strict_allowlist", duck("v_users v_beta", """
select user_id from v_users where user_id in (select user_id from v_beta)"""))
def _(s: Source):
    return access.strict_allowlist(s.users, s.beta)


@catalog.add("parse_id_list", duck("v_id_lists", """
select distinct cast(trim(x) as bigint) as user_id
from (select unnest(string_split(csv, ',')) as x from v_id_lists) where regexp_full_match(trim(x), '[0-9]+')"""))
def _(s: Source):
    return access.parse_id_list(s.id_lists, "csv")


@catalog.add("version_whitelist", duck("v_updates", """
select event_id, version, case version when 'full' then 'Full (11 шагов)' when 'lite' then 'Lite'
  else 'Spec-only (техчасть)' end as label
from v_updates where version in ('full', 'lite', 'spec_only')"""))
def _(s: Source):
    return access.labelled_versions(s.updates).select("event_id", "version", "label")


@catalog.add("active_sessions", duck("v_sessions", """
select id, tg_user_id, version, current_step from v_sessions where status = 'active'"""))
def _(s: Source):
    return access.active_sessions(s.sessions).select("id", "tg_user_id", "version", "current_step")


@catalog.add("open_questions", duck("v_sessions", """
select id, tg_user_id, case when current_step = '_finish' then 'past_last_step'
  when current_question is not null then 'waiting' else 'no_question' end as state,
  case when current_step <> '_finish' then current_question end as question
from v_sessions where status = 'active'"""))
def _(s: Source):
    return access.open_questions(s.sessions)


@catalog.add("load_tables", duck("v_sessions", """
select id, slug, clarify_count, clarify_budget, refunded, len(from_json(current_options, '["varchar"]')) as n_options,
  from_json(current_options, '["varchar"]')[1] as first_option from v_sessions"""))
def _(s: Source):
    return access.decoded_sessions(s.sessions).selectExpr(
        "id", "slug", "clarify_count", "clarify_budget", "refunded",
        "cast(size(options) as bigint) as n_options", "options[0] as first_option",
    )


@catalog.add("load_run_tables", folded("""
select 'sessions' as "table", cast(id as varchar) as "key", concat_ws('/', slug, version, status, clarify_count, refunded,
    len(from_json(current_options, '["varchar"]'))) as value from v_sessions
union all select 'artifacts', concat_ws('/', session_id, write_no, step_id), cast(length(markdown) as varchar) from v_artifact_writes
union all select 'messages', concat_ws('/', session_id, id), concat_ws(': ', role, text) from v_messages
union all select 'adrs', concat_ws('/', session_id, n, id), title from v_adrs
union all select 'billing', cast(user_id as varchar), concat_ws('/', free_used, paid_credits) from bal
union all select 'payments', charge_id, concat_ws('/', user_id, amount) from credited""", "v_sessions v_artifact_writes v_messages v_adrs"))
def _(s: Source):
    """All six tables written in their fixed schemas and read by them."""
    folder = fresh_path(s.spark, "tables")
    events, credited, owners = parts(s)
    credited = settle(credited)
    tables.write_tables({
        "sessions": s.sessions, "messages": s.messages, "adrs": s.adrs,
        "artifacts": s.artifact_writes.withColumnRenamed("write_no", "id"),
        "billing": ledger.ledger_balances(events, credited, owners).withColumnRenamed("user_id", "tg_user_id"),
        "payments": credited.withColumnRenamed("user_id", "tg_user_id"),
    }, folder)
    read = tables.load_tables(s.spark, folder)
    read["sessions"] = access.decoded_sessions(read["sessions"])
    shown = {
        "sessions": ("id", "concat_ws('/', slug, version, status, clarify_count, refunded, if(options is null, null, size(options)))"),
        "artifacts": ("concat_ws('/', session_id, id, step_id)", "char_length(markdown)"),
        "messages": ("concat_ws('/', session_id, id)", "concat_ws(': ', role, text)"),
        "adrs": ("concat_ws('/', session_id, n, id)", "title"),
        "billing": ("tg_user_id", "concat_ws('/', free_used, paid_credits)"),
        "payments": ("charge_id", "concat_ws('/', tg_user_id, stars)"),
    }
    return reduce(DataFrame.unionByName, [
        read[name].selectExpr(f"'{name}' as table", f"cast({key} as string) as key", f"cast({value} as string) as value")
        for name, (key, value) in shown.items()])


@catalog.add("constraint_audit", duck("v_sessions v_artifact_writes v_adrs v_payments_raw", """
select 'one active run per user' as rule, concat(tg_user_id) as "key", count(*) as n from v_sessions
  where status = 'active' group by tg_user_id having count(*) > 1
union all select 'artifact per session and step', concat(session_id, '/', step_id), count(*) from v_artifact_writes
  group by session_id, step_id having count(*) > 1
union all select 'decision number per session', concat(session_id, '/', n), count(*) from v_adrs
  group by session_id, n having count(*) > 1
union all select 'charge', charge_id, count(*) from v_payments_raw group by charge_id having count(*) > 1"""))
def _(s: Source):
    return audits.constraint_audit(s.sessions, s.artifact_writes, s.adrs, s.payments_raw)


@catalog.add("check_audit", duck("v_sessions", """
select 'status' as rule, count(*) filter (where status not in ('active', 'finished', 'abandoned')) as broken,
  count(*) as checked from v_sessions
union all select 'last_verdict', count(*) filter (where last_verdict not in ('answer', 'partial', 'offtopic')), count(*) from v_sessions
union all select 'consumed', count(*) filter (where consumed not in ('free', 'paid', 'none')), count(*) from v_sessions
union all select 'clarify_budget', count(*) filter (where clarify_count > clarify_budget), count(*) from v_sessions"""))
def _(s: Source):
    return audits.check_audit(s.sessions)


@catalog.add("orphans", duck("v_sessions v_artifact_writes v_messages v_adrs", """
, kids as (select 'artifacts' as child, session_id from v_artifact_writes union all
  select 'messages', session_id from v_messages union all select 'adrs', session_id from v_adrs)
select child, session_id, count(*) as n from kids
where session_id not in (select id from v_sessions) group by all"""))
def _(s: Source):
    return audits.orphans(
        s.sessions, {"artifacts": s.artifact_writes, "messages": s.messages, "adrs": s.adrs}
    )
