"""Payments, entitlements and the lifecycle of runs.

The entitlement of a user is a bounded free allowance followed by a prepaid balance that can hit zero. Both
have a closed form over running values (a balance that stops at zero is the running sum minus its running
minimum), so the whole ledger is three scans over one ordering instead of a per-user loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.operators.ordered import SEGMENT, OrderedRows, last_seen, running_min, running_sum
from runlens.registry import CURRENCY, FREE_RUNS, RUN_PRICE
from runlens.session import settle


def payment_verdicts(payments: DataFrame, price: int = RUN_PRICE, currency: str = CURRENCY) -> DataFrame:
    """Each payment with the first rule it breaks, or 'ok'."""
    own = F.concat(F.lit("run:"), F.col("user_id").cast("string"))
    return payments.withColumn(
        "verdict",
        F.when(~F.col("currency").eqNullSafe(currency), "currency")
        .when(~F.col("amount").eqNullSafe(price), "amount")
        .when(~F.col("payload").eqNullSafe(own), "payload")
        .otherwise("ok"),
    )


def valid_payments(payments: DataFrame, price: int = RUN_PRICE, currency: str = CURRENCY) -> DataFrame:
    return payment_verdicts(payments, price, currency).filter("verdict = 'ok'").drop("verdict")


def dedup_payments(payments: DataFrame, price: int = RUN_PRICE, currency: str = CURRENCY) -> DataFrame:
    """The first valid payment of each charge; later ones credit nothing.

    A minimum per charge combines before the shuffle, so a charge repeated without end costs one row a task.
    """
    first = F.min(F.struct("us", "event_id", "user_id", "amount")).alias("first")
    return (
        valid_payments(payments, price, currency)
        .groupBy("charge_id")
        .agg(first)
        .select("charge_id", "first.event_id", "first.us", "first.user_id", F.col("first.amount").alias("stars"))
    )


CARRY = {
    "carry_cycle": "0L",
    "carry_credits": "0L",
    "carry_prior": "cast(null as struct<cycle: bigint, credits: bigint>)",
    "carry_delivered": "0L",
    "carry_floor": "0L",
}
"""What a user's earlier events leave behind, and its value before the first event."""


def run_events(events: DataFrame, credited: DataFrame) -> DataFrame:
    """The events that touch an entitlement: starts and ends of runs, and the credited payments.

    credited: event_id, us, user_id of the payments that count. They bring their own place, so events need not be joined with
    them.
    """
    runs = events.filter(F.col("kind").isin("start", "finish", "abandon")).select("event_id", "us", "user_id", "kind")
    return runs.unionByName(credited.select("event_id", "us", "user_id", F.lit("pay").alias("kind")))


def ledger_rows(
    events: DataFrame, credited: DataFrame, owners: DataFrame, free_runs: int = FREE_RUNS
) -> OrderedRows:
    """Run events with the running values the ledger needs.

    events: event_id, us, user_id, kind. credited: event_id, us, user_id of the payments that count.
    owners: user_id of the users who are never billed.
    """
    rows = OrderedRows.of(run_events(events, credited), ["user_id"], ["us", "event_id"], bound=events)
    rows = rows.attach(owners.select("user_id").distinct().withColumn("owner", F.lit(True)))
    rows = rows.map(lambda df: df.withColumn("owner", F.coalesce("owner", F.lit(False))))
    rows = rows.map(lambda df: df.withColumns({name: F.expr(zero) for name, zero in CARRY.items()}))
    return ledger_scans(rows, free_runs)


def ledger_scans(rows: OrderedRows, free_runs: int = FREE_RUNS) -> OrderedRows:
    """The running values, going on from the carry of each user. rows: us, event_id, kind, owner, CARRY."""
    # one cycle = everything up to and including a closing event
    rows = rows.scan(
        cycle=running_sum("if(kind in ('finish', 'abandon'), 1L, 0L)", before=True),
        credits=running_sum("if(kind = 'pay', 1L, 0L)"),
    )
    rows = rows.map(
        lambda df: df.withColumns(
            {"cycle": F.expr("cycle + carry_cycle"), "credits": F.expr("credits + carry_credits")}
        )
    )
    rows = rows.scan(prior=last_seen("if(kind = 'start', struct(cycle, credits), null)", before=True))
    rows = rows.map(lambda df: df.withColumn("prior", F.expr("coalesce(prior, carry_prior)")))
    asked = "coalesce(prior.cycle = cycle, false)"
    rows = rows.map(
        lambda df: df.withColumns(
            {"asked": F.expr(asked), "spends": F.expr(f"not owner and kind = 'finish' and {asked}")}
        )
    )
    # delivered runs before this cycle: the first ones are free, the others take from the paid balance
    rows = rows.scan(delivered=running_sum("if(spends, 1L, 0L)", before=True))
    free = f"greatest(0L, delivered - {free_runs})"
    after = f"greatest(0L, delivered + 1 - {free_runs})"
    rows = rows.map(
        lambda df: df.withColumn("delivered", F.expr("delivered + carry_delivered")).withColumns(
            {
                "spent": F.expr(free),
                "trough": F.expr(f"if(spends and delivered >= {free_runs}, prior.credits - {after}, null)"),
            }
        )
    )
    rows = rows.scan(floor=running_min("trough", before=True))
    return rows.map(
        lambda df: df.withColumn("floor", F.least(F.lit(0), "carry_floor", F.coalesce("floor", F.lit(0)))).withColumns(
            {
                "on_free": F.expr(f"not owner and delivered < {free_runs}"),
                "funded": F.expr("credits - spent - floor > 0"),
                "was_funded": F.expr("coalesce(prior.credits - spent - floor > 0, false)"),
            }
        )
    )


def ledger_carry(rows: DataFrame) -> DataFrame:
    """What each user's rows leave behind for the events to come. Combines before the shuffle."""
    started = F.when(F.col("kind") == "start", F.struct("cycle", "credits"))
    closing = F.expr("if(kind in ('finish', 'abandon'), 1L, 0L)")
    return rows.groupBy("user_id").agg(
        F.max("us").alias("last_us"),
        F.max(F.struct("us", "event_id"))["event_id"].alias("last_id"),
        F.max(F.col("cycle") + closing).alias("carry_cycle"),
        F.max("credits").alias("carry_credits"),
        F.max(F.coalesce(started, "prior")).alias("carry_prior"),
        F.max(F.expr("delivered + if(spends, 1L, 0L)")).alias("carry_delivered"),
        F.min(F.least("floor", F.coalesce("trough", F.lit(0)))).cast("bigint").alias("carry_floor"),
    )


def with_outcomes(rows: OrderedRows) -> OrderedRows:
    """What each event did to the user's entitlement."""
    settled = "owner or on_free"
    bucket = "case when owner then 'none' when on_free then 'free' else 'paid' end"
    was_open = f"asked and ({settled} or was_funded)"
    outcome = f"""
        case kind
          when 'pay' then 'credited'
          when 'start' then case
            when {was_open} then 'resumed'
            when owner then 'owner'
            when on_free then 'free'
            when funded then 'paid'
            else 'needs_payment' end
          when 'finish' then case when {was_open} then 'delivered' else 'ignored' end
          else case
            when not ({was_open}) then 'ignored'
            when owner then 'no_refund'
            when on_free then 'refunded_free'
            else 'refunded_paid' end
        end"""
    return rows.map(lambda df: df.withColumns({"bucket": F.expr(bucket), "outcome": F.expr(outcome)}))


def entitlement_ledger(
    events: DataFrame, credited: DataFrame, owners: DataFrame, free_runs: int = FREE_RUNS
) -> DataFrame:
    """One row per start, credited payment, finish and abandon with its outcome."""
    rows = with_outcomes(ledger_rows(events, credited, owners, free_runs))
    return rows.df.select("event_id", "us", "user_id", "kind", "outcome")


def settled_ledger(events: DataFrame, credited: DataFrame, owners: DataFrame, free_runs: int = FREE_RUNS) -> OrderedRows:
    """The ledger's narrow rows, written once, for several reports on it (``balances_of``, ``lifecycle_of``)."""
    narrow = ["event_id", "us", "user_id", "kind", "bucket", "outcome"]
    rows = with_outcomes(ledger_rows(events, credited, owners, free_runs))
    rows = rows.map(lambda df: df.select(*narrow, *([SEGMENT] if SEGMENT in df.columns else [])))
    return OrderedRows(settle(rows.usual), None if rows.hot is None else settle(rows.hot), rows.key, rows.order, rows.most)


def ledger_balances(
    events: DataFrame, credited: DataFrame, owners: DataFrame, free_runs: int = FREE_RUNS
) -> DataFrame:
    """free_used, paid_credits and the bucket of the open run per user, after all events."""
    return balances_of(with_outcomes(ledger_rows(events, credited, owners, free_runs)))


def balances_of(rows: OrderedRows) -> DataFrame:
    """The balances after the rows of a ledger."""
    count = lambda *names: F.count_if(F.col("outcome").isin(*names))
    opened = F.col("outcome").isin("owner", "free", "paid")
    closed = F.col("outcome").isin("delivered", "refunded_free", "refunded_paid", "no_refund")
    place = F.struct("us", "event_id")
    return (
        rows.df.groupBy("user_id")
        .agg(
            (count("free") - count("refunded_free")).alias("free_used"),
            (count("credited") + count("refunded_paid") - count("paid")).alias("paid_credits"),
            (F.count_if(opened) - F.count_if(closed)).alias("open_runs"),
            F.max_by(F.when(opened, F.col("bucket")), F.when(opened, place)).alias("last_bucket"),
        )
        .select(
            "user_id",
            "free_used",
            "paid_credits",
            F.when(F.col("open_runs") > 0, F.col("last_bucket")).alias("open_bucket"),
        )
    )


def session_lifecycle(
    events: DataFrame, credited: DataFrame, owners: DataFrame, free_runs: int = FREE_RUNS
) -> DataFrame:
    """One row per opened run: what it consumed, how it ended, whether it was given back.

    A run has one opening row and at most one closing row, so the grouping is bounded.
    """
    return lifecycle_of(with_outcomes(ledger_rows(events, credited, owners, free_runs)))


def lifecycle_of(rows: OrderedRows) -> DataFrame:
    """The runs in the rows of a ledger."""
    opens = "outcome in ('owner', 'free', 'paid')"
    rows = rows.scan(run_no=running_sum(f"if({opens}, 1L, 0L)"))
    ends = "outcome in ('delivered', 'refunded_free', 'refunded_paid', 'no_refund')"
    return (
        rows.df.filter(f"{opens} or {ends}")
        .groupBy("user_id", "run_no")
        .agg(
            F.max(F.expr(f"if({opens}, bucket, null)")).alias("consumed"),
            F.max(F.expr(f"if({opens}, event_id, null)")).alias("opened_by"),
            F.max(F.expr(f"if({ends}, event_id, null)")).alias("closed_by"),
            F.max(F.expr(f"if({ends}, kind, null)")).alias("ending"),
        )
        .select(
            "user_id",
            "run_no",
            "consumed",
            "opened_by",
            "closed_by",
            F.expr(
                "case ending when 'finish' then 'finished' when 'abandon' then 'abandoned' else 'active' end"
            ).alias("status"),
            F.expr("coalesce(ending = 'abandon', false)").alias("refunded"),
        )
    )


def billing_snapshot(users: DataFrame, balances: DataFrame) -> DataFrame:
    """Balances of every user, (0, 0) for those without a billing row."""
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name)
    return (
        users.select("user_id")
        .distinct()
        .join(balances.select("user_id", "free_used", "paid_credits"), "user_id", "left")
        .select("user_id", zero("free_used"), zero("paid_credits"))
    )


def ledger_reconcile(sessions: DataFrame, payments: DataFrame, billing: DataFrame) -> DataFrame:
    """Balances that follow from runs and payments against the stored ones.

    sessions: user_id, consumed, refunded. payments: user_id. billing: user_id, free_used, paid_credits.
    """
    held = lambda bucket: F.sum(
        F.when((F.col("consumed") == bucket) & ~F.col("refunded"), 1).otherwise(0)
    )
    runs = sessions.groupBy("user_id").agg(held("free").alias("free"), held("paid").alias("paid"))
    bought = payments.groupBy("user_id").agg(F.count("*").alias("bought"))
    derived = runs.join(bought, "user_id", "full_outer").selectExpr(
        "user_id",
        "cast(coalesce(free, 0) as bigint) as expected_free",
        "cast(coalesce(bought, 0) - coalesce(paid, 0) as bigint) as expected_paid",
    )
    stored = billing.selectExpr("user_id", "free_used as stored_free", "paid_credits as stored_paid")
    return derived.join(stored, "user_id", "full_outer").withColumn(
        "matches",
        F.expr("expected_free <=> stored_free and expected_paid <=> stored_paid and expected_paid >= 0"),
    )


def run_funnel(sessions: DataFrame, by: list[str]) -> DataFrame:
    return sessions.groupBy(*by).agg(F.count("*").alias("runs"))


def illegal_transitions(changes: DataFrame) -> DataFrame:
    """Status changes of a run that leave a closed state.

    changes: user_id, run_no, ord, status. Only active -> finished | abandoned is legal.
    """
    rows = OrderedRows.of(changes, ["user_id", "run_no"], ["ord"])
    rows = rows.scan(previous=last_seen("status", before=True))
    legal = "previous is null and status = 'active' or previous = 'active' and status in ('finished', 'abandoned')"
    return rows.df.filter(f"not coalesce({legal}, false)")


def pending_choice(updates: DataFrame) -> DataFrame:
    """The version a message starts with: the latest pick since the previous message or reset.

    updates: user_id, us, event_id, kind in (pick, message, reset), version. A message takes the pick and
    so uses it up; a message without a pick starts nothing (null).
    """
    rows = OrderedRows.of(updates, ["user_id"], ["us", "event_id"])
    rows = rows.scan(
        stretch=running_sum("if(kind in ('message', 'reset'), 1L, 0L)", before=True),
    )
    rows = rows.scan(pick=last_seen("if(kind = 'pick', struct(stretch, version), null)", before=True))
    return rows.df.filter("kind = 'message'").selectExpr(
        "event_id", "user_id", "if(pick.stretch = stretch, pick.version, null) as version"
    )
