"""Transcripts: tails, merged histories, lost replies, question discipline and the clarification budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions import text as rules
from runlens.operators.ordered import OrderedRows, last_seen, running_sum
from runlens.registry import CLARIFY_BUDGET, HISTORY_ROWS, TURN_ROUNDS



def transcript_tail(messages: DataFrame, limit: int = HISTORY_ROWS) -> DataFrame:
    """The last ``limit`` messages of each session.

    The rank filter becomes a group limit before the shuffle: a task sends at most ``limit`` rows of a
    session, however long the session is.
    """
    newest = Window.partitionBy("session_id").orderBy(F.col("id").desc())
    return messages.withColumn("_rank", F.row_number().over(newest)).filter(f"_rank <= {limit}").drop("_rank")


def normalize_history(
    messages: DataFrame, raw_limit: int = HISTORY_ROWS, max_messages: int = HISTORY_ROWS
) -> DataFrame:
    """Consecutive messages of one role merged, the last ones kept, starting with a user message.

    The raw cut comes first, so all windows below see ``raw_limit`` rows a session at most.
    """
    by_id = Window.partitionBy("session_id").orderBy("id")
    whole = Window.partitionBy("session_id")
    turned = F.coalesce((F.col("role") != F.lag("role").over(by_id)).cast("int"), F.lit(1))
    kept = F.col("run") > F.max("run").over(whole) - max_messages
    first_user = F.min(F.when((F.col("role") == "user") & F.col("kept"), F.col("run"))).over(whole)
    runs = (
        transcript_tail(messages, raw_limit)
        .withColumn("turned", turned)
        .withColumn("run", F.sum("turned").over(by_id))
        .withColumn("kept", kept)
        .withColumn("first_user", first_user)
        .filter("kept and run >= first_user")
    )
    return runs.groupBy("session_id", "run").agg(
        F.first("role").alias("role"),
        F.min("id").alias("first_id"),
        F.expr("listagg(text, '\n\n') within group (order by id)").alias("content"),
    ).drop("run")


def double_user_rows(messages: DataFrame) -> DataFrame:
    """User messages right after a user message: the reply in between got lost."""
    narrow = messages.select("session_id", "id", "role")
    rows = OrderedRows.of(narrow, ["session_id"], ["id"]).scan(previous=last_seen("role", before=True))
    return rows.df.filter("role = 'user' and previous = 'user'").select("session_id", "id")


def verbatim_reask(messages: DataFrame) -> DataFrame:
    """Assistant messages that ask the very question of the assistant's previous question."""
    said = messages.filter("role = 'assistant'")
    asked = said.select("session_id", "id", rules.first_question(F.col("text")).alias("question"))
    rows = OrderedRows.of(asked, ["session_id"], ["id"], bound=said)
    rows = rows.scan(previous=last_seen("question", before=True))
    return rows.df.filter("question = previous").select("session_id", "id", "question")


def unanswered_tail(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions that end on a user message, or on a statement while no question is open."""
    last = messages.groupBy("session_id").agg(
        F.max_by(F.struct("role", rules.question_marks(F.col("text")).alias("marks")), "id").alias("last"),
        F.max("id").alias("last_id"),
    )
    states = sessions.select(
        F.col("id").alias("session_id"), F.expr("status = 'active' and current_question is null").alias("idle")
    )
    state = (
        F.when(F.col("last.role") == "user", "no_reply")
        .when((F.col("last.marks") == 0) & F.coalesce("idle", F.lit(False)), "nothing_asked")
    )
    return (
        last.join(states, "session_id", "left")
        .withColumn("state", state)
        .filter("state is not null")
        .select("session_id", "last_id", "state")
    )


def turn_rollup(pieces: DataFrame) -> DataFrame:
    """All texts of a turn joined by blank lines, one row a turn; turns without text are dropped.

    A turn has a few rounds, so its pieces are few; however many there are, they give one row.
    """
    return (
        pieces.filter(~rules.blank(F.col("text")))
        .groupBy("session_id", "turn_id")
        .agg(F.expr("listagg(text, '\n\n') within group (order by seq)").alias("text"))
    )


def question_lint(messages: DataFrame) -> DataFrame:
    """Every message under the four text rules."""
    t = F.col("text")
    return messages.withColumn("text", rules.cleaned(t)).withColumns(
        {
            "question": rules.question_verdict(t),
            "prose": rules.prose_verdict(t),
            "preamble": rules.preamble_verdict(t),
            "rendered": rules.rendered_verdict(t),
            "marks": rules.count_of(t, "?").cast("bigint"),
        }
    ).drop("text")


def discipline_rates(messages: DataFrame) -> DataFrame:
    """Share of messages that break each rule, per session and role."""
    checked = question_lint(messages)

    def share(rule: str) -> Column:
        return F.count_if(F.col(rule) != "ok") / F.count("*")

    return checked.groupBy("session_id", "role").agg(
        F.count("*").alias("n"),
        *[share(rule).alias(f"{rule}_share") for rule in ("question", "prose", "preamble", "rendered")],
        F.max("marks").alias("max_marks"),
    )


def answer_resolution(answers: DataFrame, budget: int = CLARIFY_BUDGET) -> DataFrame:
    """What the controller decides on each reply to an open question.

    answers: session_id, seq, reply, options, verdict, skipped. Explicit intent comes before a matched option,
    that before the verdict. Other replies spend the budget; the one after the last unit closes the question.
    The spent count is the position in the stretch since the last closing reply, so no loop is needed.
    """
    picked = rules.match_choice(F.col("reply"), F.col("options"))
    rows = answers.withColumns(
        {"unknown": rules.is_dont_know(F.col("reply")), "value": picked}
    ).withColumn(
        "reason",
        F.when(F.col("skipped"), "user_skip")
        .when(F.col("unknown"), "user_said_unknown")
        .when(F.col("value").isNotNull(), "deterministic_choice_match")
        .when(F.col("verdict") == "answer", "llm_answer"),
    )
    rows = rows.select(
        "session_id", "seq", "verdict", "reason",
        F.when(F.col("reason") == "deterministic_choice_match", F.col("value")).alias("value"),
    )
    ordered = OrderedRows.of(rows, ["session_id"], ["seq"], bound=answers)
    ordered = ordered.scan(weak=running_sum("if(reason is null, 1L, 0L)"))
    ordered = ordered.scan(base=last_seen("if(reason is not null, weak, null)", before=True))
    spent = "(weak - coalesce(base, 0L))"
    cycle = budget + 1
    return ordered.df.selectExpr(
        "session_id",
        "seq",
        f"reason is not null or {spent} % {cycle} = 0 as terminal",
        f"coalesce(reason, if({spent} % {cycle} = 0, 'clarify_budget_exhausted', 'need_clarify')) as reason",
        f"""case
              when reason = 'user_skip' then 'skipped'
              when reason = 'user_said_unknown' then 'unknown'
              when reason is not null then 'complete'
              when {spent} % {cycle} <> 0 then null
              when verdict in ('partial', 'offtopic') then verdict
              else 'unknown' end as status""",
        "value",
        f"if(reason is not null, 0L, {spent} % {cycle}) as clarify_count",
    )


def order_gate(calls: DataFrame) -> DataFrame:
    """Which tool calls of a turn run.

    calls: session_id, turn_id, seq, name, accepted, owed. While an assessment is owed, calls before the first
    accepted assess_answer do not run; calls after an accepted ask_question are skipped.
    """
    rows = OrderedRows.of(calls, ["session_id", "turn_id"], ["seq"])
    rows = rows.scan(judged=running_sum("if(name = 'assess_answer' and accepted, 1L, 0L)", before=True))
    rows = rows.map(
        lambda df: df.withColumn("gated", F.expr("owed and judged = 0 and name <> 'assess_answer'"))
    )
    rows = rows.scan(asked=running_sum("if(name = 'ask_question' and accepted and not gated, 1L, 0L)", before=True))
    return rows.df.withColumn(
        "fate", F.expr("case when asked > 0 then 'skipped' when gated then 'gated' else 'executed' end")
    ).drop("judged", "gated", "asked")


def turn_outcomes(rounds: DataFrame, most_rounds: int = TURN_ROUNDS) -> DataFrame:
    """How each turn ended, from the log of its model rounds.

    rounds: turn_id, round (from 0), stop_reason, text, tools (number of tool calls), asks (one of them asks), asked (a question
    was accepted), active and open (the run's state behind the turn: still active, a question open). A turn goes on over the first cut
    answer and the first breach of the prose rules, and ends with the second of either, with an accepted question, or with a round that
    calls no tool. The outcome is 'truncated', 'violation', 'silent' (nothing reached the person), 'stranded' (something was said, but
    nothing asked and nothing is open), 'asked' or 'said'. One shuffle by turn; a turn has at most ``most_rounds`` rounds.
    """
    cut = F.coalesce(F.col("stop_reason") == "max_tokens", F.lit(False))
    text = F.coalesce("text", F.lit(""))
    prose = F.when(text != "", rules.prose_verdict(rules.cleaned(text))).otherwise("ok")
    flagged = rounds.filter(F.col("round") < most_rounds).select(
        "turn_id", "round", cut.alias("cut"), (~cut & ~F.col("asks") & (prose != "ok")).alias("breach"),
        ((text != "") & (prose == "ok")).alias("clean"), "tools", "asked", "active", "open")
    so_far = Window.partitionBy("turn_id").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    counted = flagged.withColumns({"cuts": F.count_if("cut").over(so_far), "breaches": F.count_if("breach").over(so_far)})
    failed = F.when(F.col("cut") & (F.col("cuts") == 2), "truncated").when(F.col("breach") & (F.col("breaches") == 2), "violation")
    goes_on = F.col("cut") | F.col("breach")
    ended = counted.withColumn("failed", failed).withColumn("ends", F.col("failed").isNotNull() | (~goes_on & ((F.col("tools") == 0) | F.col("asked"))))
    last = F.min(F.when(F.col("ends"), F.col("round"))).over(Window.partitionBy("turn_id"))
    taken = ended.withColumn("last", last).filter("last is null or round <= last")
    said, asked = F.bool_or(F.col("clean") & ~goes_on), F.bool_or(F.col("asked") & ~goes_on)
    told = taken.groupBy("turn_id").agg(
        F.count(F.lit(1)).alias("rounds"), F.max("failed").alias("failed"), said.alias("said"), asked.alias("asked"),
        F.bool_or("cut").alias("retried_cut"), F.bool_or("breach").alias("retried_breach"),
        F.max_by(F.struct("active", "open"), "round").alias("after"))
    nothing = ~F.col("said") & ~F.col("asked")
    outcome = (
        F.when(F.col("failed").isNotNull(), F.col("failed"))
        .when(nothing, "silent")
        .when(~F.col("asked") & F.col("after.active") & ~F.col("after.open"), "stranded")
        .when(F.col("asked"), "asked")
        .otherwise("said")
    )
    return told.select("turn_id", "rounds", outcome.alias("outcome"), "retried_cut", "retried_breach")
