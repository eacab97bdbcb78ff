"""Steps, artifacts and decisions of runs: progress, size caps, numbering, replay of writes."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import text as rules
from runlens.operators.compose import looked_up, states_before
from runlens.operators.fold import fold_rows
from runlens.operators.ordered import SEGMENT, OrderedRows, joined_on, last_seen, running_max, running_sum
from runlens.registry import (
    FINISH_MARKER,
    MAX_ARTIFACT_BYTES,
    MAX_SESSION_BYTES,
    OPTIONAL,
    PIPELINES,
    TOOLS,
    steps_table,
)
from runlens.session import settle

STRING_OPTIONS = """transform(filter(try_variant_get(_args, '$.options', 'array<variant>'),
    o -> schema_of_variant(o) = 'STRING'), o -> variant_get(o, '$', 'string'))"""
"""The options of a question; elements that are not strings are left out."""


def required_steps(sessions: DataFrame) -> DataFrame:
    """(session_id, step_id, pos, title): every step the run's version asks for."""
    steps = F.broadcast(steps_table(sessions.sparkSession))  # one row per step of the registry
    runs = sessions.select(F.col("id").alias("session_id"), "version", "current_step")
    return runs.join(steps, "version").select("session_id", "version", "current_step", "pos", "step_id", "title")


def saved_steps(artifacts: DataFrame) -> DataFrame:
    return artifacts.select("session_id", "step_id").distinct()


def progress(sessions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Every step of each run with its done flag and whether the run stands on it."""
    saved = saved_steps(artifacts).withColumn("saved", F.lit(True))
    return (
        required_steps(sessions)
        .join(saved, ["session_id", "step_id"], "left")
        .select(
            "session_id",
            "pos",
            "step_id",
            "title",
            F.coalesce("saved", F.lit(False)).alias("done"),
            (F.col("step_id") == F.col("current_step")).alias("current"),
        )
    )


def can_finish(sessions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Whether all required steps are saved; decisions are not required."""
    return progress(sessions, artifacts).groupBy("session_id").agg(
        F.every("done").alias("complete"), F.count_if(F.col("done")).alias("saved")
    )


def missing_steps(sessions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Required pairs minus saved pairs."""
    return required_steps(sessions).select("session_id", "step_id").subtract(saved_steps(artifacts))


def step_lookup(rows: DataFrame) -> DataFrame:
    """Position (-1 if unknown), first and next step for each (version, step_id) of ``rows``."""
    spark = rows.sparkSession
    known = []
    for version, steps in PIPELINES.items():
        ids = [step[0] for step in steps]
        known += [(version, i, pos, ids[pos + 1] if pos + 1 < len(ids) else None) for pos, i in enumerate(ids)]
    table = F.broadcast(spark.createDataFrame(known, "version string, step_id string, at int, next_step string"))
    first = F.create_map(*[F.lit(x) for v, steps in PIPELINES.items() for x in (v, steps[0][0])])
    return rows.join(table, ["version", "step_id"], "left").select(
        *rows.columns,
        F.coalesce("at", F.lit(-1)).cast("bigint").alias("pos"),
        F.try_element_at(first, F.col("version")).alias("first_step"),
        "next_step",
    )


def artifact_upsert(writes: DataFrame) -> DataFrame:
    """The current artifact per session and step: the last write. ``write_no`` is unique in a session.

    The last number is found on narrow rows; the texts are only filtered by it, never sorted or aggregated.
    """
    key = ["session_id", "step_id"]
    newest = writes.groupBy(*key).agg(F.max("write_no").alias("write_no"))
    return joined_on(writes, newest, [*key, "write_no"], "left_semi").select(*key, "write_no", "markdown")


def artifact_bytes(
    writes: DataFrame, max_artifact: int = MAX_ARTIFACT_BYTES, max_session: int = MAX_SESSION_BYTES
) -> DataFrame:
    """UTF-8 bytes of the current artifacts per session against both caps; the texts are not shuffled."""
    sizes = writes.select("session_id", "step_id", "write_no", F.octet_length("markdown").alias("bytes"))
    current = sizes.groupBy("session_id", "step_id").agg(F.max_by("bytes", "write_no").cast("bigint").alias("bytes"))
    return current.groupBy("session_id").agg(
        F.sum("bytes").alias("total_bytes"),
        F.max("bytes").alias("largest"),
        F.count_if(F.col("bytes") > max_artifact).alias("oversized"),
        (F.sum("bytes") > max_session).alias("over_cap"),
    )


def adr_counts(adrs: DataFrame) -> DataFrame:
    return adrs.groupBy("session_id").agg(
        F.count("*").alias("adrs"), (F.coalesce(F.max("n"), F.lit(0)) + 1).cast("bigint").alias("next_n")
    )


def adr_numbering(adrs: DataFrame) -> DataFrame:
    """Decisions numbered 1, 2, 3 .. per session in order of arrival."""
    rows = OrderedRows.of(adrs.select("session_id", "id", "title"), ["session_id"], ["id"])
    return rows.scan(n=running_sum("1L")).df


def adr_list(adrs: DataFrame) -> DataFrame:
    return adrs.select("session_id", "n", "id", "title").orderBy("session_id", "n", "id")


def last_finished(sessions: DataFrame) -> DataFrame:
    """The latest finished run of each user."""
    finished = sessions.filter("status = 'finished'")
    newest = finished.groupBy("tg_user_id").agg(F.max("id").alias("id"))
    others = [c for c in sessions.columns if c != "tg_user_id"]
    return joined_on(finished, newest, ["tg_user_id", "id"], "left_semi").select("tg_user_id", *others)


def known_pos(step: Column, version: Column) -> Column:
    """Position of a step in its version, null if unknown; a literal table of 19 steps."""
    places = {f"{v}/{s[0]}": pos for v, steps in PIPELINES.items() for pos, s in enumerate(steps)}
    table = F.create_map(*[F.lit(x) for pair in places.items() for x in pair])
    return F.try_element_at(table, F.concat_ws("/", version, step))


def version_size(version: Column) -> Column:
    table = F.create_map(*[F.lit(x) for v, steps in PIPELINES.items() for x in (v, len(steps))])
    return F.try_element_at(table, version)


def step_progression(
    writes: DataFrame, max_artifact: int = MAX_ARTIFACT_BYTES, max_session: int = MAX_SESSION_BYTES
) -> DataFrame:
    """What becomes of each artifact write, replayed in order.

    writes: session_id, write_no, version, step_id, bytes, blocked (a question is open). A write of the
    current step advances the run, one of a past step overwrites, one further ahead is refused. The pointer is
    the number of steps done so far, each a running maximum that needs the one before. Only sessions whose
    largest writes together exceed the session cap need the exact replay of sizes; they are folded.
    """
    # what follows needs sizes and places only, so the texts behind ``bytes`` are read this once
    return _progression(settle(_placed(writes, max_artifact)), max_session)


def _placed(writes: DataFrame, max_artifact: int) -> DataFrame:
    """Writes with their place in the version and the reason to refuse them whatever came before."""
    placed = writes.select(
        "session_id",
        "write_no",
        "bytes",
        known_pos(F.col("step_id"), F.col("version")).alias("pos"),
        F.coalesce(version_size(F.col("version")), F.lit(0)).alias("steps"),
        "blocked",
    )
    refusal = (
        F.when(F.col("blocked"), "question_open")
        .when(F.col("pos").isNull(), "unknown_step")
        .when(F.col("bytes") > max_artifact, "too_large")
    )
    return placed.withColumn("refusal", refusal)


def _progression(placed: DataFrame, max_session: int) -> DataFrame:
    heavy = (
        placed.filter("refusal is null")
        .groupBy("session_id", "pos")
        .agg(F.max("bytes").alias("bytes"))
        .groupBy("session_id")
        .agg(F.sum("bytes").alias("most"))
        .filter(F.col("most") > max_session)
        .select("session_id")
    )
    rows = OrderedRows.of(placed, ["session_id"], ["write_no"]).attach(heavy.withColumn("heavy", F.lit(True)))
    light = _light_progression(rows.map(lambda df: df.filter("heavy is null").drop("heavy")))
    exact = fold_rows(
        rows.map(lambda df: df.filter("heavy").drop("heavy")),
        {"at": 0, "sizes": {}},
        _capped_write(max_session),
        "outcome string, pointer bigint",
    ).df
    return light.unionByName(exact)


def _light_progression(rows: OrderedRows) -> DataFrame:
    longest = max(len(steps) for steps in PIPELINES.values())
    for pos in range(longest):
        ready = f"refusal is null and pos = {pos}" + (f" and done{pos - 1} = 1" if pos else "")
        rows = rows.scan(**{f"done{pos}": running_max(f"if({ready}, 1, 0)", before=True)})
    at = " + ".join(f"coalesce(done{pos}, 0)" for pos in range(longest))
    outcome = F.expr(
        "case when refusal is not null then refusal when at < steps and pos > at then 'skip_ahead' "
        "when pos = at then 'advanced' else 'overwritten' end"
    )
    return rows.map(
        lambda df: df.withColumn("at", F.expr(at)).select(
            "session_id",
            "write_no",
            outcome.alias("outcome"),
            F.expr("cast(at + if(refusal is null and pos = at, 1, 0) as bigint)").alias("pointer"),
        )
    ).df


def _capped_write(max_session: int):
    """Replay of a write on {'at': pointer, 'sizes': bytes by position}, with the cap on their sum."""

    def outcome(at: int, sizes: dict, row) -> str:
        if isinstance(row.refusal, str):
            return row.refusal
        if at < row.steps and row.pos > at:
            return "skip_ahead"
        if sum(b for p, b in sizes.items() if p != str(int(row.pos))) + row.bytes > max_session:
            return "session_full"
        return "advanced" if row.pos == at else "overwritten"

    def step(state: dict, row) -> tuple:
        at, sizes = state["at"], state["sizes"]
        found = outcome(at, sizes, row)
        if found in ("advanced", "overwritten"):
            sizes = {**sizes, str(int(row.pos)): int(row.bytes)}
            at += found == "advanced"
        return {"at": at, "sizes": sizes}, (found, at)

    return step


def version_change(calls: DataFrame, initial: str = "lite", max_artifact: int = MAX_ARTIFACT_BYTES) -> DataFrame:
    """Whether each change of version is allowed: only while the run has no artifact.

    calls: session_id, seq, name, version, step_id, bytes. Until then the version is the latest allowed one, so
    the first artifact is the first write of that version's first step.
    """
    first = F.create_map(*[F.lit(x) for v, steps in PIPELINES.items() for x in (v, steps[0][0])])
    known = F.col("version").isin(*PIPELINES)
    rows = OrderedRows.of(calls, ["session_id"], ["seq"])
    rows = rows.map(lambda df: df.withColumn("picked", F.when((F.col("name") == "set_version") & known, F.col("version"))))
    rows = rows.scan(now=last_seen("picked", before=True))
    opens = (
        (F.col("name") == "save_artifact")
        & (F.col("step_id") == F.element_at(first, F.coalesce("now", F.lit(initial))))
        & (F.col("bytes") <= max_artifact)
    )
    rows = rows.map(lambda df: df.withColumn("opens", F.coalesce(opens, F.lit(False)).cast("bigint")))
    rows = rows.scan(saved=running_sum("opens", before=True))
    return rows.df.filter("name = 'set_version'").select(
        "session_id",
        "seq",
        "version",
        F.expr(
            "case when picked is null then 'unknown_version' when saved > 0 then 'has_artifacts' else 'changed' end"
        ).alias("outcome"),
    )


def tool_args_audit(calls: DataFrame, tools: dict = TOOLS, keep: str | None = None) -> DataFrame:
    """The first thing wrong with each tool call, or 'ok': name, required arguments, types, allowed values.

    ``keep``: a name for the parsed arguments, to go on with them.
    """
    parsed = calls.withColumn("_args", F.try_parse_json("args"))
    verdict = F.when(~F.col("name").isin(*tools), "unknown_tool").when(F.col("_args").isNull(), "not_json")
    for tool, arguments in tools.items():
        for arg, required, allowed in arguments:
            here = F.col("name") == tool
            kind = F.schema_of_variant(F.try_variant_get("_args", f"$.{arg}", "variant"))
            value = F.try_variant_get("_args", f"$.{arg}", "string")
            missing = kind.isNull() | (kind == "VOID")
            if required:
                verdict = verdict.when(here & missing, f"missing_{arg}")
            verdict = verdict.when(here & ~missing & (kind != "STRING"), f"type_{arg}")
            if allowed:
                verdict = verdict.when(here & ~missing & ~value.isin(*allowed), f"value_{arg}")
    done = parsed.withColumn("verdict", verdict.otherwise("ok"))
    return done.withColumnRenamed("_args", keep) if keep else done.drop("_args")


def tool_schema_audit(calls: DataFrame, tools: dict = TOOLS, optional: dict = OPTIONAL) -> DataFrame:
    """All that is wrong with each tool call by the schema of its run's version, comma-joined, or 'ok'.

    calls: version of the run, name, args. Beyond ``tool_args_audit``, which stops at what makes a call fail, it judges step
    ids by the version, options as a list of strings, and arguments that the replay passes over.
    """
    parsed = calls.withColumn("_args", F.try_parse_json("args"))
    name = F.col("name")
    found = [F.when(~name.isin(*tools), "unknown_tool"), F.when(F.col("_args").isNull(), "not_json")]
    for tool, arguments in tools.items():
        extra = [(arg, False, None, kind) for arg, kind in optional.get(tool, [])]
        for arg, required, allowed, kind in [*((*a, "string") for a in arguments), *extra]:
            here = (name == tool) & F.col("_args").isNotNull()
            seen = F.schema_of_variant(F.try_variant_get("_args", f"$.{arg}", "variant"))
            value = F.try_variant_get("_args", f"$.{arg}", "string")
            missing = seen.isNull() | (seen == "VOID")
            if required:
                found.append(F.when(here & missing, f"missing_{arg}"))
            if kind == "strings":
                listed = F.startswith(seen, F.lit("ARRAY<"))
                found.append(F.when(here & ~missing & ~listed, f"type_{arg}").when(here & listed & ~seen.isin("ARRAY<STRING>", "ARRAY<VOID>"), f"item_{arg}"))
            else:
                found.append(F.when(here & ~missing & (seen != "STRING"), f"type_{arg}"))
            known = value.isin(*allowed) if allowed else known_pos(value, F.col("version")).isNotNull() if arg == "step_id" else None
            if known is not None:
                found.append(F.when(here & (seen == "STRING") & ~known, f"value_{arg}"))
    problems = F.array_join(F.array_compact(F.array(*found)), ",")
    return parsed.withColumn("problems", F.when(problems == "", "ok").otherwise(problems)).drop("_args")


def checked_calls(calls: DataFrame) -> DataFrame:
    """Tool calls with what the text rules make of each: ``fine``, ``unknown`` and the short values that the replay needs."""
    text = lambda arg: F.try_variant_get("_args", f"$.{arg}", "string")
    asks, names, decides = (F.col("name") == n for n in ("ask_question", "set_product_name", "create_adr"))
    # a lead-in that is not a string counts as none
    lead = F.when(asks & (F.col("verdict") != "type_preamble"), text("preamble"))
    rows = tool_args_audit(calls, keep="_args").select(
        "session_id",
        "seq",
        "turn_id",
        "name",
        "reply",
        F.col("verdict").isin("ok", "type_preamble").alias("sound"),
        text("step_id").alias("step_id"),
        text("version").alias("version"),
        text("verdict").alias("said"),
        F.when(names, text("name")).alias("given"),
        F.when(names, rules.slug(text("name"))).alias("slug"),
        F.when(decides, text("title")).alias("title"),
        F.octet_length(text("markdown")).cast("bigint").alias("bytes"),
        F.when(asks, text("question")).alias("question"),
        lead.alias("lead"),
        F.when(asks, F.expr(STRING_OPTIONS)).alias("options"),
    )
    # each text is cleaned once, in a column of its own, for the rules that read it
    rows = rows.withColumns(
        {
            "shown": F.when(asks, rules.cleaned(rules.rendered(F.col("lead"), F.col("question")))),
            "asked": F.when(asks, rules.cleaned(F.col("question"))),
            "led": F.when(asks, rules.cleaned(F.col("lead"))),
        }
    )
    asks_well = (
        (rules.preamble_verdict(F.col("led")) == "ok")
        & (rules.rendered_verdict(F.col("shown")) == "ok")
        & (rules.question_verdict(F.col("asked")) == "ok")
    )
    fine = (
        F.when(~F.col("sound"), False)
        .when(asks, asks_well)
        .when(names, rules.product_name_verdict(F.col("given")) == "ok")
        .when(decides, (F.col("title") != "") & F.col("bytes").between(1, MAX_ARTIFACT_BYTES))
        .otherwise(True)
    )
    # an unknown step is refused by the run, not here
    rows = rows.withColumns(
        {"fine": F.coalesce(fine, F.lit(False)), "unknown": rules.is_dont_know(F.col("reply"))}
    ).drop("sound", "given", "title", "question", "lead", "shown", "asked", "led")
    return rows


def prepared_calls(calls: DataFrame) -> DataFrame:
    """As ``checked_calls``, with reply and options as words to be looked for instead of texts."""
    rows = checked_calls(calls)
    asks = (F.col("name") == "ask_question") & F.col("fine")
    assesses = F.col("name") == "assess_answer"
    return rows.withColumns({
        "reply_words": F.when(assesses, rules.reply_words(F.col("reply"))),
        "option_words": F.when(asks, rules.option_words(F.col("options"))),
    }).drop("reply", "options")


def tool_replay(calls: DataFrame, initial: str = "lite", budget: int = 2) -> DataFrame:
    """The end state of each session after its tool calls ran, with all guards.

    calls: session_id, turn_id, seq, name, args (JSON), reply (the human's text the turn answers). Text rules
    are column expressions, a small fold tells which calls run, and running values give the rest.
    """
    rows = checked_calls(calls)
    offered = F.when((F.col("name") == "ask_question") & F.col("fine"), F.struct("options"))
    ordered = OrderedRows.of(rows, ["session_id"], ["seq"], bound=calls)
    ordered = ordered.scan(offer=last_seen(offered, before=True), last_turn=last_seen("turn_id", before=True))
    picked = rules.match_choice(F.col("reply"), F.col("offer.options")).isNotNull()
    ordered = ordered.map(
        lambda df: df.withColumns(
            {"picked": picked, "new_turn": F.expr("not (turn_id <=> last_turn)")}
        ).drop("reply", "options", "offer", "turn_id", "last_turn")
    )
    return _end_states(_guarded(ordered, budget), initial)


def _guarded(rows: OrderedRows, budget: int) -> OrderedRows:
    """The calls with whether they run, and the open question and spent clarifications around them.

    The state has a handful of values: whether a question is open, clarifications spent, whether the reply was judged, whether the turn
    is over. What a call does to it depends on a few flags, so it is a row of a small table, and calls compose (``compose``).
    """
    flags = (False, True)
    states = [(asked, spent, judged, stopped) for asked in flags for spent in range(budget + 1) for judged in flags for stopped in flags]
    calls = [(tool, *bits) for tool in ("other", "assess_answer", "ask_question") for bits in product(flags, repeat=5)]

    def after(state: tuple, call: tuple) -> tuple:
        asked, spent, judged, stopped = state
        tool, new_turn, fine, unknown, picked, answered = call
        if new_turn:
            judged, stopped = not asked, False
        if not fine or stopped or not (judged or tool == "assess_answer"):
            return asked, spent, judged, stopped
        if tool == "ask_question":
            return True, spent, judged, True
        if tool == "assess_answer":
            closes = unknown or (asked and picked) or answered or spent >= budget
            return (False, 0, True, stopped) if closes else (asked, spent + 1, True, stopped)
        return asked, spent, judged, stopped

    table = [[states.index(after(state, call)) for state in states] for call in calls]
    bit = lambda condition, weight: F.coalesce(condition, F.lit(False)).cast("int") * weight
    tool = F.when(F.col("name") == "ask_question", 2).when(F.col("name") == "assess_answer", 1).otherwise(0)
    code = (tool * 32 + bit(F.col("new_turn"), 16) + bit(F.col("fine"), 8) + bit(F.col("unknown"), 4) + bit(F.col("picked"), 2)
            + bit(F.col("said") == "answer", 1)).cast("int")
    rows = rows.map(lambda df: df.withColumn("code", code))
    rows = states_before(rows, "code", table, states.index((False, 0, True, False)), "state")
    held = lambda facts, state: F.element_at(F.lit(facts), state + 1)
    state, then = F.col("state"), looked_up(table, F.col("code"), F.col("state"))
    asked, spent, judged, stopped = ([s[i] for s in states] for i in range(4))
    judged_now = F.when(F.col("new_turn"), ~held(asked, state)).otherwise(held(judged, state))
    stopped_now = ~F.col("new_turn") & held(stopped, state)
    runs = F.col("fine") & ~stopped_now & (judged_now | (F.col("name") == "assess_answer"))
    passed = ["name", "step_id", "version", "said", "slug", "bytes"]
    return rows.map(lambda df: df.select(
        *rows.key, *rows.order, runs.alias("runs"), held(asked, state).alias("was_open"), held(asked, then).alias("open"),
        held(spent, then).cast("bigint").alias("spent"), *passed, *([SEGMENT] if SEGMENT in df.columns else [])))


def _end_states(rows: OrderedRows, initial: str) -> DataFrame:
    """The end state per session of calls of which it is known whether they ran."""
    first = F.create_map(*[F.lit(x) for v, steps in PIPELINES.items() for x in (v, steps[0][0])])
    rows = rows.map(
        lambda df: df.withColumns(
            {
                "writes": F.expr("runs and not was_open and name = 'save_artifact'"),
                "pick": F.expr("if(runs and name = 'set_version', version, null)"),
            }
        )
    )
    # the version can change until its first step is saved
    rows = rows.scan(now=last_seen("pick", before=True))
    opens = (
        F.col("writes")
        & (F.col("bytes") <= MAX_ARTIFACT_BYTES)
        & (F.col("step_id") == F.element_at(first, F.coalesce("now", F.lit(initial))))
    )
    rows = rows.map(lambda df: df.withColumn("opens", F.coalesce(opens, F.lit(False)).cast("bigint")))
    rows = rows.scan(saved=running_sum("opens", before=True))
    rows = rows.map(lambda df: df.withColumn("pick", F.expr("if(saved = 0, pick, null)")))
    rows = rows.scan(held=last_seen("pick"))
    traced = settle(rows.map(lambda df: df.withColumn("version", F.coalesce("held", F.lit(initial)))).df)

    writes = traced.filter("writes").select(
        "session_id", F.col("seq").alias("write_no"), "version", "step_id", "bytes", F.lit(False).alias("blocked")
    )
    written = _progression(_placed(writes, MAX_ARTIFACT_BYTES), MAX_SESSION_BYTES)
    reached = written.groupBy("session_id").agg(
        F.max("pointer").alias("at"),
        F.min(F.struct(-F.col("pointer"), "write_no"))["write_no"].alias("reached_at"),
    )
    ran = lambda tool, value: F.max_by(
        F.when(F.col("runs") & (F.col("name") == tool), F.col(value)),
        F.when(F.col("runs") & (F.col("name") == tool), F.col("seq")),
    )
    ends = traced.groupBy("session_id").agg(
        F.max_by(F.struct("version", "open", "spent"), "seq").alias("last"),
        ran("assess_answer", "said").alias("verdict"),
        ran("set_product_name", "slug").alias("slug"),
        F.count_if(F.col("runs") & (F.col("name") == "create_adr")).alias("adrs"),
        ran("finish", "seq").alias("finish_at"),
    )
    places = F.create_map(
        *[
            F.lit(x)
            for v, pipeline in PIPELINES.items()
            for x in (v, F.array(*[F.lit(s[0]) for s in pipeline], F.lit(FINISH_MARKER)))
        ]
    )
    complete = F.col("artifacts") >= version_size(F.col("version"))
    return (
        ends.join(reached, "session_id", "left")
        .select(
            "session_id", "last.version", "last.open", "last.spent", "verdict", "slug", "adrs", "finish_at",
            "reached_at", F.coalesce("at", F.lit(0)).cast("bigint").alias("artifacts"),
        )
        .withColumn("current_step", F.element_at(places, F.col("version"))[F.col("artifacts").cast("int")])
        .withColumn(
            "status",
            F.when(complete & (F.col("finish_at") > F.col("reached_at")), "finished").otherwise("active"),
        )
        .drop("finish_at", "reached_at")
    )
