"""Literal cases of the text rules."""

import pytest
from pyspark.sql import functions as F

from runlens.functions import text as rules
from runlens.operators import dialogue, documents, methodology, steps


def judged(rule):
    return lambda t: rule(rules.cleaned(t))


def value(spark, expr_of, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in sorted(df.select("i", expr_of(F.col("t"))).collect())]


def test_question_rules(spark):
    got = value(
        spark, judged(rules.question_verdict),
        "Кто страдает?", "Кто? Какая боль?", "Кто？ Что？ Где？", "Ответь: 1) кто 2) что?", "А. Б. В. Г?", None, "  ",
        "Опиши боль", "x" * 400 + "?", "раз; два; три?", "Кто платит？",
    )
    assert got == ["ok", "several_questions", "several_questions", "list", "too_many_sentences", "empty", "empty",
                   "no_question", "too_long", "list", "ok"]


def test_prose_rules(spark):
    got = value(
        spark, judged(rules.prose_verdict),
        "Теперь:\n1. Расскажи про X\n2. Опиши Y", "Отлично, зафиксировал. Идём дальше.", "Как дела？", None,
        "- поток предсказуем\n- команда мала", "Дай X; уточни Y", "РАССКАЖИ про X", "Дайджест\nНазовите",
    )
    assert got == ["request_dump", "ok", "question_in_prose", "ok", "ok", "request_dump", "ok", "ok"]


def test_preamble_and_rendered(spark):
    assert value(spark, judged(rules.preamble_verdict), "Ок.", "Что?", "а. " * 13, "б" * 1201, "") == [
        "ok", "question_in_preamble", "too_many_sentences", "too_long", "ok"]
    assert value(spark, judged(rules.rendered_verdict), "Ок.\n\nЧто?", "Что? Кто?", "", "ж" * 1800 + "?", "нет") == [
        "ok", "not_one_question", "empty", "too_long", "not_one_question"]


def test_first_question(spark):
    assert value(
        spark, rules.first_question,
        "Вот. 1) Кто  ваш **клиент**? Что ещё?", "нет вопроса", None, "да?", "а?\n- Какой срок?",
    ) == ["1) Кто ваш клиент?"[3:], None, None, None, "Какой срок?"]


def test_dont_know_and_choice(spark):
    assert value(spark, rules.is_dont_know, "Не знаю!", "незнаю", "хз скорее", "хзачем", "НЕ В КУРСЕ.", "знаю", None) == [
        True, True, True, False, True, False, False]
    options = F.array(F.lit("скорость"), F.lit("регулярность"), F.lit("две недели"))
    pick = lambda t: rules.match_choice(t, options)
    assert value(
        spark, pick, "  СКОРОСТЬ  ", "думаю, Скорость!", "скоростью", "регулярность и скорость", "ну,\tдве недели\nда",
        "две  недели", "", None,
    ) == ["скорость", "скорость", None, "скорость", "две недели", None, None, None]


def test_slugs(spark):
    assert value(spark, rules.slug, "Идея: бот", "", "!!!", "_AI_рекрутер_", "a" * 39 + " b", None) == [
        "идея-бот", "product", "product", "ai_рекрутер", "a" * 39 + "-", "product"]
    assert value(spark, rules.product_name_verdict, "AI-рекрутер", "да", "", "x" * 121, "Product") == [
        "ok", "meaningless", "length", "length", "meaningless"]


def test_markup(spark):
    assert value(
        spark, rules.md_to_html,
        "ЛПНП <3,0 это хорошо", "A & B **bold**", "## Title \n- one\n* two", "a *b* _c_ `d` x_y_z 2*3*4",
    ) == ["ЛПНП &lt;3,0 это хорошо", "A &amp; B <b>bold</b>", "<b>Title</b>\n• one\n• two",
          "a <i>b</i> <i>c</i> <code>d</code> x_y_z 2<i>3</i>4"]


@pytest.mark.parametrize("text", [
    "<b>" + "z" * 9000 + "</b>", "\n".join("line %d <i>x</i>" % i for i in range(900)),
    "<b>" + "\n".join("w" * 500 for _ in range(30)) + "</b>", "\n" * 5000, "a" * 4030 + "<code>" + "b" * 4100 + "</code>",
])
def test_chunks_fit_and_balance(text):
    chunks = documents.chunks_of(text)
    assert all(len(c) <= 4096 for c in chunks)
    for chunk in chunks:
        for tag in ("b", "i", "code"):
            assert chunk.count(f"<{tag}>") == chunk.count(f"</{tag}>")
    bare = lambda s: __import__("re").sub(r"</?\w+>|\n", "", s)
    assert bare("".join(chunks)) == bare(text)


def test_chunk_ends():
    """Cuts in a line stay before a tag, blank lines at a chunk's start go, tags live on across chunks."""
    assert documents.chunks_of("x" * 60 + "<a href='" + "q" * 30 + "'>y</a>\n\n" + "z" * 60, 64) == [
        "x" * 60, "<a href='" + "q" * 30 + "'>y</a>\n", "z" * 60]
    assert documents.chunks_of("<b><I class='k'>" + "w" * 80 + "</i>\n</b>tail", 64) == [
        "<b><I class='k'>" + "w" * 48 + "</i></b>", "<b><i>" + "w" * 32 + "</i>\n</b>tail"]
    assert documents.chunks_of("\n" * 80, 64) == [""]
    assert documents.chunks_of("x" * 63 + "<<" + "y" * 70, 64) == ["x" * 63, "<", "<" + "y" * 63, "y" * 7]


def test_events_without_secrets(spark):
    hidden = rules.REDACTED
    rows = {
        '{"a": ["x tok1 \\"q", 5, null, {"token": "tok1"}], "tok1": "tok1tok1"}': (
            f'{{"a": ["x {hidden} \\"q", 5, null, {{"token": "{hidden}"}}], "tok1": "{hidden}{hidden}"}}', False),
        '{"dsn": "abc", "secret": "bcde", "s": "xabcdex", "text": {"deep": 1}}': (
            f'{{"dsn": "{hidden}", "secret": "{hidden}", "s": "x{hidden}x", "text": "{hidden}"}}', False),
        '{"token": "", "n": 1.5}': (f'{{"token": "{hidden}", "n": 1.5}}', False),
        '["plain"]': ('["plain"]', False),
        '{"token": "cut': (hidden, True),
        None: (None, False),
    }
    df = spark.createDataFrame([(event,) for event in rows], "event string")
    assert [tuple(r) for r in documents.redact_events(df).collect()] == list(rows.values())


def test_short_text_is_untouched(spark):
    df = spark.createDataFrame([(1, "<b>open"), (2, "x" * 5000)], "doc_id long, text string")
    got = sorted(map(tuple, documents.chunk_documents(df).collect()))
    assert got[0] == (1, 0, "<b>open") and [len(r[2]) for r in got[1:]] == [4048, 952]


def test_marked_up_documents_survive_chunking(spark):
    import re

    import runlens.plans.steps  # noqa: F401  (its views)

    from runlens.plans.query import Source

    marked = Source(spark, "/root/testdata/sf0.001").markdown
    marked = marked.select("doc_id", rules.md_to_html(F.col("text")).alias("text"))
    whole = {r.doc_id: r.text for r in marked.collect()}
    parts = {}
    for r in documents.chunk_documents(marked).orderBy("doc_id", "chunk_no").collect():
        assert len(r.chunk) <= 4096
        for tag in ("b", "i", "code"):
            assert r.chunk.count(f"<{tag}>") == r.chunk.count(f"</{tag}>") or len(whole[r.doc_id]) <= 4096
        parts.setdefault(r.doc_id, []).append(r.chunk)
    bare = lambda s: re.sub(r"</?(b|i|code)>|\n", "", s)
    assert set(parts) == set(whole)
    assert all(bare("".join(parts[d])) == bare(whole[d]) for d in whole)


def test_redaction(spark):
    event = '{"message": "boom 123:abc", "extra": [{"bot_token": "123:abc", "api-key": "123", "caption": "hi", "n": 1}]}'
    df = spark.createDataFrame([(event,), (None,)], "event string")
    got = [r[0] for r in documents.redact_events(df).collect()]
    assert got[1] is None
    assert got[0] == (
        '{"message": "boom «REDACTED»", "extra": [{"bot_token": "«REDACTED»", "api-key": "«REDACTED»", '
        '"caption": "«REDACTED»", "n": 1}]}'
    )


def test_history_windows(spark):
    rows = [(1, 0, "assistant", "hi"), (1, 1, "user", "a"), (1, 2, "assistant", "x"), (1, 3, "assistant", "y"), (1, 4, "user", "b")]
    rows += [(2, i, "user" if i % 2 else "assistant", str(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "session_id long, id long, role string, text string")
    got = dialogue.normalize_history(df).orderBy("session_id", "first_id").collect()
    one = [(r.role, r.content) for r in got if r.session_id == 1]
    assert one == [("user", "a"), ("assistant", "x\n\ny"), ("user", "b")]
    two = [r for r in got if r.session_id == 2]
    assert len(two) <= 40 and two[0].role == "user"


def test_budget(spark):
    said = ["partial", "offtopic", "partial", "weird", "weird", "weird", "answer"]
    df = spark.createDataFrame([(1, i, "ответ", v) for i, v in enumerate(said)], "session_id int, seq int, reply string, verdict string")
    df = df.withColumn("options", F.lit(None).cast("array<string>")).withColumn("skipped", F.lit(False))
    got = dialogue.answer_resolution(df).orderBy("seq").collect()
    assert [r.status for r in got] == [None, None, "partial", None, None, "unknown", "complete"]
    assert [r.clarify_count for r in got] == [1, 2, 0, 1, 2, 0, 0]


def test_waves_and_lint_of_odd_backlogs(spark):
    def text(tasks):
        return "# B\n\n## Задачи\n\n" + "".join(
            f"### {t}: дело\n\n**Эпик:** E\n**Размер:** S\n**Зависимости:** {', '.join(n) or '—'}\n\n**Definition of Done:**\n- [ ] x\n\n" for t, n in tasks)

    chain = [(f"T-{i:03}", [f"T-{i - 1:03}"] if i > 1 else []) for i in range(1, 41)]
    backlogs = [
        (1, text([("T-001", ["T-002"]), ("T-002", ["T-001"]), ("T-003", ["T-001"]), ("T-004", []), ("T-005", ["T-004", "T-099"])])),
        (2, text(chain[::-1])), (3, text([("T-001", ["T-001"])])), (4, "no tasks"), (5, None),
        (6, text([("T-001", []), ("T-002", ["T-001"]), ("T-001", ["T-003"]), ("T-003", [])])),
    ]
    table = spark.createDataFrame(backlogs, "doc_id long, text string")
    waves = {(r.doc_id, r.task): r.wave for r in methodology.backlog_waves(table).collect()}
    assert {t: w for (d, t), w in waves.items() if d == 1} == {"T-001": None, "T-002": None, "T-003": None, "T-004": 1, "T-005": 2}
    assert {t: w for (d, t), w in waves.items() if d == 2} == {f"T-{i:03}": i for i in range(1, 41)}
    assert {(d, t): w for (d, t), w in waves.items() if d not in (1, 2)} == {(3, "T-001"): None, (6, "T-001"): 2, (6, "T-002"): 3, (6, "T-003"): 1}
    lint = methodology.backlog_lint(table)
    assert sorted(map(tuple, lint.collect())) == [(1, "T-005", "needs_missing T-099"), (3, "T-001", "needs_itself")]
    for made in (lint, methodology.backlog_waves(table)):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_turn_outcomes(spark):
    ok = ("tool_use", "Понял.", 1, False, False)
    cut, breach = ("max_tokens", "Понял", 1, True, True), ("end_turn", "А что дальше?", 0, False, False)
    turns = {
        1: ([("end_turn", "Понял.", 0, False, False)], True, False, "stranded"), 2: ([cut, ("tool_use", "", 1, True, True)], True, True, "asked"),
        3: ([cut, breach, cut, ok], True, False, "truncated"), 4: ([breach, cut, breach], True, False, "violation"), 5: ([("tool_use", "", 2, False, False)] * 8, True, True, "silent"),
        6: ([ok, ("end_turn", None, 0, False, False)], False, False, "said"), 7: ([ok, ("end_turn", None, 0, False, False), cut, cut], True, True, "said"),
        8: ([("tool_use", "Что?", 1, True, False), ("end_turn", "", 0, False, False)], True, False, "silent"),
        9: ([(None, "Опиши боль\nНазови срок", 1, True, True)], True, True, "asked"),
    }
    rows = [(t, i, *r, active, is_open) for t, (rounds, active, is_open, _) in turns.items() for i, r in enumerate(rounds)]
    table = spark.createDataFrame(rows, "turn_id long, round int, stop_reason string, text string, tools int, asks boolean, asked boolean, active boolean, open boolean")
    found = {r.turn_id: r for r in dialogue.turn_outcomes(table).collect()}
    assert {t: r.outcome for t, r in found.items()} == {t: expected for t, (_, _, _, expected) in turns.items()}
    assert (found[3].rounds, found[5].rounds, found[7].rounds) == (3, 6, 2) and found[4].retried_cut and found[4].retried_breach
    plan = dialogue.turn_outcomes(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_schema_audit_of_odd_calls(spark):
    import json

    calls = [
        ("ask_question", {"question": "a?", "options": ["x", 1], "preamble": 3}), ("ask_question", {"question": None, "options": {}}), ("ask_question", {"question": "a?", "options": []}),
        ("save_artifact", {"step_id": "F1", "markdown": "m"}), ("save_artifact", {"step_id": "L1"}), ("assess_answer", {"verdict": "no", "missing": []}), ("dance", {}), ("finish", "{"),
    ]
    rows = [(1, i, "lite", name, args if isinstance(args, str) else json.dumps(args)) for i, (name, args) in enumerate(calls)]
    found = steps.tool_schema_audit(spark.createDataFrame(rows, "session_id long, seq long, version string, name string, args string")).orderBy("seq")
    assert [r.problems for r in found.collect()] == [
        "type_preamble,item_options", "missing_question,type_options", "ok", "value_step_id", "missing_markdown", "value_verdict,type_missing", "unknown_tool", "not_json"]


def test_chunks_are_given_out_in_small_batches(spark, monkeypatch):
    """A worker's batches are bounded by their text, not by the number of documents or the length of one."""
    from pyspark.sql import functions as F

    from runlens.operators import documents

    monkeypatch.setattr(documents, "STEP_CHARS", 10_000)
    texts = [("a" * 99 + "\n") * 1000, None, "", "short"]
    docs = spark.createDataFrame([(2**60 + i if i != 3 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    chunked = documents.chunk_documents(docs)
    sizes = chunked.mapInArrow(lambda batches: batches, chunked.schema)  # the rows pass on as they are
    want = [(2**60 + i if i != 3 else None, no, c) for i, t in enumerate(texts) if t is not None for no, c in enumerate(documents.chunks_of(t))]
    assert [tuple(r) for r in sizes.collect()] == want
    assert chunked.agg(F.count("*")).first()[0] == len(want) > 20
