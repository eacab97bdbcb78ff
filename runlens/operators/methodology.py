"""Rules on the markdown artifacts of a product: contracts, research questions, decisions, backlogs.

Everything one file can answer is answered in its row, with array functions and without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Headings and labels of the artifact templates.
MARKER = r"\[(?:NEEDS CLARIFICATION|НУЖНО УТОЧНИТЬ):\s*([^\]]*)\]"
BLOCKS = "ABCDE"
NOT_DONE_ITEMS = 5
EPIC_TITLE = "^(Реализовать модуль|Сделать |Запилить |Интегрировать )"
HOURS = {"S": (0, 1), "M": (1, 2), "L": (2, 3)}
PRIORITIES = {"🔴": 1, "🟡": 2, "🟢": 3}
MAX_QUESTIONS = 15
GATES = {"faq": 10, "decisions_low": 3, "decisions_high": 5, "context_lines": 100, "drifts": 3}


def label(text: Column, name: str) -> Column:
    """The value of a ``**name:** value`` line; '' if absent."""
    return F.trim(F.regexp_extract(text, rf"(?dm)^\*\*{name}:\*\*[ \t]*([^\n]*)$", 1))


def sections(text: Column) -> Column:
    """A document cut before each second-level heading."""
    return F.split(text, r"(?dm)(?=^## )")


def markers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MARKER), 1)


def clarification_markers(documents: DataFrame) -> DataFrame:
    """Every open question of a contract with the letter of its block ('' outside the blocks)."""
    parts = documents.select("doc_id", F.posexplode(sections(F.col("draft"))).alias("section_no", "section"))
    found = parts.select(
        "doc_id",
        "section_no",
        F.regexp_extract("section", r"^## Блок ([A-E])\.", 1).alias("block"),
        F.posexplode(markers(F.col("section"))).alias("marker_no", "question"),
    )
    return found.select("doc_id", "section_no", "marker_no", "block", "question")


def contract_lint(documents: DataFrame) -> DataFrame:
    """Missing blocks, items of the block of limits, and open questions, per contract."""
    text = F.col("draft")
    missing = [F.when(~text.rlike(rf"(?dm)^## Блок {b}\."), F.lit(b)) for b in BLOCKS]
    limits = F.filter(sections(text), lambda s: F.startswith(s, F.lit("## Блок D.")))
    items = F.aggregate(
        limits, F.lit(0), lambda n, s: n + F.regexp_count(s, F.lit(r"(?dm)^[ \t]*[-*][ \t]+[^\n]"))
    )
    return documents.select(
        "doc_id",
        F.concat_ws("", *missing).alias("missing_blocks"),
        items.cast("bigint").alias("limit_items"),
        (items >= NOT_DONE_ITEMS).alias("enough_limits"),
        F.size(markers(text)).cast("bigint").alias("open_questions"),
    )


def unresolved_markers(documents: DataFrame) -> DataFrame:
    """Open questions of the draft: still in the final contract, or resolved."""
    found = documents.select(
        "doc_id", F.array_distinct(markers(F.col("draft"))).alias("draft"), markers(F.col("final")).alias("final")
    )
    kept, gone = F.array_intersect("draft", "final"), F.array_except("draft", "final")
    state = lambda name, found: F.transform(found, lambda q: F.struct(q.alias("question"), F.lit(name).alias("state")))
    both = F.concat(state("unresolved", kept), state("resolved", gone))
    return found.select("doc_id", F.explode(both).alias("m")).select("doc_id", "m.question", "m.state")


def research_questions(text: Column) -> Column:
    """The research questions of a brief, most urgent first, as an array of structs."""
    blocks = F.filter(F.split(text, r"(?dm)(?=^### RQ-)"), lambda b: F.startswith(b, F.lit("### RQ-")))

    def parsed(block: Column) -> Column:
        priority = label(block, "Приоритет")
        rank = F.coalesce(*[F.when(F.startswith(priority, F.lit(sign)), r) for sign, r in PRIORITIES.items()], F.lit(9))
        method = F.regexp_extract(block, r"(?ds)\*\*Способ проверки:\*\*[ \t]*(.*?)(?:\n\*\*|\n#|\z)", 1)
        return F.struct(
            rank.alias("rank"),
            F.regexp_extract(block, r"^### (RQ-\d+)", 1).alias("rq"),
            F.trim(F.regexp_extract(block, r"^### RQ-\d+:([^\n]*)", 1)).alias("title"),
            (F.regexp_replace(method, r"(?U)\s+", "") != "").alias("has_method"),
        )

    return F.array_sort(F.transform(blocks, parsed))


def rq_priority(briefs: DataFrame) -> DataFrame:
    """Research questions in order of priority."""
    placed = briefs.select("doc_id", F.posexplode(research_questions(F.col("text"))).alias("place", "q"))
    return placed.select("doc_id", "place", "q.rank", "q.rq", "q.title", "q.has_method")


def rq_flags(briefs: DataFrame) -> DataFrame:
    """Briefs with questions nobody can check, without a critical one, or with too many."""
    q = F.col("q")
    return briefs.select("doc_id", research_questions(F.col("text")).alias("q")).select(
        "doc_id",
        F.size(q).cast("bigint").alias("questions"),
        F.size(F.filter(q, lambda x: ~x["has_method"])).cast("bigint").alias("without_method"),
        (~F.exists(q, lambda x: x["rank"] == 1)).alias("none_critical"),
        (F.size(q) > MAX_QUESTIONS).alias("too_many"),
    )


def task_items(text: Column) -> Column:
    """The task blocks of a backlog, in order, as an array."""
    heading = r"^#{3,4} (T-\d{3}):"
    blocks = F.filter(F.split(text, r"(?dm)(?=^#{2,4} )"), lambda b: b.rlike(heading))
    ids = lambda line: F.regexp_extract_all(line, F.lit(r"(T-\d{3})"), 1)

    def item(block: Column) -> Column:
        done = F.regexp_extract(block, r"(?ds)\*\*Definition of Done:\*\*(.*?)(?:\n\*\*|\z)", 1)
        return F.struct(
            F.regexp_extract(block, heading, 1).alias("task"),
            F.trim(F.regexp_extract(block, r"^#{3,4} T-\d{3}:([^\n]*)", 1)).alias("title"),
            label(block, "Эпик").alias("epic"),
            F.regexp_extract(label(block, "Размер"), r"^([A-Z]+)", 1).alias("size"),
            ids(label(block, "Зависимости")).alias("needs"),
            ids(label(block, "Можно параллельно с")).alias("beside"),
            F.regexp_count(done, F.lit(r"(?dm)^- \[[ xX]\]")).cast("bigint").alias("done_items"),
            F.regexp_extract_all(label(block, "Связано с ADR"), F.lit(r"(ADR-\d{3})"), 1).alias("decisions"),
        )

    return F.transform(blocks, item)


def backlog_tasks(backlogs: DataFrame) -> DataFrame:
    """One row per task block of a backlog."""
    return backlogs.select("doc_id", F.posexplode(task_items(F.col("text"))).alias("place", "item")).select("doc_id", "place", "item.*")


def backlog_lint(backlogs: DataFrame) -> DataFrame:
    """Tasks that are too large, have no definition of done, look like an epic, or need a task that is not there.

    A backlog is one row, so all its tasks are at hand: no shuffle.
    """
    def problems(x: Column) -> Column:
        problem = lambda bad, name: F.when(bad, F.lit(name))
        found = F.array_compact(F.array(
            problem(~x["size"].isin(*HOURS), "too_large"),
            problem(x["done_items"] == 0, "no_definition_of_done"),
            problem(F.array_contains(x["needs"], x["task"]), "needs_itself"),
            problem(x["title"].rlike(EPIC_TITLE), "looks_like_epic"),
        ))
        return F.transform(found, lambda name: F.struct(x["task"].alias("task"), name.alias("problem")))

    items = backlogs.select("doc_id", task_items(F.col("text")).alias("items"))
    known = F.transform("items", lambda x: x["task"])

    def missing(x: Column) -> Column:
        return F.transform(
            F.array_except(x["needs"], F.col("known")),
            lambda need: F.struct(x["task"].alias("task"), F.concat(F.lit("needs_missing "), need).alias("problem")))

    found = items.withColumn("known", known).select("doc_id", F.explode(F.concat(
        F.flatten(F.transform("items", problems)), F.array_distinct(F.flatten(F.transform("items", missing))))).alias("p"))
    return found.select("doc_id", "p.task", "p.problem")


def backlog_waves(backlogs: DataFrame) -> DataFrame:
    """The wave in which each task can start; null for tasks on or behind a cycle.

    A fold over the backlog's own array: in each round the tasks without an open need are placed and struck from the
    needs of the others. A row needs as many rounds as it has tasks, the last of them on nothing; no shuffle, no job per round.
    """
    items = backlogs.select("doc_id", task_items(F.col("text")).alias("items"))
    known = items.withColumn("known", F.array_distinct(F.transform("items", lambda x: x["task"])))
    # a task that comes twice has the needs of both; needs that are no tasks do not hold anything up
    nodes = F.transform("known", lambda t: F.struct(t.alias("task"), F.array_intersect(
        F.array_distinct(F.flatten(F.transform(F.filter("items", lambda x: x["task"] == t), lambda x: x["needs"]))), F.col("known")).alias("needs")))
    start = F.struct(
        F.filter(nodes, lambda x: F.size(x["needs"]) > 0).alias("waiting"),
        F.transform(F.filter(nodes, lambda x: F.size(x["needs"]) == 0), lambda x: x["task"]).alias("ready"),
        F.expr("cast(array() as array<struct<task: string, wave: int>>)").alias("placed"),
    )

    def round_of(held: Column, wave: Column) -> Column:
        freed = F.transform(held["waiting"], lambda x: F.struct(x["task"].alias("task"), F.array_except(x["needs"], held["ready"]).alias("needs")))
        # the one-element array binds what is freed, so that it is worked out once
        return F.element_at(F.transform(F.array(freed), lambda now: F.struct(
            F.filter(now, lambda x: F.size(x["needs"]) > 0).alias("waiting"),
            F.transform(F.filter(now, lambda x: F.size(x["needs"]) == 0), lambda x: x["task"]).alias("ready"),
            F.concat(held["placed"], F.transform(held["ready"], lambda t: F.struct(t.alias("task"), wave.alias("wave")))).alias("placed"),
        )), 1)

    stuck = lambda x: F.struct(x["task"].alias("task"), F.lit(None).cast("int").alias("wave"))
    ends = F.aggregate(
        F.when(F.size("known") > 0, F.sequence(F.lit(1), F.size("known"))).otherwise(F.array().cast("array<int>")), start, round_of,
        lambda held: F.concat(held["placed"], F.transform(held["waiting"], stuck)))
    return known.select("doc_id", F.explode(ends).alias("w")).select("doc_id", "w.task", "w.wave")


def epic_rollup(tasks: DataFrame) -> DataFrame:
    """Tasks and hours per epic of a backlog, and the total of the backlog."""
    hours = lambda i: F.coalesce(*[F.when(F.col("size") == s, h[i]) for s, h in HOURS.items()])
    epics = tasks.groupBy("doc_id", "epic").agg(
        F.count("*").alias("tasks"),
        F.coalesce(F.sum(hours(0)), F.lit(0)).alias("least_hours"),
        F.coalesce(F.sum(hours(1)), F.lit(0)).alias("most_hours"),
        F.count_if(~F.col("size").isin(*HOURS)).alias("unsized"),
    )
    sums = [F.sum(c).alias(c) for c in ("tasks", "least_hours", "most_hours", "unsized")]
    totals = epics.groupBy("doc_id").agg(*sums).withColumn("epic", F.lit("Итого"))
    return epics.unionByName(totals)


def adr_index(files: DataFrame) -> DataFrame:
    """Header fields and gaps of each decision record: product, file_no, text."""
    text = F.col("text")
    return files.select(
        "product",
        "file_no",
        F.regexp_extract(text, r"^# ADR-(\d{3}):", 1).try_cast("int").alias("number"),
        F.trim(F.regexp_extract(text, r"^# ADR-\d{3}:([^\n]*)", 1)).alias("title"),
        label(text, "Дата").alias("dated"),
        label(text, "Статус").alias("status"),
        label(text, "Уровень").alias("level"),
        label(text, "Связано с").alias("related"),
        (~text.rlike(r"(?dm)^## Альтернативы")).alias("no_alternatives"),
        (~text.rlike(r"(?dm)^## Когда пересмотреть")).alias("no_review"),
    )


def adr_levels(index: DataFrame) -> DataFrame:
    return index.groupBy("product", "level").agg(
        F.count("*").alias("records"),
        F.count_if("no_alternatives").alias("without_alternatives"),
        F.count_if("no_review").alias("without_review"),
    )


def adr_links(index: DataFrame) -> DataFrame:
    """Records that replace or refer to others, and whether the other one exists."""

    def edges(column: str, kind: str) -> DataFrame:
        found = F.regexp_extract_all(F.col(column), F.lit(r"ADR-(\d{3})"), 1)
        return index.select("product", "number", F.lit(kind).alias("kind"), F.explode(found).alias("target")).withColumn(
            "target", F.col("target").cast("int")
        )

    links = edges("status", "replaced_by").unionByName(edges("related", "related"))
    known = index.select("product", F.col("number").alias("target")).distinct().withColumn("known", F.lit(True))
    return links.join(known, ["product", "target"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def drift_split(checks: DataFrame, index: DataFrame) -> DataFrame:
    """Discrepancies of a sync check: with an existing decision 'evolution', without 'drift'."""
    part = F.filter(sections(F.col("text")), lambda s: F.startswith(s, F.lit("## Расхождения")))
    lines = F.regexp_extract_all(F.array_join(part, "\n"), F.lit(r"(?dm)^- ([^\n]*)$"), 1)
    items = checks.select("product", "check_no", F.posexplode(lines).alias("place", "item"))
    items = items.withColumn("number", F.regexp_extract("item", r"ADR-(\d{3})", 1).try_cast("int"))
    known = index.select("product", "number").distinct().withColumn("known", F.lit(True))
    return items.join(known, ["product", "number"], "left").select(
        "product",
        "check_no",
        "place",
        "item",
        F.when(F.col("known"), "evolution").otherwise("drift").alias("kind"),
    )


def stage_gates(files: DataFrame) -> DataFrame:
    """Which exit rules hold per product: product, file_name, text. Only counts are shuffled."""
    name, text = F.col("file_name"), F.col("text")

    def count(which: Column, pattern: str) -> Column:
        return F.sum(F.when(which, F.regexp_count(text, F.lit(pattern))).otherwise(0))

    product_level = text.rlike(r"(?dm)^\*\*Уровень:\*\*[ \t]*Продуктовый")
    counts = files.groupBy("product").agg(
        count(name == "06-faq.md", r"(?dm)^### ").alias("faq"),
        F.count_if(F.startswith(name, F.lit("adr/0")) & product_level).alias("decisions"),
        F.max(F.when(name == "09-CLAUDE.md", F.regexp_count(text, F.lit("\n")) + 1)).cast("bigint").alias("context_lines"),
        count(name == "06-vision-contract-final.md", MARKER).alias("open_markers"),
        F.count_if(name == "06-vision-contract-final.md").alias("finals"),
        count(name == "07-story-sync-check.md", r"(?dm)^- дрейф").alias("drifts"),
    )
    return counts.select(
        "product",
        "faq",
        "decisions",
        "context_lines",
        "open_markers",
        "drifts",
        (F.col("faq") >= GATES["faq"]).alias("faq_ready"),
        F.col("decisions").between(GATES["decisions_low"], GATES["decisions_high"]).alias("decisions_ready"),
        F.coalesce(F.col("context_lines") <= GATES["context_lines"], F.lit(False)).alias("context_ready"),
        ((F.col("open_markers") == 0) & (F.col("finals") > 0)).alias("contract_ready"),
        (F.col("drifts") >= GATES["drifts"]).alias("go_back"),
    )
