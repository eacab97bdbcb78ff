"""Small tables that steer the operators. Callers may pass their own instead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FINISH_MARKER = "_finish"
MEANING, BRIDGE, DELIVERY = "Смысл", "Bridge", "Реализация"

# Step ids, zones and titles of the pipelines, in pipeline order.
LITE = [
    ("L1", MEANING, "Идея, Northern Star и метафора"),
    ("L2", MEANING, "Vision Contract"),
    ("L3", BRIDGE, "Короткая архитектура"),
    ("L4", BRIDGE, "Контекст и задачи"),
]
FULL = [
    ("F1", MEANING, "Northern Star"),
    ("F2", MEANING, "Vision Story с метафорой"),
    ("F3", MEANING, "Vision Contract Draft"),
    ("F4", MEANING, "Research Brief"),
    ("F5", MEANING, "Research"),
    ("F6", MEANING, "Финальный контракт + ADR + FAQ"),
    ("F7", MEANING, "Story Sync Check"),
    ("F8", BRIDGE, "Архитектура + Tech-spec + ADR"),
    ("F9", BRIDGE, "CLAUDE.md + документация"),
    ("F10", BRIDGE, "BACKLOG задач"),
    ("F11", DELIVERY, "Итог и передача"),
]
PIPELINES = {"lite": LITE, "full": FULL, "spec_only": FULL[7:]}
VERSION_LABELS = {"full": "Full (11 шагов)", "lite": "Lite", "spec_only": "Spec-only (техчасть)"}

# Vocabularies and limits.
STATUSES = ["active", "finished", "abandoned"]
VERDICTS = ["answer", "partial", "offtopic"]
BUCKETS = ["free", "paid", "none"]
FREE_RUNS = 1
RUN_PRICE = 100
CURRENCY = "XTR"
CLARIFY_BUDGET = 2
MAX_ARTIFACT_BYTES = 20_000
MAX_SESSION_BYTES = 200_000
HISTORY_ROWS = 40
TURN_BUDGET_S = 120.0
TURN_ROUNDS = 6
CALL_ATTEMPTS = 6
MAX_WAIT_S = 30.0

# Tool name -> (argument, required, allowed values) of the tool schema.
TOOLS = {
    "save_artifact": [("step_id", True, None), ("markdown", True, None)],
    "set_version": [("version", True, ["lite", "full", "spec_only"])],
    "set_product_name": [("name", True, None)],
    "ask_question": [("question", True, None), ("preamble", False, None)],
    "assess_answer": [("verdict", True, VERDICTS)],
    "create_adr": [("title", True, None), ("markdown", True, None)],
    "finish": [],
}

# What the tool schema says beyond that: argument -> kind of value. The steps of the run's version are the only step ids.
OPTIONAL = {"ask_question": [("options", "strings")], "assess_answer": [("missing", "string")]}

# Replies that mean "I do not know".
DONT_KNOW = [
    "не знаю", "незнаю", "не в курсе", "хз", "понятия не имею", "затрудняюсь",
    "не могу сказать", "idk", "dunno", "no idea",
]

# Workspace file -> path in the destination repository (None: stays as history).
ROUTES = [
    ("02-vision-story.md", "docs/vision/story.md"),
    ("03-vision-contract-draft.md", None),
    ("04-research-brief.md", None),
    ("05-research-results.md", None),
    ("06-vision-contract-final.md", "docs/vision.md"),
    ("06-faq.md", "docs/faq.md"),
    ("07-story-sync-check.md", None),
    ("08-architecture.md", "docs/architecture.md"),
    ("08-tech-spec.md", "docs/tech-spec.md"),
    ("09-CLAUDE.md", "CLAUDE.md"),
    ("09-README-for-repo.md", "README.md"),
    ("10-BACKLOG.md", "BACKLOG.md"),
    ("adr/", "adr/"),
]
# The two published copies of the table differ on this file only.
ROUTE_VARIANTS = {
    "status": [("01-northern-star.md", None)],
    "docs": [("01-northern-star.md", "docs/vision/northern-star.md")],
}


def steps_table(spark: SparkSession) -> DataFrame:
    """(version, pos, step_id, zone, title), 19 rows."""
    rows = [
        (version, pos, *step) for version, steps in PIPELINES.items() for pos, step in enumerate(steps)
    ]
    return spark.createDataFrame(rows, "version string, pos int, step_id string, zone string, title string")


def routes_table(spark: SparkSession) -> DataFrame:
    """(variant, file_name, destination)."""
    rows = [(v, f, d) for v, own in ROUTE_VARIANTS.items() for f, d in [*own, *ROUTES]]
    return spark.createDataFrame(rows, "variant string, file_name string, destination string")


def labels_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(VERSION_LABELS.items()), "version string, label string")
