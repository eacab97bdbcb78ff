"""The run tables as files: fixed schemas, append-only transcript."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "sessions": "id long, tg_user_id long, slug string, version string, current_step string, status string, "
    "created_at timestamp, updated_at timestamp, current_question string, last_verdict string, "
    "clarify_count int, clarify_budget int, current_options string, consumed string, refunded boolean",
    "artifacts": "id long, session_id long, step_id string, markdown string, updated_at timestamp",
    "messages": "id long, session_id long, role string, text string, created_at timestamp",
    "adrs": "id long, session_id long, n int, title string, markdown string, created_at timestamp",
    "billing": "tg_user_id long, free_used int, paid_credits int, updated_at timestamp",
    "payments": "charge_id string, tg_user_id long, stars int, created_at timestamp",
}


def load_tables(spark: SparkSession, folder: str, file_format: str = "parquet") -> dict[str, DataFrame]:
    """The six tables under ``folder`` with their fixed schema; nothing is inferred."""
    return {
        name: spark.read.schema(schema).format(file_format).load(f"{folder.rstrip('/')}/{name}")
        for name, schema in SCHEMAS.items()
    }


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """The six tables below ``folder`` in their fixed schemas; columns that a table lacks are null."""
    for name, schema in SCHEMAS.items():
        have = set(tables[name].columns)
        fields = [field.strip().split() for field in schema.split(",")]
        columns = [(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in fields]
        tables[name].select(*columns).write.parquet(f"{folder.rstrip('/')}/{name}")


def append_messages(messages: DataFrame, path: str) -> None:
    """Add rows to the transcript log; written rows are never touched."""
    messages.write.mode("append").parquet(path)
