"""Who may enter, and which runs wait for whom."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.text import strip
from runlens.registry import FINISH_MARKER, PIPELINES, labels_table


def parse_id_list(df: DataFrame, column: str) -> DataFrame:
    """Distinct ids of a comma-separated column; chunks that are not plain ASCII digits are dropped."""
    chunks = df.select(F.explode(F.split(column, ",")).alias("chunk")).select(strip(F.col("chunk")).alias("chunk"))
    numbers = chunks.filter(F.col("chunk").rlike("^[0-9]+$"))
    return numbers.select(F.col("chunk").try_cast("bigint").alias("user_id")).filter("user_id is not null").distinct()


def strict_allowlist(users: DataFrame, allowed: DataFrame) -> DataFrame:
    """Members only; an empty list admits nobody."""
    return users.join(allowed.select("user_id"), "user_id", "left_semi")


def access_gate(users: DataFrame, owners: DataFrame, beta: DataFrame) -> DataFrame:
    """Owners always pass; an empty beta list admits everybody, any other list its members."""
    listed = beta.select("user_id").unionByName(owners.select("user_id")).distinct()
    listed = listed.withColumn("listed", F.lit(True))
    everybody = beta.agg(F.count(F.lit(1)) == 0).scalar()  # a subquery of the plan: no job runs while it is built
    return users.join(listed, "user_id", "left").select(
        "user_id", F.coalesce("listed", everybody).alias("admitted")
    )


def known_versions(df: DataFrame, keep: str = "false") -> DataFrame:
    """Rows with a version of the registry, and those the condition ``keep`` spares."""
    return df.filter(F.col("version").isin(*PIPELINES) | F.expr(keep))


def labelled_versions(df: DataFrame) -> DataFrame:
    labels = F.broadcast(labels_table(df.sparkSession))  # one row per version of the registry
    return df.join(labels, "version")


def active_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.filter("status = 'active'")


def open_questions(sessions: DataFrame) -> DataFrame:
    """Active runs by what they wait for; a run past its last step has no question to show."""
    past = F.col("current_step") == FINISH_MARKER
    state = (
        F.when(past, "past_last_step").when(F.col("current_question").isNotNull(), "waiting").otherwise("no_question")
    )
    return active_sessions(sessions).select(
        "id", "tg_user_id", state.alias("state"), F.when(~past, F.col("current_question")).alias("question")
    )


def decoded_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions with the JSON column of answer options as an array."""
    return sessions.withColumn("options", F.from_json("current_options", "array<string>"))
