"""Product workspaces (trees of markdown files) as a source, assembled documents as a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.registry import routes_table
from runlens.sources.texts import TextFiles


def file_facts(files: DataFrame) -> DataFrame:
    """Step number, decision number and kind of each file, from its name.

    files: product, file_name, text. Names outside the contract are of kind 'other'.
    """
    name = F.col("file_name")
    step = F.regexp_extract(name, r"^(\d{2})-[^/]+\.md$", 1)
    decision = F.regexp_extract(name, r"^adr/(\d{3})-[^/]+\.md$", 1)
    kind = F.when(step != "", "step").when(decision != "", "decision").otherwise("other")
    return files.select(
        "product",
        "file_name",
        kind.alias("kind"),
        step.try_cast("int").alias("step_no"),
        decision.try_cast("int").alias("decision_no"),
        "text",
    )


def load_workspace(spark: SparkSession, root: str) -> DataFrame:
    """One row per markdown file below ``root``, a folder per product."""
    files = markdown_files(spark, root)
    inside = F.regexp_extract("path", r"([^/]+)/((?:adr/)?[^/]+)$", 2)
    product = F.regexp_extract("path", r"([^/]+)/(?:adr/)?[^/]+$", 1)
    return file_facts(files.select(product.alias("product"), inside.alias("file_name"), "text"))


def markdown_files(spark: SparkSession, root: str) -> DataFrame:
    """path, text of each file, listed by the tasks that read them: a table's own listing holds every file in the driver."""
    spark.dataSource.register(TextFiles)
    files = spark.read.format("text_files").option("suffix", ".md").load(root)
    return files.select(F.col("file_name").alias("path"), F.col("content").cast("string").alias("text"))


def write_workspace(files: DataFrame, path: str) -> None:
    """Workspaces as trees of files below ``path``: files: product, file_name, text. Each text gets a line end."""
    files.sparkSession.dataSource.register(TextFiles)
    name = F.concat_ws("/", F.col("product").cast("string"), "file_name")
    files.select(name.alias("file_name"), F.col("text").alias("value")).write.format("text_files").option("folders", "true").mode("append").save(path)


def artifact_route(files: DataFrame, variant: str) -> DataFrame:
    """Where each file goes in the repository, or that it stays: files: product, file_name."""
    routes = routes_table(files.sparkSession).filter(F.col("variant") == variant)
    key = F.when(F.startswith("file_name", F.lit("adr/")), "adr/").otherwise(F.col("file_name"))
    table = routes.select(F.col("file_name").alias("_key"), "destination", F.lit(True).alias("known"))
    return (
        files.withColumn("_key", key)
        .join(F.broadcast(table), "_key", "left")  # one row per file of the contract
        .select(
            "product",
            "file_name",
            F.when(F.col("_key") == "adr/", F.col("file_name")).otherwise(F.col("destination")).alias("destination"),
            F.when(F.col("known").isNull(), "unmapped")
            .when(F.col("destination").isNull(), "stays")
            .otherwise("moves")
            .alias("fate"),
        )
    )


def write_specs(specs: DataFrame, path: str) -> None:
    """The blocks of documents as a table, in the order of the documents."""
    specs.repartitionByRange("tg_user_id", "session_id", "place", "id").sortWithinPartitions(
        "tg_user_id", "session_id", "place", "id"
    ).write.mode("overwrite").parquet(path)


def write_spec_texts(specs: DataFrame, path: str) -> None:
    """Documents as text files, one for each run, named by run and file; a task writes many of them into one folder.

    A run's blocks are sorted and written one after another. The writer ends every value with a line end itself. Files
    come into place when all tasks are done (``texts``).
    """
    specs.sparkSession.dataSource.register(TextFiles)
    run = ["session_id", "file_name"]
    last = F.lead("block").over(Window.partitionBy(*run).orderBy("place", "id")).isNull()
    text = F.when(last, F.regexp_replace("block", r"(?U)(?<!\s)\s++$", "")).otherwise(F.concat("block", F.lit("\n")))
    kept = specs.filter("block is not null").select(*run, "place", "id", text.alias("value")).sortWithinPartitions(*run, "place", "id")
    name = F.concat(F.col("session_id").cast("string"), F.lit("-"), "file_name")
    kept.select(name.alias("file_name"), "value").write.format("text_files").mode("append").save(path)


def read_spec_texts(spark: SparkSession, path: str) -> DataFrame:
    """session_id, file_name, spec: the files that ``write_spec_texts`` has written."""
    name = F.regexp_extract("path", r"/(\d+-[^/]+)$", 1)
    return markdown_files(spark, path).select(
        F.regexp_extract(name, r"^(\d+)", 1).cast("bigint").alias("session_id"), F.regexp_extract(name, r"^\d+-(.*)$", 1).alias("file_name"),
        F.col("text").alias("spec"))


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "tg_user_id long, session_id long, file_name string, place long, id long, block string"
    ).parquet(path)
