"""The text sink: many files a task, all of a job or none; readers see nothing in between."""

import os

import pytest
from pyspark.sql import functions as F

from runlens.sources.texts import Attempt, TextFiles, TextFilesWriter
from runlens.sources.workspace import load_workspace, write_workspace


def lines(spark, files, n=3, parts=4):
    rows = spark.range(files * n).select(
        F.concat(F.expr(f"id div {n}").cast("string"), F.lit(".md")).alias("file_name"), F.concat(F.lit("línea "), F.col("id")).alias("value"), "id")
    return rows.repartition(parts, "file_name").sortWithinPartitions("file_name", "id").drop("id")


def found(path):
    return {name: open(f"{folder}/{name}").read() for folder, _, names in os.walk(path) for name in names if not name.startswith(".")}


def test_many_files_for_each_task(spark, tmp_path):
    spark.dataSource.register(TextFiles)
    lines(spark, 50).write.format("text_files").mode("append").save(f"{tmp_path}/out")
    assert found(f"{tmp_path}/out") == {f"{i}.md": "".join(f"línea {j}\n" for j in range(3 * i, 3 * i + 3)) for i in range(50)}
    assert len([d for d in os.listdir(f"{tmp_path}/out") if d.startswith("part-")]) == 4
    assert not os.listdir(f"{tmp_path}/out/_staging")
    lines(spark, 2).write.format("text_files").mode("overwrite").save(f"{tmp_path}/out")
    assert len(found(f"{tmp_path}/out")) == 2
    lines(spark, 1).limit(0).write.format("text_files").mode("append").save(f"{tmp_path}/out")
    assert len(found(f"{tmp_path}/out")) == 2


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(TextFiles)
    bad = F.when(F.col("value") == "línea 100", F.raise_error(F.lit("bad row"))).otherwise(F.col("value")).cast("string")
    with pytest.raises(Exception, match="bad row"):
        lines(spark, 50).withColumn("value", bad).write.format("text_files").mode("append").save(f"{tmp_path}/out")
    assert found(f"{tmp_path}/out") == {}


def test_attempts_that_are_not_committed_are_not_seen(tmp_path):
    from pyspark.sql import Row

    row = Row("file_name", "value")
    writer = TextFilesWriter(str(tmp_path / "out"), overwrite=False)
    first, second = (writer.write(iter([row("a.md", text), row("b/c.md", "x")])) for text in ("lost", "kept"))
    assert writer.write(iter([])) == Attempt(None)
    other = TextFilesWriter(str(tmp_path / "out"), overwrite=False)
    other.write(iter([row("z.md", "of another job")]))
    writer.commit([second, None, Attempt(None)])
    parts = [d for d in os.listdir(tmp_path / "out") if d.startswith("part-")]
    assert len(parts) == 1 and found(tmp_path / "out" / parts[0]) == {"a.md": "kept\n", "b_c.md": "x\n"}
    assert first != second and os.listdir(tmp_path / "out" / "_staging") == [other.job]
    other.abort([])
    assert os.listdir(tmp_path / "out" / "_staging") == []


def test_files_are_read_back_by_the_tasks(spark, tmp_path):
    """Names and texts as written, bytes as they are; hidden names, other suffixes and empty files are passed over."""
    spark.dataSource.register(TextFiles)
    lines(spark, 50).write.format("text_files").mode("append").save(f"{tmp_path}/out")
    want = {name: text.encode() for name, text in found(f"{tmp_path}/out").items()}
    (tmp_path / "out" / "p 1%2F" / "adr").mkdir(parents=True)
    for name, data in (("p 1%2F/adr/001-é.md", b"a\xff\nb"), ("p 1%2F/x.txt", b"no"), ("p 1%2F/none.md", b""), ("_h.md", b"no"), ("p 1%2F/.h.md", b"no")):
        (tmp_path / "out" / name).write_bytes(data)
    files = spark.read.format("text_files").option("suffix", ".md").option("tasks", "3").load(f"{tmp_path}/out")
    assert files.rdd.getNumPartitions() == 3
    got = {r.file_name.rsplit("/", 1)[1]: bytes(r.content) for r in files.collect()}
    assert got == {"001-é.md": b"a\xff\nb", **want}


def test_the_driver_holds_no_list_of_workspace_files(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("product"), F.lit("adr/001-a.md").alias("file_name"), F.concat(F.lit("t"), "id").alias("text"))
    write_workspace(rows, f"{tmp_path}/work")
    read = load_workspace(spark, f"{tmp_path}/work")
    assert read.inputFiles() == []
    assert {(r.product, r.file_name, r.decision_no, r.text) for r in read.collect()} == {(str(i), "adr/001-a.md", 1, f"t{i}\n") for i in range(40)}
