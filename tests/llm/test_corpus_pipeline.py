"""The pipeline stage by stage against plain Python."""

from collections import Counter

import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from test_llm_operators import plain_components

import corpus_pipeline
from runlens.llm import mixing, near, quality, templates
from runlens.llm.common import ARROW_BYTES, BATCH_BYTES, settled


def test_stages(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(settled(stage(spark, seen[-1], SMALL), f"test-{name}"))
        assert name == "sharding" or seen[-1].columns == columns
    before, kept, single, clean, mixed, sharded = ([tuple(r) for r in df.collect()] for df in seen)
    verdict = {r.doc_id for r in quality.quality_report(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).where("kept").collect()}
    assert {r[0] for r in kept} == verdict and len(kept) < len(before)
    components = plain_components([(r[0], r[1]) for r in kept], 5, 80)
    assert {r[0] for r in single} == {c for _, c in components.values()}
    bad = {r.doc_id for r in templates.contamination_report(seen[2], spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert {r[0] for r in clean} == {r[0] for r in single} - bad
    times = {r.doc_id: r.times for r in mixing.mixing_report(seen[3]).collect()}
    assert Counter(r[0] for r in mixed) == Counter({k: v for k, v in times.items() if v})
    assert Counter(r[: len(columns)] for r in sharded) == Counter(mixed)


ODD = [(1, None, "en", "a", 0, "x"), (1, "", None, None, 0, "x"), (None, " ".join(f"n{i}" for i in range(60)), "en", "a", None, None), (None, None, None, None, None, None)]


def test_stages_on_odd_rows(spark):
    """Nulls, empty texts, shared ids, repeated rows, names that clash with the stages' own or need quotes; and no rows at all."""
    story = " ".join(f"word{i}" for i in range(80))
    rows = [*ODD, *[(2, story, "en", "b", 9, "x")] * 30, (2, story.replace("word", "other"), "en", "b", 9, "x"), (3, f"{story} end", "de", "b", 9, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string").withColumn("a.b", F.lit(1)).withColumn("_key", F.lit("k"))
    for table in (docs, docs.limit(0)):
        kept = table
        for name, stage in corpus_pipeline.STAGES:
            before = kept
            kept = settled(stage(spark, kept, SMALL), f"odd-{name}")
            if name != "sharding":
                assert kept.columns == docs.columns
            if name == "near_duplicates":
                left = Counter(r.text for r in kept.collect())
                assert max(left.values(), default=1) == 1 and all(any(t in x for x in left) for t in {r.text for r in before.collect()} if t and not t.endswith(" end"))
        assert {"size", "shard", "slot"} <= set(kept.columns) and kept.count() == before.count()


def test_quality_sends_each_text_to_a_worker_once(spark):
    """And counts it in small steps: the sums over a step's bytes take many times as much."""
    rows = quality.quality_kept(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.rindex("MapInArrow") :].splitlines()[1]
    assert below.count("text#") == 1 and quality.STEP_BYTES <= 1 << 20


def _batch_bytes(docs):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["bytes"])

    return [r.bytes for r in docs.coalesce(1).mapInArrow(run, "bytes long").collect()]


@pytest.mark.parametrize("ask", [quality.counted, lambda docs: near.sketches(docs, 5), lambda docs: templates.marked(docs, "doc_id"),
                                 lambda docs: near.with_texts(docs.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")), docs)])
def test_texts_go_to_workers_in_small_batches(spark, ask):
    """Whatever a task holds of them several times over; a longer text still goes whole."""
    docs = spark.newSession().range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1200).alias("text"))
    ask(docs)
    sizes = _batch_bytes(docs)
    assert len(sizes) > 3 and max(sizes) < 1.2 * BATCH_BYTES
    long = docs.limit(2).withColumn("text", F.repeat("text", 1000))
    assert len(_batch_bytes(long)) == 2 and min(_batch_bytes(long)) > BATCH_BYTES


def test_batches_that_the_caller_has_set_stay(spark):
    other = spark.newSession()
    other.conf.set(ARROW_BYTES, str(1 << 20))
    quality.counted(other.read.parquet(f"{SMALL}/documents.parquet"))
    assert other.conf.get(ARROW_BYTES) == str(1 << 20)


def test_decontamination_works_on_small_steps(spark):
    """The windows of a step take many times its text; where it is cut changes nothing."""
    assert templates.STEP_BYTES <= 1 << 20
    story = " ".join(f"plain{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("filler words here "), 400), F.when(F.col("id") % 100 == 7, story).otherwise("")).alias("text"))
    items = spark.createDataFrame([(5, story)], "item_id long, text string")
    assert {r.doc_id for r in templates.contaminated(docs.coalesce(1), items).collect()} == {7, 107, 207, 307}
