"""What a run keeps on disk: slices give the same rows, and what was written on the way goes."""

import time

from pyspark.sql import functions as F

from omenflow import catalog
from omenflow.operators import durable, scoring
from omenflow.streaming import incremental


def files(spark):
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()


def tables(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(durable, "checkpoint_root", lambda s: str(tmp_path))
    return lambda: sorted(p.name for p in tmp_path.glob("omenflow-*"))


def questions(spark, n=60):
    rows = spark.range(n).select(
        F.col("id").alias("question_id"), F.concat(F.lit("Will the red fox number "), F.col("id") % 7, F.lit(" win by "), F.col("id") % 5, F.lit("?")).alias("question_text"),
        F.lit("sports").alias("category"), F.lit("1999-01-01").alias("deadline"), F.lit("BLS at https://www.bls.gov/cpi/x").alias("resolution_source"),
        (F.col("id") % 3 / 2).alias("resolution_confidence"), F.lit(0.5).alias("source_independence"), F.lit(0.5).alias("timing_reliability"),
        (F.col("id") % 11).cast("double").alias("mention_velocity"), (F.col("id") % 4).alias("source_diversity"), F.lit(1.0).alias("clarity_score"),
        F.array().cast("array<string>").alias("validation_flags"),
    )
    return rows, rows.select("question_id", "question_text").where("question_id % 2 = 0")


def test_shuffle_files_go_when_a_table_is_written(spark):
    before = files(spark)
    out = durable.written(spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 9).alias("k")).count())
    for _ in range(50):
        if files(spark) <= before:
            break
        time.sleep(0.2)
    assert files(spark) <= before and out.count() == 9


def test_slices_give_the_same_scores_and_one_table_stays(spark, monkeypatch, tmp_path):
    left = tables(spark, monkeypatch, tmp_path)
    rows, texts = questions(spark)
    whole = sorted(map(repr, scoring.score(rows, texts, "1998-06-01").collect()))
    assert len(whole) == 60 and len(left()) == 1
    monkeypatch.setattr(durable, "SLICE_ROWS", 25)
    again = scoring.score(rows, texts, "1998-06-01")
    assert sorted(map(repr, again.collect())) == whole and len(left()) == 2
    assert sorted(r["rank"] for r in again.select("rank").collect()) == list(range(1, 61))


def test_a_scored_batch_leaves_its_rows_alone(spark, monkeypatch, tmp_path):
    left = tables(spark, monkeypatch, tmp_path)
    monkeypatch.setattr(durable, "SLICE_ROWS", 30)
    monkeypatch.setattr(catalog, "FILE_ROWS", 10)
    rows, texts = questions(spark)
    out = catalog._streamed(spark, durable.written(rows), 1, lambda s, table, ck: incremental.score_stream(s, texts, table, ck, "1998-06-01"))
    assert out.count() == 60 and len(left()) == 1
