"""A slice of a stream is landed by several tasks, and still comes as one batch."""

from pyspark.sql import functions as F

from omenflow import catalog


def test_slices_are_landed_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(catalog, "FILE_ROWS", 10)
    # most rows in the last slice: the first ones have fewer rows than files
    rows = spark.range(0, 200).select(F.when(F.col("id") < 3, F.col("id") * 100).otherwise(F.col("id") + 300).alias("n"))
    root, files = catalog._landed(spark, rows, 4, "n")
    assert files == 5
    land = spark.read.schema(rows.schema).parquet(f"{root}/land")
    assert sorted(r.n for r in land.collect()) == sorted(r.n for r in rows.collect())
    sizes = land.groupBy(F.input_file_name()).count().collect()
    assert len(land.inputFiles()) == 20 and max(r["count"] for r in sizes) < 100
    seen = []
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/land")
    write = lambda batch, i: seen.append(sorted(r.n for r in batch.collect()))
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start().awaitTermination()
    low, step = 0, 499 / 4
    assert seen == [sorted(r.n for r in rows.collect() if min(3, int((r.n - low) // step)) == i) for i in range(4)]
