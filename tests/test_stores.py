"""Tables that grow by batches: replays, broken rows, snapshots, filters, and a stream with late rows."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from omenflow.sources import sinks
from omenflow.sources.store import HashStore, Sink
from omenflow.streaming import incremental


def hashes(spark, names):
    return spark.createDataFrame([(hashlib.sha256(str(n).encode()).hexdigest(),) for n in names], "content_hash string")


def test_hash_store_finds_what_was_stored_and_forgets_nothing_when_compacted(spark, tmp_path):
    store = HashStore(spark, str(tmp_path / "s"))
    asked = hashes(spark, range(150, 320))
    assert store.stored(asked, 0).count() == 0
    store.add(hashes(spark, range(100)), 0)
    store.add(hashes(spark, range(100, 200)), 1)
    assert store.stored(asked, 2).count() == 50 and store.stored(asked, 1).count() == 0
    maybe = store.maybe(hashes(spark, range(1000, 3000)), 2).count()
    assert maybe < 20  # filters rule nearly all new hashes out
    store.add(hashes(spark, range(200, 300)), 2)
    store.compact()  # batches 0 and 1; the last may still come again
    assert store.markers.state() == (0, 1, [2])
    assert store.stored(asked, 2).count() == 50 and store.stored(asked, 3).count() == 150
    store.add(hashes(spark, range(200, 210)), 2)  # batch 2 once more, and smaller
    store.add(hashes(spark, range(400, 410)), 3)
    store.compact()
    assert store.markers.state() == (1, 2, [3])
    assert store.stored(asked, 3).count() == 60


def test_unique_stream_reads_only_partitions_that_may_hold_a_hash(spark, tmp_path):
    store = HashStore(spark, str(tmp_path / "s"))
    store.add(hashes(spark, range(2000)), 0)
    one = hashes(spark, [7])
    plan = store.stored(one, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(prefix" in plan or "PartitionFilters: [prefix" in plan
    assert store.stored(one, 1).count() == 1


def test_stage_sink_is_typed_keyed_and_safe_to_replay(spark, tmp_path):
    sink = sinks.stage_sink(spark, str(tmp_path / "v"), "validation")
    rows = lambda *ids: spark.createDataFrame([(i, True, ["a"], 0.5, "more") for i in ids], "question_id int, is_valid boolean, flags array<string>, clarity_score double, other string")
    assert sink.read().count() == 0
    sink.write(rows(1, 2), 0)
    sink.write(rows(2, 3), 1)
    sink.write(rows(2, 3, 4), 1)  # the same batch again: it replaces itself
    assert sorted(r.question_id for r in sink.read().collect()) == [1, 2, 3, 4]
    assert sink.read().dtypes[0] == ("question_id", "bigint") and "other" not in sink.read().columns
    for broken, said in ((rows(7, 7), "twice"), (rows(8, None), "no key"), (rows(9).drop("flags"), "missing: flags")):
        with pytest.raises(ValueError, match=said):
            sink.write(broken, 2)
    assert sink.read().count() == 4
    sink.write(rows(5), 2)
    assert sink.read().count() == 5


def test_sink_key_of_several_columns(spark, tmp_path):
    sink = Sink(spark, str(tmp_path / "k"), "a int, b int, v string", ["a", "b"])
    sink.write(spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "a int, b int, v string"), 0)
    sink.write(spark.createDataFrame([(1, 2, "z"), (2, 2, "w")], "a int, b int, v string"), 1)
    assert sorted(tuple(r) for r in sink.read().collect()) == [(1, 1, "x"), (1, 2, "y"), (2, 2, "w")]


def test_logs_fold_the_tail_behind_a_snapshot(spark, tmp_path):
    log = sinks.review_log(spark, str(tmp_path / "r"))
    at = lambda h: dt.datetime(2026, 1, 1, h)
    schema = "question_id long, status string, reason string, notes string, changed_at timestamp_ntz"
    for i, entry in enumerate([(1, "selected", "", "", at(1)), (2, "removed", "", "", at(1)), (1, "active", "", "", at(2)), (2, "selected", "", "", at(0))]):
        log.append(spark.createDataFrame([entry], schema), i)
    before = sorted(tuple(r)[:2] for r in log.entries().collect())
    log.compact()
    assert log.tail().count() == 1 and sorted(tuple(r)[:2] for r in log.entries().collect()) == before == [(1, "active"), (2, "removed")]

    runs = sinks.stage_log(spark, str(tmp_path / "s"))
    row = lambda status, h, seq: (1, 1, "FR1", status, {"n": str(seq)}, "", at(h), seq)
    schema = "run_id long, stage_number int, stage_name string, status string, summary map<string,string>, error_message string, at timestamp_ntz, seq long"
    for i, entry in enumerate([row("pending", 0, 0), row(" Running", 1, 1), row("running", 2, 2), row("completed", 3, 3)]):
        runs.append(spark.createDataFrame([entry], schema), i)
        runs.compact()
    from omenflow.plans.runlog import fold_stages

    state = fold_stages(runs.entries()).collect()
    assert [(r.status, r.started_at, r.finished_at) for r in state] == [("completed", at(1), at(3))]
    assert runs.entries().count() == 2


def test_velocity_stream_counts_late_rows_within_the_delay(spark, tmp_path):
    at = lambda m: dt.datetime(2026, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    schema = "timestamp timestamp, source string, user_id long"
    slices = [[(at(1), "bbc", 1), (at(2), "bbc", 1), (at(14), "bbc", 2)], [(at(8), "bbc", 3), (at(12), "bbc", None)], [(at(40), "bbc", 5)], [(at(3), "bbc", 9)], [(at(900), "end", 0)]]
    for rows in slices:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "land"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "land"))
        incremental.velocity_stream(stream, str(tmp_path / "t"), str(tmp_path / "c"), "10 minutes", "10 minutes").awaitTermination()
    got = sorted((r.window_start.minute, r.mentions, r.users) for r in spark.read.parquet(str(tmp_path / "t")).collect())
    # minute 8 came within the delay, minute 3 after its window was closed
    assert got == [(0, 3, 2), (10, 2, 1), (40, 1, 1)]
