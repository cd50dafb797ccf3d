"""Tasks over questions hold a bounded number of rows, however many questions there are."""

from omenflow import bindings as b, catalog


def test_questions_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(b, "TASK_QUESTIONS", 50)
    sf = "/root/testdata/sf0.01"
    plan = catalog.gate_flags(spark, sf)
    assert plan.rdd.getNumPartitions() == 300 and plan.count() == 15_000


def test_events_of_a_task_are_bounded(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    assert catalog.event_retries(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    monkeypatch.setattr(b, "TASK_EVENTS", 50)
    plan = catalog.event_retries(spark, sf)
    assert plan.rdd.getNumPartitions() == 30 and plan.count() == 1_050
