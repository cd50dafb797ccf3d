"""Costly columns are made once: no filter moved down repeats them."""

import json

from pyspark.sql import functions as F

from omenflow.functions.text import squash
from omenflow.operators import gate, responses, stories

GOOD = {
    "question_text": "Will the committee cut rates in June?", "category": "finance", "question_type": "binary", "options": ["Yes", "No"],
    "deadline": "2026-06-30", "deadline_source": "Official calendar", "resolution_source": "Official statement",
    "resolution_criteria": "Resolves YES if the statement says so.", "rationale": "Rates matter to many.", "resolution_confidence": 1,
    "resolution_confidence_reason": "Official text", "source_independence": 0.5, "timing_reliability": 0.25, "already_resolved": False,
}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_question_rows_read_each_response_once(spark):
    changes = [
        {}, {"category": "none"}, {"options": ["Yes"]}, {"options": ["Yes", ""]}, {"options": [1, 2]}, {"options": []}, {"deadline": "soon"},
        {"resolution_confidence": 1.5}, {"resolution_confidence": "1"}, {"already_resolved": "no"}, {"rationale": None}, {"extra": 1},
        {"question_text": "x" * 501}, {"question_text": 5}, {"timing_reliability": 0}, {"timing_reliability": 1e-3}, {"options": None},
    ]
    rows = [(i, json.dumps({"questions": [GOOD, GOOD | c]})) for i, c in enumerate(changes)]
    rows.append((len(rows), json.dumps({"questions": [{k: v for k, v in GOOD.items() if k != "deadline"}]})))
    df = spark.createDataFrame(rows, "question_id long, response string")
    checked = responses.question_contract(df)
    error = [r.error for r in checked.orderBy("question_id").collect()]
    assert error == [
        None, "not allowed: category", "too few: options", "item length: options", "type: options", "too few: options", "too short: deadline",
        "out of range: resolution_confidence", "type: resolution_confidence", "type: already_resolved", "type: rationale", "extra keys: extra",
        "too long: question_text", "type: question_text", None, None, "type: options", "missing: deadline",
    ]
    out = responses.question_rows(checked)
    assert plan(out).count("regexp_replace") <= 5  # the fence is taken off once
    assert sorted((r.question_id, r.item, r.timing_reliability) for r in out.collect()) == [
        (0, 0, 0.25), (0, 1, 0.25), (14, 0, 0.25), (14, 1, 0.0), (15, 0, 0.25), (15, 1, 0.001)]


def test_fingerprint_tokens_are_made_once(spark):
    df = spark.createDataFrame([(1, "rates rates committee"), (2, "the of 12"), (3, None), (4, "")], "k long, text string")
    out = stories.token_fingerprint(df, "k", F.col("text"))
    assert [(r.k, r.tokens) for r in out.collect()] == [(1, ["committee", "rates"])]
    assert plan(out).count("[^a-z0-9]+") == 1


def test_gate_collapses_each_text_once(spark):
    rows = [(q, c) for q in ("Will a  MINOR student die?", None, " ", "Is a 17-year-old  to pass away") for c in ("How many\tdeaths. ", None, "", "x ΑΣ")]
    df = spark.createDataFrame(rows, "question_text string, resolution_criteria string").select(
        "*", F.monotonically_increasing_id().alias("question_id"), *[F.lit("a").alias(c) for c in ("question_type", "deadline", "resolution_source", "category", "resolution_confidence_reason")],
        F.array(F.lit("Yes")).alias("options"), F.lit(False).alias("already_resolved"), *[F.lit(0.5).alias(c) for c in ("resolution_confidence", "source_independence", "timing_reliability")],
    )
    out = gate._normalised(df)
    assert out.where(~F.col("hay").eqNullSafe(squash(F.col("full")))).count() == 0
    assert plan(out.select("hay")).count("regexp_replace") == 2 and plan(out.select("low", "crit", "hay")).count("regexp_replace") == 2


def test_salvageable_strips_each_flag_once(spark):
    rows = [(["ambiguous_wording "],), ([" prohibited_topic:x"],), ([],), (None,), ([None],), (["low_timing_reliability:0.10", "weak_resolution_source"],)]
    out = spark.createDataFrame(rows, "flags array<string>").select(gate.is_salvageable("flags").alias("ok"))
    assert [r.ok for r in out.collect()] == [True, False, False, None, False, True]
    assert plan(out).count("regexp_replace") == 1
