"""Worked cases of the scalar functions and rule packs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from omenflow.functions import dates, numeric, text, urls
from omenflow.operators import admission, gate, scoring

TODAY = "2026-06-01"


def one(spark, value, expr, ddl="x string"):
    return spark.createDataFrame([(value,)], ddl).select(expr.alias("r")).first().r


def test_plain_text(spark):
    assert one(spark, "  Hello,   WORLD!!  Fed-rate?\nCut.  ", text.plain("x")) == "hello world fedrate cut"


def test_hash_ignores_outer_space_and_case(spark):
    a, b = (one(spark, v, text.content_hash("x")) for v in ("  Fed Cuts Rates\n", "fed cuts rates"))
    assert a == b and len(a) == 64


def test_story_tokens_keep_order_and_alias(spark):
    assert one(spark, "Cease-fire talks: 2026 nominee in May, the TALKS", text.story_tokens("x")) == ["ceasefire", "talks", "nominate", "talks"]


@pytest.mark.parametrize("value", ["2026-12-31", "2026/12/31", "December 31, 2026", "Dec 31, 2026", "31 December 2026", "31 Dec 2026", " december  31, 2026 "])
def test_deadline_formats(spark, value):
    assert one(spark, value, dates.parse_deadline("x")) == dt.date(2026, 12, 31)


@pytest.mark.parametrize("value", ["soon", "", None, "2026-13-01", "Q3 2026", "31 Foo 2026"])
def test_unreadable_deadlines(spark, value):
    assert one(spark, value, dates.parse_deadline("x")) is None


def test_deadline_repair(spark):
    df = spark.createDataFrame(
        [("by 2026-07-04", ["2027-01-01"]), ("2020-01-01", ["Q3 2026", "2026-09-01", "August 1, 2026"]), ("soon", ["2019-01-01"])],
        "d string, c array<string>",
    )
    got = [r.r for r in df.select(dates.repair_deadline("d", "c", TODAY).alias("r")).collect()]
    assert got == ["July 4, 2026", "August 1, 2026", "soon"]


def test_novelty_buckets(spark):
    df = spark.createDataFrame([(v,) for v in (0.95, 0.9, 0.75, 0.4, 0.39)], "x double")
    assert [r.r for r in df.select(numeric.novelty_bucket("x").alias("r")).collect()] == [0.0, 0.0, 0.25, 0.5, 1.0]


def test_min_equals_max(spark):
    assert one(spark, 3.0, numeric.min_max("x", F.lit(3.0), F.lit(3.0)), "x double") == 1.0


@pytest.mark.parametrize("digits", [1, 2, 3])
def test_fixed_text_rounds_like_python(spark, digits):
    values = [i / 1000 for i in range(0, 1200, 5)] + [0.125, 2.675, 1e-9, 12.345, 999.9995, -0.04, -7.25, 70.5]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r.r for r in df.select(numeric.fixed_text("x", digits).alias("r")).collect()]
    assert got == [f"{v:.{digits}f}" for v in values]


def test_urls(spark):
    src = "See (https://www.sec.gov/edgar/browse/). More"
    assert one(spark, src, urls.first_url("x")) == "https://www.sec.gov/edgar/browse/"
    assert one(spark, src, urls.source_label("x")) == "sec.gov"
    assert one(spark, "https://example.com/index.html", urls.is_homepage("x"))
    assert one(spark, src, urls.resolution_strength("x")) == 1.0
    assert one(spark, "no link", urls.resolution_strength("x")) == 0.2


def test_json_lists(spark):
    assert one(spark, '["a","b"]', text.json_list("x")) == ["a", "b"]
    assert one(spark, "oops", text.json_list("x")) == []
    assert one(spark, "oops", text.json_list("x", keep_bad=True)) == ["oops"]


QUESTION = {
    "question_id": 1, "question_text": "Will the FOMC cut rates at its July 2026 meeting?", "category": "finance", "question_type": "binary",
    "options": ["Yes", "No"], "deadline": "July 30, 2026", "deadline_source": "FOMC calendar at https://www.federalreserve.gov",
    "resolution_source": "Federal Reserve statement at https://www.federalreserve.gov/monetarypolicy",
    "resolution_criteria": "Resolves YES if the target range is lowered. Resolves NO otherwise.", "rationale": "Scheduled meeting with a public result.",
    "resolution_confidence": 0.9, "resolution_confidence_reason": "clear", "source_independence": 0.9, "timing_reliability": 0.9,
    "already_resolved": False, "event_type": "macro_release", "candidate_deadlines": ["2026-07-30"],
}
DDL = (
    "question_id long, question_text string, category string, question_type string, options array<string>, deadline string, deadline_source string, "
    "resolution_source string, resolution_criteria string, rationale string, resolution_confidence double, resolution_confidence_reason string, "
    "source_independence double, timing_reliability double, already_resolved boolean, event_type string, candidate_deadlines array<string>"
)


def questions(spark, *changes):
    return spark.createDataFrame([tuple((QUESTION | {"question_id": i + 1} | c).values()) for i, c in enumerate(changes)], DDL)


def flags_of(spark, **change):
    return gate.gate(questions(spark, change), TODAY).first()


def test_valid_question(spark):
    row = flags_of(spark)
    assert row.is_valid and row.flags == [] and row.clarity_score == 1.0


@pytest.mark.parametrize("change,flag", [
    ({"question_text": "Will there be a car bomb in the capital?"}, "prohibited_topic:terrorism_content (car bomb)"),
    ({"question_text": "Will the senator be assassinated this year?"}, "prohibited_topic:death_market"),
    ({"question_text": "Will the gang kidnap and torture a hostage?"}, "prohibited_topic:violence_content (torture, kidnap, hostage)"),
    ({"question_text": "Will the firm face insider trading claims?"}, "manipulation_risk"),
    ({"question_text": "Will a 16-year-old win the final?"}, "minor_involvement"),
    ({"question_text": "Will 555-123-4567 be called?"}, "pii_exposure"),
    ({"question_text": "Will there be a significant change?"}, "ambiguous_wording"),
    ({"resolution_source": "news reports"}, "weak_resolution_source"),
    ({"resolution_criteria": "Too short"}, "weak_resolution_criteria"),
    ({"deadline": "2026-05-31"}, "invalid_deadline_window"),
    ({"deadline": "2040-01-01"}, "excessive_deadline"),
    ({"question_text": "The FOMC will cut rates."}, "unclear_binary_condition"),
    ({"already_resolved": True}, "already_resolved"),
    ({"resolution_confidence": 0.5}, "low_resolution_confidence:0.50 (clear)"),
    ({"source_independence": 0.125}, "low_source_independence:0.12"),
    ({"timing_reliability": 0.3}, "low_timing_reliability:0.30"),
])
def test_gate_flags(spark, change, flag):
    row = flags_of(spark, **change)
    assert flag in row.flags and not row.is_valid


def test_state_action_is_no_death_market(spark):
    assert not any(f.startswith("prohibited") for f in flags_of(spark, question_text="Will airstrikes mean many soldiers die?").flags)


def test_childrens_hospital_is_no_minor(spark):
    assert flags_of(spark, question_text="Will the children's hospital open? Are children's wards open?").flags == []


def test_salvageable(spark):
    df = spark.createDataFrame([(["ambiguous_wording", "low_source_independence:0.20"],), (["pii_exposure"],), ([],), (["other"],)], "f array<string>")
    assert [r.r for r in df.select(gate.is_salvageable("f").alias("r")).collect()] == [True, False, False, False]


@pytest.mark.parametrize("change,head", [
    ({}, None),
    ({"resolution_confidence": 0.2}, "resolution_confidence too low (0.20): clear"),
    ({"question_text": "No mark"}, "question_text does not end with '?': No mark"),
    ({"options": ["Yes"]}, "Binary question must have exactly 2 options, got 1"),
    ({"options": ["Yes", " "]}, "Option 1 is empty or not a string"),
    ({"question_type": "multiple_choice"}, "Multiple-choice question must have 3–5 options, got 2"),
    ({"deadline": "TBD", "candidate_deadlines": []}, "Deadline is missing or vague: 'TBD'"),
    ({"deadline_source": "short"}, "Deadline source is missing or too vague: 'short'"),
    ({"category": "sports", "question_text": "Will they win the next game?"}, "sportsbook-style question"),
])
def test_admission(spark, change, head):
    assert admission.admit(questions(spark, change), TODAY).first().error == head


def test_admission_cleans(spark):
    row = admission.admitted(questions(spark, {"options": ["negative", "TRUE"], "category": " ", "event_type": "election", "deadline": "2020-01-01"}), TODAY).first()
    assert (row.options, row.category, row.deadline) == (["Yes", "No"], "politics", "July 30, 2026")


def test_score_is_the_weighted_sum(spark):
    rows = spark.createDataFrame(
        [(1, "Will the quantum lab publish its chip design?", "technology", "2026-06-20", "Lab page at https://lab.example.org/chip", 0.8, 0.5, 1.0, 2.0, 1.0, 0.8, []),
         (2, "Will Reuters run an article on tea?", "other", "2026-06-20", "x", 0.8, 0.5, 1.0, 9.0, 9.0, 1.0, []),
         (3, "Will the harbour bridge reopen to cars?", "other", "2026-05-01", "x", 0.8, 0.5, 1.0, 9.0, 9.0, 1.0, []),
         (4, "Will the quantum lab publish its chip designs?", "technology", "2026-06-20", "Lab page at https://lab.example.org/chip", 0.8, 0.5, 1.0, 4.0, 3.0, 0.0, ["minor_involvement"])],
        "question_id long, question_text string, category string, deadline string, resolution_source string, resolution_confidence double, "
        "source_independence double, timing_reliability double, mention_velocity double, source_diversity double, clarity_score double, validation_flags array<string>",
    )
    got = {r.question_id: r for r in scoring.score(rows, rows.select("question_id", "question_text"), TODAY).collect()}
    assert set(got) == {1, 4}  # the media row and the expired row are out
    strength = 0.5 * 0.6 + 0.5 * 0.4
    horizon = 0.7 * 1.0 + 0.3 * 1.0
    assert got[1].total_score == pytest.approx(0.25 * 0.1 + 0.25 * strength + 0.2 * 0.8 + 0.0 + 0.1 * 1.0 + 0.05 * horizon + 0.0)
    assert got[4].novelty_score == 0.25 and got[4].near_duplicate_theme and got[4].clarity_score == 1.0
    assert got[4].penalty_total == pytest.approx(0.10 + 0.15)
    assert sorted(r.rank for r in got.values()) == [1, 2]
    assert scoring.top_rows(scoring.score(rows, rows, TODAY), 0).count() == 1
