"""Admission pack: the first failing check of a drafted question, and the cleaned row."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import terms as t
from ..functions import text as tx
from ..functions.dates import repair_deadline
from ..functions.text import as_col, or_empty, strip
from ..options import DEFAULTS, Options
from .gate import two_decimals


def _unsafe(c, label) -> Column:
    return (
        F.when(tx.has_blocked_term(or_empty(c)), F.concat(F.lit("Blocked content detected in "), F.lit(label)))
        .when(tx.is_garbled(c), F.concat(F.lit("Garbled text detected in "), F.lit(label)))
    )


def _option_error(options) -> Column:
    def check(o, i):
        name = F.concat(F.lit("Option "), i.cast("string"))
        return (
            F.when(strip(or_empty(o)) == "", F.concat(name, F.lit(" is empty or not a string")))
            .when(tx.has_blocked_term(o) | tx.is_garbled(o), F.concat(name, F.lit(" contains blocked or garbled content")))
        )

    return F.try_element_at(F.array_compact(F.transform(as_col(options), check)), F.lit(1))


def admission_error(opts: Options = DEFAULTS) -> Column:
    """Null when the draft passes every check."""
    conf, ind, tim = (
        F.coalesce(c, F.lit(0.0)) for c in ("resolution_confidence", "source_independence", "timing_reliability")
    )
    n, kind = F.size(F.coalesce("options", F.array().cast("array<string>"))), F.col("question_type")
    due, dsrc = or_empty("deadline"), or_empty("deadline_source")
    src, crit, q = or_empty("resolution_source"), or_empty("resolution_criteria"), or_empty("question_text")
    quoted = lambda head, c: F.concat(F.lit(head + ": '"), c, F.lit("'"))
    return F.coalesce(
        F.when(F.col("already_resolved"), "already_resolved: event has already concluded"),
        F.when(
            conf < opts.min_resolution_confidence,
            F.concat(F.lit("resolution_confidence too low ("), two_decimals(conf), F.lit("): "),
                     F.coalesce("resolution_confidence_reason", F.lit("no reason given"))),
        ),
        F.when(
            ind < opts.min_source_independence,
            F.concat(F.lit("source_independence too low ("), two_decimals(ind),
                     F.lit("): resolution source has conflict of interest")),
        ),
        F.when(
            tim < opts.min_timing_reliability,
            F.concat(F.lit("timing_reliability too low ("), two_decimals(tim),
                     F.lit("): resolution may never be published by deadline")),
        ),
        F.when(~strip(q).endswith("?"), F.concat(F.lit("question_text does not end with '?': "), F.substring(q, 1, 60))),
        _unsafe("question_text", "question_text"),
        _unsafe("resolution_criteria", "resolution_criteria"),
        _unsafe("resolution_source", "resolution_source"),
        F.when((kind == "binary") & (n != 2),
               F.concat(F.lit("Binary question must have exactly 2 options, got "), n.cast("string"))),
        F.when((kind == "multiple_choice") & ~n.between(3, 5),
               F.concat(F.lit("Multiple-choice question must have 3–5 options, got "), n.cast("string"))),
        _option_error("options"),
        F.when((due == "") | F.lower(strip(due)).isin(t.VAGUE_DEADLINES), quoted("Deadline is missing or vague", due)),
        F.when(F.length(strip(dsrc)) < 10, quoted("Deadline source is missing or too vague", dsrc)),
        F.when(F.length(strip(src)) < 10, quoted("Resolution source is too vague", src)),
        F.when(F.length(strip(crit)) < 20, quoted("Resolution criteria is too short", crit)),
    )


def binary_options(options, question_type) -> Column:
    """Two-way synonyms, in either order, become Yes / No."""
    o = F.transform(as_col(options), lambda x: F.lower(strip(x)))
    a, b = F.try_element_at(o, F.lit(1)), F.try_element_at(o, F.lit(2))
    mixed = (a.isin(t.YES_WORDS) & b.isin(t.NO_WORDS)) | (a.isin(t.NO_WORDS) & b.isin(t.YES_WORDS))
    hit = (as_col(question_type) == "binary") & (F.size(o) == 2) & mixed
    return F.when(hit, F.array(F.lit("Yes"), F.lit("No"))).otherwise(as_col(options))


def repaired_category(category, event_type) -> Column:
    cat, kind = F.lower(strip(or_empty(category))), F.lower(strip(or_empty(event_type)))
    return (
        F.when((kind == "election") & cat.isin("", "other", "election"), "politics")
        .when(cat == "", "other")
        .otherwise(cat)
    )


def is_sportsbook(category, question) -> Column:
    q = F.lower(or_empty(question))
    return (as_col(category) == "sports") & (
        tx.contains_any(q, t.SPORTSBOOK_TERMS)
        | tx.matches_any(q, t.SPORTSBOOK_PATTERNS)
        | (q.rlike(t.SPORTSBOOK_STAT) & F.contains(q, F.lit("next")) & F.contains(q, F.lit("game")))
    )


def admit(drafts: DataFrame, as_of, opts: Options = DEFAULTS) -> DataFrame:
    """Repair deadlines, check, clean. Adds `error` (null when admitted) and keeps every draft.

    `drafts` carries its event's event_type and candidate_deadlines.
    """
    df = drafts.withColumn("deadline", repair_deadline("deadline", "candidate_deadlines", as_of))
    df = df.withColumn("error", admission_error(opts)).withColumn(
        "options", binary_options("options", "question_type")
    )
    df = df.withColumn("category", repaired_category("category", "event_type"))
    for name in ("question_text", "deadline", "deadline_source", "resolution_source", "resolution_criteria", "rationale"):
        df = df.withColumn(name, strip(or_empty(name)))
    dropped = F.when(F.col("error").isNull() & is_sportsbook("category", "question_text"), "sportsbook-style question")
    return df.withColumn("error", F.coalesce("error", dropped))


def admitted(drafts: DataFrame, as_of, opts: Options = DEFAULTS) -> DataFrame:
    return admit(drafts, as_of, opts).where(F.col("error").isNull()).drop("error")
