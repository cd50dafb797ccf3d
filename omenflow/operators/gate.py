"""Gate pack: one narrow pass that tags each question with an ordered flag array."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import terms as t
from ..functions import text as tx
from ..functions.dates import as_date, parse_deadline
from ..functions.numeric import clarity, fixed_text
from ..functions.text import as_col, or_empty, squash
from ..options import DEFAULTS, Options


def two_decimals(c) -> Column:
    return fixed_text(c, 2)


def pair_text(a, b) -> Column:
    return F.concat(or_empty(a), F.lit(" "), or_empty(b))


def prohibited_topic(question, full, hay) -> Column:
    """Reason text, or null: terrorism, illegal activity, death market, severe violence.

    `full` is question and criteria as written, `hay` the same lowercased and collapsed.
    """
    individual = ~tx.matches_any(full, t.STATE_ACTION_PATTERNS)
    asks = F.lower(or_empty(question)).rlike("^(" + "|".join(t.QUESTION_STARTS) + ")")
    named = lambda head, term: F.concat(F.lit(head + " ("), term, F.lit(")"))
    return (
        F.when(tx.has_word(hay, t.TERRORISM_TERMS), named("terrorism_content", tx.first_word(hay, t.TERRORISM_TERMS)))
        .when(tx.has_word(hay, t.ILLEGAL_TERMS), named("illegal_activity", tx.first_word(hay, t.ILLEGAL_TERMS)))
        .when(tx.contains_any(hay, t.DEATH_WORDS) & tx.matches_any(full, t.DEATH_PATTERNS) & individual, "death_market")
        .when(
            tx.has_word(hay, t.SEVERE_VIOLENCE_TERMS) & asks & individual,
            named("violence_content", F.array_join(tx.all_words(hay, t.VIOLENCE_TERMS), ", ")),
        )
    )


def manipulation_risk(question, low) -> Column:
    return tx.has_word(low, t.MANIPULATION_TERMS) | tx.matches_any(or_empty(question), t.MORAL_HAZARD_PATTERNS)


def minor_involvement(low) -> Column:
    """`low` is the collapsed lowercase question."""
    age = F.regexp_extract(low, t.MINOR_AGE, 1)
    named = lambda word: F.contains(as_col(low), F.lit(word))
    return (
        (named("year") & (F.coalesce(age.try_cast("int"), F.lit(99)) < 18))
        | (named("minor") & as_col(low).rlike("(?d)" + t.MINOR_CONTEXT))
        | tx.has_word(low, t.MINOR_WORD_TERMS)
        | (tx.has_word(low, ["children"]) & ~F.contains(as_col(low), F.lit("children's")))
    )


def ambiguous_wording(full) -> Column:
    return tx.has_word(F.lower(as_col(full)), t.AMBIGUOUS_TERMS)


def media_mentions(source) -> Column:
    named = [m for m in t.TRUSTED_MEDIA_TERMS if m != "ap"]
    return tx.count_contains(source, named) + tx.has_word(source, ["ap"]).cast("int")


def weak_resolution_source(src, cat, hay) -> Column:
    """`src`, `cat`, `hay`: collapsed lowercase source, category, and question with criteria."""
    s, cat = as_col(src), as_col(cat)
    located = tx.contains_any(s, ["http://", "https://", "."])
    media, generic = media_mentions(s), tx.contains_any(s, t.GENERIC_SOURCE_TERMS)
    reported = cat.isin(t.CREDIBLE_REPORTING_CATEGORIES) & (media > 0)
    disputed = tx.contains_any(hay, t.DISPUTED_TERMS)
    return (
        F.when(F.length(s) < 15, True)
        .when(cat.isin(t.AUTHORITATIVE_CATEGORIES) & tx.contains_any(s, t.GENERIC_FALLBACK_TERMS), True)
        .when(tx.contains_any(s, t.AUTHORITATIVE_TERMS), False)
        .when(reported & (disputed | generic), True)
        .when(reported & ((media >= 2) | tx.contains_any(s, t.STATEMENT_ANCHORS) | located), False)
        .when(~located & (media == 0), True)
        .otherwise(generic | tx.contains_any(s, t.GENERIC_NEWS_ONLY_TERMS))
    )


def weak_resolution_criteria(crit, question_type, options, hay) -> Column:
    """`crit`, `hay`: collapsed lowercase criteria, and question with criteria."""
    c = as_col(crit)
    opts = F.coalesce(as_col(options), F.array().cast("array<string>"))
    named = F.size(F.filter(F.transform(opts, squash), lambda o: (o != "") & F.contains(c, o)))
    needed = F.greatest(F.lit(2), F.least(F.size(opts), F.lit(3)))
    rule_missing = F.when(
        as_col(question_type) == "multiple_choice",
        (named < needed) & (F.regexp_count(c, F.lit("resolves to")) < 2),
    ).otherwise(~tx.contains_any(c, ["resolves yes", "resolves no"]))
    return (
        (F.length(c) < 30)
        | tx.contains_any(hay, t.DISPUTED_TERMS)
        | rule_missing
        | tx.contains_any(c, t.WEAK_CRITERIA_TERMS)
    )


def unclear_binary(question, question_type) -> Column:
    q = tx.strip(or_empty(question))
    return (as_col(question_type) == "binary") & (~q.endswith("?") | ~q.rlike(t.BINARY_LEAD))


def _normalised(questions: DataFrame) -> DataFrame:
    """Each text is lowercased and collapsed once; the rules read these columns."""
    full = pair_text("question_text", "resolution_criteria")
    texts = questions.select(
        "question_id", "question_text", "question_type", "options", "already_resolved",
        F.coalesce("resolution_confidence", F.lit(0.0)).alias("conf"),
        or_empty("resolution_confidence_reason").alias("reason"),
        F.coalesce("source_independence", F.lit(0.0)).alias("indep"),
        F.coalesce("timing_reliability", F.lit(0.0)).alias("timing"),
        parse_deadline("deadline").alias("due"), full.alias("full"),
        squash("question_text").alias("low"), squash("resolution_criteria").alias("crit"),
        squash("resolution_source").alias("src"), squash("category").alias("cat"),
    )
    return texts.withColumn("hay", F.trim(pair_text("low", "crit")))


def gate(questions: DataFrame, as_of, opts: Options = DEFAULTS) -> DataFrame:
    """question_id, is_valid, flags, clarity_score; flags in fixed order, none means valid."""
    today = as_date(as_of)
    due, conf, indep, timing = (F.col(c) for c in ("due", "conf", "indep", "timing"))
    judged = _normalised(questions).select(
        "question_id", "reason", "due", "conf", "indep", "timing", "already_resolved",
        prohibited_topic("question_text", F.col("full"), F.col("hay")).alias("topic"),
        manipulation_risk("question_text", F.col("low")).alias("manipulation_risk"),
        minor_involvement(F.col("low")).alias("minor_involvement"),
        tx.has_pii("question_text").alias("pii_exposure"),
        ambiguous_wording("full").alias("ambiguous_wording"),
        weak_resolution_source("src", "cat", "hay").alias("weak_resolution_source"),
        weak_resolution_criteria("crit", "question_type", "options", "hay").alias("weak_resolution_criteria"),
        unclear_binary("question_text", "question_type").alias("unclear_binary_condition"),
    )
    flag = lambda name: F.when(F.col(name), name)
    low = lambda name, v: F.concat(F.lit(name + ":"), two_decimals(v))
    why = F.when(F.col("reason") != "", F.concat(F.lit(" ("), F.col("reason"), F.lit(")"))).otherwise("")
    flags = F.array_compact(F.array(
        F.concat(F.lit("prohibited_topic:"), F.col("topic")),
        flag("manipulation_risk"), flag("minor_involvement"), flag("pii_exposure"), flag("ambiguous_wording"),
        flag("weak_resolution_source"), flag("weak_resolution_criteria"),
        F.when(due.isNull() | (due < today), "invalid_deadline_window"),
        F.when(due > F.date_add(today, opts.max_deadline_days), "excessive_deadline"),
        flag("unclear_binary_condition"), flag("already_resolved"),
        F.when(conf < opts.min_resolution_confidence, F.concat(low("low_resolution_confidence", conf), why)),
        F.when(indep < opts.min_source_independence, low("low_source_independence", indep)),
        F.when(timing < opts.min_timing_reliability, low("low_timing_reliability", timing)),
    ))
    return judged.select("question_id", flags.alias("flags")).select(
        "question_id", (F.size("flags") == 0).alias("is_valid"), "flags", clarity("flags").alias("clarity_score")
    )


def is_salvageable(flags) -> Column:
    """Some flag, none of them a hard policy block, all of a repairable kind."""
    def judged(flags):
        hard = F.exists(flags, lambda f: f.rlike("^(" + "|".join(t.NON_SALVAGEABLE_PREFIXES) + ")"))
        soft = F.forall(flags, lambda f: F.substring_index(f, ":", 1).isin(t.SALVAGEABLE_FLAGS))
        return (F.size(flags) > 0) & ~hard & soft

    return tx.let(F.transform(as_col(flags), lambda f: tx.strip(or_empty(f))), judged)


def top_flags(results: DataFrame, n: int = 3) -> DataFrame:
    """The n most frequent flag texts. Valid rows have no flags and so add nothing.

    explode_outer, with the null test after it, keeps the optimizer from copying the rule
    expressions into a filter below the explode.
    """
    return (
        results.select(F.explode_outer("flags").alias("flag")).where(F.col("flag").isNotNull())
        .groupBy("flag").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), F.asc("flag")).limit(n)
    )
