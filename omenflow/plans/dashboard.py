"""Review and repair queues: read models over the stored tables."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import as_date, parse_deadline
from ..functions.text import or_empty, strip
from ..operators.gate import is_salvageable
from ..operators.ranks import global_rank

QUESTION_COLUMNS = [
    "question_id", "question_text", "category", "question_type", "options", "deadline", "resolution_source",
    "resolution_criteria", "rationale", "resolution_confidence", "source_independence", "timing_reliability",
]


def ranked_questions(scored: DataFrame, questions: DataFrame) -> DataFrame:
    """Every scored question with its text, by rank then id."""
    return scored.join(questions.select(*QUESTION_COLUMNS), "question_id").orderBy("rank", "question_id")


def effective_status(review_status, deadline, as_of) -> Column:
    """A manual decision wins; else expired when the deadline has passed; else active."""
    manual = F.lower(strip(or_empty(review_status)))
    due = parse_deadline(or_empty(deadline))
    return (
        F.when(manual.isin("selected", "removed"), manual)
        .when(due < as_date(as_of), "expired")
        .otherwise("active")
    )


def latest_review(log: DataFrame) -> DataFrame:
    """Last decision per question from an append-only log; `active` clears the override.

    max_by combines map-side, so a question with very many changes is no hot spot.
    """
    last = log.groupBy("question_id").agg(
        F.max_by(F.struct("status", "reason", "notes", "changed_at"), F.struct("changed_at", "status")).alias("r")
    )
    return last.select("question_id", "r.*").where("status <> 'active'")


def review_queue(scored: DataFrame, questions: DataFrame, review: DataFrame, as_of, validation: DataFrame | None = None) -> DataFrame:
    """Scored questions with review state and effective status.

    With `validation`, the variant that also shows validation results (one row per result).
    """
    df = scored.join(
        questions.select(*QUESTION_COLUMNS, "deadline_source", F.col("created_at").alias("question_created_at")), "question_id"
    )
    if validation is not None:
        df = df.join(validation.select("question_id", "is_valid", F.col("flags").alias("validation_flags")), "question_id", "left")
    state = review.select(
        "question_id", F.col("status").alias("review_status"), F.col("reason").alias("review_reason"),
        F.col("notes").alias("review_notes"), F.col("changed_at").alias("review_changed_at"),
    )
    df = df.join(state, "question_id", "left")
    return df.withColumn("effective_status", effective_status("review_status", "deadline", as_of))


def display_ranks(rows: DataFrame) -> DataFrame:
    """Rank per effective status by score, then id.

    There are only four statuses, so each is numbered by range partitions, not in one window.
    """
    order = [F.asc("effective_status"), F.desc(F.coalesce("total_score", F.lit(0.0))), F.asc("question_id")]
    numbered = global_rank(rows, order, "_n")
    starts = numbered.groupBy("effective_status").agg(F.min("_n").alias("_s"))
    return numbered.join(F.broadcast(starts), "effective_status").withColumn("rank", F.col("_n") - F.col("_s") + 1).drop("_n", "_s")


def repair_queue(questions: DataFrame, validation: DataFrame, extracted: DataFrame, clusters: DataFrame) -> DataFrame:
    """Failed questions with their cluster's signal and whether a repair exists."""
    parents = questions.where("repair_parent_question_id IS NOT NULL").select(
        F.col("repair_parent_question_id").alias("question_id"), F.lit(True).alias("has_repair_child")
    ).distinct()
    return (
        questions.join(validation.where("NOT is_valid").select("question_id", F.col("flags").alias("validation_flags")), "question_id")
        .join(extracted.select(F.col("id").alias("extracted_event_id"), "cluster_id", F.col("confidence").alias("extraction_confidence")), "extracted_event_id")
        .join(clusters.select("cluster_id", "mention_velocity", "weighted_mention_velocity", "source_diversity", "recency"), "cluster_id")
        .join(parents, "question_id", "left")
        .withColumn("has_repair_child", F.coalesce("has_repair_child", F.lit(False)))
    )


def repair_order() -> list[Column]:
    return [
        F.desc_nulls_last("weighted_mention_velocity"), F.desc_nulls_last("mention_velocity"),
        F.desc_nulls_last("source_diversity"), F.desc_nulls_last("extraction_confidence"),
        F.asc_nulls_last("recency"), F.asc("question_id"),
    ]


def repair_ranks(queue: DataFrame) -> DataFrame:
    """Rank of the repairable rows that have no repair yet."""
    open_ = queue.where(~F.col("has_repair_child") & is_salvageable("validation_flags"))
    return global_rank(open_, repair_order())


def _common_filters(rows: DataFrame, search: str, categories: list[str], kind: str) -> DataFrame:
    if search and search.strip():
        rows = rows.where(F.contains(F.lower(or_empty("question_text")), F.lit(search.strip().lower())))
    if categories:
        cat = F.lower(F.when(or_empty("category") == "", "other").otherwise(F.col("category")))
        rows = rows.where(cat.isin([c.lower() for c in categories]))
    if kind != "All":
        rows = rows.where(or_empty("question_type") == ("binary" if kind == "Binary" else "multiple_choice"))
    return rows


def sort_columns(choice: str) -> list[Column]:
    """Deadlines sort by date; unreadable ones come last."""
    return {
        "Score (Highest First)": [F.desc(F.coalesce("total_score", F.lit(0.0))), F.asc("question_id")],
        "Deadline (Soonest)": [F.asc_nulls_last(parse_deadline("deadline")), F.asc("question_id")],
        "Category (A-Z)": [F.asc(F.lower(or_empty("category"))), F.asc("question_id")],
    }[choice]


def filter_review(
    rows: DataFrame, search: str = "", categories: list[str] = (), kind: str = "All", min_score_pct: int = 0,
    sort: str = "Score (Highest First)",
) -> DataFrame:
    rows = _common_filters(rows, search, list(categories), kind)
    if min_score_pct > 0:
        rows = rows.where(F.coalesce("total_score", F.lit(0.0)) >= min_score_pct / 100)
    return rows.orderBy(*sort_columns(sort))


def filter_repair(rows: DataFrame, search: str = "", categories: list[str] = (), kind: str = "All", sort: str = "") -> DataFrame:
    rows = _common_filters(rows, search, list(categories), kind)
    known = sort in ("Category (A-Z)", "Deadline (Soonest)")
    return rows.orderBy(*(sort_columns(sort) if known else [F.asc("rank")]))


def status_stats(rows: DataFrame) -> DataFrame:
    """Per status: rows, distinct categories, mean and best score, questions of each type."""
    cat = F.lower(F.when(or_empty("category") == "", "other").otherwise(F.col("category")))
    return rows.groupBy("effective_status").agg(
        F.count("*").alias("n"), F.count_distinct(cat).alias("categories"),
        F.avg("total_score").alias("avg_score"), F.max("total_score").alias("max_score"),
        F.count_if(F.col("question_type") == "binary").alias("binary"),
        F.count_if(F.col("question_type") == "multiple_choice").alias("multiple_choice"),
    )
