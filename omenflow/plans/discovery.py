"""Discovery views: markets, topics, trends, filters and metrics."""

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import terms as t
from ..functions.dates import as_date, as_instant, micros, parse_deadline
from ..functions.text import as_col, or_empty, strip


def lookup(table: dict, key, default=None) -> Column:
    """Small fixed table as a map literal."""
    m = F.create_map(*[F.lit(x) if not isinstance(x, list) else F.array(*[F.lit(i) for i in x]) for x in chain.from_iterable(table.items())])
    hit = F.try_element_at(m, as_col(key))
    return hit if default is None else F.coalesce(hit, default)


def category_label(c) -> Column:
    raw = strip(F.lower(F.replace(F.coalesce(as_col(c), F.lit("Other")), F.lit("_"), F.lit(" "))))
    title = F.initcap(raw)
    return F.when(raw == "", "Other").otherwise(
        lookup(t.CATEGORY_ALIASES, raw, F.when(title.isin(t.DISCOVERY_CATEGORIES), title).otherwise("Other"))
    )


def market_status(tracked, days) -> Column:
    days = as_col(days)
    return (
        F.when(tracked, "Tracked").when(days < 0, "Expired").when(days <= 14, "Ending Soon").otherwise("Active")
    )


def markets(rows: DataFrame, as_of, tracked: DataFrame | None = None) -> DataFrame:
    """Scored rows with defaults, label, breakdown, validation state and status.

    `tracked`: question_id of the markets someone follows.
    """
    text = lambda c, d: F.when(or_empty(c) == "", d).otherwise(F.col(c))
    score = lambda c: F.coalesce(c, F.lit(0.0))
    warnings = F.coalesce("validation_flags", F.array().cast("array<string>"))
    if tracked is None:
        df = rows.withColumn("_tracked", F.lit(False))
    else:
        ids = tracked.select("question_id", F.lit(True).alias("_tracked")).distinct()
        df = rows.join(ids, "question_id", "left").withColumn("_tracked", F.coalesce("_tracked", F.lit(False)))
    due = parse_deadline("deadline", extra_iso=True)
    return df.withColumn("days_left", F.datediff(due, as_date(as_of))).select(
        F.col("question_id").alias("id"),
        text("question_text", "Untitled market").alias("question"),
        category_label("category").alias("category"),
        text("question_type", "binary").alias("question_type"),
        score("total_score").alias("total_score"),
        "deadline", "days_left",
        text("deadline_source", "Not provided").alias("deadline_source"),
        text("resolution_source", "Not provided").alias("resolution_source"),
        text("resolution_criteria", "Resolution criteria not available yet.").alias("resolution_criteria"),
        text("rationale", "This market is drawing attention because it sits at the intersection of news momentum and clear resolution.").alias("rationale"),
        F.struct(
            score("market_interest_score").alias("market_interest"), score("resolution_strength_score").alias("resolution_strength"),
            score("clarity_score").alias("clarity"), score("mention_velocity_score").alias("mention_velocity"),
            score("novelty_score").alias("novelty"), score("time_horizon_score").alias("time_horizon"),
            score("source_diversity_score").alias("source_diversity"),
        ).alias("score_breakdown"),
        F.when(F.col("is_valid"), "Valid").when(F.size(warnings) > 0, "Needs Review").otherwise("Unknown").alias("validation_status"),
        warnings.alias("warnings"),
        F.col("question_created_at").alias("created_at"),
        "review_status",
        market_status(F.col("_tracked"), "days_left").alias("status"),
    )


def filter_markets(
    rows: DataFrame, search: str = "", category: str = "All", explorer_category: str = "All", kind: str = "All",
    min_score: float = 0.0, status: str = "All",
) -> DataFrame:
    needle = (search or "").strip().lower()
    if needle:
        hit = F.lit(False)
        for c in ("question", "rationale", "category"):
            hit = hit | F.contains(F.lower(c), F.lit(needle))
        rows = rows.where(hit)
    for label in (category, explorer_category):
        if label and label != "All":
            rows = rows.where(category_label("category") == label)
    if kind != "All":
        rows = rows.where(F.col("question_type") == ("multiple_choice" if kind == "Multiple Choice" else "binary"))
    rows = rows.where(F.col("total_score") >= float(min_score))
    return rows if status == "All" else rows.where(F.col("status") == status)


def market_order(how: str = "Highest Score") -> list[Column]:
    """Future deadlines come first by distance, then unknown ones, then past ones."""
    days = F.col("days_left")
    group = F.when(days.isNull(), 1).when(days < 0, 2).otherwise(0)
    distance = F.coalesce(F.abs(days), F.lit(999999))
    score, newest = F.desc("total_score"), F.desc_nulls_last("created_at")
    return {
        "Newest": [newest, score],
        "Ending Soon": [F.asc(group), F.asc(distance), score],
        "Emerging": [score, newest, F.asc(distance)],
        "Highest Score": [score, F.asc(group), F.asc(distance), newest],
    }[how] + [F.asc("id")]


def topic_rollup(extracted: DataFrame, cluster_events: DataFrame, events: DataFrame, questions: DataFrame, scored: DataFrame) -> DataFrame:
    """One row per extracted event with its news and question counts.

    News and questions are aggregated apart and then joined: together they would multiply to events
    times questions per topic. The counts are distinct and the mean repeats each question equally,
    so the result is the same.
    """
    news = (
        cluster_events.join(events.select(F.col("id").alias("event_id"), "source", "timestamp"), "event_id", "left")
        .groupBy("cluster_id", "source").agg(F.count_distinct("event_id").alias("n"), F.max("timestamp").alias("last"))
        .groupBy("cluster_id").agg(
            F.sum("n").alias("event_count"), F.count("source").alias("source_count"), F.max("last").alias("latest_event_at")
        )
    )
    joined = questions.join(scored.select("question_id", "total_score"), "question_id", "left")
    # order value: best score first, unscored last, then the smallest id
    best = F.struct(F.coalesce(-F.col("total_score"), F.lit(float("inf"))), F.col("question_id"))
    asked = joined.groupBy("extracted_event_id").agg(
        F.count_distinct("question_id").alias("suggested_market_count"), F.avg("total_score").alias("avg_candidate_score"),
        F.min_by(F.struct(F.nullif("category", F.lit("")).alias("category"), "question_text"), best).alias("first"),
    )
    return (
        extracted.select("id", "cluster_id", "event_summary", "event_type")
        .join(news, "cluster_id", "left")
        .join(asked.withColumnRenamed("extracted_event_id", "id"), "id", "left")
        .select(
            "id",
            F.coalesce(F.nullif("event_summary", F.lit("")), F.lit("Emerging topic")).alias("title"),
            F.col("event_summary").alias("summary"),
            F.coalesce("first.category", F.nullif("event_type", F.lit("")), F.lit("other")).alias("category"),
            F.coalesce("event_count", F.lit(0)).alias("event_count"), F.coalesce("source_count", F.lit(0)).alias("source_count"),
            F.coalesce("suggested_market_count", F.lit(0)).alias("suggested_market_count"), "avg_candidate_score",
            "latest_event_at", F.col("first.question_text").alias("example_question"),
        )
    )


def topic_order() -> list[Column]:
    return [F.desc_nulls_last("latest_event_at"), F.desc("event_count"), F.asc("id")]


def trend_score(as_of) -> Column:
    num = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    cap = lambda c, x: F.least(num(c), F.lit(x))
    age = F.greatest((micros(as_instant(as_of)) - micros("latest_event_at")) / F.lit(86400e6), F.lit(0.0))
    recency = F.when(F.col("latest_event_at").isNull(), 0.0).otherwise(25.0 - F.least(age, F.lit(25.0)))
    return F.round(
        cap("event_count", 20.0) * 2.2 + cap("source_count", 15.0) * 2.0 + cap("suggested_market_count", 10.0) * 2.4
        + num("avg_candidate_score") * 24.0 + recency, 1,
    )


def enrich_topics(topics: DataFrame) -> DataFrame:
    """Six descriptive columns per topic, from the label and the counts."""
    title = strip(F.coalesce("title", F.lit("This topic")))
    summary = strip(or_empty("summary"))
    first = strip(F.substring_index(summary, ".", 1))
    label = F.col("_label")
    low = F.lower(F.when(or_empty("title") == "", "this topic").otherwise(F.col("title")))
    fill = lambda table: F.replace(lookup(table, label, F.lit(table["Other"])), F.lit("{t}"), low)
    day = lambda n: F.date_format(F.date_add(F.col("latest_event_at").cast("date"), n), "MMM dd")
    dates = F.when(
        F.col("latest_event_at").isNull(), F.array(F.lit("Near-term follow-up timing is still unclear."))
    ).otherwise(F.array(
        F.concat(F.lit("Near-term follow-up window: by "), day(7)),
        F.concat(F.lit("If the story is durable, expect a clearer milestone before "), day(30)),
    ))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    listed = lambda table: lookup(table, label, F.array(*[F.lit(x) for x in table["Other"]]))
    return topics.withColumn("_label", category_label("category")).select(
        *topics.columns,
        F.when(first != "", F.concat(first, F.lit("."))).otherwise(
            F.concat(title, F.lit(" is attracting enough cross-source attention to be worth active monitoring."))
        ).alias("focus_sentence"),
        fill(t.TOPIC_UNCERTAINTY).alias("what_is_uncertain"),
        F.array(
            F.concat(F.lit("Watch whether mention velocity stays elevated beyond the current "), count("event_count"), F.lit("-event burst.")),
            F.concat(F.lit("Track whether coverage broadens beyond the current "), count("source_count"), F.lit(" distinct sources.")),
            lookup(t.TOPIC_WATCH, label, F.lit(t.TOPIC_WATCH["Other"])),
        ).alias("watching_points"),
        dates.alias("key_dates"), listed(t.TOPIC_SOURCES).alias("data_sources"), listed(t.ADJACENT_TOPICS).alias("adjacent_topics"),
    )


def filter_topics(topics: DataFrame, search: str = "", category: str = "All") -> DataFrame:
    needle = (search or "").strip().lower()
    if needle:
        hit = F.lit(False)
        for c in ("title", "summary", "what_is_uncertain"):
            hit = hit | F.contains(F.lower(or_empty(c)), F.lit(needle))
        topics = topics.where(hit)
    return topics if category == "All" else topics.where(category_label("category") == category)


def top_topics(topics: DataFrame, n: int = 6) -> DataFrame:
    return topics.orderBy(F.desc("trend_score"), F.desc("event_count"), F.asc("id")).limit(n)


def summary_metrics(market_rows: DataFrame, topics: DataFrame, as_of) -> DataFrame:
    """One row of headline numbers."""
    week_ago = as_instant(as_of) - F.expr("INTERVAL 7 DAYS")
    m = market_rows.agg(
        F.count_if(F.col("status") != "Expired").alias("active_markets"),
        F.format_string("%.1f", F.coalesce(F.avg("total_score"), F.lit(0.0)) * 100).alias("average_market_score"),
        F.count_if(F.coalesce(F.col("created_at") >= week_ago, F.lit(False))).alias("new_this_week"),
    )
    return m.withColumn("_k", F.lit(1)).join(topics.agg(F.count("*").alias("emerging_topics")).withColumn("_k", F.lit(1)), "_k").drop("_k")


def category_counts(market_rows: DataFrame) -> DataFrame:
    return market_rows.groupBy(category_label("category").alias("category")).agg(F.count("*").alias("n"))
