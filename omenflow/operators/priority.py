"""Topic inference and priority scores, two profiles, and the ranked queues."""

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import terms
from ..functions.numeric import clamp, log_scale
from ..functions.text import as_col, has_word, let, or_empty, squash
from .clusters import feature_columns, source_slices

TOPICS = list(terms.TOPIC_TERMS)


def hit_mask(text, words: list[str]) -> Column:
    """Bit i is set when the i-th term is a substring: masks of many rows combine with bit_or."""
    bits = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(1 << i).cast("bigint").alias("bit")) for i, w in enumerate(words)])
    hit = lambda x, t: F.when(F.contains(x, t["w"]), t["bit"]).otherwise(F.lit(0).cast("bigint"))
    return let(text, lambda x: F.aggregate(bits, F.lit(0).cast("bigint"), lambda m, t: m.bitwiseOR(hit(x, t))))


def topic_and_prior(hits: dict[str, Column], has_outlet: Column, has_benchmark: Column) -> tuple[Column, Column]:
    """Best topic (ties by listed order) and its prior from per-topic hit counts."""
    score = {t: h.cast("double") for t, h in hits.items()}
    score["major_news"] = score["major_news"] + F.when(has_outlet, 0.75).otherwise(0.0)
    for topic, bonus in (("crypto", 0.25), ("finance", 0.20), ("sports", 0.15)):
        score[topic] = score[topic] + F.when(has_benchmark, bonus).otherwise(0.0)
    best = F.greatest(*[score[t] for t in TOPICS])
    topic = F.when(best <= 0, "other")
    for t in TOPICS:
        topic = topic.when(score[t] == best, t)
    prior = F.when(best <= 0, 0.20).otherwise(clamp(0.20 + 0.18 * F.least(best, F.lit(4.0))))
    return topic, prior


def text_topic(text, has_outlet: Column, has_benchmark: Column) -> tuple[Column, Column]:
    """Topic and prior of one text."""
    hay = squash(text)
    hits = {t: F.bit_count(hit_mask(hay, words)) for t, words in terms.TOPIC_TERMS.items()}
    return topic_and_prior(hits, has_outlet, has_benchmark)


def procedural_penalty(hits: Column) -> Column:
    return clamp(hits * 0.18, 0.0, 0.72)


def cluster_score(prior, penalty, weighted_velocity, diversity, recency, coherence, has_benchmark) -> Column:
    return F.round(
        0.38 * as_col(prior)
        + 0.24 * log_scale(weighted_velocity, 12.0)
        + 0.14 * clamp(as_col(diversity) / 6.0)
        + 0.10 * clamp(1.0 - F.greatest(as_col(recency), F.lit(0.0)) / 168.0)
        + 0.08 * clamp(coherence)
        + 0.06 * F.when(has_benchmark, 1.0).otherwise(0.0)
        - as_col(penalty),
        4,
    )


def member_text(*parts) -> Column:
    """Non-empty parts joined by a space."""
    kept = F.filter(F.array(*[or_empty(p) for p in parts]), lambda p: p != "")
    return F.array_join(kept, " ")


def cluster_priorities(members: DataFrame, as_of, coherence: DataFrame | None = None) -> DataFrame:
    """Profile A for clusters, with their features.

    `members`: cluster_id, source, signal_role, timestamp, title, content, entities. Term hits are
    taken per event and combined as bit masks, so no cluster text is ever put together.
    """
    hay = squash(member_text("title", "content", "entities"))
    src = squash("source")
    masked = members.select(
        "cluster_id", "source", "signal_role", "timestamp",
        *[hit_mask(hay, w).alias(f"m_{t}") for t, w in terms.TOPIC_TERMS.items()],
        hit_mask(hay, terms.PROCEDURAL_TERMS).alias("m_procedural"),
    )
    names = [f"m_{t}" for t in TOPICS] + ["m_procedural"]
    slices = source_slices(masked, [F.bit_or(n).alias(n) for n in names])
    per_cluster = slices.groupBy("cluster_id").agg(
        *feature_columns(as_of),
        *[F.bit_or(n).alias(n) for n in names],
        F.bool_or(src.isin(terms.MAJOR_OUTLETS)).alias("has_outlet"),
        F.bool_or(src.isin(terms.BENCHMARK_SOURCES)).alias("has_benchmark"),
    )
    if coherence is None:
        per_cluster = per_cluster.withColumn("coherence_score", F.lit(0.0))
    else:
        per_cluster = per_cluster.join(coherence, "cluster_id", "left").fillna(0.0, ["coherence_score"])
    hits = {t: F.bit_count(F.col(f"m_{t}")) for t in TOPICS}
    topic, prior = topic_and_prior(hits, F.col("has_outlet"), F.col("has_benchmark"))
    penalty = procedural_penalty(F.bit_count("m_procedural"))
    return (
        per_cluster.withColumn("priority_topic", topic)
        .withColumn(
            "priority_score",
            cluster_score(prior, penalty, "weighted_mention_velocity", "source_diversity", "recency",
                          F.round("coherence_score", 4), F.col("has_benchmark")),
        )
        .drop(*names, "has_outlet", "has_benchmark")
    )


def extraction_queue(clusters: DataFrame, limit: int | None = 10) -> DataFrame:
    """Clusters by priority, weighted velocity, velocity, diversity, recency, id."""
    out = clusters.orderBy(
        F.desc("priority_score"), F.desc("weighted_mention_velocity"), F.desc("mention_velocity"),
        F.desc("source_diversity"), F.asc("recency"), F.asc("cluster_id"),
    )
    return out if limit is None else out.limit(limit)


def event_text() -> Column:
    """Text an extracted event is ranked on."""
    return member_text(
        "event_summary", "market_angle", "outcome_variable", "event_type",
        F.array_join("entities", " "), F.array_join("resolution_sources", " "),
    )


def event_type_prior(event_type) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(terms.EVENT_TYPE_PRIORS.items())])
    key = F.replace(squash(event_type), F.lit(" "), F.lit("_"))
    return F.coalesce(F.try_element_at(table, key), F.lit(terms.EVENT_TYPE_PRIORS["other"]))


def event_priorities(events: DataFrame, source_flags: DataFrame | None = None) -> DataFrame:
    """Profile A for extracted events that carry their cluster's features.

    `source_flags`: cluster_id, has_outlet, has_benchmark; a cluster that is missing has neither.
    """
    if source_flags is None:
        df = events.withColumn("has_outlet", F.lit(False)).withColumn("has_benchmark", F.lit(False))
    else:
        df = events.join(source_flags, "cluster_id", "left").fillna(False, ["has_outlet", "has_benchmark"])
    hay = squash(event_text())
    df = df.withColumn("_hay", hay)
    topic, prior = text_topic("_hay", F.col("has_outlet"), F.col("has_benchmark"))
    penalty = procedural_penalty(F.bit_count(hit_mask("_hay", terms.PROCEDURAL_TERMS)))
    cluster = cluster_score("_prior", "_penalty", "weighted_mention_velocity", "source_diversity", "recency",
                            "coherence_score", F.col("has_benchmark"))
    score = F.round(
        0.40 * cluster
        + 0.22 * F.col("_prior")
        + 0.20 * clamp("confidence")
        + 0.12 * event_type_prior("event_type")
        + 0.06  # both topics come from the same text and sources, so they always agree
        - F.when(F.col("contradiction_flag"), 0.12).otherwise(0.0)
        - 0.6 * F.col("_penalty"),
        4,
    )
    return (
        df.withColumn("priority_topic", topic).withColumn("_prior", prior).withColumn("_penalty", penalty)
        .withColumn("priority_score", score)
        .drop("_hay", "_prior", "_penalty", "has_outlet", "has_benchmark")
    )


def source_flags(members: DataFrame) -> DataFrame:
    """Which clusters have a major outlet or a benchmark source among their events."""
    src = squash("source")
    return members.groupBy("cluster_id").agg(
        F.bool_or(src.isin(terms.MAJOR_OUTLETS)).alias("has_outlet"),
        F.bool_or(src.isin(terms.BENCHMARK_SOURCES)).alias("has_benchmark"),
    )


def generation_order() -> list[Column]:
    return [
        F.desc("priority_score"), F.desc("weighted_mention_velocity"), F.desc("mention_velocity"),
        F.desc("confidence"), F.desc("source_diversity"), F.asc("recency"), F.asc("id"),
    ]


def generation_queue(events: DataFrame, limit: int | None = 5) -> DataFrame:
    out = events.orderBy(*generation_order())
    return out if limit is None else out.limit(limit)


# ---- profile B --------------------------------------------------------------------

def tiered_prior(tiers_hit: list[Column], has_outlet: Column) -> Column:
    out = None
    for (value, _), hit in zip(terms.TIERED_TERMS, tiers_hit):
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.when(has_outlet, 0.8).otherwise(0.2)


def linear(c, scale: float) -> Column:
    return clamp(F.coalesce(as_col(c), F.lit(0.0)) / scale)


def cluster_priorities_tiered(members: DataFrame, as_of) -> DataFrame:
    """Profile B for clusters: whole-word lexicons, best tier wins."""
    hay = squash(F.concat_ws(" ", or_empty("title"), or_empty("content")))
    tiers = [f"tier{i}" for i in range(len(terms.TIERED_TERMS))]
    tagged = members.withColumn("_hay", hay).select(
        "cluster_id", "source", "signal_role", "timestamp",
        *[has_word("_hay", words).alias(t) for t, (_, words) in zip(tiers, terms.TIERED_TERMS)],
        has_word("_hay", terms.TIERED_PROCEDURAL).alias("procedural"),
        has_word(squash("source"), terms.TIERED_OUTLETS).alias("outlet"),
        ((F.col("signal_role") == "benchmark") | F.col("source").isin(terms.BENCHMARK_SOURCES)).alias("benchmark"),
    )
    flags = tiers + ["procedural", "outlet", "benchmark"]
    slices = source_slices(tagged, [F.bool_or(f).alias(f) for f in flags])
    df = slices.groupBy("cluster_id").agg(*feature_columns(as_of), *[F.bool_or(f).alias(f) for f in flags])
    score = (
        0.45 * tiered_prior([F.col(t) for t in tiers], F.col("outlet"))
        + 0.25 * linear("weighted_mention_velocity", 15.0)
        + 0.15 * linear("source_diversity", 6.0)
        + 0.10 * clamp(1.0 - F.greatest("recency", F.lit(0.0)) / 168.0)
        + 0.05 * F.when(F.col("benchmark"), 0.08).otherwise(0.0)
        - F.when(F.col("procedural"), 0.35).otherwise(0.0)
    )
    return df.withColumn("priority_score", F.round(score, 4)).drop(*flags)


def event_priorities_tiered(events: DataFrame) -> DataFrame:
    """Profile B for extracted events that carry their cluster's features."""
    sources = F.array_join("resolution_sources", " ")
    df = events.withColumn(
        "_hay",
        squash(F.concat_ws(" ", "event_summary", "event_type", "outcome_variable", "market_angle",
                           F.array_join("entities", " "), sources)),
    )
    prior = tiered_prior([has_word("_hay", w) for _, w in terms.TIERED_TERMS],
                         has_word(squash(sources), terms.TIERED_OUTLETS))
    score = (
        0.40 * prior
        + 0.20 * clamp(F.coalesce("confidence", F.lit(0.0)))
        + 0.20 * linear("weighted_mention_velocity", 15.0)
        + 0.10 * linear("source_diversity", 6.0)
        + 0.10 * clamp(1.0 - F.greatest("recency", F.lit(0.0)) / 168.0)
        - F.when(has_word("_hay", terms.TIERED_PROCEDURAL), 0.35).otherwise(0.0)
        - F.when(F.col("contradiction_flag"), 0.1).otherwise(0.0)
    )
    return df.withColumn("priority_score", F.round(score, 4)).drop("_hay")
