"""Per-cluster features from the event-to-cluster bridge.

Every aggregate is algebraic, so a cluster that holds a third of all events is
combined map-side and never gathered in one task.
"""

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import terms
from ..functions.dates import as_instant, micros
from ..options import DEFAULTS, Options


def source_weight(source) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(terms.SOURCE_WEIGHTS.items())])
    return F.coalesce(F.try_element_at(table, source), F.lit(terms.DEFAULT_SOURCE_WEIGHT))


def hours(later, earlier) -> Column:
    return (later - earlier) / F.lit(3600e6)


def source_slices(members: DataFrame, extra: list[Column] = ()) -> DataFrame:
    """First combine: one row per (cluster, source, signal_role)."""
    return members.groupBy("cluster_id", "source", "signal_role").agg(
        F.count("*").alias("n"),
        F.min(micros("timestamp")).alias("t0"),
        F.max(micros("timestamp")).alias("t1"),
        *extra,
    )


def feature_columns(as_of) -> list[Column]:
    """Velocity, diversity, recency and weighted velocity over `source_slices` rows."""
    n, t0, t1 = F.sum("n"), F.min("t0"), F.max("t1")
    span = hours(t1, t0)
    weight = F.sum(F.col("n") * source_weight(F.col("source")))
    return [
        n.alias("size"),
        F.when(span < 0.01, n.cast("double")).otherwise(F.round(n / span, 4)).alias("mention_velocity"),
        F.count_distinct("source").alias("source_diversity"),
        F.round(hours(micros(as_instant(as_of)), t1), 4).alias("recency"),
        F.when(span < 0.01, weight).otherwise(F.round(weight / span, 4)).alias("weighted_mention_velocity"),
    ]


def role_mix(slices: DataFrame) -> DataFrame:
    """cluster_id, source_role_mix map<string,long>."""
    return (
        slices.groupBy("cluster_id", "signal_role").agg(F.sum("n").alias("n"))
        .groupBy("cluster_id")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("signal_role", "n")))).alias("source_role_mix"))
    )


def coherence(vectors: DataFrame) -> DataFrame:
    """Mean pairwise cosine per cluster, in closed form.

    With unit vectors u the sum over unordered pairs is (|sum u|^2 - sum |u|^2) / 2, so one
    sum per dimension is enough and no pair is formed.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    unit = vectors.select(
        "cluster_id", F.posexplode(x).alias("dim", "v"), F.when(norm == 0, 1.0).otherwise(norm).alias("norm")
    ).withColumn("u", F.col("v") / F.col("norm"))
    per_dim = unit.groupBy("cluster_id", "dim").agg(
        F.sum("u").alias("s"), F.sum(F.col("u") * F.col("u")).alias("q"), F.count("*").alias("n")
    )
    n = F.max("n")
    pairs = (n * (n - 1)).cast("double")
    return per_dim.groupBy("cluster_id").agg(
        F.when(n < 2, 0.0)
        .otherwise((F.sum(F.col("s") * F.col("s")) - F.sum("q")) / F.nullif(pairs, F.lit(0.0)))
        .alias("coherence_score")
    )


def cluster_features(
    members: DataFrame, as_of, vectors: DataFrame | None = None, opts: Options = DEFAULTS,
    min_mentions: int | None = None,
) -> DataFrame:
    """All cluster features.

    `members`: cluster_id, source, signal_role, timestamp (one row per event in a cluster).
    `vectors`: optional cluster_id, embedding. `min_mentions` keeps clusters of at least that size.
    """
    slices = source_slices(members)
    out = slices.groupBy("cluster_id").agg(*feature_columns(as_of)).join(role_mix(slices), "cluster_id")
    if vectors is None:
        out = out.withColumn("coherence_score", F.lit(0.0))
    else:
        out = out.join(coherence(vectors), "cluster_id", "left").withColumn(
            "coherence_score", F.round(F.coalesce("coherence_score", F.lit(0.0)), 4)
        )
    floor = opts.cluster_min_mentions if min_mentions is None else min_mentions
    return out.where(F.col("size") >= floor)
