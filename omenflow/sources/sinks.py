"""Writing stage outputs: append-only tables, with ids from an explicit order."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ranks import global_rank
from .store import Sink, UpsertLog


def new_events(batch: DataFrame, stored: DataFrame | None = None, order: list[str] | None = None) -> DataFrame:
    """First row per content hash that is not stored yet.

    The first row is an aggregate with a partial per task, so many copies of one text are cheap.
    """
    cols = [c for c in batch.columns if c != "content_hash"]
    order = order or ["timestamp", "source", "title", "url"]
    first = batch.groupBy("content_hash").agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r"))
    rows = first.select("r.*", "content_hash").select(*batch.columns)
    return rows if stored is None else rows.join(stored.select("content_hash"), "content_hash", "left_anti").select(*batch.columns)


def ingest_counts(batch: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Per source: fetched, new and deduplicated."""
    fresh = new_events(batch, stored).groupBy("source").agg(F.count("*").alias("new"))
    return (
        batch.groupBy("source").agg(F.count("*").alias("fetched")).join(fresh, "source", "left")
        .withColumn("new", F.coalesce("new", F.lit(0))).withColumn("deduplicated", F.col("fetched") - F.col("new"))
    )


def with_ids(rows: DataFrame, order: list[Column], name: str = "id", after: int = 0) -> DataFrame:
    """Dense ids in the given order, following `after`."""
    return global_rank(rows, order, name, start=after + 1)


def append(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = rows.write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


#: Columns and keys of the tables that the stages append to.
CONTRACTS = {
    "extracted": ("id bigint, cluster_id bigint, event_summary string, entities array<string>, event_type string, outcome_variable string, "
                  "candidate_deadlines array<string>, resolution_sources array<string>, tradability string, rejection_reason string, confidence double, "
                  "market_angle string, contradiction_flag boolean, contradiction_details string, time_horizon string, resolution_hints array<string>", ["id"]),
    "questions": ("question_id bigint, extracted_event_id bigint, repair_parent_question_id bigint, question_text string, category string, question_type string, "
                  "options array<string>, deadline string, deadline_source string, resolution_source string, resolution_criteria string, rationale string, "
                  "resolution_confidence double, resolution_confidence_reason string, source_independence double, timing_reliability double, "
                  "already_resolved boolean, created_at timestamp_ntz", ["question_id"]),
    "validation": ("question_id bigint, is_valid boolean, flags array<string>, clarity_score double", ["question_id"]),
    "scored": ("question_id bigint, total_score double, mention_velocity_score double, source_diversity_score double, clarity_score double, "
               "novelty_score double, market_interest_score double, resolution_strength_score double, time_horizon_score double", ["question_id"]),
}


def stage_sink(spark: SparkSession, path: str, table: str) -> Sink:
    """The append table of a stage: extracted, questions, validation or scored."""
    contract, key = CONTRACTS[table]
    return Sink(spark, path, contract, key)


def _last_reviews(log: DataFrame) -> DataFrame:
    last = log.groupBy("question_id").agg(F.max_by(F.struct("status", "reason", "notes", "changed_at"), F.struct("changed_at", "status")).alias("r"))
    return last.select("question_id", "r.*")


def review_log(spark: SparkSession, path: str) -> UpsertLog:
    """Decisions by question: the last one is all that is kept in a snapshot, `active` ones too, as they clear earlier ones."""
    return UpsertLog(spark, path, "question_id bigint, status string, reason string, notes string, changed_at timestamp_ntz", _last_reviews)


def _needed_stages(log: DataFrame) -> DataFrame:
    """The last entry of a stage, and the first that says it runs."""
    entry = F.struct("stage_name", "status", "summary", "error_message", "at", "seq")
    running = F.lower(F.trim(F.coalesce("status", F.lit("")))) == "running"
    kept = log.groupBy("run_id", "stage_number").agg(
        F.max_by(entry, F.struct("at", "seq")).alias("l"), F.min_by(F.when(running, entry), F.when(running, F.struct("at", "seq"))).alias("f")
    )
    # a map is no set member: the first entry is another one if its place differs
    other = F.col("f").isNotNull() & ((F.col("f.at") != F.col("l.at")) | (F.col("f.seq") != F.col("l.seq")))
    both = F.when(other, F.array("l", "f")).otherwise(F.array("l"))
    return kept.select("run_id", "stage_number", F.explode(both).alias("e")).select("run_id", "stage_number", "e.*")


def stage_log(spark: SparkSession, path: str) -> UpsertLog:
    """Status entries by run and stage."""
    schema = "run_id bigint, stage_number int, stage_name string, status string, summary map<string,string>, error_message string, at timestamp_ntz, seq bigint"
    return UpsertLog(spark, path, schema, _needed_stages)


def write_clusters(features: DataFrame, members: DataFrame, clusters_path: str, bridge_path: str) -> None:
    """Cluster rows, and the bridge of their events; members without an id are left out."""
    append(features, clusters_path)
    kept = members.where(F.col("event_id").isNotNull()).join(features.select("cluster_id"), "cluster_id", "left_semi")
    append(kept.select("cluster_id", "event_id").distinct(), bridge_path)


def review_entries(decisions: DataFrame) -> DataFrame:
    """Log entries of manual decisions; an unknown status is an error."""
    status = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    known = F.when(status.isin("active", "selected", "removed"), status).otherwise(
        F.raise_error(F.concat(F.lit("Unsupported review status: "), F.coalesce("status", F.lit("None"))))
    )
    return decisions.select("question_id", known.alias("status"), "reason", "notes", "changed_at")


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)


def read_fixture(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of question objects."""
    return spark.read.option("multiLine", True).json(path)
