"""Run and stage status kept as append-only logs and folded on read."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import or_empty, strip

RUN_STATUSES = ["queued", "running", "completed", "failed"]
STAGE_STATUSES = ["pending", "running", "completed", "failed"]


def fold_stages(log: DataFrame) -> DataFrame:
    """Current state per (run_id, stage_number).

    The last entry gives name, status, summary and error; started_at is the first `running`
    entry; finished_at is the time of the last entry if it closed the stage.
    """
    order = F.struct("at", "seq") if "seq" in log.columns else F.col("at")
    last = F.struct("stage_name", F.lower(strip(or_empty("status"))).alias("status"), "summary", "error_message", "at")
    return (
        log.groupBy("run_id", "stage_number")
        .agg(F.max_by(last, order).alias("l"),
             F.min(F.when(F.lower(strip(or_empty("status"))) == "running", F.col("at"))).alias("started_at"))
        .select("run_id", "stage_number", "l.stage_name", "l.status", "l.summary", "l.error_message", "started_at",
                F.when(F.col("l.status").isin("completed", "failed"), F.col("l.at")).alias("finished_at"))
    )


def fold_runs(log: DataFrame) -> DataFrame:
    """Current state per run_id; a run's first `running` entry sets started_at."""
    order = F.struct("at", "seq") if "seq" in log.columns else F.col("at")
    return (
        log.groupBy("run_id")
        .agg(F.max_by(F.struct("status", "error_message", "at"), order).alias("l"),
             F.min(F.when(F.col("status") == "running", F.col("at"))).alias("started_at"))
        .select("run_id", "l.status",
                F.when(F.col("l.status") == "failed", strip(or_empty("l.error_message"))).otherwise("").alias("error_message"),
                "started_at", F.when(F.col("l.status").isin("completed", "failed"), F.col("l.at")).alias("finished_at"))
    )


def new_run(runs: DataFrame, first: int, last: int) -> DataFrame:
    """Placeholder stage entries of new runs: run_id, at -> one pending entry per stage."""
    return runs.select("run_id", "at", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("stage_number")).select(
        "run_id", "stage_number", F.concat(F.lit("FR"), F.col("stage_number").cast("string")).alias("stage_name"),
        F.lit("pending").alias("status"), F.create_map().cast("map<string,string>").alias("summary"),
        F.lit("").alias("error_message"), "at",
    )


def cancel(stages: DataFrame, run_id: int, at, reason: str = "Cancelled by user") -> DataFrame:
    """Entries that close the unfinished stages of a run."""
    return stages.where((F.col("run_id") == run_id) & F.col("status").isin("pending", "running")).select(
        "run_id", "stage_number", "stage_name", F.lit("failed").alias("status"), "summary",
        F.lit(reason).alias("error_message"), F.lit(at).cast("timestamp_ntz").alias("at"),
    )


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("run_id")).limit(1)


def active_run(runs: DataFrame) -> DataFrame:
    return latest_run(runs.where(F.col("status").isin("queued", "running")))


def run_progress(stages: DataFrame) -> DataFrame:
    """Share of completed stages per run."""
    return stages.groupBy("run_id").agg(F.avg((F.col("status") == "completed").cast("double")).alias("progress"))


def stage_progress(summary="summary") -> Column:
    """processed / total within [0, 1] when the summary holds such a pair, else null."""
    num = lambda k: F.try_element_at(F.col(summary), F.lit(k)).try_cast("double")
    share = lambda done, total: F.when((num(total) != 0) & num(done).isNotNull(), F.least(F.greatest(num(done) / num(total), F.lit(0.0)), F.lit(1.0)))
    return F.coalesce(share("clusters_processed", "pending_clusters"), share("events_processed", "eligible_events"))
