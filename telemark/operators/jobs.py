"""Work status from the attempt log, and the backlog lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemark.operators.topk import bounded_limit

# Fixed values of the retry rule.
MAX_BACKOFF_SECONDS = 300
OPEN_CLAIM = "claimed"
FINAL_STATES = ("COMPLETE", "FAILED")
SECOND_US = 1000000


def backoff_seconds(attempt: Column, base: int = 1) -> Column:
    if base <= 0:
        raise ValueError("base backoff must be positive")
    doubled = F.lit(base) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0)))
    return F.least(doubled, F.lit(float(MAX_BACKOFF_SECONDS))).cast("bigint")


def job_status(jobs: DataFrame, attempts: DataFrame, base_backoff: int = 1) -> DataFrame:
    """State of every job after its last attempt.

    A log row ends with ``success``, ``temporary`` or ``permanent``; a row still
    ``claimed`` carries its lease expiry in ``ended_us``.
    """
    last = attempts.groupBy("job_id").agg(
        F.max_by(F.struct("attempt_no", "ended_us", "outcome", "error"), "attempt_no").alias("last")
    )
    n, ended, outcome = (F.col(f"last.{c}") for c in ("attempt_no", "ended_us", "outcome"))
    state = (
        F.when(outcome.isNull() & F.col("queued_us").isNull(), "PENDING_QUEUE")
        .when(outcome.isNull(), "QUEUED")
        .when(outcome == "success", "COMPLETE")
        .when(outcome == OPEN_CLAIM, "PROCESSING")
        .when((outcome == "permanent") | (n >= F.col("max_attempts")), "FAILED")
        .otherwise("RETRY_WAIT")
    )
    return (
        jobs.join(last, "job_id", "left")
        .withColumn("state", state)
        .select(
            "job_id",
            "packet_id",
            "created_us",
            "queued_us",
            "state",
            F.coalesce(n, F.lit(0)).cast("bigint").alias("attempt_count"),
            F.col("max_attempts").cast("bigint").alias("max_attempts"),
            F.when(F.col("state") == "RETRY_WAIT", ended + backoff_seconds(n, base_backoff) * SECOND_US)
            .alias("next_attempt_us"),
            F.when(F.col("state") == "COMPLETE", ended).alias("completed_us"),
            F.when(F.col("state") == "FAILED", ended).alias("failed_us"),
            F.when(F.col("state") == "PROCESSING", ended).alias("lease_expires_us"),
            F.when(F.col("state") != "COMPLETE", F.col("last.error")).alias("last_error"),
            F.when(F.col("state") == "PENDING_QUEUE", "PENDING_QUEUE")
            .otherwise("QUEUED")
            .alias("queue_status"),
        )
    )


def is_pending(as_of_us: int) -> Column:
    due = (F.col("state") == "RETRY_WAIT") & (F.col("next_attempt_us") <= as_of_us)
    return (F.col("state") == "PENDING_QUEUE") | due


def is_claimable(as_of_us: int) -> Column:
    """Queued work, a due retry or a claim whose lease has run out."""
    expired = (F.col("state") == "PROCESSING") & (F.col("lease_expires_us") <= as_of_us)
    due = (F.col("state") == "RETRY_WAIT") & (F.col("next_attempt_us") <= as_of_us)
    return (F.col("state") == "QUEUED") | due | expired


def pending_jobs(status: DataFrame, as_of_us: int, limit: int = 100) -> DataFrame:
    return bounded_limit(
        status.where(is_pending(as_of_us)), [F.asc("created_us"), F.asc("job_id")], limit, 1000
    )


def recoverable_jobs(status: DataFrame, as_of_us: int, limit: int = 1000) -> DataFrame:
    """Pending work plus queued references that a lost queue would have held."""
    ready = is_pending(as_of_us) | (F.col("state") == "QUEUED")
    return bounded_limit(
        status.where(ready), [F.asc("created_us"), F.asc("job_id")], limit, 10000
    )


def queue_depth(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count_if(~F.col("state").isin(*FINAL_STATES)).alias("payload_processing_queue_depth")
    )
