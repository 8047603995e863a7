"""Operations analytics: stuck jobs, retries, admission and credits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.operators.running import RANGE_ROWS, ranged, running

FREE_A_DAY = 10


def stuck_jobs(jobs: DataFrame, progress: DataFrame, now: Column) -> DataFrame:
    """(id, action) of running jobs without activity for five minutes: finalize from 95 % processed on, else resume;
    jobs of an unknown type fail. progress: matter_id, total, processed."""
    idle = F.col("last_activity_at").isNull() | (F.col("last_activity_at") < now - F.expr("INTERVAL 5 MINUTES"))
    rows = jobs.where((F.col("status") == "processing") & F.col("is_resumable") & idle).join(progress, "matter_id", "left")
    done = (F.coalesce("total", F.lit(0)) > 0) & (F.col("processed") >= 0.95 * F.col("total"))
    known = F.col("job_type").isin("single_matter", "full_database")
    return rows.select("id", F.when(~known, "fail").when(done, "finalize").otherwise("resume").alias("action"))


def retries(documents: DataFrame, now: Column, most: int | None = None) -> DataFrame:
    """Failed documents whose back-off is over: at once up to 2 tries, 5 minutes up to 5, 30 minutes up to 9, then 2 hours."""
    n = F.col("retry_count")
    wait = F.when(n <= 2, F.expr("INTERVAL 0 MINUTES")).when(n <= 5, F.expr("INTERVAL 5 MINUTES")).when(n <= 9, F.expr("INTERVAL 30 MINUTES")).otherwise(F.expr("INTERVAL 120 MINUTES"))
    due = documents.where(F.col("processing_error").isNotNull() & (F.col("updated_at") <= now - wait))
    return due if most is None else due.orderBy("retry_count", "updated_at", "id").limit(most)


def sync_state(matters: DataFrame, now: Column) -> DataFrame:
    """sync_status with syncs of over 30 minutes marked as failed."""
    stale = (F.col("sync_status") == "syncing") & (F.col("sync_started_at") < now - F.expr("INTERVAL 30 MINUTES"))
    return matters.withColumn("sync_status", F.when(stale, "failed").otherwise(F.col("sync_status")))


def admission(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """(id, admission): conflict while the matter has an active job, queued while the user has one, else pending."""
    active = jobs.where(F.col("status").isin("processing", "queued", "pending"))
    matters = active.select("matter_id").distinct().withColumn("m", F.lit(True))
    users = active.where("status = 'processing'").select("user_id").distinct().withColumn("u", F.lit(True))
    out = requests.join(matters, "matter_id", "left").join(users, "user_id", "left")
    return out.select("id", F.when(F.col("m"), "conflict").when(F.col("u"), "queued").otherwise("pending").alias("admission"))


def credit_decisions(requests: DataFrame, organizations: DataFrame, free: int = FREE_A_DAY, rows: int = RANGE_ROWS) -> DataFrame:
    """requests (id, user_id, organization_id, ts) with decision: paid, free (first of a user's day), balance, denied.

    Subscribed organizations pay nothing here; the balance covers an organization's requests beyond the free ones in order.
    A user's day and an organization may hold any share of the requests: their running counts are made by ranges of time. A null user
    or organization counts as one of its own; requests that repeat count as often.
    """
    o = organizations.select(F.col("id").alias("organization_id"), "subscription_status", "bonus_credits")
    asked = requests.join(o, "organization_id", "left")
    paid = F.coalesce(F.col("subscription_status").isin("active", "trialing"), F.lit(False))
    order = [F.col("ts"), F.col("id")]
    asked = running(ranged(asked, order, rows), [F.col("user_id"), F.to_date("ts")], order, "of_day")
    within = paid | (F.col("of_day") <= free)
    asked = running(asked.withColumn("within", within), [F.col("organization_id")], order, "beyond", F.when(F.col("within"), 0).otherwise(1).cast("long"))
    covered = F.col("beyond") <= F.coalesce("bonus_credits", F.lit(0))
    return asked.select("id", F.when(paid, "paid").when(F.col("within"), "free").when(covered, "balance").otherwise("denied").alias("decision"))
