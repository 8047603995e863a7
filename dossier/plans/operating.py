"""Operations: OPS, QTA."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.operators import ops as O
from dossier.plans.bindings import Tables
from dossier.plans.registry import query


@query("ops_01_stuck_jobs", """WITH p AS (SELECT matter_id, count(*) AS total, count(*) FILTER (WHERE is_processed) AS processed FROM filings GROUP BY 1), n AS (SELECT max(ts) AS now FROM events)
    SELECT j.id, CASE WHEN j.id % 11 = 0 THEN 'fail' WHEN coalesce(total, 0) > 0 AND processed >= 0.95 * total THEN 'finalize' ELSE 'resume' END AS action
    FROM jobs j CROSS JOIN n LEFT JOIN p USING (matter_id) WHERE status = 'processing' AND j.id % 2 = 0 AND (last_activity_at IS NULL OR last_activity_at < now - INTERVAL 5 MINUTE)""")
def stuck_jobs(t: Tables) -> DataFrame:
    jobs = t.jobs.withColumns({"is_resumable": F.expr("id % 2 = 0"), "job_type": F.expr("CASE WHEN id % 11 = 0 THEN 'other' ELSE 'single_matter' END")})
    progress = t.filings.groupBy("matter_id").agg(F.count("*").alias("total"), F.count_if("is_processed").alias("processed"))
    return O.stuck_jobs(jobs, progress, F.lit(t.now))


@query("ops_02_retries", """SELECT id FROM filings WHERE processing_error IS NOT NULL AND updated_at <= (SELECT max(updated_at) FROM filings)
    - CASE WHEN retry_count <= 2 THEN INTERVAL 0 MINUTE WHEN retry_count <= 5 THEN INTERVAL 5 MINUTE WHEN retry_count <= 9 THEN INTERVAL 30 MINUTE ELSE INTERVAL 120 MINUTE END""")
def retries(t: Tables) -> DataFrame:
    now = t.filings.agg(F.max("updated_at")).first()[0]
    return O.retries(t.filings, F.lit(now)).select("id")


@query("ops_03_stale_syncs", """SELECT id, CASE WHEN id % 3 = 0 AND created_at < (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE THEN 'failed' WHEN id % 3 = 0 THEN 'syncing' ELSE 'idle' END AS sync_status FROM jobs""")
def stale_syncs(t: Tables) -> DataFrame:
    rows = t.jobs.select("id", F.expr("CASE WHEN id % 3 = 0 THEN 'syncing' ELSE 'idle' END").alias("sync_status"), F.col("created_at").alias("sync_started_at"))
    return O.sync_state(rows, F.lit(t.now)).select("id", "sync_status")


@query("ops_04_admission", """WITH a AS (SELECT * FROM jobs WHERE status IN ('processing', 'queued'))
    SELECT id, CASE WHEN matter_id IN (SELECT matter_id FROM a) THEN 'conflict' WHEN user_id IN (SELECT user_id FROM a WHERE status = 'processing') THEN 'queued' ELSE 'pending' END AS admission FROM jobs WHERE status = 'completed'""")
def admission(t: Tables) -> DataFrame:
    return O.admission(t.jobs.where("status = 'completed'"), t.jobs)


@query("qta_01_credits", """WITH r AS (SELECT event_id AS id, user_id, user_id % 25 AS org, ts FROM events WHERE event_type <> 'view'),
    w AS (SELECT r.*, o.bonus_credits, o.subscription_status IN ('active', 'trialing') AS paid, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, r.id) <= 2 AS in_free FROM r JOIN organizations o ON o.id = r.org),
    b AS (SELECT *, sum(CASE WHEN paid OR in_free THEN 0 ELSE 1 END) OVER (PARTITION BY org ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS beyond FROM w)
    SELECT id, CASE WHEN paid THEN 'paid' WHEN in_free THEN 'free' WHEN beyond <= bonus_credits THEN 'balance' ELSE 'denied' END AS decision FROM b""")
def credits(t: Tables) -> DataFrame:
    rows = t.events.where("event_type <> 'view'").select(F.col("event_id").alias("id"), "user_id", (F.col("user_id") % 25).alias("organization_id"), "ts")
    return O.credit_decisions(rows, t.organizations, free=2)
