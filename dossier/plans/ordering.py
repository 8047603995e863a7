"""Windows, orders and pages: WIN, SRT."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.text import cosine, relevance_rank
from dossier.operators import claims as C
from dossier.operators import relations as R
from dossier.operators.running import ranged, running
from dossier.plans.bindings import Tables
from dossier.plans.registry import query


def _place(*key: str):
    return lambda *order: F.row_number().over(Window.partitionBy(*key).orderBy(*order))


@query("win_01_renumber_jobs", "SELECT id, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id)::INTEGER AS job_number FROM jobs")
def renumber_jobs(t: Tables) -> DataFrame:
    return t.jobs.select("id", _place("user_id")("created_at", "id").alias("job_number"))


@query("win_02_queue_position", "SELECT id, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id)::INTEGER AS queue_position FROM jobs WHERE status = 'queued'")
def queue_position(t: Tables) -> DataFrame:
    return t.jobs.where("status = 'queued'").select("id", _place("user_id")("created_at", "id").alias("queue_position"))


@query("win_03_claim_numbers", """WITH old AS (SELECT matter_id, claim_type, max(claim_number_raw)::BIGINT AS base FROM claims WHERE id % 3 > 0 GROUP BY ALL), new AS (SELECT * FROM claims WHERE id % 3 = 0)
    SELECT n.matter_id, n.claim_type, coalesce(base, 0) + row_number() OVER (PARTITION BY n.matter_id, n.claim_type ORDER BY n.id) AS claim_number, claim_text, coalesce(confidence, 0.8) AS confidence
    FROM new n LEFT JOIN old USING (matter_id, claim_type)""")
def claim_numbers(t: Tables) -> DataFrame:
    old = t.claims.where("id % 3 > 0").withColumn("claim_number", F.col("claim_number_raw").cast("long"))
    return C.add_claims(old, t.claims.where("id % 3 = 0").withColumn("seq", F.col("id")))


@query("win_04_latest_record", "SELECT matter_id, max(id) AS id FROM jobs GROUP BY matter_id")
def latest_record(t: Tables) -> DataFrame:
    return R.latest(t.jobs, ["matter_id"], [F.desc("created_at"), F.desc("id")]).select("matter_id", "id")


@query("win_05_first_per_case", "SELECT claim_ref, arg_min(id, (source_page IS NULL, source_page, id)) AS id FROM mentions GROUP BY claim_ref")
def first_per_case(t: Tables) -> DataFrame:
    return R.latest(t.mentions, ["claim_ref"], [F.asc_nulls_last("source_page"), F.col("id")]).select("claim_ref", "id")


@query("win_06_reasons", """WITH n AS (SELECT l.person_id, concat(upper(substr(c.claim_type, 1, 1)), c.claim_number_raw::BIGINT, ': ', l.explanation) AS r,
      row_number() OVER (PARTITION BY l.person_id ORDER BY l.case_claim_id, l.explanation) AS n FROM links l JOIN claims c ON l.case_claim_id = c.id)
    SELECT person_id, string_agg(r, '; ' ORDER BY n) AS reason FROM n WHERE n <= 3 GROUP BY person_id""")
def reasons(t: Tables) -> DataFrame:
    return C.reasons(t.links, t.claims.withColumn("claim_number", F.col("claim_number_raw").cast("long")), "person_id")


@query("win_07_group_rows", """WITH g AS (SELECT document_id, count(*) AS n FROM mentions GROUP BY 1)
    SELECT document_id, n, CASE WHEN n = 1 THEN 1 ELSE n + 1 END AS report_rows FROM g""")
def group_rows(t: Tables) -> DataFrame:
    sized = t.mentions.withColumn("n", F.count("*").over(Window.partitionBy("document_id")))
    first = _place("document_id")("id")
    kinds = F.when(F.col("n") == 1, F.array(F.lit("single"))).when(F.col("first") == 1, F.array(F.lit("summary"), F.lit("detail"))).otherwise(F.array(F.lit("detail")))
    rows = sized.withColumn("first", first).select("document_id", "n", F.explode(kinds).alias("kind"))
    return rows.groupBy("document_id", "n").agg(F.count("*").alias("report_rows"))


@query("win_08_turn_batches", "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS batch FROM conversations")
def turn_batches(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.floor((_place("conv_id")("turn") - 1) / 3).alias("batch"))


@query("win_09_page_chunks", "SELECT document_id, (coalesce(source_page, 1) - 1) // 2 AS chunk, count(*) AS pages FROM mentions GROUP BY 1, 2")
def page_chunks(t: Tables) -> DataFrame:
    chunk = F.floor((F.coalesce("source_page", F.lit(1)) - 1) / 2).alias("chunk")
    return t.mentions.groupBy("document_id", chunk).agg(F.count("*").alias("pages"))


@query("win_10_first_observation", "SELECT canonical_id, document_id, min(id) AS id FROM mentions WHERE observation IS NOT NULL GROUP BY 1, 2")
def first_observation(t: Tables) -> DataFrame:
    return R.latest(t.mentions.where("observation IS NOT NULL"), ["canonical_id", "document_id"], [F.col("id")]).select("canonical_id", "document_id", "id")


@query("win_11_promotion", "SELECT user_id, arg_min(id, (created_at, id)) AS id FROM jobs WHERE status = 'queued' GROUP BY user_id")
def promotion(t: Tables) -> DataFrame:
    return t.jobs.where("status = 'queued'").groupBy("user_id").agg(F.min_by("id", F.struct("created_at", "id")).alias("id"))


@query("win_12_running_use", "SELECT event_id, count(*) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM events WHERE event_type = 'purchase'")
def running_use(t: Tables) -> DataFrame:
    order = [F.col("ts"), F.col("event_id")]
    rows = ranged(t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), order)
    return running(rows, [F.col("user_id"), F.to_date("ts")], order, "used").select("event_id", "used")


@query("srt_01_page", "SELECT id, full_name FROM mentions ORDER BY full_name, id LIMIT 50 OFFSET 100")
def page(t: Tables) -> DataFrame:
    return R.page(t.mentions, [F.col("full_name"), F.col("id")], 3, 50).select("id", "full_name")


@query("srt_02_by_importance", "SELECT id, importance, full_name FROM mentions ORDER BY CASE importance WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, full_name, id LIMIT 100")
def by_importance(t: Tables) -> DataFrame:
    return R.page(t.mentions, [R.importance_rank(F.col("importance")), F.col("full_name"), F.col("id")], 1, 100).select("id", "importance", "full_name")


@query("srt_03_canonicals", "SELECT id, source_document_count FROM canonicals ORDER BY source_document_count DESC, full_name LIMIT 40")
def canonicals(t: Tables) -> DataFrame:
    return R.page(t.canonicals, [F.desc("source_document_count"), F.col("full_name")], 1, 40).select("id", "source_document_count")


@query("srt_04_matters", "SELECT id, client_name FROM matters ORDER BY client_name DESC NULLS LAST, id")
def matters(t: Tables) -> DataFrame:
    return R.sorted_matters(t.matters, "client_name", descending=True).select("id", "client_name")


@query("srt_05_claims", "SELECT id, confidence FROM claims ORDER BY confidence DESC NULLS LAST, id LIMIT 10")
def top_claims(t: Tables) -> DataFrame:
    return t.claims.orderBy(F.desc_nulls_last("confidence"), "id").limit(10).select("id", "confidence")


@query("srt_06_top_chunks", """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 9) AS sim FROM embeddings, q)
    SELECT vec_id, round(sim, 6) AS similarity FROM s ORDER BY sim DESC, vec_id LIMIT 5""")
def top_chunks(t: Tables) -> DataFrame:
    rows = t.spark.sql("SELECT vec_id, embedding, (SELECT first(embedding) FROM {e} WHERE vec_id = 0) AS q FROM {e}", e=t.embeddings)
    scored = rows.withColumn("s", F.round(cosine(F.col("embedding"), F.col("q")), 9))
    return scored.orderBy(F.desc("s"), "vec_id").limit(5).select("vec_id", F.round("s", 6).alias("similarity"))


@query("srt_07_uncertain", "SELECT canonical_id, round(list_sum(list_slice(list_reverse_sort(list(confidence_score)), 1, 3)), 6) AS top3 FROM mentions GROUP BY canonical_id")
def uncertain(t: Tables) -> DataFrame:
    top = t.mentions.withColumn("n", _place("canonical_id")(F.desc("confidence_score"), "id")).where("n <= 3")
    return top.groupBy("canonical_id").agg(F.round(F.sum("confidence_score"), 6).alias("top3"))


@query("srt_08_report_order", """SELECT id, relevance FROM canonicals ORDER BY coalesce(CASE relevance WHEN 'highly_relevant' THEN 0 WHEN 'relevant' THEN 1 WHEN 'somewhat_relevant' THEN 2 WHEN 'not_relevant' THEN 3 END, 1), id""")
def report_order(t: Tables) -> DataFrame:
    rank = relevance_rank(F.col("relevance"))
    return t.canonicals.orderBy(F.when(rank < 0, 1).otherwise(3 - rank), "id").select("id", "relevance")


@query("srt_09_retry_order", "SELECT id FROM filings WHERE processing_error IS NOT NULL ORDER BY retry_count, updated_at, id LIMIT 10")
def retry_order(t: Tables) -> DataFrame:
    return t.filings.where("processing_error IS NOT NULL").orderBy("retry_count", "updated_at", "id").limit(10).select("id")


@query("srt_10_research_order", "SELECT id FROM claims ORDER BY confidence DESC NULLS LAST, id LIMIT 15")
def research_order(t: Tables) -> DataFrame:
    return t.claims.orderBy(F.desc_nulls_last("confidence"), "id").limit(15).select("id")


@query("srt_11_assets", "SELECT id, coalesce(source_page, 0) AS page FROM mentions ORDER BY coalesce(source_page, 0), id")
def asset_order(t: Tables) -> DataFrame:
    return t.mentions.orderBy(F.coalesce("source_page", F.lit(0)), "id").select("id", F.coalesce("source_page", F.lit(0)).alias("page"))


@query("srt_12_usage_history", "SELECT ts::DATE::VARCHAR AS day, count(*) AS used FROM events WHERE event_type = 'purchase' AND ts::DATE >= (SELECT max(ts)::DATE - 5 FROM events) GROUP BY 1 ORDER BY 1 DESC")
def usage_history(t: Tables) -> DataFrame:
    recent = t.events.where("event_type = 'purchase'").where(F.to_date("ts") >= F.date_sub(F.to_date(F.lit(t.now)), 5))
    return recent.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("used")).orderBy(F.desc("day"))


@query("srt_13_newest", "SELECT id FROM jobs ORDER BY created_at DESC, id DESC")
def newest(t: Tables) -> DataFrame:
    return t.jobs.orderBy(F.desc("created_at"), F.desc("id")).select("id")
