"""Aggregations: AGG."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.operators import relations as R
from dossier.plans.bindings import Tables
from dossier.plans.registry import query


@query("agg_01_total", "SELECT count(*) AS total FROM mentions WHERE importance = 'high' AND contains(lower(full_name), 'smith')")
def total(t: Tables) -> DataFrame:
    return R.matching(t.mentions, equal={"importance": "high"}, contains={"full_name": "smith"}).agg(F.count("*").alias("total"))


@query("agg_02_job_stats", "SELECT " + ", ".join(f"count(*) FILTER (WHERE status = '{s}' AND NOT is_archived) AS {s}" for s in ("queued", "processing", "completed", "failed", "cancelled")) + ", count(*) FILTER (WHERE is_archived) AS archived FROM jobs")
def job_stats(t: Tables) -> DataFrame:
    kinds = ("queued", "processing", "completed", "failed", "cancelled")
    return t.jobs.agg(*[F.count_if((F.col("status") == s) & ~F.col("is_archived")).alias(s) for s in kinds], F.count_if("is_archived").alias("archived"))


@query("agg_03_processed_share", "SELECT matter_id, count(*) AS total, count(*) FILTER (WHERE is_processed) AS processed FROM filings GROUP BY matter_id")
def processed_share(t: Tables) -> DataFrame:
    return t.filings.groupBy("matter_id").agg(F.count("*").alias("total"), F.count_if("is_processed").alias("processed"))


@query("agg_04_next_number", "SELECT t.id AS matter_id, coalesce(max(c.claim_number_raw), 0)::BIGINT + 1 AS next FROM matters t LEFT JOIN claims c ON c.matter_id = t.id AND c.claim_type = 'defense' GROUP BY t.id")
def next_number(t: Tables) -> DataFrame:
    highest = t.claims.where("claim_type = 'defense'").groupBy("matter_id").agg(F.max("claim_number_raw").cast("long").alias("n"))
    return t.matters.select(F.col("id").alias("matter_id")).join(highest, "matter_id", "left").select("matter_id", (F.coalesce("n", F.lit(0)) + 1).alias("next"))


@query("agg_05_filter_values", "SELECT string_agg(DISTINCT status, '|' ORDER BY status) AS statuses, string_agg(DISTINCT practice_area, '|' ORDER BY practice_area) AS areas, count(DISTINCT client_name) AS clients FROM matters")
def filter_values(t: Tables) -> DataFrame:
    return t.matters.agg(*[F.array_join(F.array_sort(F.collect_set(c)), "|").alias(a) for c, a in (("status", "statuses"), ("practice_area", "areas"))], F.size(F.collect_set("client_name")).cast("long").alias("clients"))


@query("agg_06_job_rollup", """SELECT d.matter_id, count(*) FILTER (WHERE d.processing_error IS NULL) AS success, count(*) FILTER (WHERE d.processing_error IS NOT NULL) AS failed, coalesce(sum(m.n), 0)::BIGINT AS witnesses
    FROM filings d LEFT JOIN (SELECT document_id, count(*) AS n FROM mentions GROUP BY document_id) m ON d.id = m.document_id GROUP BY d.matter_id""")
def job_rollup(t: Tables) -> DataFrame:
    per = t.mentions.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n"))
    summary = F.struct(F.count_if(F.col("processing_error").isNull()).alias("success"), F.count_if(F.col("processing_error").isNotNull()).alias("failed"), F.coalesce(F.sum("n"), F.lit(0)).alias("witnesses"))
    return t.filings.join(per, "id", "left").groupBy("matter_id").agg(summary.alias("s")).select("matter_id", "s.*")


@query("agg_07_recomputed", """SELECT t.id, (SELECT count(*) FROM filings d WHERE d.matter_id = t.id AND d.is_processed) AS processed,
    (SELECT count(*) FROM filings d WHERE d.matter_id = t.id AND d.processing_error IS NOT NULL) AS failed,
    (SELECT count(*) FROM filings d JOIN mentions m ON m.document_id = d.id WHERE d.matter_id = t.id) AS mentions,
    (SELECT count(*) FROM canonicals c WHERE c.matter_id = t.id) AS canonicals FROM matters t""")
def recomputed(t: Tables) -> DataFrame:
    docs = t.filings.groupBy("matter_id").agg(F.count_if("is_processed").alias("processed"), F.count_if(F.col("processing_error").isNotNull()).alias("failed"))
    said = t.mentions.join(t.filings.select(F.col("id").alias("document_id"), "matter_id"), "document_id").groupBy("matter_id").agg(F.count("*").alias("mentions"))
    people = t.canonicals.groupBy("matter_id").agg(F.count("*").alias("canonicals"))
    out = t.matters.select(F.col("id").alias("matter_id"))
    for part in (docs, said, people):
        out = out.join(part, "matter_id", "left")
    return out.na.fill(0).withColumnRenamed("matter_id", "id")


@query("agg_08_canonical_stats", """SELECT count(*) AS total, count(*) FILTER (WHERE canonical_id % 9 > 0) AS linked, count(*) FILTER (WHERE canonical_id % 9 = 0) AS unlinked,
    round((1 - count(DISTINCT CASE WHEN canonical_id % 9 > 0 THEN canonical_id END) / count(*)) * 100, 1) AS ratio FROM mentions""")
def canonical_stats(t: Tables) -> DataFrame:
    linked = F.col("canonical_id") % 9 > 0
    people = F.count_distinct(F.when(linked, F.col("canonical_id")))
    ratio = F.when(F.count("*") == 0, F.lit(0.0)).otherwise(F.round((1 - people / F.count("*")) * 100, 1))
    return t.mentions.agg(F.count("*").alias("total"), F.count_if(linked).alias("linked"), F.count_if(~linked).alias("unlinked"), ratio.alias("ratio"))


_ROLE = "CASE role WHEN 'expert' THEN 2 WHEN 'attorney' THEN 4 WHEN 'eyewitness' THEN 6 ELSE 11 END"
_REL = "CASE relevance WHEN 'not_relevant' THEN 0 WHEN 'somewhat_relevant' THEN 1 WHEN 'relevant' THEN 2 WHEN 'highly_relevant' THEN 3 ELSE -1 END"


@query("agg_09_merged_people", f"""SELECT canonical_id, arg_max(full_name, (length(full_name), -id)) AS full_name, arg_min(role, ({_ROLE}, id)) AS role, max({_REL}) AS rank,
      string_agg(relevance_reason, ' | ' ORDER BY id) AS relevance_reason, arg_min(email, id) FILTER (WHERE email IS NOT NULL) AS email, arg_min(phone, id) FILTER (WHERE phone IS NOT NULL) AS phone,
      arg_min(address, id) FILTER (WHERE address IS NOT NULL) AS address, max(confidence_score) AS max_confidence, count(DISTINCT document_id) AS documents, count(*) AS mentions, count(observation) AS observations
      FROM mentions GROUP BY canonical_id""")
def merged_people(t: Tables) -> DataFrame:
    from dossier.functions.text import relevance_rank

    found = R.merged_people(t.mentions, ["canonical_id"])
    return found.withColumn("rank", relevance_rank(F.col("relevance"))).drop("relevance")


@query("agg_10_relevancy_stats", """SELECT c.matter_id, count(DISTINCT c.id) FILTER (WHERE claim_type = 'allegation') AS allegations, count(DISTINCT c.id) FILTER (WHERE claim_type = 'defense') AS defenses,
    count(DISTINCT l.person_id) AS linked FROM claims c LEFT JOIN links l ON l.case_claim_id = c.id GROUP BY c.matter_id""")
def relevancy_stats(t: Tables) -> DataFrame:
    kinds = t.claims.groupBy("matter_id").agg(F.count_if(F.col("claim_type") == "allegation").alias("allegations"), F.count_if(F.col("claim_type") == "defense").alias("defenses"))
    people = t.links.join(t.claims.select(F.col("id").alias("case_claim_id"), "matter_id"), "case_claim_id").groupBy("matter_id").agg(F.count_distinct("person_id").alias("linked"))
    return kinds.join(people, "matter_id", "left").na.fill(0)


@query("agg_11_witness_relevance", """WITH s AS (SELECT p.id, count(l.case_claim_id) AS n, coalesce(sum(CASE WHEN relationship = 'supports' THEN 2 WHEN relationship IS NULL THEN 0 ELSE 1 END), 0)::BIGINT AS score
      FROM (SELECT id, id AS key FROM canonicals UNION SELECT -id, id FROM mentions) p LEFT JOIN (SELECT person_id AS id, * FROM links UNION ALL SELECT -witness_id, * FROM links) l ON l.id = p.id GROUP BY p.id)
    SELECT id, score, CASE WHEN n = 0 THEN 'UNKNOWN' WHEN score >= 4 OR n >= 3 THEN 'HIGHLY_RELEVANT' WHEN score >= 2 THEN 'RELEVANT' ELSE 'SOMEWHAT_RELEVANT' END AS level FROM s""")
def witness_relevance(t: Tables) -> DataFrame:
    from dossier.operators.claims import relevance_levels

    people = t.canonicals.select("id").unionByName(t.mentions.select((-F.col("id")).alias("id")).distinct())
    of_person = t.links.withColumn("id", F.col("person_id")).unionByName(t.links.withColumn("id", -F.col("witness_id")))
    return relevance_levels(people, of_person, "id")


@query("agg_12_authority_stats", "SELECT source, count(*) AS documents, count(*) FILTER (WHERE n_chars > 500) AS processed, sum(greatest(1, ceil(n_chars / 800)))::BIGINT AS chunks FROM documents GROUP BY source")
def authority_stats(t: Tables) -> DataFrame:
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 800))
    return t.documents.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("n_chars") > 500).alias("processed"), F.sum(chunks).cast("long").alias("chunks"))


@query("agg_13_pivot", "SELECT conv_id, arg_min(length(text), turn) FILTER (WHERE role = 'user') AS relevance, arg_min(length(text), turn) FILTER (WHERE role = 'assistant') AS irac FROM conversations GROUP BY conv_id")
def pivot(t: Tables) -> DataFrame:
    def first(kind: str):
        return F.min_by(F.length("text").cast("long"), F.when(F.col("role") == kind, F.col("turn")))

    return t.conversations.groupBy("conv_id").agg(first("user").alias("relevance"), first("assistant").alias("irac"))


@query("agg_14_daily_usage", "SELECT user_id, ts::DATE::VARCHAR AS day, count(*) AS used FROM events WHERE event_type = 'purchase' GROUP BY 1, 2")
def daily_usage(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'purchase'").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("used"))


@query("agg_15_credits", "SELECT user_id % 25 AS organization_id, sum(floor(value))::BIGINT AS credits FROM events WHERE event_type = 'purchase' GROUP BY 1")
def credits(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'purchase'").groupBy((F.col("user_id") % 25).alias("organization_id")).agg(F.sum(F.floor("value")).cast("long").alias("credits"))


@query("agg_16_batch_totals", "SELECT count(*) AS polled, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, sum(total_documents)::BIGINT AS records FROM jobs")
def batch_totals(t: Tables) -> DataFrame:
    return t.jobs.agg(F.count("*").alias("polled"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("total_documents").alias("records"))


@query("agg_17_page_kinds", "SELECT source, count(*) FILTER (WHERE n_chars >= 485) AS text_pages, count(*) FILTER (WHERE n_chars < 485) AS scanned_pages FROM documents GROUP BY source")
def page_kinds(t: Tables) -> DataFrame:
    is_text = (F.col("n_chars") >= 100) & (F.col("n_chars") / 484704.0 >= 0.001)
    return t.documents.groupBy("source").agg(F.count_if(is_text).alias("text_pages"), F.count_if(~is_text).alias("scanned_pages"))


@query("agg_19_enabled_users", "SELECT count(*) AS users FROM (SELECT DISTINCT user_id FROM events) WHERE coalesce(user_id % 10 <> 3, true)")
def enabled_users(t: Tables) -> DataFrame:
    users = t.events.select("user_id", (F.col("user_id") % 10 != 3).alias("enabled")).distinct()
    return users.agg(F.count_if(F.coalesce("enabled", F.lit(True))).alias("users"))
