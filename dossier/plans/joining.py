"""Joins and set operations: JN, SET."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions import fixed, rules
from dossier.functions.names import tokens
from dossier.operators import relations as R
from dossier.plans.bindings import Tables
from dossier.plans.registry import query


@query("jn_01_inner", "SELECT m.id, t.user_id, d.matter_id FROM mentions m JOIN filings d ON m.document_id = d.id JOIN matters t ON d.matter_id = t.id")
def inner(t: Tables) -> DataFrame:
    return R.mention_rows(t.mentions, t.filings, t.matters).select("id", "user_id", "matter_id")


@query("jn_02_left", """SELECT m.id, coalesce(d.filename, 'Unknown') AS filename, t.description AS matter FROM mentions m
    LEFT JOIN (SELECT * FROM filings WHERE NOT is_soft_deleted) d ON m.document_id = d.id LEFT JOIN matters t ON d.matter_id = t.id""")
def left(t: Tables) -> DataFrame:
    rows = R.mention_rows(t.mentions, t.filings.where("NOT is_soft_deleted"), t.matters, "left")
    return rows.select("id", F.coalesce("filename", F.lit("Unknown")).alias("filename"), "matter")


@query("jn_03_nested_links", """SELECT p.id, count(l.case_claim_id) AS links, coalesce(min(concat(c.claim_type, ':', l.relationship)), 'none') AS first_link
    FROM canonicals p LEFT JOIN links l ON l.person_id = p.id LEFT JOIN claims c ON l.case_claim_id = c.id GROUP BY p.id""")
def nested_links(t: Tables) -> DataFrame:
    linked = t.links.join(t.claims.select(F.col("id").alias("case_claim_id"), "claim_type"), "case_claim_id")
    nested = linked.groupBy(F.col("person_id").alias("id")).agg(F.collect_list(F.struct("case_claim_id", F.concat_ws(":", "claim_type", "relationship").alias("label"))).alias("of"))
    out = t.canonicals.join(nested, "id", "left")
    return out.select("id", F.coalesce(F.size("of"), F.lit(0)).cast("long").alias("links"), F.coalesce(F.array_min(F.transform("of", lambda x: x["label"])), F.lit("none")).alias("first_link"))


@query("jn_04_processed_chunks", "SELECT e.vec_id, d.doc_id FROM embeddings e JOIN documents d ON e.label = d.doc_id WHERE d.n_chars > 100 AND e.embedding IS NOT NULL")
def processed_chunks(t: Tables) -> DataFrame:
    chunks = t.embeddings.where("embedding IS NOT NULL").select("vec_id", F.col("label").cast("long").alias("doc_id"))
    return chunks.join(t.documents.where("n_chars > 100").select("doc_id"), "doc_id").select("vec_id", "doc_id")


@query("jn_05_claim_refs", """WITH refs AS (SELECT id, claim_ref % 50 AS matter_id, CASE WHEN id % 2 = 0 THEN 'allegation' ELSE 'defense' END AS claim_type, claim_ref % 30 + 1 AS n FROM mentions)
    SELECT r.id, c.id AS claim_id FROM refs r JOIN claims c ON r.matter_id = c.matter_id AND r.claim_type = c.claim_type AND r.n = c.claim_number_raw""")
def claim_refs(t: Tables) -> DataFrame:
    refs = t.mentions.select("id", F.expr("claim_ref % 50").alias("matter_id"), F.expr("CASE WHEN id % 2 = 0 THEN 'allegation' ELSE 'defense' END").alias("claim_type"), F.expr("claim_ref % 30 + 1").alias("n"))
    claims = t.claims.select(F.col("id").alias("claim_id"), "matter_id", "claim_type", F.col("claim_number_raw").cast("long").alias("n"))
    return refs.join(claims, ["matter_id", "claim_type", "n"]).select("id", "claim_id")


@query("jn_06_failed_documents", "SELECT DISTINCT d.id, d.retry_count FROM filings d JOIN matters t ON d.matter_id = t.id JOIN jobs j ON j.matter_id = t.id WHERE d.processing_error IS NOT NULL AND j.status = 'failed'")
def failed_documents(t: Tables) -> DataFrame:
    failing = t.jobs.where("status = 'failed'").select("matter_id").distinct()
    known = t.matters.select(F.col("id").alias("matter_id"))
    return t.filings.where("processing_error IS NOT NULL").join(known, "matter_id", "left_semi").join(failing, "matter_id", "left_semi").select("id", "retry_count").dropDuplicates(["id"])


@query("jn_07_semi_delete", "SELECT id FROM mentions WHERE document_id NOT IN (SELECT id FROM filings WHERE matter_id % 10 = 3)")
def semi_delete(t: Tables) -> DataFrame:
    gone = t.filings.where("matter_id % 10 = 3").select(F.col("id").alias("document_id"))
    return t.mentions.join(gone, "document_id", "left_anti").select("id")


@query("jn_08_snapshot", "SELECT d.id, d.matter_id, f.id IS NOT NULL AS in_snapshot FROM filings d LEFT JOIN (SELECT id FROM filings WHERE NOT is_soft_deleted AND updated_at < DATE '1997-01-01') f ON d.id = f.id")
def snapshot(t: Tables) -> DataFrame:
    """Today's documents against those that were live when the job was made."""
    frozen = t.filings.where("NOT is_soft_deleted AND updated_at < DATE '1997-01-01'").select("id", F.lit(True).alias("kept"))
    return t.filings.join(frozen, "id", "left").select("id", "matter_id", F.col("kept").isNotNull().alias("in_snapshot"))


@query("jn_09_absent", "SELECT id FROM filings WHERE id % 5 <> 0 AND id NOT IN (SELECT id FROM filings WHERE id % 7 <> 0)")
def absent(t: Tables) -> DataFrame:
    return t.filings.where("id % 5 <> 0").join(t.filings.where("id % 7 <> 0").select("id"), "id", "left_anti").select("id")


@query("jn_10_promotable_users", "SELECT DISTINCT user_id FROM jobs q WHERE status = 'queued' AND NOT EXISTS (SELECT 1 FROM jobs p WHERE p.user_id = q.user_id AND p.status = 'processing' AND p.id % 4 = 0)")
def promotable_users(t: Tables) -> DataFrame:
    busy = t.jobs.where("status = 'processing' AND id % 4 = 0").select("user_id")
    return t.jobs.where("status = 'queued'").select("user_id").distinct().join(busy, "user_id", "left_anti")


@query("jn_11_unlinked", "SELECT id, id IN (SELECT witness_id FROM links) AS is_linked FROM mentions")
def unlinked(t: Tables) -> DataFrame:
    linked = t.links.select(F.col("witness_id").alias("id")).distinct().withColumn("is_linked", F.lit(True))
    return t.mentions.select("id").join(linked, "id", "left").select("id", F.coalesce("is_linked", F.lit(False)).alias("is_linked"))


@query("jn_15_cached_text", """SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN d.text WHEN d.doc_id % 3 = 1 THEN d.text END AS text FROM documents d""")
def cached_text(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.col("doc_id").alias("external_id"), F.sha2("text", 256).alias("content_hash"))
    by_id = t.documents.where("doc_id % 3 <> 2").select(F.col("doc_id").alias("external_id"), F.expr("CASE WHEN doc_id % 3 = 0 THEN text ELSE '' END").alias("text"))
    hashes = t.documents.where("doc_id % 3 = 1").select(F.sha2("text", 256).alias("content_hash"), "text").dropDuplicates(["content_hash"])
    others = t.documents.where("doc_id % 3 = 2").select(F.sha2("text", 256).alias("content_hash"))
    only = docs.join(others.distinct(), "content_hash", "left_semi").where("doc_id % 3 = 2").select("doc_id")
    out = R.coalesced_text(docs, by_id, hashes).select("doc_id", "text").join(only.withColumn("none", F.lit(True)), "doc_id", "left")
    return out.select("doc_id", F.when(F.col("none").isNull(), F.col("text")).alias("text"))


@query("jn_16_record_ids", "SELECT d.id, 'rec-' || d.matter_id || '-' || d.id AS record_id FROM filings d WHERE d.id % 3 = 0")
def record_ids(t: Tables) -> DataFrame:
    records = t.filings.where("id % 3 = 0").select(F.concat_ws("-", F.lit("rec"), "matter_id", "id").alias("record_id"))
    parsed = records.withColumn("id", F.element_at(F.split("record_id", "-"), -1).try_cast("long"))
    return parsed.join(t.filings.select("id"), "id").select("id", "record_id")


@query("jn_17_concepts", "SELECT id, CASE " + " ".join("WHEN {} THEN '{}'".format(" OR ".join(f"contains(lower(claim_text), '{w}')" for w in c), c[0]) for c in fixed.CONCEPTS) + " END AS concept FROM claims")
def concepts(t: Tables) -> DataFrame:
    """The first concept, in the order of the dictionary, that a text names."""
    return t.claims.select("id", F.get(rules.concept_queries(F.col("claim_text"), 1), F.lit(0)).alias("concept"))


@query("jn_18_counts", """SELECT t.id, count(DISTINCT d.id) AS documents, count(m.id) AS mentions FROM matters t
    LEFT JOIN filings d ON d.matter_id = t.id LEFT JOIN mentions m ON m.document_id = d.id GROUP BY t.id""")
def counts(t: Tables) -> DataFrame:
    per_document = t.mentions.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n"))
    per_matter = t.filings.join(per_document, "id", "left").groupBy("matter_id").agg(F.count("*").alias("documents"), F.sum("n").alias("mentions"))
    out = t.matters.join(per_matter.withColumnRenamed("matter_id", "id"), "id", "left")
    return out.select("id", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("mentions", F.lit(0)).alias("mentions"))


@query("jn_21_user_organization", "SELECT m.id, o.name, o.subscription_status FROM matters m LEFT JOIN (SELECT * FROM organizations WHERE id % 6 > 0) o ON m.user_id = o.id")
def user_organization(t: Tables) -> DataFrame:
    o = t.organizations.where("id % 6 > 0").select(F.col("id").alias("user_id"), "name", "subscription_status")
    return t.matters.join(o, "user_id", "left").select("id", "name", "subscription_status")


@query("jn_22_selected", "SELECT matter_id, id FROM jobs WHERE status = 'completed' AND id % 7 < 2")
def selected(t: Tables) -> DataFrame:
    wanted = t.jobs.where("id % 7 < 2").select("matter_id", "id")
    return t.jobs.where("status = 'completed'").join(wanted, ["matter_id", "id"], "left_semi").select("matter_id", "id")


@query("jn_23_latest_job", "SELECT d.id, j.job FROM filings d JOIN (SELECT matter_id, arg_max(id, id) AS job FROM jobs GROUP BY matter_id) j USING (matter_id)")
def latest_job(t: Tables) -> DataFrame:
    newest = R.latest(t.jobs, ["matter_id"], [F.desc("created_at"), F.desc("id")]).select("matter_id", F.col("id").alias("job"))
    return t.filings.join(newest, "matter_id").select("id", "job")


@query("set_01_union_first", """WITH u AS (SELECT id, 1 AS query_no FROM claims WHERE id % 2 = 0 UNION ALL SELECT id, 2 FROM claims WHERE id % 3 = 0 UNION ALL SELECT id, 3 FROM claims WHERE id % 5 = 0)
    SELECT id, min(query_no) AS query_no FROM u GROUP BY id""")
def union_first(t: Tables) -> DataFrame:
    lists = [t.claims.where(f"id % {k} = 0").select("id", F.lit(n).alias("query_no")) for n, k in ((1, 2), (2, 3), (3, 5))]
    every = lists[0].unionByName(lists[1]).unionByName(lists[2])
    return R.latest(every, ["id"], [F.col("query_no")])


@query("set_02_assets", "SELECT doc_id AS id, 'text' AS kind FROM documents UNION ALL SELECT page_id, 'image' FROM pages")
def assets(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id"), F.lit("text").alias("kind")).unionByName(t.pages.select(F.col("page_id").alias("id"), F.lit("image").alias("kind")))


@query("set_03_tagged", "SELECT id, claim_type FROM claims")
def tagged(t: Tables) -> DataFrame:
    kinds = [t.claims.where(F.col("claim_type") == k).select("id", F.lit(k).alias("claim_type")) for k in ("allegation", "defense")]
    return kinds[0].unionByName(kinds[1])


@query("set_04_difference", "SELECT id FROM filings WHERE id % 5 <> 0 EXCEPT SELECT id FROM filings WHERE id % 7 <> 0")
def difference(t: Tables) -> DataFrame:
    return t.filings.where("id % 5 <> 0").select("id").exceptAll(t.filings.where("id % 7 <> 0").select("id"))


@query("set_05_token_sets", """WITH w AS (SELECT id, list_distinct(string_split(lower(full_name), ' ')) AS a, ['john', 'smith', 'carroll'] AS b FROM mentions)
    SELECT id, len(list_intersect(a, b)) AS shared, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS other FROM w""")
def token_sets(t: Tables) -> DataFrame:
    a, b = F.array_distinct(tokens(F.lower("full_name"))), F.array(*map(F.lit, ("john", "smith", "carroll")))
    return t.mentions.select("id", F.size(F.array_intersect(a, b)).cast("long").alias("shared"), F.size(F.array_except(a, b)).cast("long").alias("other"))


@query("set_06_last_wins", "SELECT user_id, arg_max(value, id) AS value FROM jobs GROUP BY user_id")
def last_wins(t: Tables) -> DataFrame:
    return R.latest(t.jobs, ["user_id"], [F.desc("id")]).select("user_id", "value")


