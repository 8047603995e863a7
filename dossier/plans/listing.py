"""Projections and filters: PRJ, FLT."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions import fixed, rules
from dossier.operators import relations as R
from dossier.plans.bindings import Tables
from dossier.plans.registry import query

_ROWS = "mentions m JOIN filings d ON m.document_id = d.id JOIN matters t ON d.matter_id = t.id"


def _has(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


@query("prj_01_mention_rows", f"SELECT m.id, m.full_name, upper(m.importance) AS importance, d.filename, t.description AS matter FROM {_ROWS}")
def mention_rows(t: Tables) -> DataFrame:
    return R.mention_rows(t.mentions, t.filings, t.matters).select("id", "full_name", F.upper("importance").alias("importance"), "filename", "matter")


@query("prj_02_canonical_observations", """SELECT canonical_id, document_id, id AS mention, coalesce(document_id, 0) AS doc_id, coalesce(filename, 'Unknown') AS filename, source_page AS page, coalesce(observation, '') AS text
    FROM mentions LEFT JOIN (SELECT id AS document_id, filename FROM filings) USING (document_id)""")
def canonical_observations(t: Tables) -> DataFrame:
    """The observations of a person with the keys of its view: each person's array, put out one entry a row again."""
    files = t.filings.select(F.col("id").alias("document_id"), "filename")
    told = F.struct("document_id", F.col("id").alias("mention"), F.coalesce("document_id", F.lit(0)).alias("doc_id"), F.coalesce("filename", F.lit("Unknown")).alias("filename"), F.col("source_page").alias("page"), F.coalesce("observation", F.lit("")).alias("text"))
    return t.mentions.join(files, "document_id", "left").select("canonical_id", told.alias("o")).select("canonical_id", "o.*")


@query("prj_03_job_rows", """SELECT j.id, CASE WHEN total_documents = 0 THEN 0.0 ELSE round(processed_documents * 100.0 / total_documents, 1) END::DOUBLE AS progress,
    CASE WHEN m.id IS NULL THEN 'Unknown matter' WHEN m.client_name IS NULL THEN m.description ELSE concat(m.description, ', Case No. ', m.display_number) END AS name
    FROM jobs j LEFT JOIN matters m ON j.matter_id = m.id""")
def job_rows(t: Tables) -> DataFrame:
    m = t.matters.select(F.col("id").alias("matter_id"), "description", "display_number", "client_name", F.lit(True).alias("known"))
    progress = F.when(F.col("total_documents") == 0, F.lit(0.0)).otherwise(F.round(F.col("processed_documents") * 100.0 / F.col("total_documents"), 1))
    name = F.when(F.col("known").isNull(), "Unknown matter").when(F.col("client_name").isNull(), F.col("description")).otherwise(F.concat("description", F.lit(", Case No. "), "display_number"))
    return t.jobs.join(m, "matter_id", "left").select("id", progress.alias("progress"), name.alias("name"))


@query("prj_04_research_rows", "SELECT doc_id, source AS court, lang, substr(text, 1, 300) AS snippet, length(text) > 300 AS is_cut FROM documents")
def research_rows(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.col("source").alias("court"), "lang", F.substring("text", 1, 300).alias("snippet"), (F.length("text") > 300).alias("is_cut"))


@query("flt_01_tenant", "SELECT id, description FROM matters WHERE user_id = 7")
def tenant(t: Tables) -> DataFrame:
    return R.matching(t.matters, equal={"user_id": 7}).select("id", "description")


@query("flt_02_search_matters", "SELECT id, description FROM matters WHERE contains(lower(description), '12') OR contains(lower(display_number), '12') OR contains(lower(client_name), 'client 5')")
def search_matters(t: Tables) -> DataFrame:
    m = t.matters
    return m.where(R.contains_any(["description", "display_number"], "12") | R.contains_any(["client_name"], "CLIENT 5")).select("id", "description")


@query("flt_03_matter_filters", "SELECT id FROM matters WHERE status = 'Open' AND contains(lower(practice_area), 'build') AND balance >= 100 AND balance <= 5000")
def matter_filters(t: Tables) -> DataFrame:
    return R.matching(t.matters, equal={"status": "Open"}, contains={"practice_area": "BUILD"}, between={"balance": (100, 5000)}).select("id")


@query("flt_04_mention_filters", "SELECT id, full_name FROM mentions WHERE importance IN ('high', 'low') AND role IN ('expert', 'eyewitness') AND contains(lower(full_name), 'carroll')")
def mention_filters(t: Tables) -> DataFrame:
    among = {"importance": R.checked(["HIGH", "low"], fixed.IMPORTANCE), "role": R.checked(["expert", "eyewitness"], fixed.ROLES)}
    return R.matching(t.mentions, among=among, contains={"full_name": "Carroll"}).select("id", "full_name")


@query("flt_05_canonical_filters", "SELECT id, full_name FROM canonicals WHERE relevance IN ('relevant', 'highly_relevant') AND role IN ('expert', 'other') AND contains(lower(full_name), '1')")
def canonical_filters(t: Tables) -> DataFrame:
    return R.matching(t.canonicals, among={"relevance": R.checked(["RELEVANT", "highly_relevant"], fixed.RELEVANCE), "role": ["expert", "other"]}, contains={"full_name": "1"}).select("id", "full_name")


@query("flt_06_jobs_by_status", "SELECT id FROM jobs WHERE NOT is_archived AND status = 'queued'")
def jobs_by_status(t: Tables) -> DataFrame:
    return R.matching(t.jobs, equal={"is_archived": False, "status": "queued"}).select("id")


@query("flt_07_pending_batches", "SELECT id, status FROM jobs WHERE status IN ('queued', 'processing') OR (status IN ('completed', 'failed') AND NOT is_archived)")
def pending_batches(t: Tables) -> DataFrame:
    return t.jobs.where("status IN ('queued', 'processing') OR (status IN ('completed', 'failed') AND NOT is_archived)").select("id", "status")


@query("flt_08_document_scope", """WITH live AS (SELECT * FROM filings WHERE NOT is_soft_deleted AND folder IS DISTINCT FROM '5-LOW'),
    inside AS (SELECT DISTINCT matter_id FROM live WHERE folder = '1-URGENT')
    SELECT id, matter_id FROM live WHERE folder = '1-URGENT' OR matter_id NOT IN (SELECT matter_id FROM inside)""")
def document_scope(t: Tables) -> DataFrame:
    return R.in_scope(t.filings, folder="1-URGENT", excluded="5-LOW").select("id", "matter_id")


@query("flt_09_unprocessed", "SELECT d.id FROM filings d JOIN matters t ON d.matter_id = t.id WHERE t.user_id = 3 AND NOT d.is_processed")
def unprocessed(t: Tables) -> DataFrame:
    mine = t.matters.where("user_id = 3").select(F.col("id").alias("matter_id"))
    return t.filings.where("NOT is_processed").join(mine, "matter_id", "left_semi").select("id")


@query("flt_10_work_product", f"SELECT doc_id, {_has('lower(concat(source, chr(32), text))', fixed.WORK_PRODUCT_NAMES)} OR {_has('upper(substr(text, 1, 2048))', fixed.WORK_PRODUCT_HEADERS)} AS skip FROM documents")
def work_product(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", rules.work_product(F.concat_ws(" ", "source", "text"), F.col("text")).alias("skip"))


def _rlike(column: str, patterns) -> str:
    return "(" + " OR ".join("regexp_matches({}, '{}')".format(column, p.replace("'", "''")) for p in patterns) + ")"


@query("flt_11_attorney_rule", f"""SELECT id, {_has('role', fixed.ATTORNEY_ROLES)} AND NOT {_rlike("lower(coalesce(observation, ''))", fixed.FACT_WITNESS)}
    AND {_rlike("lower(coalesce(observation, ''))", fixed.REPRESENTATION)} AS exclude FROM mentions""")
def attorney_rule(t: Tables) -> DataFrame:
    return t.mentions.select("id", rules.attorney_rule(F.col("role"), F.col("observation"))["exclude"].alias("exclude"))


@query("flt_12_attorney_phrase", f"SELECT id FROM mentions WHERE role = 'attorney' AND {_has('lower(observation)', fixed.ATTORNEY_PHRASES)}")
def attorney_phrase(t: Tables) -> DataFrame:
    return t.mentions.where(rules.attorney_phrase(F.col("role"), F.col("observation"))).select("id")


@query("flt_13_own_staff", "SELECT id FROM mentions WHERE NOT coalesce(split_part(lower(email), '@', 2) = 'firm2.com', false)")
def own_staff(t: Tables) -> DataFrame:
    return t.mentions.where(~rules.own_staff(F.col("email"), F.lit("firm2.com"))).select("id")


@query("flt_14_criminal", f"""WITH c AS (SELECT id, lower(concat(CASE id % 5 WHEN 0 THEN 'People v. ' WHEN 1 THEN 'Roe, felony and guilty plea ' ELSE 'Roe v. ' END, claim_text)) AS x FROM claims)
    SELECT id FROM c WHERE starts_with(x, 'people v') OR starts_with(x, 'state v') OR starts_with(x, 'united states v')
    OR {' + '.join(f"contains(x, '{w}')::INT" for w in fixed.CRIMINAL_WORDS)} >= 2""")
def criminal(t: Tables) -> DataFrame:
    name = F.expr("CASE id % 5 WHEN 0 THEN 'People v.' WHEN 1 THEN 'Roe, felony and guilty plea' ELSE 'Roe v.' END")
    return t.claims.where(rules.criminal(name, F.col("claim_text"))).select("id")


@query("flt_15_context_selection", "SELECT id, full_name FROM canonicals WHERE relevance IN ('highly_relevant', 'relevant') ORDER BY relevance, id LIMIT 10")
def context_selection(t: Tables) -> DataFrame:
    return t.canonicals.where("relevance IN ('highly_relevant', 'relevant')").orderBy("relevance", "id").limit(10).select("id", "full_name")


@query("flt_16_minimum_score", "SELECT id, coalesce(confidence * 6, 5) AS score FROM claims WHERE coalesce(confidence * 6, 5) >= 5")
def minimum_score(t: Tables) -> DataFrame:
    score = F.coalesce(F.col("confidence") * 6, F.lit(5.0))
    return t.claims.where(score >= 5).select("id", score.alias("score"))


@query("flt_17_private_data", "SELECT doc_id, " + " OR ".join("regexp_matches(text, '(?i){}')".format(p) for p in fixed.PII) + " AS has_pii FROM documents")
def private_data(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", rules.has_pii(F.col("text")).alias("has_pii"))


@query("flt_18_observation_search", """SELECT canonical_id FROM mentions GROUP BY canonical_id
    HAVING bool_or(coalesce(contains(lower(observation), 'accident') OR contains(lower(full_name), 'taylor') OR contains(lower(email), '@firm1'), false))""")
def observation_search(t: Tables) -> DataFrame:
    held = [F.coalesce(F.contains(F.lower(c), F.lit(word)), F.lit(False)) for c, word in (("full_name", "taylor"), ("email", "@firm1"), ("observation", "accident"))]
    return t.mentions.groupBy("canonical_id").agg(F.bool_or(held[0] | held[1] | held[2]).alias("found")).where("found").select("canonical_id")


@query("flt_19_awaiting_review", "SELECT matter_id, count(*) AS results FROM jobs WHERE status = 'completed' AND NOT is_archived GROUP BY matter_id")
def awaiting_review(t: Tables) -> DataFrame:
    return t.jobs.where("status = 'completed' AND NOT is_archived").groupBy("matter_id").agg(F.count("*").alias("results"))


@query("flt_20_query_lines", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    c AS (SELECT doc_id, i, trim(regexp_replace(x, '^[\\s\\-*0-9.]+', '')) AS x FROM l),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM c WHERE length(x) > 5 AND length(x) < 100)
    SELECT doc_id, count(*) AS lines, sum(length(x))::BIGINT AS chars FROM k WHERE n <= 5 GROUP BY doc_id""")
def query_lines(t: Tables) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[\s\-*0-9.]+", "")))
    kept = F.slice(F.filter(lines, lambda x: (F.length(x) > 5) & (F.length(x) < 100)), 1, 5)
    out = t.documents.select("doc_id", kept.alias("k")).where(F.size("k") > 0)
    return out.select("doc_id", F.size("k").cast("long").alias("lines"), F.aggregate("k", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("chars"))


@query("flt_21_page_class", "SELECT doc_id, CASE WHEN n_chars >= 100 AND n_chars / 484704.0 >= 0.001 THEN 'text' ELSE 'scanned' END AS page_class FROM documents")
def page_class(t: Tables) -> DataFrame:
    kind = F.when((F.col("n_chars") >= 100) & (F.col("n_chars") / 484704.0 >= 0.001), "text").otherwise("scanned")
    return t.documents.select("doc_id", kind.alias("page_class"))


@query("flt_22_attachments", "SELECT id FROM filings WHERE regexp_extract(lower(filename), '\\.([a-z0-9]+)$', 1) IN ('pdf', 'docx', 'txt') AND contains(filename, 'memo')")
def attachments(t: Tables) -> DataFrame:
    extension = F.regexp_extract(F.lower("filename"), r"\.([a-z0-9]+)$", 1)
    return t.filings.where(extension.isin("pdf", "docx", "txt") & F.contains("filename", F.lit("memo"))).select("id")


@query("flt_23_unchanged", """WITH old AS (SELECT doc_id, sha256(CASE WHEN doc_id % 4 = 0 THEN text || 'x' ELSE text END) AS h, doc_id % 3 > 0 AS done FROM documents)
    SELECT d.doc_id FROM documents d LEFT JOIN old o USING (doc_id) WHERE NOT coalesce(o.done AND o.h = sha256(d.text), false)""")
def unchanged(t: Tables) -> DataFrame:
    old = t.documents.select("doc_id", F.sha2(F.expr("CASE WHEN doc_id % 4 = 0 THEN text || 'x' ELSE text END"), 256).alias("h"), F.expr("doc_id % 3 > 0").alias("done"))
    joined = t.documents.select("doc_id", F.sha2("text", 256).alias("now")).join(old, "doc_id", "left")
    return joined.where(~F.coalesce(F.col("done") & (F.col("h") == F.col("now")), F.lit(False))).select("doc_id")
