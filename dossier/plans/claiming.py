"""Claims, links and reports: CLM, RPT, SNK-02, SNK-03."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.operators import claims as C
from dossier.operators import reports as P
from dossier.plans.bindings import Tables
from dossier.plans.registry import query
from dossier.sources.shared import scratch


def _claims(t: Tables) -> DataFrame:
    return t.claims.withColumn("claim_number", F.col("claim_number_raw").cast("long"))


def _people(t: Tables) -> DataFrame:
    return t.canonicals.select(F.col("id").alias("person_id"), "full_name")


@query("clm_01_manual_claims", """WITH b AS (SELECT matter_id, claim_type, max(claim_number_raw)::BIGINT AS base FROM claims WHERE id % 2 = 0 GROUP BY ALL)
    SELECT c.matter_id, c.claim_type, coalesce(base, 0) + row_number() OVER (PARTITION BY c.matter_id, c.claim_type ORDER BY id DESC) AS claim_number, claim_text, 1.0::DOUBLE AS confidence
    FROM claims c LEFT JOIN b USING (matter_id, claim_type) WHERE id % 2 = 1""")
def manual_claims(t: Tables) -> DataFrame:
    return C.add_claims(_claims(t).where("id % 2 = 0"), t.claims.where("id % 2 = 1").withColumn("seq", -F.col("id")), manual=True)


@query("clm_02_merge_links", """WITH l AS (SELECT person_id AS w, case_claim_id AS c, relationship AS r, explanation AS e, witness_id AS s FROM links WHERE witness_id % 2 = 0
      UNION ALL SELECT person_id, case_claim_id, relationship, explanation, witness_id + 1000000000000000000 FROM links WHERE witness_id % 2 = 1)
    SELECT w AS witness_id, c AS case_claim_id, arg_max(r, s) AS relationship, arg_max(e, s) AS explanation FROM l GROUP BY w, c""")
def merge_links(t: Tables) -> DataFrame:
    part = lambda k: t.links.where(f"witness_id % 2 = {k}").select(F.col("person_id").alias("witness_id"), "case_claim_id", "relationship", "explanation", F.col("witness_id").alias("seq"))
    return C.merge_links(part(0), part(1))


@query("clm_03_edit_claims", """SELECT id, CASE WHEN id % 5 = 0 THEN concat('edited ', id) ELSE claim_text END AS claim_text, CASE WHEN id % 5 = 0 THEN 'manual' ELSE 'model' END AS method,
    id % 3 = 0 AS is_verified FROM claims WHERE id % 30 <> 7""")
def edit_claims(t: Tables) -> DataFrame:
    base = t.claims.select("id", "claim_text", F.lit("model").alias("method"), F.lit(False).alias("is_verified"))
    edits = t.claims.select("id", F.expr("CASE WHEN id % 5 = 0 THEN concat('edited ', id) END").alias("new_text"), F.expr("CASE WHEN id % 3 = 0 THEN true END").alias("verify"), F.expr("id % 30 = 7").alias("remove"))
    return C.edit_claims(base, edits.where("id % 5 = 0 OR id % 3 = 0 OR id % 30 = 7"))


def _part(name: str):
    return lambda t: C.relevancy(_claims(t), t.links, _people(t))[name]


_LISTED = """SELECT c.id, coalesce(string_agg(concat(p.full_name, ' ', p.id, ' ', l.relationship), '; ' ORDER BY p.full_name, p.id, l.relationship) FILTER (WHERE p.id IS NOT NULL), '') AS witnesses
    FROM claims c LEFT JOIN links l ON l.case_claim_id = c.id LEFT JOIN canonicals p ON p.id = l.person_id WHERE c.claim_type = '{kind}' GROUP BY c.id"""


def _lines():
    """The witnesses of a claim as one text."""
    return F.array_join(F.transform("witnesses", lambda w: F.concat_ws(" ", w["full_name"], w["person_id"].cast("string"), w["relationship"])), "; ").alias("witnesses")


@query("clm_04_allegations", _LISTED.replace("{kind}", "allegation"))
def allegations(t: Tables) -> DataFrame:
    return _part("allegations")(t).select("id", _lines())


@query("clm_04_defenses", _LISTED.replace("{kind}", "defense"))
def defenses(t: Tables) -> DataFrame:
    return _part("defenses")(t).select("id", _lines())


@query("clm_04_witness_summary", """SELECT l.person_id, p.full_name, count(*) AS links, count(*) FILTER (WHERE claim_type = 'allegation') AS allegations, count(*) FILTER (WHERE claim_type = 'defense') AS defenses
    FROM links l JOIN canonicals p ON p.id = l.person_id JOIN claims c ON c.id = l.case_claim_id GROUP BY ALL""")
def witness_summary(t: Tables) -> DataFrame:
    return _part("witness_summary")(t)


@query("clm_04_unlinked", "SELECT * FROM (SELECT id AS person_id, full_name FROM canonicals UNION ALL SELECT -c_custkey, c_name FROM customer) WHERE person_id NOT IN (SELECT person_id FROM links)")
def unlinked(t: Tables) -> DataFrame:
    """People of the matters, and clients, whom no claim is linked to."""
    clients = t.customer.select((-F.col("c_custkey")).alias("person_id"), F.col("c_name").alias("full_name"))
    return C.relevancy(_claims(t), t.links, _people(t).unionByName(clients))["unlinked"]


@query("clm_04_stats", "SELECT claim_type, count(*) AS claims FROM claims GROUP BY claim_type")
def stats(t: Tables) -> DataFrame:
    return _part("stats")(t)


@query("clm_05_claims_of_matter", "SELECT id, claim_type FROM claims WHERE matter_id = 7 AND claim_type = 'defense' ORDER BY claim_type, claim_number_raw")
def claims_of_matter(t: Tables) -> DataFrame:
    return t.claims.where("matter_id = 7 AND claim_type = 'defense'").orderBy("claim_type", "claim_number_raw").select("id", "claim_type")


def _report_rows(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    people = t.mentions.withColumns({"full_name": F.concat("full_name", F.lit(" "), "document_id"), "filename": F.concat(F.lit("doc "), "document_id")})
    return people.withColumns({"phone": none, "address": none, "relevance_reason": none, "source_quote": none, "document_relevance": none})


_REPORT = """WITH r AS (SELECT *, concat(full_name, ' ', document_id) AS who, CASE coalesce(relevance, CASE importance WHEN 'high' THEN 'highly_relevant' WHEN 'low' THEN 'somewhat_relevant' ELSE 'relevant' END)
      WHEN 'highly_relevant' THEN 0 WHEN 'relevant' THEN 1 WHEN 'somewhat_relevant' THEN 2 ELSE 3 END AS rank FROM mentions),
    g AS (SELECT *, count(*) OVER (PARTITION BY who) AS n, row_number() OVER (PARTITION BY who ORDER BY rank, id, confidence_score DESC) AS i, min(rank) OVER (PARTITION BY who) AS top FROM r),
    k AS (SELECT *, unnest(CASE WHEN n = 1 THEN ['single'] WHEN i = 1 THEN ['summary', 'detail'] ELSE ['detail'] END) AS kind FROM g)
    SELECT kind = 'summary' AS is_summary, top AS color_class, CASE kind WHEN 'detail' THEN '' ELSE printf('%.0f%%', round_even(confidence_score * 100, 0)) END AS confidence,
      CASE kind WHEN 'summary' THEN concat('Multiple observations (', n, ' entries) - see details below') ELSE coalesce(observation, '') END AS observation,
      CASE kind WHEN 'summary' THEN 'See Below' ELSE concat('doc ', document_id, CASE WHEN source_page IS NULL THEN '' ELSE concat(' (Page ', source_page, ')') END) END AS source_document FROM k"""


@query("rpt_01_report", _REPORT)
def report(t: Tables) -> DataFrame:
    return P.report(_report_rows(t)).select((F.col("source_summary") == "See Below").alias("is_summary"), "color_class", "confidence", "observation", "source_document")


@query("snk_02_report_file", _REPORT)
def report_file(t: Tables) -> DataFrame:
    """The report written as JSON lines in its order, and read back."""
    path = scratch(t.spark, "report")
    P.write_report(P.report(_report_rows(t)), path, "json")
    read = t.spark.read.schema("source_summary string, color_class int, confidence string, observation string, source_document string").json(path)
    return read.select((F.col("source_summary") == "See Below").alias("is_summary"), "color_class", "confidence", "observation", "source_document")


@query("snk_02_report_scope", "SELECT m.id FROM mentions m JOIN filings d ON m.document_id = d.id JOIN jobs j ON j.matter_id = d.matter_id WHERE j.id = 4 AND m.importance = 'high'")
def report_scope(t: Tables) -> DataFrame:
    return P.scope(t.mentions, t.filings, t.jobs, job=4, matter=9, importance="high").select("id")


@query("snk_03_relevancy_tables", """SELECT claim_type, count(*) AS claims, count(*) FILTER (WHERE n > 0) AS linked FROM (SELECT c.claim_type, c.id, count(p.id) AS n FROM claims c LEFT JOIN links l ON l.case_claim_id = c.id
    LEFT JOIN canonicals p ON p.id = l.person_id GROUP BY 1, 2) GROUP BY claim_type""")
def relevancy_tables(t: Tables) -> DataFrame:
    """The tables of a relevancy report, written side by side and read back."""
    path, found = scratch(t.spark, "relevancy"), C.relevancy(_claims(t), t.links, _people(t))
    P.write_tables({k: found[k] for k in ("allegations", "defenses")}, path)
    tables = {k: t.spark.read.parquet(f"{path}/{k}") for k in ("allegations", "defenses")}
    both = tables["allegations"].select("claim_type", "witnesses").unionByName(tables["defenses"].select("claim_type", "witnesses"))
    return both.groupBy("claim_type").agg(F.count("*").alias("claims"), F.count_if(F.size("witnesses") > 0).alias("linked"))


@query("rpt_02_color_class", """WITH r AS (SELECT concat(full_name, ' ', document_id) AS who, min(CASE coalesce(relevance, CASE importance WHEN 'high' THEN 'highly_relevant' WHEN 'low' THEN 'somewhat_relevant' ELSE 'relevant' END)
      WHEN 'highly_relevant' THEN 0 WHEN 'relevant' THEN 1 WHEN 'somewhat_relevant' THEN 2 ELSE 3 END) AS c, count(*) AS n FROM mentions GROUP BY 1)
    SELECT c AS color_class, sum(CASE WHEN n = 1 THEN 1 ELSE n + 1 END)::BIGINT AS rows FROM r GROUP BY c""")
def color_class(t: Tables) -> DataFrame:
    return P.report(_report_rows(t)).groupBy("color_class").agg(F.count("*").alias("rows"))


@query("rpt_03_claim_lines", """SELECT c.id, coalesce(string_agg(concat('• ', p.full_name, ' (', l.relationship, ')'), chr(10) ORDER BY concat('• ', p.full_name, ' (', l.relationship, ')')) FILTER (WHERE p.id IS NOT NULL), 'No linked witnesses') AS lines
    FROM claims c LEFT JOIN links l ON l.case_claim_id = c.id LEFT JOIN canonicals p ON p.id = l.person_id GROUP BY c.id""")
def claim_lines(t: Tables) -> DataFrame:
    return P.claim_lines(t.claims, t.links, _people(t))


@query("rpt_03_witness_lines", """WITH x AS (SELECT person_id, concat('• ', CASE claim_type WHEN 'defense' THEN 'Defense' ELSE 'Allegation' END, ' #', claim_number_raw::BIGINT, ' (', relationship, '): ', substr(explanation, 1, 80)) AS l
    FROM links JOIN claims c ON c.id = case_claim_id) SELECT person_id, string_agg(l, chr(10) ORDER BY l) AS lines FROM x GROUP BY person_id""")
def witness_lines(t: Tables) -> DataFrame:
    return P.witness_lines(t.links, _claims(t))
