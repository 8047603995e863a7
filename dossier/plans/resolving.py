"""Person resolution: ER, with the model hooks' offline defaults (UDF-01 to UDF-03)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions import hooks
from dossier.operators import resolve as P
from dossier.plans.bindings import Tables
from dossier.plans.registry import query


#: What the fold needs of a mention; all that it gets goes through its stream.
PLACED = ("id", "document_id", "source_page", "full_name")


def _mentions(t: Tables, *more: str, rows: DataFrame | None = None) -> DataFrame:
    rows = (t.mentions if rows is None else rows).select(*PLACED, *more)
    return rows.join(t.filings.select(F.col("id").alias("document_id"), "matter_id"), "document_id")


@query("er_20_canonicalize")
def canonicalize(t: Tables) -> DataFrame:
    """All tiers: names embedded once a spelling, doubtful pairs put to a verdict (the default is never sure)."""
    rows = _mentions(t, "role", "observation", rows=P.excluded(t.mentions, "firm2.com"))
    found = P.resolved(rows, verdict=hooks.no_verdict, embed=hooks.embed, spelt=t.mentions)
    return found.select("id", "matter_id", "person", "match_type", F.round("match_score", 4).alias("match_score"))


@query("er_20_scale_mode")
def scale_mode(t: Tables) -> DataFrame:
    """The pair-free transitive form beside the ordered fold, matter by matter."""
    return P.compared(_mentions(t, rows=P.placed(t.mentions)), spelt=t.mentions)


@query("er_21_merged")
def merged(t: Tables) -> DataFrame:
    told = t.mentions.withColumn("observation", F.substring("observation", 1, 1))  # only whether something was observed counts
    more = ("role", "relevance", "relevance_reason", "observation", "email", "phone", "address", "confidence_score")
    return P.canonical_people(P.resolved(_mentions(t, *more, rows=told), spelt=t.mentions))


@query("er_22_loose_clusters")
def loose_clusters(t: Tables) -> DataFrame:
    return P.loose_clusters(_mentions(t), spelt=t.mentions).select("id", "matter_id", "cluster")


@query("er_23_recanonicalize")
def recanonicalize(t: Tables) -> DataFrame:
    return P.stats(P.resolved(_mentions(t), spelt=t.mentions))


@query("er_24_members", "SELECT canonical_id, id, full_name, row_number() OVER (PARTITION BY canonical_id ORDER BY full_name, id) AS place FROM mentions")
def members(t: Tables) -> DataFrame:
    """The members of each person by name, one row each: no list of a person's mentions is gathered."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("canonical_id").orderBy("full_name", "id"))
    return t.mentions.select("canonical_id", "id", "full_name", place.cast("long").alias("place"))


@query("udf_01_embedding")
def embedding(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(F.concat_ws(",", F.transform(hooks.embed(F.substring("text", 1, 8000)), lambda x: F.round(x, 4).cast("string"))), 256).alias("h"))


@query("udf_03_attorney_verdict", """SELECT id, coalesce(contains(observation, 'Counsel'), false) AS exclude, coalesce(contains(observation, 'Testified') OR contains(observation, 'Saw'), false) AS is_fact_witness,
    CASE WHEN observation IS NULL THEN 'no sign' WHEN contains(observation, 'Counsel') THEN 'counsel' ELSE 'saw or testified' END AS reason FROM mentions WHERE role = 'attorney'""")
def attorney_verdict(t: Tables) -> DataFrame:
    """The verdict by words is sure of counsel and of witnesses; the default model is never sure and excludes nobody."""
    rows = t.mentions.where("role = 'attorney'").select("id", hooks.attorney_by_words(F.col("observation")).alias("v"), hooks.keep_attorney("full_name", "observation").alias("d"))
    return rows.select("id", F.expr("(v.exclude AND v.confidence >= 0.7) OR (d.exclude AND d.confidence >= 0.7)").alias("exclude"), "v.is_fact_witness", "v.reason")


@query("udf_04_extraction")
def extraction(t: Tables) -> DataFrame:
    """The people of each text by name, one text a document."""
    names = F.transform(hooks.people_in(F.col("text")), lambda x: x["fullName"])
    return t.documents.select("doc_id", F.size(names).alias("people"), F.array_join(F.array_sort(names), "; ").alias("names"))


@query("udf_02_verdict")
def verdict(t: Tables) -> DataFrame:
    """A verdict that is sure of equal initials and last names confirms uncertain pairs."""
    found = P.resolved(_mentions(t, "role", "observation"), verdict=hooks.initials_verdict, spelt=t.mentions)
    return found.select("id", "matter_id", "person", "match_type", "match_reason")


@query("udf_05_verified", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'checked' ELSE role END AS people FROM conversations")
def verified(t: Tables) -> DataFrame:
    answer = F.when(F.col("turn") % 2 == 0, F.lit("checked"))
    return t.conversations.select("conv_id", "turn", hooks.verified(F.col("role"), answer).alias("people"))


@query("udf_06_claims", "SELECT id, 'allegation' AS claim_type, concat(claim_text, '.') AS claim_text FROM claims WHERE id % 2 = 0 UNION ALL SELECT id, 'defense', concat('The hospital denies it ', id) FROM claims")
def claims(t: Tables) -> DataFrame:
    text = F.concat(F.expr("CASE WHEN id % 2 = 0 THEN concat(claim_text, '. ') ELSE 'Nothing here. ' END"), F.lit("The hospital denies it "), "id")
    return t.claims.select("id", F.inline(hooks.claims_in(text)))


@query("udf_08_case_analysis", "SELECT id, CASE WHEN contains(lower(claim_text), 'fraud') THEN 9 WHEN contains(lower(claim_text), 'negligence') THEN 9 ELSE 8 END::BIGINT AS score FROM claims")
def case_analysis(t: Tables) -> DataFrame:
    asked = F.array(F.lit("fraud"), F.lit("negligence"))
    answer = hooks.case_analysis(F.lit("Roe"), F.col("claim_text"), asked)
    return t.claims.select("id", F.get_json_object(answer, "$.score").cast("long").alias("score"))
