"""Numbered claims, links of people to them, and relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.text import claim_label


def level(links: Column, score: Column) -> Column:
    return F.when(links == 0, "UNKNOWN").when((score >= 4) | (links >= 3), "HIGHLY_RELEVANT").when(score >= 2, "RELEVANT").otherwise("SOMEWHAT_RELEVANT")


def relevance_levels(people: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """(key, score, level) of every person: two points for support, one for any other link."""
    points = F.when(F.col("relationship") == "supports", 2).otherwise(1)
    scored = links.groupBy(key).agg(F.count("*").alias("n"), F.sum(points).alias("score"))
    out = people.join(scored, key, "left").na.fill(0, ["n", "score"])
    return out.select(key, "score", level(F.col("n"), F.col("score")).alias("level"))


def add_claims(claims: DataFrame, new: DataFrame, manual: bool = False) -> DataFrame:
    """New claims (matter_id, claim_type, seq, claim_text, confidence) numbered after the highest of their matter and type."""
    highest = claims.groupBy("matter_id", "claim_type").agg(F.max("claim_number").alias("base"))
    place = F.row_number().over(Window.partitionBy("matter_id", "claim_type").orderBy("seq"))
    numbered = new.withColumn("place", place).join(highest, ["matter_id", "claim_type"], "left")
    confidence = F.lit(1.0) if manual else F.coalesce("confidence", F.lit(0.8))
    return numbered.select("matter_id", "claim_type", (F.coalesce("base", F.lit(0)) + F.col("place")).cast("long").alias("claim_number"), "claim_text", confidence.alias("confidence"))


def merge_links(old: DataFrame, new: DataFrame) -> DataFrame:
    """Links by (witness_id, case_claim_id): the last write (highest seq, new after old) gives relationship and explanation."""
    every = old.withColumn("w", F.struct(F.lit(0).alias("a"), F.col("seq"))).unionByName(new.withColumn("w", F.struct(F.lit(1).alias("a"), F.col("seq"))))
    return every.groupBy("witness_id", "case_claim_id").agg(F.max_by(F.struct("relationship", "explanation"), "w").alias("r")).select("witness_id", "case_claim_id", "r.*")


def edit_claims(claims: DataFrame, edits: DataFrame) -> DataFrame:
    """claims with edits (id, new_text, verify, remove): a new text marks the claim as manual; removed ones go."""
    joined = claims.join(edits.select("id", "new_text", "verify", "remove"), "id", "left").where(~F.coalesce("remove", F.lit(False)))
    return joined.withColumns(
        {
            "claim_text": F.coalesce("new_text", "claim_text"),
            "method": F.when(F.col("new_text").isNotNull(), "manual").otherwise(F.col("method")),
            "is_verified": F.coalesce("verify", "is_verified"),
        }
    ).drop("new_text", "verify", "remove")


def relevancy(claims: DataFrame, links: DataFrame, people: DataFrame) -> dict[str, DataFrame]:
    """The analysis as five tables: allegations, defenses, witness_summary, unlinked, stats (people: person_id, full_name)."""
    named = links.join(people.select("person_id", "full_name"), "person_id")
    per_claim = named.groupBy("case_claim_id").agg(F.array_sort(F.collect_list(F.struct("full_name", "person_id", "relationship"))).alias("witnesses"))
    listed = claims.join(per_claim.withColumnRenamed("case_claim_id", "id"), "id", "left")
    listed = listed.withColumn("witnesses", F.coalesce("witnesses", F.array().cast("array<struct<full_name:string,person_id:bigint,relationship:string>>")))
    summary = named.join(claims.select(F.col("id").alias("case_claim_id"), "claim_type", "claim_number"), "case_claim_id")
    summary = summary.groupBy("person_id", "full_name").agg(F.count("*").alias("links"), F.count_if(F.col("claim_type") == "allegation").alias("allegations"), F.count_if(F.col("claim_type") == "defense").alias("defenses"))
    unlinked = people.join(links.select("person_id").distinct(), "person_id", "left_anti")
    stats = claims.groupBy("claim_type").agg(F.count("*").alias("claims"))
    return {
        "allegations": listed.where("claim_type = 'allegation'"),
        "defenses": listed.where("claim_type = 'defense'"),
        "witness_summary": summary,
        "unlinked": unlinked,
        "stats": stats,
    }


def reasons(links: DataFrame, claims: DataFrame, key: str, most: int = 3) -> DataFrame:
    """(key, reason): "A1: explanation; D2: explanation" of the first links of each person, by claim label."""
    named = links.join(claims.select(F.col("id").alias("case_claim_id"), claim_label(F.col("claim_type"), F.col("claim_number")).alias("label")), "case_claim_id")
    place = F.row_number().over(Window.partitionBy(key).orderBy("case_claim_id", "explanation", "label"))
    first = named.withColumn("n", place).where(F.col("n") <= most)
    text = F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat_ws(": ", "label", "explanation").alias("t")))), lambda x: x["t"])
    return first.groupBy(key).agg(F.array_join(text, "; ").alias("reason"))
