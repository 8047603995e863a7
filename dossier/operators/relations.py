"""Projections, predicates, joins and orders of the evidence tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions import fixed
from dossier.functions.text import role_rank

SORTABLE = ("id", "description", "display_number", "status", "practice_area", "client_name")


def mention_rows(mentions: DataFrame, documents: DataFrame, matters: DataFrame, how: str = "inner") -> DataFrame:
    """Mentions with file name and matter; `left` keeps mentions whose document or matter is unknown."""
    d = documents.select(F.col("id").alias("document_id"), "filename", "matter_id")
    m = matters.select(F.col("id").alias("matter_id"), F.col("description").alias("matter"), "user_id")
    return mentions.join(d, "document_id", how).join(m, "matter_id", how)


def contains_any(columns: list[str], text: str) -> Column:
    """Case-insensitive containment in any column; null columns do not match."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text.lower())), F.lit(False)) for c in columns])


def matching(df: DataFrame, equal: dict | None = None, contains: dict | None = None, between: dict | None = None, among: dict | None = None) -> DataFrame:
    """Optional predicates, ANDed; an absent value asks nothing. Ranges are closed; None leaves an end open."""
    for c, v in (equal or {}).items():
        df = df if v is None else df.where(F.col(c) == v)
    for c, v in (contains or {}).items():
        df = df if not v else df.where(contains_any([c], v))
    for c, (low, high) in (between or {}).items():
        df = df if low is None else df.where(F.col(c) >= low)
        df = df if high is None else df.where(F.col(c) <= high)
    for c, values in (among or {}).items():
        df = df if not values else df.where(F.col(c).isin(list(values)))
    return df


def checked(values: list[str], domain) -> list[str]:
    """Lower-cased values of an enumeration; an unknown one is an error."""
    low = [v.lower() for v in values]
    if unknown := sorted(set(low) - set(domain)):
        raise ValueError(f"unknown value: {', '.join(unknown)}")
    return low


def in_scope(documents: DataFrame, folder: str | None = None, excluded: str | None = None) -> DataFrame:
    """Documents that are not deleted, without an excluded folder (null folders stay), in a folder where the matter has any there."""
    live = documents.where("NOT is_soft_deleted")
    if excluded is not None:
        live = live.where(~F.col("folder").eqNullSafe(F.lit(excluded)))
    if folder is None:
        return live
    inside = live.where(F.col("folder") == folder).select("matter_id").distinct().withColumn("__some", F.lit(True))
    return live.join(inside, "matter_id", "left").where(F.col("__some").isNull() | (F.col("folder") == folder)).drop("__some")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def importance_rank(importance: Column) -> Column:
    out = F.lit(len(fixed.IMPORTANCE))
    for i, v in enumerate(fixed.IMPORTANCE):
        out = F.when(F.lower(importance) == v, F.lit(i)).otherwise(out)
    return out


def sorted_matters(matters: DataFrame, by: str, descending: bool = False) -> DataFrame:
    if by not in SORTABLE:
        raise ValueError(f"cannot sort by {by}")
    return matters.orderBy(F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_first(), "id")


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order; a partial limit runs before the shuffle."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def coalesced_text(documents: DataFrame, by_id: DataFrame, by_hash: DataFrame) -> DataFrame:
    """Cached text by external id, else by content hash; empty texts count as absent."""
    a = by_id.select("external_id", F.col("text").alias("__a"))
    b = by_hash.select("content_hash", F.col("text").alias("__b"))
    text = F.coalesce(F.nullif(F.col("__a"), F.lit("")), F.nullif(F.col("__b"), F.lit("")))
    return documents.join(a, "external_id", "left").join(b, "content_hash", "left").withColumn("text", text).drop("__a", "__b")


def merged_people(mentions: DataFrame, key: list[str]) -> DataFrame:
    """One row per group of mentions: longest name (earliest of equals), role by priority, highest relevance, all reasons in
    order joined by " | ", first non-empty contacts, sources. observations(mentions) holds the observations themselves."""
    from dossier.functions.text import relevance_rank

    rank = relevance_rank(F.col("relevance"))
    filled = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("id"))).alias(c)
    reasons = F.array_sort(F.collect_list(F.when(F.coalesce(F.col("relevance_reason"), F.lit("")) != "", F.struct("id", F.col("relevance_reason").alias("r")))))
    return mentions.groupBy(*key).agg(
        F.max_by("full_name", F.struct(F.length("full_name"), -F.col("id"))).alias("full_name"),
        F.min_by("role", F.struct(role_rank(F.col("role")), "id")).alias("role"),
        F.max_by("relevance", F.struct(rank, -F.col("id"))).alias("relevance"),
        F.nullif(F.array_join(F.transform(reasons, lambda x: x["r"]), " | "), F.lit("")).alias("relevance_reason"),
        F.count_if(F.coalesce(F.col("observation"), F.lit("")) != "").alias("observations"),
        filled("email"), filled("phone"), filled("address"),
        F.max("confidence_score").alias("max_confidence"),
        F.count_distinct("document_id").alias("documents"),
        F.count("*").alias("mentions"),
    )


def observations(mentions: DataFrame, key: list[str]) -> DataFrame:
    """The observations of merged people, one row each: key, document_id, source_page, observation, confidence_score."""
    return mentions.where(F.coalesce(F.col("observation"), F.lit("")) != "").select(*key, "document_id", "source_page", "observation", "confidence_score")
