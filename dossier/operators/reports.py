"""Report tables: what a report shows of witnesses, claims and their relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.text import relevance_rank
from dossier.operators.running import RANGE_ROWS, ranged, running
from dossier.sources.shared import materialize

LEVELS = {"highly_relevant": "Highly Relevant", "relevant": "Relevant", "somewhat_relevant": "Somewhat Relevant", "not_relevant": "Not Relevant", "high": "Highly Relevant", "medium": "Relevant", "low": "Somewhat Relevant"}


def witness_info() -> Column:
    """"name, Role Title, contact" of columns full_name, role, address, phone, email."""
    contact = F.concat_ws(", ", *[F.when(F.col(c) != "", F.col(c)) for c in ("address", "phone", "email")])
    contact = F.when(contact == "", "Contact info unknown at this time").otherwise(contact)
    return F.concat_ws(", ", F.coalesce("full_name", F.lit("Unknown")), F.initcap(F.translate(F.coalesce("role", F.lit("")), "_", " ")), contact)


def source_document() -> Column:
    name = F.coalesce("filename", F.lit(""))
    return F.when(F.coalesce("source_page", F.lit(0)) != 0, F.concat(name, F.lit(" (Page "), F.col("source_page").cast("string"), F.lit(")"))).otherwise(name)


def level_text(level: Column, reason: Column) -> Column:
    shown = F.lit("Relevant")
    for k, v in LEVELS.items():
        shown = F.when(F.lower(level) == k, F.lit(v)).otherwise(shown)
    return F.when(F.coalesce(reason, F.lit("")) != "", F.concat(shown, F.lit(" - "), reason)).otherwise(shown)


def percent(score: Column) -> Column:
    """Ties go to the even number; null is 0 %."""
    return F.format_string("%.0f%%", F.bround(F.coalesce(score, F.lit(0.0)) * 100))


NAME_BUCKETS = 65_536


def _numbered(rows: DataFrame, order: list[Column], range_rows: int) -> DataFrame:
    """rows with n, the rows of their full_name, i, their number among them, and top, the rank and id of the first.

    Names are windows of their own, in one shuffle. Those of a hash bucket with more rows than any task should hold are ranged instead,
    so a common name is many tasks; of NAME_BUCKETS counts all are small.
    """
    bucket = F.pmod(F.xxhash64("full_name"), F.lit(NAME_BUCKETS))
    sizes = materialize(rows.groupBy(bucket.alias("__bucket")).agg(F.count("*").alias("size")), "buckets")
    mean = F.lit((sizes.agg(F.avg("size")).first()[0] or 0) * 4)
    heavy = sizes.where(F.col("size") > F.greatest(F.lit(range_rows), mean)).select("__bucket")
    name = Window.partitionBy("full_name").orderBy(*order)
    whole = name.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def light(part: DataFrame) -> DataFrame:
        top = F.first(F.struct("rank", "id")).over(whole)
        return part.withColumns({"i": F.row_number().over(name), "n": F.count("*").over(whole), "top": top})

    if heavy.isEmpty():
        return light(rows)
    rows = rows.withColumn("__bucket", bucket)
    common = running(ranged(rows.join(F.broadcast(heavy), "__bucket", "left_semi"), order, range_rows), [F.col("full_name")], order, "i").withColumn("i", F.col("i").cast("int"))
    person = F.coalesce(F.concat(F.lit("n"), "full_name"), F.lit(""))
    each = common.groupBy(person.alias("__person")).agg(F.count("*").alias("n"), F.min(F.struct("rank", "id")).alias("top"))
    common = common.withColumn("__person", person).join(each, "__person").drop("__person", "__range", "__bucket")
    return light(rows.join(F.broadcast(heavy), "__bucket", "left_anti").drop("__bucket")).unionByName(common)


def report(rows: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Seven report columns plus place and color_class. People come by relevance, then by their first row; one row stays
    single, several get a summary and a detail each whose person columns are blank."""
    rank = relevance_rank(F.coalesce("relevance", F.when(F.col("importance") == "high", "highly_relevant").when(F.col("importance") == "low", "somewhat_relevant").otherwise("relevant")))
    rows = rows.withColumn("rank", F.when(rank < 0, 1).otherwise(3 - rank))
    rows = _numbered(rows, [F.col("rank"), F.col("id"), F.desc("confidence_score")], range_rows)
    kinds = F.when(F.col("n") == 1, F.array(F.lit("single"))).when(F.col("i") == 1, F.array(F.lit("summary"), F.lit("detail"))).otherwise(F.array(F.lit("detail")))
    rows = rows.withColumn("kind", F.explode(kinds))
    blank, below = F.col("kind") == "detail", F.col("kind") == "summary"
    text = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        F.struct(F.col("top.rank"), F.col("top.id"), F.when(below, 0).otherwise(F.col("i")).alias("i")).alias("place"),
        F.when(blank, "").otherwise(witness_info()).alias("witness_info"),
        F.when(blank, "").otherwise(level_text(F.coalesce("relevance", "importance"), F.col("relevance_reason"))).alias("relevance"),
        F.when(blank, "").otherwise(percent(F.col("confidence_score"))).alias("confidence"),
        F.when(below, F.concat(F.lit("Multiple observations ("), F.col("n").cast("string"), F.lit(" entries) - see details below"))).otherwise(text(F.col("observation"))).alias("observation"),
        F.when(below, "See Below").otherwise(text(F.col("source_quote"))).alias("source_summary"),
        F.when(below, "See Below").otherwise(source_document()).alias("source_document"),
        F.when(below, "See Below").otherwise(level_text(F.col("document_relevance"), F.lit(None))).alias("doc_relevance"),
        F.col("top.rank").alias("color_class"),
    )


def claim_lines(claims: DataFrame, links: DataFrame, people: DataFrame) -> DataFrame:
    """(id, lines): "• name (relationship)" of each claim, or "No linked witnesses"."""
    named = links.join(people.select("person_id", "full_name"), "person_id")
    line = F.concat(F.lit("• "), F.col("full_name"), F.lit(" ("), F.col("relationship"), F.lit(")"))
    per = named.groupBy(F.col("case_claim_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    return claims.select("id").join(per, "id", "left").select("id", F.coalesce("lines", F.lit("No linked witnesses")).alias("lines"))


def witness_lines(links: DataFrame, claims: DataFrame) -> DataFrame:
    """(person_id, lines): "• Allegation #n (relationship): explanation", cut to 80 characters, for each person."""
    named = links.join(claims.select(F.col("id").alias("case_claim_id"), "claim_type", "claim_number"), "case_claim_id")
    line = F.concat(F.lit("• "), F.initcap("claim_type"), F.lit(" #"), F.col("claim_number").cast("string"), F.lit(" ("), F.col("relationship"), F.lit("): "), F.substring("explanation", 1, 80))
    return named.groupBy("person_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))


def scope(mentions: DataFrame, documents: DataFrame, jobs: DataFrame, job: int | None = None, matter: int | None = None, importance: str | None = None) -> DataFrame:
    """Mentions of a report: of the job's matter if a job is asked for (it takes precedence), else of the matter."""
    docs = documents.select(F.col("id").alias("document_id"), "matter_id")
    if job is not None:
        docs = docs.join(jobs.where(F.col("id") == job).select("matter_id"), "matter_id", "left_semi")
    elif matter is not None:
        docs = docs.where(F.col("matter_id") == matter)
    rows = mentions if importance is None else mentions.where(F.col("importance") == importance.lower())
    return rows.join(docs.select("document_id"), "document_id", "left_semi")


def write_report(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """Writes a report table in its order: parquet, or json or csv in gzip files."""
    out = rows.orderBy("place").drop("place").write.mode("overwrite").option("header", "true")
    getattr(out if form == "parquet" else out.option("compression", "gzip"), form)(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Writes named tables side by side."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
