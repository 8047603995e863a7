"""Retrieval of chunks and ranking of case law."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions import rules
from dossier.functions.text import cosine, strip_tags


def context_text(rows: DataFrame, key: list[str], order: list[Column], text: Column, most: int | None = 5) -> DataFrame:
    """(key, context): the first rows of each key (all if most is None) as numbered lines."""
    numbered = rows.select(*key, text.alias("__t"), F.row_number().over(Window.partitionBy(*key).orderBy(*order)).alias("__n"))
    first = numbered if most is None else numbered.where(F.col("__n") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("__n", "__t"))), lambda x: F.concat(F.lit("["), x["__n"].cast("string"), F.lit("] "), x["__t"]))
    return first.groupBy(*key).agg(F.array_join(lines, "\n").alias("context"))


SALTS, BROADCAST_QUERIES = 16, 50_000


def nearest_chunks(queries: DataFrame, chunks: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, rank, chunk_id, similarity) within each matter: queries (query_id, matter_id, q), chunks (chunk_id, matter_id, e).

    Up to BROADCAST_QUERIES queries, counted, go to the chunks where they lie. More of them meet the chunks by matter and one
    of SALTS parts of it, each query in every part, so that no matter is one task. Ranks are cut before the shuffle.
    """
    chunks = chunks.where("e IS NOT NULL")
    if queries.count() <= BROADCAST_QUERIES:
        met = chunks.join(F.broadcast(queries), "matter_id")
    else:
        salted = queries.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = chunks.withColumn("__salt", F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)).cast("int")).join(salted, ["matter_id", "__salt"])
    scored = met.select("query_id", "chunk_id", F.round(cosine(F.col("e"), F.col("q")), 9).alias("similarity"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= most)


def key_facts(rows: DataFrame, key: list[str], most: int = 5, chars: int = 300) -> DataFrame:
    """(key, fact_no, fact): the start of each observation of the first rows (by id) of a key; rows without one give none."""
    first = rows.withColumn("fact_no", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).where(F.col("fact_no") <= most)
    return first.where(F.coalesce("observation", F.lit("")) != "").select(*key, "fact_no", F.substring("observation", 1, chars).alias("fact"))


#: Patterns of legal phrases in order, words that simplified claims drop, and the least lengths.
PHRASES = (r"cause of action for (\w+(?:\s+\w+)?)", r"(\w+(?:\s+\w+)?) claim", r"liable for (\w+(?:\s+\w+)?)", r"damages for (\w+(?:\s+\w+)?)")
PROCEDURAL = r"(named as|plaintiff|defendant|court|case caption|form|document|attached|exhibit|paragraph|\d+)"


def search_queries(claims: DataFrame, observations: DataFrame, most: int = 5) -> DataFrame:
    """(matter_id, queries) of claims (matter_id, id, claim_text) and observations (matter_id, id, observation).

    The concepts that the claims name, in the order of the dictionary; where a matter names none, the legal phrases of its
    claims; else its first three claims without procedural words; else its first three observations. At most `most`.
    """
    squeezed = lambda c: F.substring(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), 1, 100)
    low = F.lower(F.coalesce("claim_text", F.lit("")))
    named = F.array(*[F.when(low.rlike(rules.any_of(c)), F.struct(F.lit(i).cast("long").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), F.lit(c[0]).alias("q"))) for i, c in enumerate(rules.fixed.CONCEPTS)])
    concepts = claims.select("matter_id", F.lit(1).alias("way"), F.explode(F.filter(named, lambda x: x.isNotNull())).alias("x")).select("matter_id", "way", "x.*").distinct()
    def matches(b: int) -> Column:
        of = F.regexp_extract_all("claim_text", F.lit(f"(?iU){PHRASES[b]}"), F.lit(1))
        return F.transform(of, lambda m, i: F.struct(F.lit(b).alias("b"), i.alias("c"), F.lower(F.trim(m)).alias("q")))

    found = F.flatten(F.array(*map(matches, range(len(PHRASES)))))
    phrases = claims.select("matter_id", F.lit(2).alias("way"), F.col("id").cast("long").alias("a"), F.explode(found).alias("x")).select("matter_id", "way", "a", "x.*").where(F.length("q") > 3)
    first = lambda df: df.withColumn("__n", F.row_number().over(Window.partitionBy("matter_id").orderBy("id"))).where("__n <= 3")
    plain = first(claims).select("matter_id", F.lit(3).alias("way"), F.col("id").cast("long").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), squeezed(F.regexp_replace("claim_text", f"(?iU){PROCEDURAL}", "")).alias("q")).where(F.length("q") > 20)
    seen = first(observations).where(F.length("observation") > 20)
    seen = seen.select("matter_id", F.lit(4).alias("way"), F.col("id").cast("long").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), squeezed(F.regexp_replace("observation", r"(?U)[^\w\s]", " ")).alias("q")).where(F.length("q") > 15)
    every = concepts.unionByName(phrases).unionByName(plain).unionByName(seen)
    # Of phrases that repeat the first place counts.
    once = every.groupBy("matter_id", "way", "q", F.when(F.col("way") > 2, F.col("a")).alias("own")).agg(F.min(F.struct("a", "b", "c")).alias("place"))
    order = Window.partitionBy("matter_id", "way").orderBy("place")
    kept = once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    lists = kept.groupBy("matter_id", "way").agg(F.array_sort(F.collect_list(F.struct("n", "q"))).alias("of"))
    return lists.groupBy("matter_id").agg(F.min_by("of", "way").alias("of")).select("matter_id", F.transform("of", lambda x: x["q"]).alias("queries"))


def case_rows(raw: DataFrame, column: str) -> DataFrame:
    """Case-law results from JSON texts whose keys vary: id, name, citation (text or first of a list), court, date, snippet, url, score."""
    def first(*paths: str) -> Column:
        return F.coalesce(*[F.nullif(F.get_json_object(column, p), F.lit("")) for p in paths])

    url = first("$.absolute_url", "$.url")
    return raw.select(
        "*",
        first("$.id", "$.cluster_id").try_cast("long").alias("case_id"),
        F.coalesce(first("$.caseName", "$.case_name"), F.lit("Unknown")).alias("case_name"),
        first("$.citation[0]", "$.citation").alias("citation"),
        first("$.court", "$.court_id").alias("court"),
        first("$.dateFiled", "$.date_filed").alias("date_filed"),
        strip_tags(F.coalesce(first("$.snippet", "$.opinions[0].snippet"), F.lit(""))).alias("snippet"),
        F.when(F.startswith(url, F.lit("http")), url).otherwise(F.concat(F.lit("https://courts.example"), url)).alias("absolute_url"),
        F.coalesce(first("$.score").try_cast("double"), F.lit(0.0)).alias("score"),
    )


def ranked_cases(results: DataFrame, most: int = 15) -> DataFrame:
    """Results of several queries (query_no, pos): first of each case, no criminal ones, best scores first."""
    first = F.row_number().over(Window.partitionBy("matter_id", "case_id").orderBy("query_no", "pos"))
    kept = results.withColumn("__n", first).where("__n = 1").where(~rules.criminal(F.col("case_name"), F.col("snippet"))).drop("__n")
    place = F.row_number().over(Window.partitionBy("matter_id").orderBy(F.desc("score"), "case_id"))
    return kept.withColumn("rank", place).where(F.col("rank") <= most)


def with_analysis(cases: DataFrame, answers: DataFrame, least: float = 5.0) -> DataFrame:
    """Model answers (case_id, kind, score, text) pivoted to one row a case, joined; scores under `least` go (default 5)."""
    def of(kind: str, c: str) -> Column:
        return F.first(F.when(F.col("kind") == kind, F.col(c)), ignorenulls=True)

    per = answers.groupBy("case_id").agg(of("relevance", "score").alias("model_score"), of("relevance", "text").alias("why"), of("irac", "text").alias("irac"))
    joined = cases.join(per, "case_id", "left").withColumn("model_score", F.coalesce("model_score", F.lit(5.0)))
    return joined.where(F.col("model_score") >= least)
