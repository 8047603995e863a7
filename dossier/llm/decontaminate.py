"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

A benchmark item is contained in a document when at least ``CONTAINED`` of its distinct five-word shingles (A-Z lower-cased)
occur there; an item of one to four words has one shingle, its whole word sequence. Banded MinHash loses short items in long
documents, as their Jaccard similarity tends to zero, so the sketch is the bottom-m one: under the random order of a hash, an
item of q shingles of which c must occur keeps its q - c + 1 least hashes; a document that contains the item holds one of them
at least, whatever its length. Nothing is lost. Items are partitioned by size, first by the words of their shingles, then by
q: all items of a partition share c and m, and documents with fewer shingles than c do not meet it. Candidates are then
checked by comparing the shingles themselves.

The sketches are broadcast only when their counted rows are at most ``BROADCAST_ROWS``; beyond that both sides are shuffled
by hash. Only DataFrame functions run. Defined results: null or blank texts are never contained nor contain; documents and items without an id are not reported
and not removed; repeated rows are reported once with their highest containment; whole texts of any length are searched; an
empty benchmark leaves all documents; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import lower_ascii, materialize, table, words

SHINGLE, CONTAINED, BROADCAST_ROWS = 5, 0.8, 200_000


def _shingles(of: Column, one, k: int = SHINGLE) -> Column:
    """Array of one(words of a shingle) for each run of k words in an array of words, else null."""
    n = F.size(of) - k + 1
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: one(*[of[i + j] for j in range(k)]))
    return F.when(n > 0, each)


def _of_item(one) -> Column:
    """The shingles of an item's words w: runs of five, or all of the fewer words it has."""
    few = [F.when(F.size("w") == k, F.array(one(*[F.col("w")[j] for j in range(k)]))) for k in range(1, SHINGLE)]
    return F.coalesce(_shingles(F.col("w"), one), *few)


def _joined(*w: Column) -> Column:
    return F.concat_ws(" ", *w)


def sketches(items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """(hash, item, k, q, need): the bottom-m MinHash sketch of each item (item, w = its words); k words make its shingles."""
    sized = items.select("item", F.least(F.size("w"), F.lit(SHINGLE)).alias("k"), F.array_sort(F.array_distinct(_of_item(F.xxhash64))).alias("h")).where("h is not null")
    sized = sized.withColumn("q", F.size("h")).withColumn("need", F.ceil(F.col("q") * contained - 1e-9).cast("int"))
    return sized.select(F.explode(F.slice("h", F.lit(1), F.col("q") - F.col("need") + 1)).alias("hash"), "item", "k", "q", "need")


def contained_items(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, contained: float = CONTAINED) -> DataFrame:
    """(id_col, item_col, shared, item_shingles, containment) for each item that a document contains."""
    lists = docs.select(F.col(id_col).alias("doc"), words(lower_ascii(F.col(text_col))).alias("w")).where("doc is not null")
    bench = items.select(F.col(item_col).alias("item"), words(lower_ascii(F.col(item_text_col))).alias("w")).where("item is not null")
    bench = materialize(bench, "items")
    sketch = materialize(sketches(bench, contained), "sketches")
    n = sketch.count()
    sizes = sorted(r["k"] for r in sketch.select("k").distinct().collect())  # of 1 to SHINGLE words
    # explode_outer: explode would infer a filter that computes the shingles a second time, inside the scan.
    runs = F.concat(*[F.coalesce(_shingles(F.col("w"), F.xxhash64, k), F.array().cast("array<long>")) for k in sizes]) if sizes else F.array().cast("array<long>")
    probes = lists.select("doc", F.size("w").alias("n"), F.explode_outer(runs).alias("hash"))
    met = probes.join(F.broadcast(sketch) if n <= BROADCAST_ROWS else sketch.hint("shuffle_hash"), "hash").where("n - k + 1 >= need")
    candidates = materialize(met.select("doc", "item").distinct(), "candidates")
    pairs = lists.join(candidates, "doc").join(bench.select("item", F.col("w").alias("iw"), F.array_distinct(_of_item(_joined)).alias("it")), "item")
    runs = [F.when(F.size("iw") == k, _shingles(F.col("w"), _joined, k)) for k in range(1, SHINGLE)]
    of_doc = F.coalesce(*runs, _shingles(F.col("w"), _joined))
    pairs = pairs.select("doc", "item", F.array_distinct(of_doc).alias("s"), F.col("it").alias("t"))
    exact = pairs.select("doc", "item", F.size(F.array_intersect("s", "t")).alias("shared"), F.size("t").alias("item_shingles"))
    exact = exact.groupBy("doc", "item").agg(F.max_by("shared", F.col("shared") / F.col("item_shingles")).alias("shared"), F.max_by("item_shingles", F.col("shared") / F.col("item_shingles")).alias("item_shingles"))
    kept = exact.where(F.col("shared") >= F.ceil(F.col("item_shingles") * contained - 1e-9))
    return kept.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), F.col("shared").cast("long").alias("shared"), F.col("item_shingles").cast("long").alias("item_shingles"), (F.col("shared") / F.col("item_shingles")).alias("containment"))


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that contain a benchmark item."""
    found = contained_items(docs, benchmark, id_col, text_col, "item_id", "text")
    gone = materialize(found.select(id_col).distinct(), "leaks")
    return docs.join(gone, id_col, "left_anti")


_SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

ORACLE_SQL = f"""
WITH bench AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
items AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (
  SELECT item_id, w, least(len(w), {SHINGLE}) AS k, unnest(range(1, len(w) - least(len(w), {SHINGLE}) + 2)) AS i FROM bench WHERE len(w) > 0)),
sizes AS (SELECT item_id, count(*) AS q FROM items GROUP BY item_id),
docs AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT doc_id, {_SQL_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL), (SELECT DISTINCT k FROM items))),
found AS (SELECT doc_id, item_id, count(*) AS shared FROM docs JOIN items USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, shared, q AS item_shingles, shared / q AS containment
FROM found JOIN sizes USING (item_id) WHERE shared >= ceil({CONTAINED} * q - 1e-9)
"""
