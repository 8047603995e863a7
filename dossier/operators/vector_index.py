"""Inverted-file vector index: rows in lists around centroids, searched by the lists nearest to a query.

Centroids come from spherical k-means over a bounded sample, the ``SAMPLE`` vectors with the least hashes; every row is put into the list of its
nearest centroid and the index is written by list. A search scores the rows of the ``probes`` lists nearest to each query, within
its matter; how many is measured when the index is built, on rows of the sample, as vectors without clusters need many. The answer is then checked: a query that found fewer rows than asked for is searched exactly. What else the lists miss is measured,
see recall(); probing all lists is the exact search.

Defined results: vectors (of rows and of queries) that are null, of another length than the queries' index, or hold null or non-finite entries are in no list and
never found; zero vectors have similarity 0 to all. Rows that repeat are found as often. An empty table gives an empty index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.operators.research import BROADCAST_QUERIES, cosine, nearest_chunks
from dossier.sources.shared import materialize

LISTS, SAMPLE, ROUNDS = 100, 50_000, 12
#: Lists to probe are chosen so that this share of the nearest rows of the sample (in its matters) lies in them, for so many of its rows as queries.
AIM, TRIALS, NEAREST = 0.97, 400, 5


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def _usable(vector: str) -> Column:
    x = F.col(vector).cast("array<double>")
    return F.col(vector).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))


def centroids(x: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit vectors, begun at evenly spaced rows; an empty list takes the row that is farthest from its own."""
    found = x[np.linspace(0, len(x) - 1, lists).astype(int)]
    for _ in range(rounds):
        score = x @ found.T
        own = score.argmax(1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        sums[empty] = x[np.argsort(score.max(1), kind="stable")[: len(empty)]]
        found = _unit(sums)
    return found


def needed(x: np.ndarray, matters: np.ndarray, centres: np.ndarray, aim: float = AIM) -> int:
    """How many lists hold the share `aim` of the nearest rows of the same matter, over rows of the sample as queries."""
    own, ranks = (x @ centres.T).argmax(1), []
    for i in np.linspace(0, len(x) - 1, min(TRIALS, len(x))).astype(int):
        score = np.where((matters == matters[i]) & (np.arange(len(x)) != i), x @ x[i], -np.inf)
        near = np.argsort(-score, kind="stable")[:NEAREST]
        place = np.empty(len(centres), int)
        place[np.argsort(-(centres @ x[i]), kind="stable")] = np.arange(len(centres))
        ranks.append(place[own[near[np.isfinite(score[near])]]])
    found = np.concatenate(ranks) if ranks else np.zeros(0, int)
    return int(np.quantile(found, aim, method="higher")) + 1 if len(found) else len(centres)


class InvertedFile:
    """An index of chunks (chunk_id, matter_id, e) in a folder."""

    def __init__(self, spark: SparkSession, path: str, centres: np.ndarray, probes: int, schema: T.StructType) -> None:
        self.spark, self.path, self.centres, self.probes, self.schema = spark, path.rstrip("/"), centres, probes, schema

    @classmethod
    def build(cls, chunks: DataFrame, path: str, lists: int = LISTS, sample: int = SAMPLE) -> InvertedFile:
        """Fits on at most `sample` rows, indexes all rows. Fewer rows than lists make as many lists as rows."""
        rows = chunks.where(_usable("e")).select("chunk_id", "matter_id", "e")
        facts = rows.agg(F.count("*"), F.mode(F.size("e"), True)).first()
        dim = facts[1] or 1
        rows = rows.where(F.size("e") == dim)
        place = F.xxhash64("chunk_id", "e")
        share = min(1.0, 1.2 * sample / max(1, facts[0]))
        few = rows.where(F.pmod(place, F.lit(1_000_000)) < share * 1_000_000).select(place.alias("p"), "matter_id", "e").orderBy("p").limit(sample).collect()  # `sample` rows
        x = _unit(np.array([r["e"] for r in few], float).reshape(-1, dim))
        centres = centroids(x, max(1, min(lists, len(x)))) if len(x) else np.zeros((1, dim))
        schema = T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType())])
        found = cls(chunks.sparkSession, path, centres, needed(x, np.array([str(r["matter_id"]) for r in few]), centres), schema)
        listed = found._with_lists(rows, "e", 1).withColumn("list", F.col("lists")[0]).drop("lists")
        listed.repartition("list", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).write.mode("overwrite").partitionBy("list").parquet(f"{found.path}/rows")
        return found

    def _with_lists(self, rows: DataFrame, vector: str, probes: int) -> DataFrame:
        """rows with lists: the numbers of the lists nearest to a vector, the nearest first."""
        centres, probes, at = self.centres, min(probes, len(self.centres)), rows.columns.index(vector)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, centres.shape[1])
                near = np.argsort(-(_unit(x) @ centres.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * probes, pa.int32()), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "lists"])

        schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
        return rows.mapInArrow(run, f"{schema}, lists array<int>")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def search(self, queries: DataFrame, most: int = 5, probes: int | None = None) -> DataFrame:
        """(query_id, chunk_id, similarity, rank) for queries (query_id, matter_id, q), each within its matter."""
        probes = probes or self.probes
        queries = materialize(queries.where(_usable("q")).where(F.size("q") == self.centres.shape[1]).select("query_id", "matter_id", "q"), "queries")
        if self.rows().isEmpty():
            return nearest_chunks(queries, self.rows(), most)
        asked = self._with_lists(queries, "q", probes).select("query_id", "matter_id", "q", F.explode("lists").alias("list"))
        # Bounded: at most BROADCAST_QUERIES queries; beyond that both sides are shuffled by list and matter.
        asked = F.broadcast(asked) if queries.count() <= BROADCAST_QUERIES else asked
        scored = self.rows().join(asked, ["list", "matter_id"]).select("query_id", "chunk_id", F.round(cosine(F.col("e"), F.col("q")), 9).alias("similarity"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id"))
        found = materialize(scored.withColumn("rank", place).where(F.col("rank") <= most), "found")
        enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= most).select("query_id")
        short = materialize(queries.join(enough, "query_id", "left_anti"), "short")
        if short.isEmpty():
            return found
        exact = nearest_chunks(short, self.rows().drop("list"), most).select(*found.columns)
        return found.join(enough, "query_id", "left_semi").unionByName(exact)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact answers that were found."""
    both = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "chunk_id"], "left")
    n, hits = both.agg(F.count("*"), F.count("hit")).first()
    return hits / n if n else 1.0
