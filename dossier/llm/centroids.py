"""Centroid clustering on integers, inside the JVM.

Components become integers once and are written to the shared folder. In each round the centroids are literal arrays of the
plan: zip_with and aggregate give the squared distance to each, array_min of (distance, number) structs chooses the cluster, and
partial sums of every component over the clusters are added up map-side, so a round shuffles at most one row a cluster and
task, and reads the table once. Only the sums of the clusters (k rows) reach the driver. The work is integer, so it is the same in
any order and layout.

Defined results: vectors that are null, hold null or non-finite components or have another number of components take no part.
Components beyond 2**27 units of 1/scale count as that bound, so that distances fit 64 bits. Rows that repeat are vectors of
their own; a start vector that ties by its id's hash is the one with the smallest components; rows without an id start a
centroid only where there are too few others. Fewer vectors than centroids give as many centroids as vectors; an empty table
gives an empty result. Inertia beyond 64 bits is shown as the greatest long. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import materialize, table

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SALT = 40, 5, 64, 256, "2"
_FAR, _LONG = 1 << 27, (1 << 63) - 1
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def integers(vectors: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """(id, v): the usable vectors as arrays of integers."""
    x = F.col(vector_col).cast("array<double>")
    usable = F.col(vector_col).isNotNull() & (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    v = F.transform(x, lambda c: F.greatest(F.least(F.floor(c * F.lit(float(scale))), F.lit(_FAR)), F.lit(-_FAR)).cast("long"))
    return vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def nearest(centroids: list[list[int]], v: str = "v") -> Column:
    """Struct (distance, cluster) of the nearest centroid, the one with the smaller number where two are equally near."""
    literal = ",".join("array(" + ",".join(f"{x}L" for x in c) + ")" for c in centroids)
    distance = f"aggregate(zip_with({v}, c, (a, b) -> (a - b) * (a - b)), 0L, (s, x) -> s + x)"
    return F.expr(f"array_min(transform(array({literal}), (c, i) -> named_struct('distance', {distance}, 'cluster', i)))")


def start(rows: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors whose ids have the smallest hashes."""
    order = F.sha2(F.concat(F.lit(salt + ":"), F.col("id").cast("string")), 256)
    return [list(r["v"]) for r in rows.select("v", order.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()]


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: every vector to its nearest centroid, every centroid that has any to the floor of their mean."""
    sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(len(centroids[0]))]
    found = rows.select(nearest(centroids)["cluster"].alias("cluster"), "v").groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect()
    by = {r["cluster"]: [r[f"s{i}"] // r["n"] for i in range(len(sums))] for r in found}
    return [by.get(i, c) for i, c in enumerate(centroids)]


def clustered(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIMENSIONS, scale: int = SCALE, salt: str = SALT
) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector, and the centroids."""
    spark = vectors.sparkSession
    rows = materialize(integers(vectors, id_col, vector_col, dim, scale), "integers")
    centroids = start(rows, k, salt)
    if not centroids:
        return spark.createDataFrame([], RESULT), []
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    best = rows.select(F.col("id").alias("vec_id"), nearest(centroids).alias("b"))
    assigned = materialize(best.select("vec_id", F.col("b.cluster").alias("cluster"), F.col("b.distance").alias("distance")), "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = min(sum(sums.values()), _LONG)
    facts = [(c, min(s, _LONG), total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    by = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(by), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids  # k rows


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))[0]


def _oracle() -> str:
    """Rounds written one after the other; distances from inner products, exact in doubles for components below 2**21."""
    near = "row_number() OVER (PARTITION BY r ORDER BY n2 - 2 * list_inner_product(v, c) + c2, k) = 1"
    sql = f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v, row_number() OVER () AS r FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
rows AS MATERIALIZED (SELECT *, list_inner_product(v, v) AS n2 FROM kept),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SALT}:' || vec_id), v) - 1 AS k, v AS c, n2 AS c2 FROM rows QUALIFY k < {CLUSTERS})"""
    for i in range(ROUNDS):
        sql += f""",
a{i} AS MATERIALIZED (SELECT k, v FROM rows, c{i} QUALIFY {near}),
m{i} AS (SELECT k, i, floor(sum(x) / count(*)) AS x FROM (SELECT k, unnest(v) AS x, unnest(range({DIMENSIONS})) AS i FROM a{i}) GROUP BY k, i),
n{i} AS (SELECT k, list(x ORDER BY i) AS c FROM m{i} GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT k, coalesce(n.c, o.c) AS c, list_inner_product(coalesce(n.c, o.c), coalesce(n.c, o.c)) AS c2 FROM c{i} o LEFT JOIN n{i} n USING (k))"""
    return sql + f""",
last AS (SELECT vec_id, k, c, (n2 - 2 * list_inner_product(v, c) + c2)::BIGINT AS d FROM rows, c{ROUNDS} QUALIFY {near})
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM last
"""


ORACLE_SQL = _oracle()
