"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from dossier.sources.shared import discard, materialize


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The links as a table, and what tells it from the table of the round before: their number and the sum of their hashes."""
    seen = Observation()
    e = materialize(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "links")
    return e, (seen.get["n"], seen.get["h"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the least node that can be reached.

    Every round reduces neighbourhoods to their minimum by a partial aggregate and joins it back; each round is written to
    the shared folder and the one before deleted. The aggregate never gathers a node's links in one task; in the join, the
    links of a node with very many of them are one key, which adaptive execution splits over tasks. Self-links, repeated
    links and null ends are dropped; an empty table gives an empty result.
    """
    e, now = _written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while now != before and now[0]:
        before, old = now, e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, now = _written(small.unionByName(m.select("u", F.col("m").alias("v"))).distinct())
        discard(old)
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
