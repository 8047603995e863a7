"""Trees given by parent pointers: roots, depths and paths by pointer doubling.

Every round replaces each pointer by the pointer of where it leads, so a chain of n folders takes log2(n) rounds, each one a join by id
over a table in the shared folder; no limit on depth or size. Where many pointers lead to one folder (a hot parent), that join
has one row of it on the other side, so adaptive execution can split the hot side. Rows of a cycle, or below one, are those
that are still under way when a round ends no row: in a tree some row ends in every round until all have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.sources.shared import discard, materialize


def ends(nodes: DataFrame) -> DataFrame:
    """(id, end, steps) of nodes (id, next), ids different: the last node that pointers lead to, and how many lead there.

    A null next ends a way; end is null where it never ends. Every next must be an id.
    """
    last = F.col("next").isNull()
    now = materialize(nodes.select("id", F.when(last, F.col("id")).alias("end"), F.when(last, 0).otherwise(1).cast("long").alias("steps"), F.col("next").alias("jump")), "pointers")
    before, under_way = None, now.where("jump IS NOT NULL").count()
    while under_way and under_way != before:
        there = now.select(F.col("id").alias("jump"), F.col("end").alias("end2"), F.col("steps").alias("steps2"), F.col("jump").alias("jump2"))
        moved = now.where("jump IS NOT NULL").join(there, "jump").select("id", F.col("end2").alias("end"), (F.col("steps") + F.col("steps2")).alias("steps"), F.col("jump2").alias("jump"))
        old, now = now, materialize(moved.unionByName(now.where("jump IS NULL")), "pointers")
        discard(old)
        before, under_way = under_way, now.where("jump IS NOT NULL").count()
    ended = F.col("jump").isNull()
    return now.select("id", F.when(ended, F.col("end")).alias("end"), F.when(ended, F.col("steps")).alias("steps"))


def paths(nodes: DataFrame) -> DataFrame:
    """(id, path) of nodes (id, name, next) without cycles: the names on the way from the end to the node, joined by slashes."""
    now = materialize(nodes.select("id", F.col("name").alias("path"), F.col("next").alias("jump")), "paths")
    while not now.where("jump IS NOT NULL").isEmpty():
        there = now.select(F.col("id").alias("jump"), F.col("path").alias("front"), F.col("jump").alias("jump2"))
        moved = now.where("jump IS NOT NULL").join(there, "jump").select("id", F.concat("front", F.lit("/"), "path").alias("path"), F.col("jump2").alias("jump"))
        old, now = now, materialize(moved.unionByName(now.where("jump IS NULL")), "paths")
        discard(old)
    return now.select("id", "path")


def _linked(folders: DataFrame) -> DataFrame:
    """(id, name, next): one row an id, next only where it is an id."""
    one = folders.where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("parent_id", "name")).alias("f")).select("id", F.col("f.name").alias("name"), F.col("f.parent_id").alias("parent_id"))
    one = materialize(one, "folders")
    known = one.select(F.col("id").alias("parent_id"), F.col("id").alias("next"))
    return one.join(known, "parent_id", "left").select("id", "name", "next")


def tree(folders: DataFrame) -> DataFrame:
    """(id, name, root, depth, path) of folders (id, name, parent_id). A parent that is null or unknown makes a root.

    Defined results: rows without an id take no part; of rows with one id the one with the greatest (parent, name) counts; a null
    name is an empty one in paths. Folders of a cycle, or below one, have no root: their root, depth and path are null.
    """
    linked = materialize(_linked(folders), "linked")
    found = materialize(ends(linked.select("id", "next")), "ends")
    ended = found.where("end IS NOT NULL").select("id")
    below = paths(linked.join(ended, "id", "left_semi").withColumn("name", F.coalesce("name", F.lit(""))))
    return linked.select("id", "name").join(found, "id").join(below, "id", "left").select("id", "name", F.col("end").alias("root"), F.col("steps").cast("int").alias("depth"), "path")


def below(folders: DataFrame, start, excluded: list | None = None) -> DataFrame:
    """(id) of start, known or not, and all folders below it; excluded folders prune what is below them, the start stays.

    Pointers end at the start and at excluded folders, so those that end at the start are below it, a cycle through it included.
    """
    linked = _linked(folders)
    kind = dict(linked.dtypes)["id"]
    stop = F.col("id") == F.lit(start)
    if excluded:
        stop = stop | F.col("id").isin(*excluded)
    found = ends(linked.select("id", F.when(~stop, F.col("next")).alias("next"))).where(F.col("end") == F.lit(start)).select("id")
    own = folders.sparkSession.range(1).select(F.lit(start).cast(kind).alias("id"))
    return found.unionByName(own).distinct()
