"""Snapshots, merges, folders and frozen scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.operators import trees


def until_repeat(items: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """Items of a paged scan before the first repeated id; everything from there on is dropped.

    Each id's second place is found by a ranked window with a limit of two; their minimum is a scalar subquery.
    """
    ranked = items.withColumn("__place", F.struct(*order)).withColumn("__n", F.row_number().over(Window.partitionBy(id_col).orderBy(*order)))
    second = ranked.where("__n <= 2").where("__n = 2").select("__place")
    sql = "SELECT * FROM {items} WHERE coalesce(__place < (SELECT min(__place) FROM {second}), true)"
    return items.sparkSession.sql(sql, items=items.withColumn("__place", F.struct(*order)), second=second).drop("__place")


def merge_snapshot(local: DataFrame, source: DataFrame, matter: str, key: str, values: list[str]) -> DataFrame:
    """Mark and sweep on (matter, key): local rows (with is_soft_deleted) against a source snapshot.

    Present in the source: insert, or update and un-delete. Absent: soft-delete, but unchanged where the source has no row
    at all for the matter. Of source rows with one key the greatest values count. Applying it twice gives the same. Columns: matter, key, values, is_soft_deleted, action.
    """
    s = source.groupBy(matter, key).agg(F.max(F.struct(*values)).alias("new")).select(matter, key, *[F.col(f"new.{v}").alias(f"new_{v}") for v in values], F.lit(True).alias("in_source"))
    old = local.select(matter, key, *values, "is_soft_deleted", F.lit(True).alias("in_local"))
    some = s.groupBy(matter).agg(F.count("*").alias("n"))
    both = old.join(s, [matter, key], "full_outer").join(some, matter, "left")
    known, there = F.col("in_local").isNotNull(), F.col("in_source").isNotNull()
    guarded = F.coalesce("n", F.lit(0)) == 0
    action = F.when(~known, "insert").when(there, "update").when(guarded | F.col("is_soft_deleted"), "unchanged").otherwise("soft_delete")
    deleted = F.when(there, F.lit(False)).when(guarded, F.col("is_soft_deleted")).otherwise(F.lit(True))
    return both.select(matter, key, *[F.when(there, F.col(f"new_{v}")).otherwise(F.col(v)).alias(v) for v in values], deleted.alias("is_soft_deleted"), action.alias("action"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Rows by key: new values where they are known, else the old ones. Of new rows with one key the greatest values count."""
    n = new.groupBy(*key).agg(F.max(F.struct(*values)).alias("new")).select(*key, *[F.col(f"new.{v}").alias(f"new_{v}") for v in values])
    return old.select(*key, *values).join(n, key, "full_outer").select(*key, *[F.coalesce(f"new_{v}", v).alias(v) for v in values])


def reset_matter(documents: DataFrame, mentions: DataFrame, matter: int) -> tuple[DataFrame, DataFrame]:
    """(documents with cleared flags, mentions without the matter's) before it is processed again."""
    mine = F.col("matter_id") == matter
    cleared = documents.withColumns({"is_processed": F.when(mine, False).otherwise(F.col("is_processed")), "processing_error": F.when(~mine, F.col("processing_error"))})
    gone = documents.where(mine).select(F.col("id").alias("document_id"))
    return cleared, mentions.join(gone, "document_id", "left_anti")


def replace_mentions(old: DataFrame, new: DataFrame, documents: DataFrame) -> DataFrame:
    """Mentions after the documents (document_id) were processed again: theirs go, the new ones come."""
    return old.join(documents, "document_id", "left_anti").unionByName(new)


def frozen_scope(documents: DataFrame) -> DataFrame:
    """(matter_id, ids): sorted ids of the live documents."""
    return documents.where("NOT is_soft_deleted").groupBy("matter_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def folder_tree(folders: DataFrame) -> DataFrame:
    """(id, name, root, depth, path) of folders (id, name, parent_id); unknown parents make roots, cycles have none."""
    return trees.tree(folders)


def documents_below(documents: DataFrame, folders: DataFrame, start: str, excluded: list[str] | None = None) -> DataFrame:
    """Documents (folder) in a folder or below it; excluded folders prune what is below them, the start stays."""
    return documents.join(trees.below(folders, start, excluded).withColumnRenamed("id", "folder"), "folder", "left_semi")


def changed(documents: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Documents whose content is new or was not processed: previous (key, content_hash, is_processed)."""
    p = previous.select(key, F.col("content_hash").alias("__h"), F.col("is_processed").alias("__p"))
    same = F.coalesce(F.col("__p") & (F.col("__h") == F.col("content_hash")), F.lit(False))
    return documents.join(p, key, "left").where(~same).drop("__h", "__p")


def text_or_name(value: Column) -> Column:
    """A JSON field that is a text or an object with a name."""
    return F.coalesce(F.get_json_object(value, "$.name"), F.when(~F.startswith(F.trim(value), F.lit("{")), F.regexp_replace(value, '^"|"$', "")))


def last_by(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")
