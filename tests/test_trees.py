"""Folder trees: deep, large, cyclic, hot and odd ones against plain walks."""

import random

from pyspark.sql import functions as F

from dossier.operators import sync, trees

SCHEMA = "id long, name string, parent_id long"


def by_hand(rows):
    one = {}
    for i, name, parent in rows:
        if i is not None:
            key = ((parent is not None, parent or 0), (name is not None, name or ""))
            if i not in one or key > one[i][0]:
                one[i] = (key, name, parent)
    out = {}
    for i in one:
        way, at = [i], one[i][2]
        while at in one and at not in way:
            way.append(at)
            at = one[at][2]
        cyclic = at in one
        out[i] = (one[i][1], None, None, None) if cyclic else (one[i][1], way[-1], len(way) - 1, "/".join(one[x][1] or "" for x in reversed(way)))
    return out


def below_by_hand(rows, start, excluded):
    children = {}
    for i, _, parent in rows:
        children.setdefault(parent, set()).add(i)
    found, todo = {start}, [start]
    while todo:
        for c in children.get(todo.pop(), ()):
            if c not in found and c not in excluded and c is not None:
                found.add(c)
                todo.append(c)
    return found


def test_trees_by_hand(spark):
    r = random.Random(2)
    rows = [(i, f"f{i}", r.choice([None, r.randrange(-3, 40), i - 1])) for i in range(40)]
    rows += [(100, "a", 102), (101, "b", 100), (102, "c", 101), (103, "under", 102), (104, "self", 104), (105, None, None), (106, "x", 105), (None, "no id", 3)]
    found = {x["id"]: (x["name"], x["root"], x["depth"], x["path"]) for x in sync.folder_tree(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == by_hand(rows)
    for start, excluded in ((3, []), (3, [5, 7]), (100, []), (100, [101]), (104, [104]), (999, [1]), (0, [0, 2])):
        below = [x["id"] for x in trees.below(spark.createDataFrame(rows, SCHEMA), start, excluded).collect()]
        assert len(below) == len(set(below)) and set(below) == below_by_hand(rows, start, excluded)
    assert trees.tree(spark.createDataFrame([], SCHEMA)).collect() == []
    twice = spark.createDataFrame([(1, "a", None), (1, "b", None), (2, "c", 1), (2, "c", 1)], SCHEMA)
    assert sorted((x["id"], x["path"]) for x in trees.tree(twice).collect()) == [(1, "b"), (2, "b/c")]


def test_deep_and_large(spark):
    """A chain of 10,000, two million folders of which a third lie in one, and a cycle."""
    chain = spark.range(10_000).select("id", F.lit("c").alias("name"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    many = spark.range(10_000, 2_000_000).select("id", F.lit("n").alias("name"), F.expr("CASE WHEN id % 3 = 0 THEN 10000 WHEN id > 10000 THEN 10000 + (id - 10000) DIV 2 END").alias("parent_id"))
    loop = spark.createDataFrame([(3_000_000, "x", 3_000_001), (3_000_001, "y", 3_000_000), (3_000_002, "z", 3_000_001)], SCHEMA)
    found = sync.folder_tree(chain.unionByName(many).unionByName(loop)).cache()
    stats = found.agg(F.count("*"), F.count_distinct("root"), F.max("depth"), F.count_if(F.col("root").isNull())).first()
    assert tuple(stats) == (2_000_003, 2, 9_999, 3)
    deep = found.where("id = 9999").first()
    assert deep["root"] == 0 and deep["path"] == "/".join("c" * 10_000)
    docs = spark.range(0, 12_000).select("id", F.col("id").alias("folder"))
    below = sync.documents_below(docs, chain.unionByName(loop), 5_000, [8_000])
    assert tuple(below.agg(F.count("*"), F.min("id"), F.max("id")).first()) == (3_000, 5_000, 7_999)
    assert {x["id"] for x in trees.below(loop, 3_000_000).collect()} == {3_000_000, 3_000_001, 3_000_002}
    found.unpersist()
