"""Keyed tables with versions: pinned readers, killed and rival writers, untouched buckets."""

import os

import pytest

from dossier.operators.sync import upsert
from dossier.sources import versioned as V

SCHEMA = "k long, v string"


def merge(old, new):
    return upsert(old, new, ["k"], ["v"])


def table(spark, tmp_path):
    return V.VersionedTable(spark, f"{tmp_path}/t", SCHEMA, ["k"], buckets=8)


def rows(df):
    return sorted((r["k"], r["v"]) for r in df.collect())


def test_versions_and_readers(spark, tmp_path):
    t = table(spark, tmp_path)
    assert rows(t.read()) == [] and t.versions() == []
    assert t.upsert(spark.createDataFrame([(i, "a") for i in range(50)], SCHEMA), merge) == 0
    pinned = t.read()
    first = t._manifest(0)
    assert t.upsert(spark.createDataFrame([(3, "b"), (3, "a"), (99, None)], SCHEMA), merge) == 1
    second = t._manifest(1)
    touched = {b for b in second if first.get(b) != second[b]}
    assert 1 <= len(touched) <= 2 and len(second) == 8  # only the buckets of 3 and 99 were written
    assert rows(pinned) == [(i, "a") for i in range(50)] == rows(t.read(0))
    assert dict(rows(t.read())) == {i: "b" if i == 3 else "a" for i in range(50)} | {99: None}
    assert t.upsert(spark.createDataFrame([], SCHEMA), merge) == 1
    t.upsert(spark.createDataFrame([(4, "c")], SCHEMA), merge)
    t.vacuum(keep=1, hours=0)
    assert t.versions() == [2] and dict(rows(t.read()))[4] == "c" and len(rows(t.read())) == 51


def test_killed_writer_leaves_the_old_version(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(spark.createDataFrame([(1, "a")], SCHEMA), merge)

    class Killed(V.VersionedTable):
        def _commit(self, version, manifest):
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        Killed(spark, f"{tmp_path}/t", SCHEMA, ["k"], buckets=8).upsert(spark.createDataFrame([(1, "b"), (2, "b")], SCHEMA), merge)
    assert len(os.listdir(f"{tmp_path}/t/data")) == 2 and rows(t.read()) == [(1, "a")]
    with pytest.raises(Exception, match="boom"):
        t.upsert(spark.createDataFrame([(1, "c")], SCHEMA), lambda old, new: merge(old, new.selectExpr("k", "raise_error('boom') AS v")))
    assert rows(t.read()) == [(1, "a")]
    t.vacuum(keep=1, hours=0)
    assert len(os.listdir(f"{tmp_path}/t/data")) == 1 and rows(t.read()) == [(1, "a")]


def test_rival_writers_lose_nothing(spark, tmp_path):
    """Another writer commits between the read and the commit: the merge is done again onto its version."""
    t, calls = table(spark, tmp_path), []

    def slow(old, new):
        calls.append(1)
        if len(calls) == 1:
            table(spark, tmp_path).upsert(spark.createDataFrame([(1, "rival"), (5, "rival")], SCHEMA), merge)
        return merge(old, new)

    assert t.upsert(spark.createDataFrame([(1, "mine"), (2, "mine")], SCHEMA), slow) == 1
    assert rows(t.read()) == [(1, "mine"), (2, "mine"), (5, "rival")] and len(calls) == 2
    assert not [n for n in os.listdir(f"{tmp_path}/t/manifests") if n.startswith("_")]
