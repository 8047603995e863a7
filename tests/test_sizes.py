"""Steps that once cost more than their input asks for."""

import email

from pyspark.sql import functions as F


def test_headers_are_parsed_once():
    from dossier.sources import landing as L

    message = email.message_from_bytes(b"Subject: =?utf-8?q?caf=C3=A9?=\nFrom: a@b.c\n\nhello", policy=L.MAIL)
    assert message["Subject"] is message["Subject"] and message["Subject"] == "café"
    long = "x" * 2_000
    assert email.message_from_bytes(f"Subject: {long}\n\nhello".encode(), policy=L.MAIL)["Subject"] == long


def test_one_join_tells_linked_from_unlinked(spark):
    import os

    import pytest

    from dossier.plans import registry
    from tests.sql_twin import DATA

    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    plan = registry.queries()["jn_11_unlinked"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_names_of_a_report_take_one_shuffle(spark):
    from dossier.operators import reports

    rows = spark.range(300).select("id", F.concat(F.lit("n"), F.col("id") % 40).alias("full_name"), F.lit(1).alias("rank"), (F.col("id") % 3 / 2).alias("confidence_score"))
    found = reports._numbered(rows, [F.col("rank"), F.col("id"), F.desc("confidence_score")], 10**6)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r["n"], r["top"]["id"]) for r in found.where("id = 47").collect()} == {(8, 7)}


def test_runs_of_many_keys_in_one_state():
    from dossier.streaming.timeouts import MINUTE, merged_runs

    runs = [("b", 5, 0, 0, 1), ("a", 5, 9 * MINUTE, 9 * MINUTE, 1), ("a", 5, 0, 4 * MINUTE, 2), ("a", 30, 40 * MINUTE, 40 * MINUTE, 1)]
    assert merged_runs(runs) == [("a", 5, 0, 9 * MINUTE, 3), ("a", 30, 40 * MINUTE, 40 * MINUTE, 1), ("b", 5, 0, 0, 1)]


def test_names_are_normalised_once_a_spelling_and_folds_run_once(spark):
    from dossier.operators import resolve as P

    rows = spark.range(60).select("id", (F.col("id") % 3).alias("matter_id"), F.col("id").alias("document_id"), F.lit(None).cast("int").alias("source_page"), F.concat(F.lit("Ann L"), F.col("id") % 5).alias("full_name"))
    for c in ("role", "relevance", "relevance_reason", "observation", "email", "phone", "address"):
        rows = rows.withColumn(c, F.lit("x"))
    plan = P.forms(rows).where("form <> ''")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "_decomposed" not in plan
    people = P.canonical_people(P.resolved(rows.withColumn("confidence_score", F.lit(0.5))))
    assert people._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_vectors_with_the_rows_or_at_once_give_the_same(spark, monkeypatch):
    from dossier.functions import hooks
    from dossier.operators import resolve as P

    names = ["Ann Lee", "Lee Ann Q", "Dr. Ann Lee", "Bob Stone", "Robert Stone", "Stone Bob R", "An Leigh"]
    rows = spark.createDataFrame([(i, i % 4, i, None, names[i * i % 7]) for i in range(120)], "id long, matter_id long, document_id long, source_page int, full_name string")

    def found():
        return sorted(tuple(r) for r in P.resolved(rows, embed=hooks.embed).select("id", "person", "match_type", "match_score").collect())

    at_once = found()
    monkeypatch.setattr(P, "FEW_SPELLINGS", 1)
    assert found() == at_once


def test_scale_mode_shuffles_mentions_twice_and_takes_no_rounds(spark, monkeypatch):
    """By document for the join, then by matter; what it needs of small matters comes from one stream, so nothing else is shuffled or written."""
    import os

    import pytest

    from dossier.operators import resolve as P
    from dossier.plans import registry
    from tests.sql_twin import DATA

    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    plans, write = {}, P.materialize

    def written(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(P, "materialize", written)
    found = registry.queries()["er_20_scale_mode"](spark, DATA)
    assert set(plans) == {"spellings", "compared"} and plans["compared"].count("Exchange hashpartitioning") <= 3
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and found.count() > 0
