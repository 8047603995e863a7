"""Running counts by ranges: any key as hot as it likes, same numbers as one window a key."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from dossier.operators import reports, running
from dossier.operators.ops import credit_decisions


def requests(spark, n=3000):
    r, start = random.Random(6), dt.datetime(2024, 1, 1)
    rows = [(i, r.choice([1, 1, 1, 2, 3, None]), r.choice([7, 7, 7, 7, 8, None]), start + dt.timedelta(minutes=r.randrange(60 * 48))) for i in range(n)]
    return spark.createDataFrame(rows + rows[:5], "id long, user_id long, organization_id long, ts timestamp")


def test_running_equals_windows_and_spreads_hot_keys(spark):
    df, order = requests(spark), [F.col("ts"), F.col("id")]
    dealt = running.ranged(df, order, 100)
    found = running.running(dealt, [F.col("organization_id")], order, "n")
    found = running.running(found, [F.col("user_id"), F.to_date("ts")], order, "s", F.col("id") % 7)
    whole = lambda *key: Window.partitionBy(*key).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"n": F.count("*").over(whole("organization_id")), "s": F.sum(F.col("id") % 7).over(whole("user_id", F.to_date("ts")))})
    key = ["id", "n", "s"]
    assert sorted(map(tuple, found.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
    sizes = [r["n"] for r in dealt.groupBy("__range").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 20 and max(sizes) < 3 * sum(sizes) / len(sizes)
    assert running.running(running.ranged(df.limit(0), order), [F.col("user_id")], order, "n").collect() == []


def test_credits_of_a_hot_organization(spark):
    """Ranges of 50 rows and one range decide alike, and as one request after the other would."""
    df = requests(spark)
    orgs = spark.createDataFrame([(7, "free", 400), (8, "active", 0)], "id long, subscription_status string, bonus_credits long")
    found = {n: sorted(map(tuple, credit_decisions(df, orgs, 5, n).collect())) for n in (50, 10**6)}
    assert found[50] == found[10**6]
    used, spent, want = {}, {}, []
    for x in sorted(df.collect(), key=lambda x: (x["ts"], x["id"])):
        org, day = x["organization_id"], (x["user_id"], x["ts"].date())
        used[day] = used.get(day, 0) + 1
        if org == 8:
            want.append((x["id"], "paid"))
        elif used[day] <= 5:
            want.append((x["id"], "free"))
        else:
            spent[org] = spent.get(org, 0) + 1
            want.append((x["id"], "balance" if spent[org] <= (400 if org == 7 else 0) else "denied"))
    assert sorted(want) == found[50]


def test_report_of_a_common_name(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["Ann Lee", "Ann Lee", "Ann Lee", "Bob Stone", f"n{i}", None]), "other", r.choice(["highly_relevant", "relevant", None]), r.choice(["high", "low"]), r.random(), f"saw {i}") for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, full_name string, role string, relevance string, importance string, confidence_score double, observation string")
    blank = {c: F.lit(None).cast("string") for c in ("email", "phone", "address", "source_quote", "filename", "document_relevance", "relevance_reason")}
    frame = frame.withColumns(blank | {"source_page": F.lit(None).cast("int")})
    few, one = (sorted(map(repr, reports.report(frame, n).collect())) for n in (40, 10**6))
    assert few == one and sum("Multiple observations" in x for x in few) == 3
