"""Person resolution: golden groups, independence of partitions, cold edges."""

import pytest

from dossier.operators import resolve as P

SCHEMA = "id long, matter_id long, document_id long, source_page int, full_name string, role string, observation string, email string, relevance string, confidence_score double, phone string, address string, relevance_reason string"
#: Fixed golden data: names of one or several people, and the number of people.
GROUPS = {
    1: (["John Smith", "John A. Smith", "J. Smith", "JOHN SMITH", "Mr. John Smith"], 2),
    2: (["Dr. Maria Garcia", "Maria Garcia, M.D.", "Maria L. Garcia", "Dr. M. Garcia"], 2),
    3: (["Robert Johnson", "Bob Johnson", "Robert 'Bob' Johnson", "R. Johnson"], 2),
    4: (["William Chen", "Bill Chen", "William H. Chen, Ph.D."], 1),
    5: (["Elizabeth Taylor", "Liz Taylor", "Beth Taylor", "E. Taylor"], 2),
    6: (["Michael Brown", "Michael Brown Jr.", "Michelle Brown", "James Wilson", "James Williams"], 3),
}


def mentions(spark):
    rows = [(m * 100 + i, m, i, None, n, "other", None, None, None, 0.5, None, None, None) for m, (names, _) in GROUPS.items() for i, n in enumerate(names)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("parts", [1, 5])
def test_golden_groups(spark, parts):
    found = P.resolved(mentions(spark).repartition(parts)).groupBy("matter_id").agg({"person": "max"}).collect()
    assert {r[0]: r[1] + 1 for r in found} == {m: n for m, (_, n) in GROUPS.items()}


def test_merged_names(spark):
    people = {(r["matter_id"], r["person"]): r["full_name"] for r in P.canonical_people(P.resolved(mentions(spark))).collect()}
    assert people[1, 0] == "Mr. John Smith" and people[3, 0] == "Robert 'Bob' Johnson" and people[4, 0] == "William H. Chen, Ph.D."


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert P.resolved(none).count() == 0 and P.loose_clusters(none).count() == 0


def test_merge_twice_is_once(spark):
    from dossier.operators.sync import merge_snapshot

    local = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", True), (2, 3, "c", False)], "m long, k long, v string, is_soft_deleted boolean")
    source = spark.createDataFrame([(1, 1, "x"), (1, 9, "n")], "m long, k long, v string")
    once = merge_snapshot(local, source, "m", "k", ["v"])
    assert {r["k"]: (r["v"], r["is_soft_deleted"], r["action"]) for r in once.collect()} == {1: ("x", False, "update"), 2: ("b", True, "unchanged"), 3: ("c", False, "unchanged"), 9: ("n", False, "insert")}
    twice = merge_snapshot(once.drop("action"), source, "m", "k", ["v"])
    assert sorted(map(tuple, twice.drop("action").collect())) == sorted(map(tuple, once.drop("action").collect()))


def test_credits(spark):
    from dossier.operators.ops import credit_decisions

    asked = spark.createDataFrame([(i, 1, 1, f"2024-01-01 10:{i:02d}:00") for i in range(14)], "id long, user_id long, organization_id long, ts string").selectExpr("id", "user_id", "organization_id", "cast(ts as timestamp) as ts")
    orgs = lambda s: spark.createDataFrame([(1, s, 2)], "id long, subscription_status string, bonus_credits long")
    said = [r["decision"] for r in credit_decisions(asked, orgs("free")).orderBy("id").collect()]
    assert said == ["free"] * 10 + ["balance"] * 2 + ["denied"] * 2
    assert {r["decision"] for r in credit_decisions(asked, orgs("trialing")).collect()} == {"paid"}


def test_linked_forms(spark):
    rows = [(i, 1, i, None, n, "other", None, None, None, 0.5, None, None, None) for i, n in enumerate(["John Carroll", "John Mike Carroll", "Mike Carroll", "Michael Carroll", "FNU Carroll", "Ann Lee", "Lee Ann", "Ann Stone", "", None, " ".join(f"Token{i}" for i in range(30))])]
    found = {r["id"]: r["person"] for r in P.linked(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len({found[i] for i in range(5)}) == 1 and found[5] == found[6] != found[7] and len(found) == len(rows) - 1


def test_linked_long_names(spark):
    """Token subsets of names of any length link, wherever their tokens stand in the alphabet."""
    names = ["Zzz Yyy", "Aaa Bbb Ccc Ddd Eee Fff Ggg Hhh Yyy Zzz", "Bbb Aaa", "Yyy Qqq", "Hhh Ggg Fff"]
    rows = [(i, 1, i, None, n, "other", None, None, None, 0.5, None, None, None) for i, n in enumerate(names)]
    found = {r["id"]: r["person"] for r in P.linked(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[0] == found[1] == found[2] == found[4] != found[3]


def test_agreement_compares_members(spark):
    a = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 1), (4, 1, 1), (5, 1, 2)], "id long, matter_id long, person long")
    b = spark.createDataFrame([(1, 1, 9), (2, 1, 8), (3, 1, 8), (4, 1, 9), (5, 1, None)], "id long, matter_id long, person long")
    assert [tuple(r) for r in P.agreement(a, b).collect()] == [(1, 3, 2, 0.2)]


def test_merge_in_order(spark):
    """Role of the first, higher relevance with its reason, one observation a document, first contacts, highest confidence."""
    rows = [
        (1, 1, 1, 2, "Ann Lee", "expert", None, None, None, 0.2, None, "", "why not"),
        (2, 1, 1, 3, "Ann Mary Lee", "plaintiff", "saw", "", "not_relevant", 0.9, None, "1 Main St", "no"),
        (3, 1, 1, 4, "Ann Lee", "other", "saw again", "a@b.c", "highly_relevant", None, "555", None, "first"),
        (4, 1, 2, None, "Mary Ann Lee", "other", "heard", "x@y.z", "highly_relevant", 0.5, "777", None, "second"),
        (5, 1, 3, None, "Ann Lee", "other", "", None, "bogus", 0.1, None, None, "third"),
    ]
    found = P.resolved(spark.createDataFrame(rows, SCHEMA).repartition(3))
    one = P.canonical_people(found).collect()
    assert len(one) == 1
    told = {k: one[0][k] for k in ("full_name", "role", "relevance", "relevance_reason", "email", "phone", "address", "max_confidence", "observations", "source_documents", "mentions")}
    assert told == {"full_name": "Ann Mary Lee", "role": "expert", "relevance": "highly_relevant", "relevance_reason": "first", "email": "a@b.c", "phone": "555", "address": "1 Main St", "max_confidence": 0.9, "observations": 2, "source_documents": 4, "mentions": 5}
    assert sorted((r["document_id"], r["observation"]) for r in P.merged_observations(found).collect()) == [(1, "saw"), (2, "heard")]
    shy = P.canonical_people(P.resolved(spark.createDataFrame(rows[:2], SCHEMA))).first()
    assert (shy["relevance"], shy["relevance_reason"]) == ("relevant", "why not")


def test_order_counts(spark):
    """The fold reads mentions one by one: a name that became longer in between changes what an equal form meets later."""
    names = ["Bob Stone", "Bob Lee Stone", "Lee Stone"]
    rows = [(i, 1, i, None, n, "other", None, None, None, 0.5, None, None, None) for i, n in enumerate([*names, "Bob Stone"])]
    found = {r["id"]: (r["person"], r["match_type"]) for r in P.resolved(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {0: (0, "none"), 1: (0, "token_subset"), 2: (0, "token_subset"), 3: (0, "token_subset")}


def test_embedding_and_verdict_tiers(spark):
    from pyspark.sql import functions as F

    rows = [(i, 1, i, None, n, r, None, None, None, 0.5, None, None, None) for i, (n, r) in enumerate([("Qadir Khan", "expert"), ("Gadhafi Mohammed", "expert"), ("Xu Wei", "other"), ("Qadhir Kahn", "expert")])]
    near = lambda name: F.when(name == "Gadhafi Mohammed", F.array(F.lit(1.0), F.lit(0.1))).when(name == "Qadir Khan", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    frame = spark.createDataFrame(rows, SCHEMA)
    kinds = lambda f: {r["id"]: (r["person"], r["match_type"]) for r in f.collect()}
    assert kinds(P.resolved(frame))[1] == (1, "none")
    assert kinds(P.resolved(frame, embed=near))[1] == (0, "embedding")
    plain = kinds(P.resolved(frame))[3]
    asked = kinds(P.resolved(frame, verdict=lambda new, known: (new["role"] == known["role"] and known["name"] == "Qadir Khan", 0.8)))[3]
    assert plain == (0, "fuzzy") or (plain[1], asked) == ("none", (0, "verified"))


def test_folds_like_plain_python(spark):
    """Random names of several matters against the fold written out over all mentions."""
    import random

    r = random.Random(3)
    pool = ["John Smith", "Jon Smith", "John Q Smith", "J. Smith", "Mike Carroll", "Michael Carroll", "Mikey Carol", "FNU Carroll", "Ann Lee", "Lee Ann", "Anne Leigh", "Dr. Ann Lee Stone", ""]
    rows = [(i, r.randrange(4), r.randrange(9), r.choice([None, 1, 2]), r.choice(pool), "other", None, None, None, 0.5, None, None, None) for i in range(300)]
    strict = {n: f for n, f in P.forms(spark.createDataFrame([(n,) for n in pool], "full_name string")).select("full_name", "form").collect()}
    people, want = {}, {}
    for i, m, d, page, name, *_ in sorted(rows, key=lambda x: (x[1], x[2], -1 if x[3] is None else x[3], x[0])):
        mine, found, best = people.setdefault(m, []), None, 0.0
        for k, known in enumerate(mine):
            if P.tier(strict[name], strict[known]):
                found = k
                break
            score = P.fuzzy_of(strict[name], strict[known])
            if score >= 0.85 and score > best:
                found, best = k, score
        if found is None:
            mine.append(name)
            found = len(mine) - 1
        elif len(name) > len(mine[found]):
            mine[found] = name
        want[i] = found
    got = {x["id"]: x["person"] for x in P.resolved(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()}
    assert got == want


def test_repeated_and_missing_ids_are_mentions_of_their_own(spark):
    """Count in = count out, whatever the ids; other columns stay with their rows."""
    rows = [(i, m, d, None, n, "other", o, None, None, 0.5, None, None, None) for i, m, d, n, o in [
        (None, 1, 1, "Ann Lee", "a"), (None, 1, 1, "Ann Lee", "b"), (5, 1, 2, "Bob Stone", "c"), (5, 1, 2, "Bob Stone", "c"), (5, 2, 3, "Ann Lee", "d"), (None, 2, None, "Xu Wei", "e"), (7, None, 1, "Ann Lee", "f"), (8, 1, 1, None, "g")]]
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"person": F.lit("clash"), "stamp": F.current_timestamp(), "money": F.lit(1).cast("decimal(9,2)")})
    apart = lambda n: F.array(*[(n == x).cast("float") for x in ("Ann Lee", "Bob Stone", "Xu Wei")])
    for embed in (None, apart):
        found = P.resolved(frame, embed=embed)
        got = found.collect()
        assert sorted((r["id"] or -1, r["matter_id"], r["full_name"], r["observation"], r["person"]) for r in got) == [(-1, 1, "Ann Lee", "a", 0), (-1, 1, "Ann Lee", "b", 0), (-1, 2, "Xu Wei", "e", 0), (5, 1, "Bob Stone", "c", 1), (5, 1, "Bob Stone", "c", 1), (5, 2, "Ann Lee", "d", 1)]
        assert all(r["stamp"] and r["money"] == 1 for r in got) and dict(found.dtypes)["person"] == "int"
    assert {(r["matter_id"], r["mentions"], r["people"]) for r in P.stats(P.resolved(frame)).collect()} == {(1, 4, 2), (2, 2, 2)}
    assert P.resolved(frame.limit(0)).count() == 0


def test_verdicts_have_reasons(spark):
    """Only a verdict that confirms leaves its reason; the other tiers have none."""
    from dossier.functions import hooks

    names = ["Jonathan Blackwood", "Ann Lee", "Jonas Blackford", "Xavier Blackwood", "Ann Lee"]
    rows = [(i, 1, i, None, n, r, None, None, None, 0.5, None, None, None) for i, (n, r) in enumerate(zip(names, ["other"] * 5, strict=True))]
    asked = lambda new, known: (known["name"].startswith("Jonathan"), 0.8, f"asked about {known['name']}")
    found = {r["id"]: (r["match_type"], r["match_reason"]) for r in P.resolved(spark.createDataFrame(rows, SCHEMA), verdict=asked).collect()}
    assert all((kind == "verified") == (why is not None) for kind, why in found.values()) and found[4] == ("exact", None) and found[0] == ("none", None)
    assert {why for kind, why in found.values() if kind == "verified"} <= {"asked about Jonathan Blackwood"} and any(kind == "verified" for kind, _ in found.values())
    assert hooks.initials_verdict({"name": "Jo Lee", "role": "a"}, {"name": "Jim Lee", "role": "b"}) == (True, 0.8, "equal initials and last names")


def random_mentions(spark, n=400):
    """Mentions of several matters whose names link by last names, nicknames, placeholders and token subsets; one matter has no names left."""
    import random

    r = random.Random(11)
    first = ["John", "Jack", "Liz A.", "Beth", "Dr. Bob", "Robert", "FNU", "Unknown", "FNU LNU", "Ann Mary", "Ann", "", "Chris", "Christine", "J."]
    last = ["Carroll", "Smith", "Smith Carroll", "O'Brien", "Chen Jr.", "Lee", "Ann", "FNU", ""]
    rows = [(i, i % 7, i % 60 * 7 + i % 7, r.choice([None, 1, 2]), " ".join([r.choice(first), r.choice(last)]), "other", None, None, None, 0.5, None, None, None) for i in range(n)]
    rows += [(n, 8, 900, None, "", *rows[0][5:]), (n + 1, 8, 900, None, "Mr.", *rows[0][5:]), (n + 2, None, 901, None, "Ann Lee", *rows[0][5:]), (n + 3, 8, 901, None, None, *rows[0][5:])]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("small", [0, 12, 30, 1_000])
def test_small_and_large_matters_are_linked_alike(spark, small):
    frame = random_mentions(spark)
    person = lambda found: {r["id"]: (r["form"], r["person"]) for r in found.collect()}
    rounds = person(P.linked(frame, small=0))
    assert person(P.linked(frame, small=small)) == rounds and len({p for _, p in rounds.values()}) > 60
    want = sorted(map(tuple, P.agreement(P.resolved(frame), P.linked(frame, small=0)).collect()))
    assert sorted(map(tuple, P.compared(frame, small=small).collect())) == want and len(want) == 8 and any(0 < r[3] < 1 for r in want)


def test_scale_mode_counts_each_mention_once(spark, monkeypatch):
    """Rows without an id or of one id are mentions of their own; forms come before or after the shuffle; matters may be texts."""
    from pyspark.sql import functions as F

    frame = random_mentions(spark, 200)
    want = sorted(map(tuple, P.compared(frame).collect()))
    equal = frame.where("id % 5 <> 0").unionByName(frame.where("id % 5 = 0").withColumn("id", F.lit(None).cast("long"))).withColumn("id", F.when(F.col("id") % 5 == 1, 7).otherwise(F.col("id")))
    each = {r["matter_id"]: (r["n"], r["people"]) for r in P.resolved(equal).groupBy("matter_id").agg(F.count("*").alias("n"), F.count_distinct("person").alias("people")).collect()}
    got = P.compared(equal).collect()
    assert {r["matter_id"]: r["people_a"] for r in got} == {m: people for m, (_, people) in each.items()}
    assert all(abs(r["same"] * each[r["matter_id"]][0] - round(r["same"] * each[r["matter_id"]][0])) < 0.01 for r in got)
    monkeypatch.setattr(P, "FEW_SPELLINGS", 1)
    assert sorted(map(tuple, P.compared(frame).collect())) == want
    texts = P.compared(frame.withColumn("matter_id", F.concat(F.lit("m"), "matter_id")), small=12).collect()
    assert sorted((int(r["matter_id"][1:]), r["people_a"]) for r in texts) == [r[:2] for r in want]
    assert P.compared(frame.limit(0)).count() == 0


def test_places_keep_the_order(spark):
    frame = random_mentions(spark).where("matter_id IS NOT NULL")
    matter = frame.select("document_id", "matter_id").distinct()
    assert matter.count() == matter.select("document_id").distinct().count()
    found = P.compared(P.placed(frame.repartition(5)).join(matter, "document_id"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, P.compared(frame).collect()))
