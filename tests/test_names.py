"""Golden values of name functions, rules and text functions."""

import pytest
from pyspark.sql import functions as F

from dossier.functions import names as N
from dossier.functions import rules
from dossier.functions import text as X


def column(spark, values, expr, names=("x",)):
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} string" for n in names))
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_strict_names(spark):
    given = ["Dr. John Smith", "Mr. John Smith", "John Smith, Esq.", "John Smith Jr.", "John Smith III", "John A. Smith", "JOHN SMITH", "Mrs. Jane Doe", "J. Smith", "O'Brien", "Mary-Jane Watson", "Robert 'Bob' Johnson", "Maria Garcia, M.D.", "José García", "", None, "Drew Barker"]
    want = ["john smith"] * 7 + ["jane doe", "smith", "obrien", "maryjane watson", "robert bob johnson", "maria garcia md", "jose garcia", "", "", "drew barker"]
    assert column(spark, given, N.strict(F.col("x"))) == want
    assert column(spark, ["Drew Barker"], N.strict(F.col("x"), compat=True)) == ["ew barker"]


@pytest.mark.parametrize(
    ("a", "b", "jw", "lev", "both"),
    [
        ("john smith", "jon smith", 0.9733, 0.9000, 0.9440),
        ("robert johnson", "bob johnson", 0.8411, 0.7143, 0.7904),
        ("john smith", "mary johnson", 0.5611, 0.1667, 0.4033),
        ("smith", "john smith", 0.4333, 0.5000, 0.4600),
        ("michael brown", "michelle brown", 0.9560, 0.7857, 0.8879),
        ("james wilson", "james williams", 0.9095, 0.6429, 0.8029),
        ("maria garcia md", "maria garcia", 0.9600, 0.8000, 0.8960),
        ("john smith", "jane doe", 0.6025, 0.2000, 0.4415),
    ],
)
def test_similarity(a, b, jw, lev, both):
    from dossier.operators.resolve import fuzzy_of

    assert N.jaro_winkler_of(a, b) == pytest.approx(jw, abs=1e-4)
    assert fuzzy_of(a, b) == pytest.approx(both, abs=1e-4)


def test_tiers_agree_with_columns(spark):
    from dossier.operators.resolve import tier

    pairs = [("john carroll", "john mike carroll"), ("mike carroll", "john mike carroll"), ("mike carroll", "michael carroll"), ("fnu carroll", "john carroll"), ("smith", "john smith"), ("edward stone", "theodore stone"), ("ann lee", "ann lee"), ("", ""), ("fnu carroll", "fnu carroll x")]
    score = F.when(F.col("x") == F.col("y"), 1.0).otherwise(F.coalesce(N.token_subset(F.col("x"), F.col("y")), N.lastname_priority(F.col("x"), F.col("y"))))
    assert column(spark, pairs, score, ("x", "y")) == [(tier(a, b) or (None, None))[1] for a, b in pairs]


def test_loose_scores():
    assert N.ratio_of("abcd", "abxd") == pytest.approx(75.0)
    assert N.loose_score_of("smith john", "john smith") == 100
    assert N.loose_score_of("", "john") == 0


def test_rules(spark):
    seen = [("Attorney", "Counsel for plaintiff, filed complaint on March 1"), ("attorney", "Testified that he overheard defendant"), ("eyewitness", "counsel for defendant"), ("lawyer", None), ("attorney", "Opposing counsel, corresponded")]
    assert column(spark, seen, rules.attorney_rule(F.col("x"), F.col("y"))["exclude"], ("x", "y")) == [True, False, False, False, True]
    files = [("Attorney Work Product - Case Analysis.docx", ""), ("Case.docx", "PREPARED in anticipation of LITIGATION"), ("Notes from Meeting.pdf", "Meeting"), (None, None)]
    assert column(spark, files, rules.work_product(F.col("x"), F.col("y")), ("x", "y")) == [True, True, False, False]


def test_text_functions(spark):
    assert [len(c) for c in column(spark, ["x" * 60_000], X.fixed_chunks(F.col("x")))[0]] == [25_000, 25_000, 10_000]
    assert column(spark, ["", None], F.size(X.fixed_chunks(F.col("x")))) == [0, 0]
    assert [len(X.sentence_chunks_of("x" * n)) for n in (500, 800, 801, 1000, 1001, 2500)] == [1, 1, 2, 2, 2, 4]
    refs = column(spark, ["A1", "d12", "X3", "A", "Ab", "", None], X.claim_ref(F.col("x")))
    assert [tuple(r) if r else None for r in refs] == [("allegation", 1), ("defense", 12), None, None, None, None, None]
    broken = ['{"a": 1}', 'Sure: {"a": 1} ok', '```json\n{"a": 1}\n```', '{"a": 1,}', "none", None, '{"witnesses": [{"a": 1}, {"a": 2']
    got = column(spark, broken, F.get_json_object(X.repaired_json(F.col("x")), "$.a"))
    assert got[:4] == ["1", "1", "1", "1"] and got[4:6] == [None, None]
