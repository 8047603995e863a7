"""Greedy seeds in rounds against the ordered pass."""

import random

import pytest

from dossier.functions import names as N
from dossier.operators import resolve as P
from dossier.operators import seeds

FIRST = ["john", "jon", "johnny", "mary", "marie", "maria", "robert", "bob", "ann", "anne", "xu", "q", "jean paul", "o brien"]
LAST = ["smith", "smyth", "smithson", "carroll", "carol", "lee", "leigh", "stone", "li", "garcia", "garcia lopez", "de la cruz", "wei"]


def name(r):
    w = [r.choice(FIRST), r.choice(LAST)]
    if r.random() < 0.3:
        w.insert(1, r.choice("abcdefgh"))
    if r.random() < 0.2:
        r.shuffle(w)
    t = list(" ".join(w))
    for _ in range(r.randrange(3)):
        t[r.randrange(len(t))] = r.choice("abcdeilnorst ")
    return "".join(t)


def test_bounds_lose_no_match():
    r = random.Random(1)
    forms = list({name(r) for _ in range(500)} | {"", "a", "aa", "aaaaaaa", "ababababab", "é ü"})
    may, sizes = seeds.possible(seeds.Sketch(forms), seeds.Sketch(forms), 85), 0
    for i, a in enumerate(forms):
        for j, b in enumerate(forms):
            if N.loose_score_of(a, b) >= 85:
                assert may[i, j], (a, b)
                sizes += 1
    assert sizes > len(forms) and may.mean() < 0.35


@pytest.mark.parametrize(("small", "block"), [(10_000, 50), (20, 7), (0, 64)])
def test_rounds_equal_the_pass(spark, small, block):
    r = random.Random(9)
    rows = [(i if i % 50 else None, m, name(r)) for i, m in enumerate([1] * 260 + [2] * 60 + [3] * 9 + [None] * 3)]
    rows += [(9_999, 1, None), (10_000, 1, "."), (5, 2, rows[0][2])]
    found = P.loose_clusters(spark.createDataFrame(rows, "id long, matter_id long, full_name string"), small=small, block=block).collect()
    loose = {x: f for x, f in spark.createDataFrame([(x[2],) for x in rows if x[2] is not None], "n string").distinct().select("n", N.loose("n").alias("f")).collect()}
    want = {}
    for m in (1, 2, 3):
        place = {}
        for i, mm, n in rows:
            if mm == m and n is not None:
                at = place.setdefault(loose[n], [])
                at += [] if i is None else [i]
        order, own = sorted(place, key=lambda f: (bool(place[f]), min(place[f], default=0), f)), []
        for f in order:
            k = next((k for k, s in enumerate(own) if N.loose_score_of(s, f) >= 85), len(own))
            if k == len(own):
                own.append(f)
            want[m, f] = k
    assert len(found) == sum(m is not None and n is not None for _, m, n in rows)
    assert {(x["matter_id"], x["form"]): x["cluster"] for x in found} == want


def test_a_matter_of_very_many_forms(spark):
    """20,000 forms of one matter, from few bases: the rounds equal one ordered pass over arrays."""
    r = random.Random(4)
    base = ["".join(r.choices("abcdefghijklmnoprstuvw", k=8)) + " " + "".join(r.choices("abcdefghijklmnoprstuvw", k=9)) for _ in range(1_500)]
    forms = list({(lambda t: t[: (k := r.randrange(len(t)))] + r.choice("xyz") + t[k:])(r.choice(base)) for _ in range(20_500)})[:20_000]
    found = {x["form"]: x["seed"] for x in seeds.seeds(spark.createDataFrame([(1, f, i) for i, f in enumerate(forms)], "matter_id long, form string, place long")).collect()}
    assert len(found) == len(forms)
    want = seeds.in_order(forms, 85)
    assert [found[f] for f in forms] == [forms[j] for j in want]
