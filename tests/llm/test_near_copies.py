"""Near copies of the pipeline against all pairs by brute force."""

import os
import random

import numpy as np
import pytest

from dossier.llm import near_copies
from tests.sql_twin import DATA


def kept_by_hand(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    least = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and 5 * len(x & y) >= 4 * len(x | y) and least[a] != least[b]:
                low, high = sorted((least[a], least[b]))
                least = {i: low if c == high else c for i, c in least.items()}
    return {i for i, c in least.items() if i == c}


def copies(seed, groups, each):
    """Groups of copies with up to a tenth of the words changed, all with a common line."""
    r, rows = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{r.randrange(900)}" for _ in range(r.randrange(30, 300))]
        for _ in range(each):
            w = list(base)
            for _ in range(r.randrange(1 + len(w) // 20)):
                w[r.randrange(len(w))] = f"x{r.randrange(900)}"
            rows.append((len(rows), " ".join([*w, "all rights are reserved by the author"])))
    return rows + [(len(rows), None), (len(rows) + 1, " "), (len(rows) + 2, "Two words"), (len(rows) + 3, "two  WORDS")]


@pytest.mark.parametrize(("cell", "small"), [(8, 2), (4096, 16)])
def test_all_pairs(spark, cell, small, monkeypatch):
    monkeypatch.setattr(near_copies, "SMALL", small)
    rows = copies(3, 6, 25)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in near_copies.dedupe(docs, cell=cell).collect()}
    assert kept == kept_by_hand(rows) and 6 < len(kept) < len(rows)


def test_no_similar_pair_is_pruned():
    """Sets of any size at a similarity of exactly 0.8 or above fit, however many fingerprint bits differ."""
    r = np.random.default_rng(5)
    for _ in range(3000):
        common, own = int(r.integers(1, 400)), [0, 0]
        for _ in range(int(r.integers(0, common // 4 + 1))):
            own[int(r.integers(0, 2))] += 1
        h = r.integers(0, 1 << 63, common + sum(own)).astype(np.uint64)
        a, b = np.sort(h[: common + own[0]]), np.sort(np.concatenate([h[:common], h[common + own[0] :]]))
        n = np.array([len(a), len(b)])
        odd = np.frombuffer(near_copies.odd_sketch(a) + near_copies.odd_sketch(b), np.uint64).reshape(-1, 4)
        assert near_copies._fitting(n, odd, np.array([0]), np.array([1])).all()
    a, b = (np.sort(r.integers(0, 1 << 63, 100).astype(np.uint64)) for _ in range(2))
    odd = np.frombuffer(near_copies.odd_sketch(a) + near_copies.odd_sketch(b), np.uint64).reshape(-1, 4)
    assert not near_copies._fitting(np.array([100, 100]), odd, np.array([0]), np.array([1])).any()


@pytest.mark.parametrize("cell", [8, 4096])
def test_a_pair_of_many_groups_is_given_once(spark, cell):
    """Thirty unlinked members meet in twenty groups; each pair comes from one cell of one group."""
    found = near_copies.shingles(" ".join(f"w{i}" for i in range(60)).encode())
    odd, wide = near_copies.odd_sketch(found), near_copies.odd_sketch(found, near_copies.WIDE)
    left = spark.createDataFrame([(s, i, 56, odd, i, 30) for s in range(-10, 10) for i in range(30) if (s + i) % 7], "s long, id long, n long, odd binary, c long, size long")
    sketches = spark.createDataFrame([(i, wide) for i in range(30)], "id long, wide binary")
    cells = near_copies._cells(near_copies._open(left, sketches), True, cell)
    pairs = [tuple(r) for r in cells.mapInPandas(near_copies._candidates("all"), near_copies._PAIRS).collect()]
    assert sorted(pairs) == [(u, v) for u in range(30) for v in range(u)]


def test_texts_that_share_much_but_are_no_copies_give_few_candidates(spark, monkeypatch):
    """A family of texts, each six of 400 words away from one base: any two have a similarity of about 0.74."""
    r, rows, counts = random.Random(4), [], []
    base = [f"w{i}" for i in range(400)]
    for i in range(60):
        w = list(base)
        for k in r.sample(range(400), 6):
            w[k] = f"x{i}-{k}"
        rows.append((i, " ".join(w)))
    rows.append((60, rows[0][1] + " y"))

    def counted(df, name, write=near_copies.materialize):
        out = write(df, name)
        if name == "candidates":
            counts.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "materialize", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"] for x in near_copies.dedupe(docs).collect()} == kept_by_hand(rows)
    assert len(counts) == 3 and max(counts[1:]) <= len(rows)  # without the long sketch nearly all 1,830 pairs


def test_fingerprints_far_apart_are_still_linked(spark):
    """Near copies of a few shingles whose fingerprints differ in very many bits."""
    from dossier.llm import simhash

    r, rows = random.Random(11), []
    for g in range(150):
        w = [f"w{r.randrange(5000)}" for _ in range(40)]
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join([*w[1:], f"x{g}"])), (len(rows) + 2, " ".join([f"y{g}", *w, f"z{g}"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"] for x in simhash.near_duplicates(docs).collect()} == kept_by_hand(rows)


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (4, "d e"), (4, "d e"), (5, "d e")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1) for r in near_copies.dedupe(docs).collect()) == [-1, -1, 4, 4]
    assert near_copies.dedupe(docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_pipeline_stage(spark):
    """The stage on the given table: the fingerprints within two bits kept 145 and 177."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()}
    assert kept == kept_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])
