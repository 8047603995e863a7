"""The inverted-file index against exact search: recall, all lists, few rows, odd vectors."""

import math
import os

import numpy as np
import pytest

from dossier.operators import research, vector_index
from dossier.plans import registry
from tests.sql_twin import twin

CHUNKS, QUERIES = "chunk_id long, matter_id string, e array<float>, list string", "query_id long, matter_id string, q array<float>"


def frames(spark, n=3000, matters=3, seed=1):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(40, 16))
    x = (middle[r.integers(0, 40, n)] + 0.4 * r.normal(size=(n, 16))).astype(np.float32)
    rows = [(i, f"m{i % matters}", v.tolist(), "clash") for i, v in enumerate(x)]
    odd = [(10_000, "m0", None, ""), (10_001, "m0", [1.0], ""), (10_002, "m0", [math.nan] * 16, ""), (10_003, "m0", [None] + [1.0] * 15, ""), (10_004, "lonely", x[0].tolist(), ""), (10_005, None, x[1].tolist(), ""), (10_006, "m0", [0.0] * 16, "")]
    asked = [(i, f"m{i % matters}", x[i].tolist()) for i in range(0, n, 40)] + [(20_000, "lonely", x[7].tolist()), (20_001, "nowhere", x[7].tolist()), (20_002, "m0", None), (20_003, "m0", [1.0])]
    return spark.createDataFrame(rows + odd, CHUNKS), spark.createDataFrame(asked, QUERIES)


def test_recall_and_exact_mode(spark, tmp_path):
    chunks, queries = frames(spark)
    index = vector_index.InvertedFile.build(chunks, f"{tmp_path}/i", lists=30, sample=900)
    usable = chunks.where("chunk_id NOT IN (10001, 10002, 10003)")
    exact = research.nearest_chunks(queries.where("size(q) = 16"), usable).cache()
    found = index.search(queries).collect()
    assert vector_index.recall(index.search(queries), exact) >= 0.9 and 1 <= index.probes < 15
    assert index.rows().count() == 3000 + 3 and {r["query_id"] for r in found} == {r["query_id"] for r in exact.collect()}
    assert [r["chunk_id"] for r in found if r["query_id"] == 20_000] == [10_004]  # fewer than asked for: searched exactly
    every = sorted(map(tuple, index.search(queries, probes=30).select(*exact.columns).collect()))
    assert every == sorted(map(tuple, exact.collect()))
    again = vector_index.InvertedFile.build(chunks.repartition(5), f"{tmp_path}/j", lists=30, sample=900)
    assert np.array_equal(again.centres, index.centres)


def test_empty_and_few(spark, tmp_path):
    chunks, queries = frames(spark, 40)
    assert vector_index.InvertedFile.build(chunks.limit(0), f"{tmp_path}/i").search(queries).collect() == []
    index = vector_index.InvertedFile.build(chunks.where("chunk_id < 3"), f"{tmp_path}/j")
    assert len(index.centres) == 3 and index.search(queries.limit(1)).count() == 1
    assert index.search(queries.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_recall_on_the_given_vectors(spark):
    data = "/root/testdata/sf0.01"
    found = {(r["query_id"], r["chunk_id"]) for r in registry.queries()["rag_02_indexed"](spark, data).collect()}
    columns, exact = twin(registry.oracle_sql()["rag_02_nearest"], data)
    exact = {(dict(zip(columns, x, strict=True))["query_id"], dict(zip(columns, x, strict=True))["chunk_id"]) for x in exact}
    assert len(found) == len(exact) and len(found & exact) >= 0.9 * len(exact)
