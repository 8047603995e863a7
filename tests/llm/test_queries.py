"""The registered training-data queries on the smallest tables: SQL twins, brute force or held-out accuracy."""

import os
import zlib
from collections import Counter

import pytest

from dossier.llm import registry
from tests.llm.test_near_copies import kept_by_hand
from tests.llm.test_operators import bytes_by_hand, classes_by_hand, fingerprint_by_hand, phrases_by_hand
from tests.sql_twin import DATA, same

QUERIES, SQL = registry.queries(), registry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def documents(spark):
    return [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_twin(spark, name):
    same(QUERIES[name](spark, DATA), SQL[name])


def test_langid_accuracy(spark):
    truth = {i: lang for i, _, lang in documents(spark)}
    held = [r for r in QUERIES["op1_langid"](spark, DATA).collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held) > 0
    assert not any(r["rejected"] for r in held)


def test_quality_accuracy(spark):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = QUERIES["op5_quality"](spark, DATA).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) == len(documents(spark)) and all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.85 * len(held) > 0


def test_phrases(spark):
    assert sorted(map(tuple, QUERIES["op3_phrases"](spark, DATA).collect()), key=repr) == phrases_by_hand([(i, t) for i, t, _ in documents(spark)])


def test_repeats(spark):
    assert sorted(map(tuple, QUERIES["op7_repeats"](spark, DATA).collect()), key=repr) == bytes_by_hand([(i, t) for i, t, _ in documents(spark)], 200)


def test_simhash(spark):
    prints = {i: fingerprint_by_hand(t) for i, t, _ in documents(spark)}
    classes = classes_by_hand(prints)
    rows = QUERIES["op8_simhash"](spark, DATA).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{p:016x}", classes[i]) for i, p in prints.items()}


def mixed_by_hand(rows):
    """How often the mix takes each document whole: the SQL twin over these rows, rounded half up."""
    import duckdb
    import pandas as pd

    documents = pd.DataFrame([r.asDict() for r in rows])  # noqa: F841 (read by the SQL)
    c = duckdb.connect()
    c.register("documents", documents)
    found = c.execute(registry.oracle_sql()["op10_mixing"])
    names = [d[0] for d in found.description]
    told = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    return Counter({t["doc_id"]: int(t["taken"] / t["size"] + 0.5) for t in told if t["size"]}), {t["doc_id"]: t["place"] for t in told}


def shards_by_hand(rows):
    """(doc_id, shard, slot) of rows (doc_id, text): numbered by bucket (of id and checksum), id, checksum and size, then walked through the permutation."""
    from dossier.llm import shuffle_shards as S

    (k, c), n = S.keys(S.SEED + 1, 1)[0], len(rows)

    def bucket(i, crc):
        t = ((i % S.PRIME + crc * 2**20) % S.PRIME + k) % S.PRIME
        return (t * t % S.PRIME * t + c) % S.PRIME % S.BUCKETS

    ordered = sorted((bucket(i, zlib.crc32(t.encode())), i, zlib.crc32(t.encode()), len(t.encode()) + 1) for i, t in rows)
    a = S.math.isqrt(n - 1) + 1
    b = -(-n // a)
    out = []
    for x, (_, i, *_rest) in enumerate(ordered):
        y = S._image(x, a, b, S.SEED)
        while y >= n:
            y = S._image(y, a, b, S.SEED)
        out.append((i, y % 8, y // 8))
    return sorted(out)


def test_pipeline(spark):
    """Each stage against a brute-force version of its decision."""
    import corpus_pipeline as pipeline
    from dossier.llm import langid
    from dossier.llm.common import materialize

    docs, kept = pipeline.table(spark, DATA, "documents"), []
    columns, given = docs.columns, documents(spark)
    model = langid.fit(docs, "doc_id", "text", "lang")
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, DATA), name)
        kept.append(docs.collect())
        assert docs.columns[: len(columns)] == columns and (name == "sharding" or docs.columns == columns)
    language, near, clean, mix, shards = kept
    said = langid.decide(model, [t for _, t, _ in given])
    assert {r["doc_id"] for r in language} == {i for (i, _, _), bad in zip(given, said["rejected"], strict=True) if not bad}
    assert {r["doc_id"] for r in near} == kept_by_hand([(r["doc_id"], r["text"]) for r in language])
    cut = lambda t: {tuple(w[k : k + 5]) for w in [(t or "").lower().split()] for k in range(len(w) - 4)}
    items = [s for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if (s := cut(r["text"]))]
    leaks = {r["doc_id"] for r in near if any(len(s & cut(r["text"])) >= 0.8 * len(s) for s in items)}
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in near} - leaks
    copies, _ = mixed_by_hand(clean)
    assert Counter(r["doc_id"] for r in mix) == +copies
    assert {r["doc_id"]: r["text"] for r in mix} == {r["doc_id"]: r["text"] for r in clean if copies[r["doc_id"]]}
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in shards) == shards_by_hand([(r["doc_id"], r["text"]) for r in mix])
    assert Counter((r["doc_id"], r["text"]) for r in shards) == Counter((r["doc_id"], r["text"]) for r in mix)


def test_mix_follows_the_schedule(spark):
    """The mix is written in the order of the places, and any stretch of the schedule holds the sources in about their shares."""
    from dossier.llm import mixing
    from dossier.llm.common import materialize

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.collect()
    copies, place = mixed_by_hand(rows)
    written = [r["doc_id"] for r in mixing.mixed(docs).coalesce(1).collect()]
    firsts = list(dict.fromkeys(written))
    at = [place[i] for i in firsts if place[i] is not None]
    assert Counter(written) == +copies and sum(x > y for x, y in zip(at, at[1:], strict=False)) <= 0.1 * len(at)
    each = materialize(docs.selectExpr("source", "size(filter(split(text, '[ \\t\\n\\r\\f\\x0B]+'), w -> w <> '')) AS size"), "sizes")
    plan = sorted((r["place"], r["sid"]) for r in mixing.schedule(materialize(mixing.targets(each), "targets")).collect())
    share = {s: n / len(plan) for s, n in Counter(s for _, s in plan).items()}
    for end in range(200, len(plan), 997):
        seen = Counter(s for _, s in plan[:end])
        assert all(abs(seen[s] - share[s] * end) <= 12 for s in share)


def test_pipeline_edges(spark, tmp_path):
    """Nulls in any column, empty and foreign texts, repeated rows, clashing extra columns and an empty table."""
    import corpus_pipeline as pipeline
    from tests.llm.test_operators import words

    long = words(9, 30_000, 3_000)
    rows = [(i, words(i, 80, 400), "en" if i % 2 else "de", "a" if i % 3 else None) for i in range(60)]
    rows += [(100, None, "en", "a"), (101, "", None, "a"), (102, " 12 ", "en", None), (103, long, "en", "a"), (104, long, "en", "b"), (105, "\u0431\u044b\u0441\u0442\u0440\u0430\u044f \u043b\u0438\u0441\u0430 \u0431\u0435\u0436\u0438\u0442", None, None)]
    rows += [(None, words(3, 80, 400), "en", None), (None, words(3, 80, 400), "en", None), (7, words(7, 80, 400), "de", "a")]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, lang string, source string, shard int, size string")
    for name, frame, bench in (("full", docs, [(1, words(5, 30, 400)), (None, "x"), (2, None), (3, "")]), ("none", docs.limit(0), [(1, "a b c")]), ("plain", docs, [])):
        frame.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    kept = spark.read.parquet(f"{tmp_path}/full/documents.parquet")
    for name, stage in pipeline.STAGES[:3]:
        kept = pipeline.materialize(stage(spark, kept, f"{tmp_path}/full"), name)
    clean = {r["doc_id"] for r in kept.collect()}
    assert not clean & {100, 101, 102, 104, 105} and {103, None, 7} <= clean
    found = pipeline.run(spark, f"{tmp_path}/full").collect()
    ids = {r["doc_id"] for r in found}
    assert ids <= clean and {103, None} <= ids  # the mix takes less than all of the source of the long text, in its shuffled order
    assert sorted(r["slot"] for r in found if r["shard"] == 0) == list(range(sum(r["shard"] == 0 for r in found)))
    assert all(r["size"] == len(r["text"].encode()) + 1 for r in found)
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0 and pipeline.run(spark, f"{tmp_path}/plain").count() > 0
