"""Training-data operators: defined results at the edges, and brute-force twins on small tables."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dossier.llm import decontaminate, langid, mixing, phrases, quality, repeats, shuffle_shards, simhash, topk, warc
from dossier.operators.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    """Documents with a column whose name clashes with results."""
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_words string")


def words(seed, n, vocabulary=40):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def edges(spark):
    long = words(5, 20_000, 3_000)
    return documents(spark, [(0, None, None, None), (1, "", "en", None), (2, "  \t ", "en", "a"), (3, long, "en", "a"), (4, long, "en", "b"), (4, long, "en", "b"), (None, words(1, 50), "de", None), (7, words(1, 50), "de", ""), (8, "Ünïcode \U0001f600 word", None, "a")])


def empty(spark):
    return documents(spark, []).limit(0)


# --- language identification ----------------------------------------------------------------------------------------


def test_langid_edges(spark):
    model = langid.fit(edges(spark), "doc_id", "text", "lang")
    found = edges(spark).select("doc_id", langid.identify(model, F.col("text"), spark).alias("r")).select("doc_id", "r.*").collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == 9 and by[0]["lang"] == by[1]["lang"] == by[2]["lang"] == "und" and by[0]["rejected"]
    assert by[3]["lang"] in ("en", "de") and all(0 <= r["score"] <= 1 for r in found)


def test_langid_learns_and_rejects(spark):
    rows = [(i, " ".join(random.Random(i).choices(["the", "and", "thing", "other", "with"], k=30)), "en", "a") for i in range(60)]
    rows += [(100 + i, " ".join(random.Random(i).choices(["und", "der", "über", "nicht", "schön"], k=30)), "de", "a") for i in range(60)]
    model = langid.fit(documents(spark, rows), "doc_id", "text", "lang")
    said = langid.decide(model, ["the other thing", "der schön über", "qzxv wjkq xxqz kkjw qqzx zzkq vvxw jjqx", "123 456"])
    assert said["lang"].tolist()[:2] == ["en", "de"] and not said["rejected"].tolist()[0]
    assert said["rejected"].tolist()[2:] == [True, True] and said["lang"].tolist()[3] == "und"


def test_langid_letters(spark):
    assert langid.letter_words("Añb½c ²³ ①x ⅷ 12 ª_b") == ["añb", "c", "x", "ª", "b"]
    rows = [(i, " ".join(random.Random(i).choices(["the", "and", "thing"], k=30)), "en", "a") for i in range(60)]
    model = langid.fit(documents(spark, rows), "doc_id", "text", "lang")
    said = langid.decide(model, ["½ ²", "①", "the ½"])
    assert said["lang"].tolist() == ["und", "und", "en"] and said["score"].tolist()[:2] == [0, 0]


def test_langid_sample_is_bounded(spark):
    rows = [(None, f"the thing {i % 900}", "en", "a") for i in range(4000)] + [(7, f"der hund {i}", "de", "a") for i in range(500)] + [(9, "le chat", "fr", "a")] * 600 + [(1, None, "fr", "a")]
    found = langid.sample(documents(spark, rows), "doc_id", "text", "lang", 100)
    assert found.groupby("lang").size().to_dict() == {"en": 100, "de": 100, "fr": 1} and not found.duplicated(["lang", "place"]).any()
    again = langid.sample(documents(spark, rows[::-1]).repartition(3), "doc_id", "text", "lang", 100)
    assert again.equals(found)


def test_langid_small_samples_are_cross_fitted(spark):
    """With few rows no text is measured under a model that it fitted: limits are not those of the training rows."""
    rows = [(i, words(i, 40, 60), "en", "a") for i in range(30)]
    model = langid.fit(documents(spark, rows), "doc_id", "text", "lang")
    fresh = langid.decide(model, [words(1000 + i, 40, 60) for i in range(50)])
    assert fresh["rejected"].sum() == 0


def test_langid_without_labels(spark):
    model = langid.fit(empty(spark), "doc_id", "text", "lang")
    assert langid.decide(model, ["the", None])["lang"].tolist() == ["und", "und"]


def kneser_ney_by_hand(words, weights, order):
    """P(letter | letters before it in the word, the first one a blank), written out from the definition."""
    grams = [{} for _ in range(order)]
    for word, weight in zip(words, weights, strict=True):
        framed = f" {word} "
        for end in range(1, len(framed)):
            for m in range(1, order + 1):
                if end - m + 1 >= 0:
                    g = framed[end - m + 1 : end + 1]
                    grams[m - 1][g] = grams[m - 1].get(g, 0) + weight
    counts = []
    for m in range(1, order + 1):
        found = dict(grams[m - 1])
        if m < order:
            for g in found:
                kinds = sum(1 for x in grams[m] if x[1:] == g)
                starts = m > 1 and g[0] == " "
                found[g] = found[g] if starts or not kinds else kinds
        n1, n2 = (sum(1 for v in found.values() if v == k) for k in (1, 2))
        counts.append((found, n1 / (n1 + 2 * n2) if n1 and n2 else 0.5))
    uniform = 1 / (len(grams[0]) + 1)

    def p(letter, before):
        if before is None:
            return uniform
        found, discount = counts[len(before)]
        mine = {g: v for g, v in found.items() if g[:-1] == before}
        lower = p(letter, before[1:] if before else None)
        if not mine:
            return lower
        total = sum(mine.values())
        return max(mine.get(before + letter, 0) - discount, 0) / total + discount * len(mine) / total * lower

    return p


def test_kneser_ney_by_hand():
    """Every word's probability equals the definition's, and what may follow sums to one."""
    words, weights, order = ["abab", "abba", "baab", "ab", "b", "caca"], [3, 2, 1, 4, 1, 2], 3
    parts, floor = langid._kneser_ney(words, np.array(weights), order)
    model = langid._stack({"x": (parts, floor)}, order)
    p = kneser_ney_by_hand(words, weights, order)
    for word in [*words, "cab", "zz", "abc", "bz", "a"]:
        framed = f" {word} "
        want = sum(math.log(p(framed[i], framed[max(0, i - order + 1) : i])) for i in range(1, len(framed)))
        assert langid.word_scores(model, [word])[0, 0] == pytest.approx(want, abs=1e-4)
    letters = [*"abc", " ", "z"]  # z stands for the one unseen letter
    for before in (" ", " a", "ab", "ca", "b", "", "zz"):
        assert sum(p(x, before) for x in letters) == pytest.approx(1)


def test_langid_limits(spark):
    """Held-back texts are rejected at about the stated rate or below, random and foreign letters are not taken."""
    r = random.Random(2)
    syllables = {"en": ["the", "er", "ing", "on", "and", "th"], "fr": ["que", "eau", "les", "ment", "ai", "ou"]}
    make = lambda lang, n: " ".join("".join(r.choices(syllables[lang], k=r.randrange(1, 4))) for _ in range(n))
    rows = [(i, make(lang, r.randrange(5, 120)), lang, "a") for i in range(400) for lang in syllables]
    rows = [(k, *x[1:]) for k, x in enumerate(rows)]
    model = langid.fit(documents(spark, rows[:600]), "doc_id", "text", "lang")
    held = langid.decide(model, [x[1] for x in rows[600:]])
    assert held["lang"].tolist() == [x[2] for x in rows[600:]] and held["rejected"].mean() <= 0.02
    odd = langid.decide(model, ["".join(r.choices("bcdfgjkpqvwxyz", k=9)) + " " + "".join(r.choices("bcdfgjkpqvwxyz", k=40)) for _ in range(50)] + ["быстрая лиса бежит в лес"])
    assert odd["rejected"].mean() >= 0.95
    assert np.isfinite(model.limit).all()


# --- WARC ------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 5000
    pages = spark.createDataFrame([(1, "http://a/ b", big, 0), (2, None, big, 0), (3, "u", None, 0), (4, "u", "", 0), (5, "u", "short", 0), (6, "u", "short", 0), (None, "u", "é" * 200, 0), (9, "u", big, 0), (9, "u", big, 0)], "page_id long, url string, html string, offset int")
    manifest = warc.write(pages, "page_id", "html", "url", str(tmp_path / "w"))
    rows = warc.read(manifest).collect()
    by = {(r["page_id"], r["record_type"]): r for r in rows}
    assert len(rows) == 9 and all(r["error"] is None for r in rows)
    assert by[1, "response"]["payload"].decode() == big and by[2, "revisit"]["refers_to"] == 1 and by[9, "revisit"]["refers_to"] == 1
    assert by[2, "revisit"]["payload_bytes"] == len(big) and by[2, "revisit"]["payload_digest"] == hashlib.sha256(big.encode()).hexdigest()
    assert by[3, "response"]["payload_bytes"] == 0 and (5, "response") in by and (6, "response") in by
    assert by[None, "response"]["payload"].decode() == "é" * 200


def test_warc_reader_reports_damage(spark, tmp_path):
    good = warc._member(warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None))
    wrong = warc._member(warc.record(2, "u", b"payload", "00", None))
    path = tmp_path / "x.warc.gz"
    path.write_bytes(good + wrong + good[:-9] + good + good[:-9])
    rows = warc.read(spark.createDataFrame([(str(path),)], "archive string")).orderBy("offset").collect()
    assert [r["error"] for r in rows] == [None, "payload digest", "gzip", None, "gzip"]
    assert [r["offset"] for r in rows] == [0, len(good), len(good) + len(wrong), 2 * len(good) + len(wrong) - 9, 3 * len(good) + len(wrong) - 9]
    assert [r["skipped"] for r in rows] == [None, None, len(good) - 9, None, len(good) - 9]


def test_warc_addresses_and_long_payloads(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/b c\r\nX: y", "z" * 3_000_000)], "page_id long, url string, html string")
    rows = warc.read(warc.write(pages, "page_id", "html", "url", str(tmp_path / "w"))).collect()
    assert [(r["page_id"], r["payload_bytes"], r["error"]) for r in rows] == [(1, 3_000_000, None)]


def test_sliding_argmin_is_the_same_everywhere():
    """Hashes that differ in their low bits only: a short and a long run choose the same offset."""
    from dossier.llm.common import sliding_argmin

    run = np.full(161, 1 << 63, np.uint64)
    run[90], run[20] = 5, 6
    short = sliding_argmin(run, 161)
    long = sliding_argmin(np.concatenate([np.full(100_000, 1 << 62, np.uint64), run]), 161)
    assert short[0] == 90 and long[100_000] == 100_090
    r = np.random.default_rng(1).integers(0, 40, 5000).astype(np.uint64)
    assert sliding_argmin(r, 9).tolist() == [i + int(r[i : i + 9].argmin()) for i in range(4992)]


class Kept:
    def __init__(self):
        self.data = b""

    def feed(self, data):
        self.data += data


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_warc_pieces(piece):
    import io

    data = b"".join(warc._member(bytes([i]) * i) for i in range(1, 5))
    assert [x.data for _, x, _ in warc.members(io.BytesIO(data), piece, Kept)] == [bytes([i]) * i for i in range(1, 5)]


@pytest.mark.parametrize("piece", [1, 50, 1 << 20])
@pytest.mark.parametrize("damage", ["flipped", "cut", "noise"])
def test_warc_goes_on_after_damage(piece, damage):
    """Members behind a damaged one still come, and one row says what was skipped."""
    import io

    parts = [warc._member(random.Random(i).randbytes(300)) for i in range(4)]
    bad = {"flipped": bytes(b ^ 0x55 if k > 20 else b for k, b in enumerate(parts[1])), "cut": parts[1][:100], "noise": b"noise" * 30}[damage]
    found = list(warc.members(io.BytesIO(parts[0] + bad + parts[2] + parts[3]), piece, Kept))
    assert [x and x.data for _, x, _ in found] == [random.Random(0).randbytes(300), None, random.Random(2).randbytes(300), random.Random(3).randbytes(300)]
    assert [(at, n) for at, _, n in found][1] == (len(parts[0]), len(bad))


def test_warc_empty(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(none, "page_id", "html", "url", str(tmp_path / "w"))).count() == 0


# --- repeated phrases ------------------------------------------------------------------------------------------------


def phrases_by_hand(rows, window=13):
    last = 1 << 62
    texts = sorted(((last if i is None else i), WORD.findall(t or "")) for i, t in rows)
    first = {}
    for i, w in texts:
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), i)
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((None if i == last else i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def passages(seed):
    """Texts that share passages, overlap, repeat inside themselves and sit near the window's length."""
    r = random.Random(seed)
    shared = [words(100 + k, r.choice((12, 13, 14, 30, 60))) for k in range(6)]
    rows = []
    for i in range(40):
        parts = [words((seed, i, k).__hash__(), r.randrange(0, 40), r.choice((2, 400))) for k in range(3)]
        parts[1:1] = r.sample(shared, 2)
        rows.append((i, "\n".join(parts)))
    return [*rows, (50, rows[0][1]), (51, rows[0][1] + " " + rows[0][1]), (None, rows[1][1]), (60, None), (61, "")]


@pytest.mark.parametrize("chunk", [300, 1 << 20])
def test_phrases(spark, monkeypatch, chunk):
    monkeypatch.setattr("dossier.llm.chunks.sized", lambda total: (total // chunk + 1, total // (4 * chunk) + 1))
    rows = passages(chunk)
    found = phrases.remove_repeats(documents(spark, [(i, t, None, None) for i, t in rows]), "doc_id", "text").drop("kept").collect()
    assert sorted(map(tuple, found), key=repr) == phrases_by_hand(rows)


def test_phrases_edges(spark):
    rows = [(r["doc_id"], r["text"]) for r in edges(spark).collect()]
    found = phrases.remove_repeats(edges(spark), "doc_id", "text").drop("kept").collect()
    assert sorted(map(tuple, found), key=repr) == phrases_by_hand(rows)
    assert phrases.remove_repeats(empty(spark), "doc_id", "text").count() == 0


# --- repeated bytes --------------------------------------------------------------------------------------------------


def bytes_by_hand(rows, length):
    from collections import Counter

    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[j : j + length] for _, b in texts for j in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                gone[j : j + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("chunk", "length", "anchor"), [(400, 200, 40), (1 << 20, 200, 40), (700, 24, 7)])
def test_repeats(spark, monkeypatch, chunk, length, anchor):
    monkeypatch.setattr("dossier.llm.chunks.sized", lambda total: (total // chunk + 1, total // (2 * chunk) + 1))
    rows = [*passages(chunk + 1), (70, "ab" * 400), (71, "a" * 300), (72, "x" + "a" * 250 + "y"), (73, "é" * 150), (74, "zé" * 150), (75, "a\x00" * 130)]
    found = repeats.remove_repeated_bytes(documents(spark, [(i, t, None, None) for i, t in rows]), "doc_id", "text", length, anchor).drop("kept").collect()
    assert sorted(map(tuple, found), key=repr) == bytes_by_hand(rows, length)


@pytest.mark.parametrize(("hot", "local"), [(3, 2), (3, 1000), (1, 1)])
def test_repeats_of_hot_anchors(hot, local, monkeypatch):
    """A common line in many contexts: its strings are dealt one by one; every step run in one process."""
    import pandas as pd

    from dossier.llm import chunks

    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "LOCAL", local)
    monkeypatch.setattr(chunks, "PART_BYTES", 900)
    line = words(77, 12, 500)
    rows = [(i, f"{words(i, 30, 900)} {line} {words(-i, 30, 900)}") for i in range(40)]
    rows += [(100 + i, f"{words(i, 25, 900)} {line} {words(-i, 30, 900)}") for i in range(9)] + [(200, rows[3][1]), (201, rows[4][1][40:]), (202, None), (203, "")]
    docs, shards, length, anchor = pd.DataFrame([(i % 5, i, (t or "").encode()) for i, t in rows], columns=["chunk", "id", "text"]), 3, 60, 12
    groups = dict(list(docs.groupby("chunk")))

    def exchange(frames, column, f):
        both = pd.concat(list(frames), ignore_index=True)
        return [f((k,), own) for k, own in both.groupby(column)]

    def told(answers, k):
        both = pd.concat(answers, ignore_index=True)
        return both[both["chunk"] == k]

    asked = exchange((repeats.send_segments(shards, length, anchor)((k,), g) for k, g in groups.items()), "shard", repeats.asked_segments)
    assert any((np.frombuffer(f, np.uint8) & repeats.SPREAD).any() for a in asked for f in a["flags"])
    found = exchange((repeats.send_bytes(shards, length, anchor)((k,), g, told(asked, k)) for k, g in groups.items()), "shard", repeats.repeated_ranges(length))
    out = pd.concat([repeats.cut_out(length, anchor)((k,), g, told(found, k)) for k, g in groups.items()])
    assert sorted(map(tuple, out.drop(columns="kept").astype(object).to_numpy().tolist()), key=repr) == bytes_by_hand(rows, length)


def test_exchange_grows_with_the_bytes():
    """Rows between chunks and shards: five times the bytes, about five times the rows."""
    from dossier.llm.chunks import sized

    rows = [a * b for a, b in (sized(x << 20) for x in (160, 800, 4000, 20_000))]
    assert all(4 < y / x < 6.5 for x, y in zip(rows, rows[1:], strict=False))


def test_repeats_edges(spark):
    rows = [(r["doc_id"], r["text"]) for r in edges(spark).collect()]
    found = repeats.remove_repeated_bytes(edges(spark), "doc_id", "text").drop("kept").collect()
    assert sorted(map(tuple, found), key=repr) == bytes_by_hand(rows, 200)
    assert repeats.remove_repeated_bytes(empty(spark), "doc_id", "text").count() == 0


# --- SimHash ---------------------------------------------------------------------------------------------------------


def fingerprint_by_hand(text, k=3):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes_by_hand(prints):
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i, a in prints.items():
            for j, b in prints.items():
                if (a ^ b).bit_count() <= 2 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_simhash_edges(spark):
    found = {r["doc_id"]: r for r in simhash.cluster(edges(spark), "doc_id", "text").collect()}
    for r in edges(spark).collect():
        assert found[r["doc_id"]]["fp"] % (1 << 64) == fingerprint_by_hand(r["text"])
    assert found[4]["component_id"] == 3 and found[None]["component_id"] == 7 and found[1]["component_id"] == found[2]["component_id"] == 0
    assert simhash.cluster(empty(spark), "doc_id", "text").count() == 0


@pytest.mark.parametrize("block", [2, 256])
def test_simhash_links(spark, block):
    r = random.Random(9)
    centres = [r.getrandbits(64) for _ in range(6)]
    prints = [c for c in centres] + [c ^ (1 << r.randrange(64)) ^ (r.random() < 0.7) * (1 << r.randrange(64)) for c in centres for _ in range(25)]
    prints = {i: p for i, p in enumerate(dict.fromkeys(prints))}
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in prints.items()], "fp long, id long")
    found = dict(map(tuple, connected_components(simhash.links(nodes, block)).collect()))
    assert {i: found.get(i, i) for i in prints} == classes_by_hand(prints)


def test_components_of_a_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(7, 7), (100, 101)], "u long, v long")
    found = dict(map(tuple, connected_components(path).collect()))
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# --- sharding --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 7, 8, 9, 905, 927])
def test_sharding(spark, n):
    docs = spark.range(n).selectExpr("id * 7919 as doc_id", "'old' as shard")
    rows = shuffle_shards.assign(docs, "doc_id", 8).collect()
    sizes = [sum(r["shard"] == s for r in rows) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == n
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    again = shuffle_shards.assign(docs.repartition(3), "doc_id", 8).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_sharding_edges(spark):
    rows = shuffle_shards.assign(edges(spark), "doc_id", 4).collect()
    assert len(rows) == 9 and sorted(r["shard"] for r in rows) == [0, 0, 0, 1, 1, 2, 2, 3, 3]


def test_rows_without_ids_spread(spark):
    """With nine of ten ids missing or equal, no chunk and no bucket holds over twice the mean."""
    from dossier.llm import chunks

    rows = [(None if i % 10 < 5 else 7 if i % 10 < 9 else i, words(i, 30, 3000), "en", "a") for i in range(6000)]
    docs = documents(spark, rows)
    chunked, _ = chunks.dealt(docs.withColumn("text", F.repeat("text", 80)), "doc_id", "text", "string")
    sizes = [r["count"] for r in chunked.groupBy("chunk").count().collect()]
    assert len(sizes) > 15 and max(sizes) < 2 * sum(sizes) / len(sizes)
    keyed = docs.select(mixing.place_key(F.col("doc_id"), F.col("text")).alias("k")).groupBy(F.expr(f"k div {shuffle_shards.PRIME // 40}")).count().collect()
    assert max(r["count"] for r in keyed) < 2 * 6000 / 40
    sized = docs.withColumns({"crc": F.crc32(F.col("text").cast("binary")).cast("long")})
    bucket = shuffle_shards.mix(shuffle_shards.dealing(F.col("doc_id"), F.col("crc")), shuffle_shards.keys(9, 1)[0]) % 40
    assert max(r["count"] for r in sized.groupBy(bucket.alias("b")).count().collect()) < 2 * 6000 / 40
    assert sorted(r["shard"] for r in shuffle_shards.assign(sized, "doc_id", order=["crc"]).groupBy("shard").count().collect()) == list(range(8))


def test_walks_cover():
    for n in (*range(2, 60), 905):
        a = shuffle_shards.math.isqrt(n - 1) + 1
        b, out = -(-n // a), set()
        most = shuffle_shards.longest_walk(n, a, b, shuffle_shards.SEED)
        for x in range(n):
            y, steps = shuffle_shards._image(x, a, b, shuffle_shards.SEED), 1
            while y >= n:
                y, steps = shuffle_shards._image(y, a, b, shuffle_shards.SEED), steps + 1
            assert steps <= most
            out.add(y)
        assert out == set(range(n))


# --- quality ---------------------------------------------------------------------------------------------------------


def test_quality(spark):
    rows = [(i, words(i, 60, 300) if i % 2 else " | ".join(words(i, 60).split()), None, None) for i in range(400)]
    rows += [(1000, None, None, None), (1001, "", None, None)]
    stats = quality.statistics(documents(spark, rows), ["doc_id"], "text")
    known = stats.where("doc_id < 400").withColumnRenamed("doc_id", "id").withColumn("label", (F.col("id") % 2).cast("int"))
    model = quality.fit(known, trees=5)
    found = {r[0]: r[1] for r in stats.select("doc_id", model.score()).collect()}
    assert 0 < len(model.rules) < 60 and len(found) == 402 and all(0 <= v <= 1 for v in found.values())
    assert all((found[i] > 0.5) == bool(i % 2) for i in range(400))


def test_quality_column_is_the_model(spark):
    """The compiled column equals the fitted logistic model over the rules, and a tree's rules are its nodes."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rows = [(i, words(i, 20 + i % 70, 300 if i % 3 else 30) + "! " * (i % 5), None, None) for i in range(200)] + [(900, None, None, None), (901, words(5, 60_000), None, None)]
    stats = quality.statistics(documents(spark, rows), ["doc_id"], "text")
    names = [c for c in stats.columns if c.startswith("s")]
    sample = stats.where("doc_id < 200").withColumn("label", ((F.col("doc_id") % 3 > 0) & (F.col("doc_id") % 7 > 0)).cast("double"))
    forest = RandomForestClassifier(numTrees=3, maxDepth=3, seed=1).fit(sample.withColumn("features", array_to_vector(F.array(*names))))
    paths = [quality._paths(t._java_obj.rootNode(), ()) for t in forest.trees]
    rules = sorted({p for own in paths for p in own}, key=repr)
    lasso = quality.weighed(sample, rules, 0.001)
    model = quality.Rules(rules, [float(w) for w in lasso.coefficients], float(lasso.intercept))
    found = stats.select("doc_id", *names, model.score().alias("score")).collect()
    holds = lambda rule, r: all((r[f"s{i}"] <= t) == low for i, low, t in rule)
    for r in found:
        flags = Vectors.dense([float(holds(rule, r)) for rule in rules])
        assert r["score"] == pytest.approx(lasso.predictProbability(flags)[1], abs=1e-9)
        for tree, own in zip(forest.trees, paths, strict=True):
            leaves = [p for p in own if not any(q[: len(p)] == p and len(q) > len(p) for q in own)]
            assert sum(holds(p, r) for p in leaves) == 1 and tree.numNodes == len([p for p in own if p]) + 1  # a root alone is the empty rule


def test_quality_is_the_same_in_any_layout(spark):
    rows = [(i, words(i, 20 + i % 70, 300 if i % 3 else 30) + "! " * (i % 5), None, None) for i in range(200)] + [(None, words(5, 9), None, None)] * 3
    stats = quality.statistics(documents(spark, rows), ["doc_id"], "text").withColumnRenamed("doc_id", "id")
    known = stats.withColumn("label", (F.coalesce("id", F.lit(1)) % 3 > 0).cast("int"))
    models = [quality.fit(known.repartition(n, F.col(by)), trees=6, max_rows=m) for m in (150, 1000) for n, by in ((1, "id"), (3, "s0"), (8, "id"))]
    for same in (models[:3], models[3:]):
        assert len({(repr(m.rules), tuple(m.weights), m.bias) for m in same}) == 1 and same[0].rules


def test_quality_without_labels(spark):
    stats = quality.statistics(empty(spark), ["doc_id"], "text")
    model = quality.fit(stats.withColumnRenamed("doc_id", "id").withColumn("label", F.lit(1)))
    assert stats.count() == 0 and model.rules == [] and model.bias == 0.0


# --- decontamination -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [0, 200_000])
def test_decontamination(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    items = [(k, words(900 + k, 24, 2_000)) for k in range(6)] + [(90, "too short"), (91, None), (None, words(1, 30))]
    rows = [(k, f"{words(k, 400)} {items[k % 6][1].upper() if k % 2 else items[k % 6][1]} {words(-k, 300)}", None, None) for k in range(1, 9)]
    cut = items[0][1].split()
    rows += [(20, " ".join(cut[:21]), None, None), (21, " ".join(cut[:19]), None, None), (22, None, None, None), (23, "", None, None), (None, items[1][1], None, None), (1, rows[0][1], None, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["containment"] for r in decontaminate.contained_items(documents(spark, rows), bench, "doc_id", "text", "item_id", "text").collect()}
    assert set(found) == {(k, k % 6) for k in range(1, 9)} | {(20, 0)} and found[20, 0] == pytest.approx(17 / 20)
    left = decontaminate.decontaminated(documents(spark, rows), bench).select("doc_id").collect()
    assert sorted((r[0] for r in left), key=repr) == [21, 22, 23, None]
    assert decontaminate.contained_items(empty(spark), bench, "doc_id", "text", "item_id", "text").count() == 0
    assert decontaminate.contained_items(documents(spark, rows), bench.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def test_decontamination_of_few_words(spark):
    """Items of one to four words are found as whole word sequences."""
    bench = spark.createDataFrame([(1, "Alpha"), (2, "beta gamma"), (3, "one two three four"), (4, " "), (5, "one two three four five")], "item_id long, text string")
    rows = [(1, "an ALPHA here", None, None), (2, "beta  Gamma", None, None), (3, "gamma beta alphabet", None, None), (4, "zero one two three\tfour five", None, None), (5, "alpha", None, None), (6, words(3, 30_000) + " beta gamma", None, None)]
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(documents(spark, rows), bench, "doc_id", "text", "item_id", "text").collect()}
    assert found == {(1, 1), (2, 2), (4, 3), (4, 5), (5, 1), (6, 2)}


# --- top-k -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("scale", [2, 64])
def test_topk(spark, scale, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 50)
    monkeypatch.setattr(topk, "QUERIES", 4)
    r = np.random.default_rng(scale)
    rows = [(i, [float(x) for x in r.normal(size=6)], "l") for i in range(200)] + [(i, [1.0] * 6, "l") for i in range(200, 300)]
    bad = [(400, None, "l"), (420, [1.0, None], "l"), (440, [float("nan")] * 6, "l"), (460, [float("inf")] * 6, "l")]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, score string")
    found = {}
    for q in topk.top_k(frame, "vec_id", "embedding", k=7, scale=scale).collect():
        found.setdefault(q["query_id"], []).append((q["rank"], q["vec_id"], q["score"]))
    m = np.floor(scale * np.array([v for _, v, _ in rows])).astype(int)
    for q in range(0, 300, 20):
        best = sorted(((-int(m[q] @ m[i]), i) for i in range(300) if i != q))[:7]
        assert sorted(found.pop(q)) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert not found


def best_by_hand(rows, k, scale=64, every=20):
    """(query_id, rank, vec_id, score clamped to a long) in integers without limit."""
    whole = lambda v: [math.floor(x * scale) if math.isfinite(x * scale) else int(x) * scale for x in v]
    queries, out = {}, []
    for i, v in rows:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(whole(v), whole(c))), i) for i, c in rows if i != q)[:k]
        out += [(q, n, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["repeats", "large", "huge"])
def test_topk_extremes(spark, kind, monkeypatch):
    """Repeated queries and candidates, ties, and finite components of any size."""
    monkeypatch.setattr(topk, "SPARE", 3)
    r = np.random.default_rng(7)
    rows = [(i % 50, [float(x) for x in r.integers(-3, 4, 5)]) for i in range(150)] + [(0, [1.0] * 5), (0, [1.0] * 5)]
    if kind == "large":
        rows += [(60 + i, [1e9 * s, 1e9, -1e9, 5.0, float(i)]) for i, s in enumerate((1, -1, 1, 1))] + [(80, [1e9] * 5), (81, [1e9] * 5)]
    if kind == "huge":
        rows += [(100, [1.7e308, -1e300, 0.0, 1.0, 1e-300]), (101, [1e308] * 5), (102, [-1e308] * 5), (120, [1e150] * 5), (121, [1e150] * 5), (40, [2.0**60] * 5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(frame.repartition(3), "vec_id", "embedding", k=6).collect())) == best_by_hand(rows, 6)


def test_topk_few(spark):
    few = spark.createDataFrame([(0, [1.0]), (20, [2.0, 1.0]), (3, [0.5])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(few, "vec_id", "embedding", k=5).collect())) == [(0, 1, 20, 8192), (0, 2, 3, 2048), (20, 1, 0, 8192), (20, 2, 3, 4096)]
    assert topk.top_k(few.limit(0), "vec_id", "embedding").count() == 0


# --- mixing ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("slots", [8, 16_384])
def test_mixing(spark, slots):
    r = random.Random(3)
    rows = [(i, words(i, r.choice((0, 1, 5, 60, 300))), None, r.choice(["a", "b", "b", "b", "c", None])) for i in range(120)] + [(500, None, None, "a"), (501, words(1, 4), None, "tiny")]
    found = mixing.mix_sources(documents(spark, rows), "doc_id", "source", "text", slots).collect()
    assert len(found) == len(rows)
    sources = sorted({x[3] for x in rows if x[3] is not None}) + [None]
    size = {s: sum(len(WORD.findall(t or "")) for _, t, _, x in rows if x == s) for s in sources}
    weight, capped = {s: i % 3 + 1 for i, s in enumerate(sources)}, {}
    while True:  # excess is shared again until none is above
        rest = sum(size.values()) - sum(capped.values())
        free = [s for s in sources if s not in capped]
        target = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free} if free else {}
        above = {s: 3 * size[s] for s in free if target[s] > 3 * size[s]}
        if not above:
            break
        capped |= above
    target |= capped
    of = {x[0]: x[3] for x in rows}
    for s in sources:
        own = [q for q in found if of[q["doc_id"]] == s]
        assert all(q["target"] == pytest.approx(target[s]) and q["source_size"] == size[s] and q["taken"] <= 3 * q["size"] for q in own)
        assert sum(q["taken"] for q in own) == int(target[s] + 1e-6)


def test_mixing_edges(spark):
    assert mixing.mix_sources(empty(spark), "doc_id", "source", "text").count() == 0
    found = mixing.mix_sources(edges(spark), "doc_id", "source", "text").collect()
    assert len(found) == 9 and sum(q["taken"] for q in found) == pytest.approx(sum(q["size"] for q in found), abs=4)
    kept = mixing.mixed(documents(spark, [(1, "a b", None, "a"), (2, "c d", None, "b"), (3, None, None, "b")]))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_words"] and {r["doc_id"] for r in kept.collect()} <= {1, 2}
