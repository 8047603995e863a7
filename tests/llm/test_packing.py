"""Packing: ids against whole encodings, every id in one piece, gapless sequences, little padding, hot and long documents."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import packing
from tests.llm.test_operators import documents, edges, empty, words


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def checked(placed, truth, size, least=packing.LEAST):
    """Placed pieces against the ids of each document: (doc_id, ids) pairs. Returns the share of padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in placed:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and 0 < r["length"] <= size
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    wanted = defaultdict(list)
    for doc, ids in truth:
        wanted[doc].append(ids)
    assert by_doc.keys() == wanted.keys()
    for doc, texts in wanted.items():
        assert sum(r["length"] for r in by_doc[doc]) == sum(map(len, texts)) and {r["doc_tokens"] for r in by_doc[doc]} == set(map(len, texts))
        found = sorted((r["start"], tuple(r["ids"])) for r in by_doc[doc])
        if len(texts) == 1:
            assert [x for _, part in found for x in part] == texts[0] and [s for s, _ in found] == list(np.cumsum([0] + [len(p) for _, p in found])[:-1])
        else:
            assert all(tuple(t[s : s + len(p)]) == p for s, p in found for t in texts[:1])  # equal texts
    padding = used = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
        used += at
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding / max(1, used + padding)


def test_edges(spark, plain):
    rows = [(r["doc_id"], r["text"]) for r in edges(spark).collect()]
    checked(packing.packed(packing.pieces(edges(spark))).collect(), [(i, plain(t)) for i, t in rows], packing.SIZE)
    assert packing.packed(packing.pieces(empty(spark))).collect() == []
    assert packing.packed(packing.pieces(empty(spark))).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset"]


def test_chunks_of_any_kind_give_the_ids_of_whole_texts(plain):
    r = random.Random(3)
    alphabet = ["a", "b", "'s", "'", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\v", "\x0c", " ", " ", "1", "23", "é", "中文", "\U0001f600", "<|endoftext|>", "!", "don't", "́", "\x85"]
    texts = ["".join(r.choices(alphabet, k=r.randrange(60))) for _ in range(3000)]
    encode = packing.Encoder(packing.default_tokenizer())
    flat, n = encode(texts)
    at = n.cumsum()
    assert [flat[b - k : b].tolist() for k, b in zip(n, at, strict=True)] == [plain(t) for t in texts]
    assert all("".join(packing.blocks(t, 7)) == t and [x for b in packing.blocks(t, 7) for x in plain(b)[:-1]] == plain(t)[:-1] for t in texts)


def test_new_chunks_are_encoded_together(plain, monkeypatch):
    """Words of any letters take few calls' texts, and each keeps its own ids."""
    r = random.Random(8)
    letters = ["a", "e", "rt", "ing", "é", "ß", "Ж", "中", "文", "\u0e01", "\U00020000", "7", "'s", "-", "Z"]
    new = list(dict.fromkeys(r.choice([" ", "\n", "  ", " \n "]) + "".join(r.choices(letters, k=r.randrange(1, 9))) + r.choice("aé中7\U00020000") for _ in range(5000)))
    encode, given = packing.Encoder(packing.default_tokenizer()), []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return tokenizer.encode_batch_fast(texts, **options)

    tokenizer, encode.tokenizer = encode.tokenizer, Counted()
    encode.learn(new)
    assert len(given) <= len(new) / 50
    for c in new:
        at, n = encode.known[c] >> 24, encode.known[c] & 0xFFFFFF
        assert encode.flat[at : at + n].tolist() == plain(c)[:-1]


def test_forgotten_chunks_are_learnt_again(plain, monkeypatch):
    monkeypatch.setattr(packing, "CHUNKS", 50)
    encode = packing.Encoder(packing.default_tokenizer())
    for seed in range(12):
        texts = [words(seed * 10 + i, 40, 300) for i in range(3)]
        flat, n = encode(texts)
        assert flat.tolist() == [x for t in texts for x in plain(t)] and len(n) == 3 and len(encode.known) < 50 + 2 * 121


def test_chunks_that_many_batches_use_are_kept(plain, monkeypatch):
    """Words that were common before stay known when a batch of others makes the encoder forget."""
    monkeypatch.setattr(packing, "CHUNKS", 60)
    encode, learnt = packing.Encoder(packing.default_tokenizer()), []
    learn = encode.learn
    monkeypatch.setattr(encode, "learn", lambda chunks: (learnt.extend(chunks), learn(chunks)))
    common = " ".join(f"common{chr(97 + i)}" for i in range(20))
    for batch in range(8):
        text = " ".join(f"rare{chr(97 + batch)}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(50))
        for t in [common] * (2 if batch == 0 else 0) + [text]:
            assert encode([t])[0].tolist() == plain(t)
    assert len(encode.known) <= 60 + 51
    del learnt[:]
    assert encode([common])[0].tolist() == plain(common) and learnt == []


def test_different_chunks_of_many_texts(plain):
    """A batch's chunks are numbered together, joined they are the texts, and no token spans two of them."""
    texts = ["one two one two, one", "", "\u00e9t\u00e9### \u00d7, \u00f7! na\u00efve(x) \u0416, e\u0301. \U0001f600? <|endoftext|>a#\t \nb", " ", "a", "\u00e9"]
    found, bounds = packing.chunked(texts)
    chunks = found.to_pylist()
    parts = [chunks[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    assert ["".join(p) for p in parts] == texts and parts[0] == ["one", " two", " one", " two", ",", " one"]
    assert parts[2][:9] == ["\u00e9t\u00e9", "###", " \u00d7,", " \u00f7!", " na\u00efve", "(x", ")", " \u0416,", " e\u0301."]
    assert len(found.dictionary) == len(set(chunks)) < len(chunks)
    r = random.Random(5)
    alphabet = [*packing.MARKS, *"ab'|<>_-\"1 \n\t\r", "\u00e9", "\u00d7", "\u00f7", "\u00df", "\u024f", "\u0416", "\u0301", "\u4e2d", "\U0001f600", "\u00a0", "'s", "'ll", "<|endoftext|>"]
    texts = ["".join(r.choices(alphabet, k=r.randrange(40))) for _ in range(3000)]
    encode = packing.Encoder(packing.default_tokenizer())
    flat, n = encode(texts)
    at = n.cumsum()
    assert [flat[b - k : b].tolist() for k, b in zip(n, at, strict=True)] == [plain(t) for t in texts]
    for t in ([], [""], ["", ""]):
        flat, n = encode(t)
        assert flat.tolist() == [packing.END_ID] * len(t) and n.tolist() == [1] * len(t) and encode(t, False)[0].tolist() == []


def test_long_text_in_blocks(spark, plain, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 5000)
    text = words(1, 30_000, 500) + "\n" + "x" * 20_000 + " " + words(2, 50)
    placed = packing.packed(packing.pieces(documents(spark, [(1, text, None, None), (2, "a b", None, None)]))).collect()
    checked(placed, [(1, plain(text)), (2, plain("a b"))], packing.SIZE)


def test_first_fit_by_hand():
    r = random.Random(7)
    for _ in range(200):
        size = r.randrange(5, 60)
        lengths = sorted((r.randrange(1, size + 1) for _ in range(r.randrange(1, 70))), reverse=True)
        bins, room = [], []
        for i, n in enumerate(lengths):
            b = next((b for b, x in enumerate(room) if x >= n), len(room))
            if b == len(room):
                room.append(size)
                bins.append([])
            room[b] -= n
            bins[b].append(i)
        assert packing.first_fit(lengths, size) == bins
        full = packing.filled([[(i, 0, lengths[i]) for i in b] for b in bins], size, 3)
        assert sum(sum(x[2] for x in b) < size - 2 for b in full) <= 1
        parts = defaultdict(list)
        for b in full:
            assert sum(x[2] for x in b) <= size
            for i, s, n in b:
                parts[i].append((s, n))
        for i, n in enumerate(lengths):
            at = 0
            for s, k in sorted(parts[i]):
                assert s == at and k > 0
                at += k
            assert at == n


def test_hot_copies_without_ids_pack_well(spark, plain):
    hot = " ".join(["word"] * 1_200)  # over half a sequence each, so none fits beside another
    docs = documents(spark, [(None, hot, None, None)] * 300 + [(i, words(i, 30), None, None) for i in range(100)]).repartition(4)
    placed = packing.packed(packing.pieces(docs), group=100).collect()
    share = checked(placed, [(None, plain(hot))] * 300 + [(i, plain(words(i, 30))) for i in range(100)], packing.SIZE)
    assert share < 0.03
    groups = defaultdict(int)
    for r in placed:
        groups[(r["sequence_id"] - 1) >> 33] += r["length"]
    assert len(groups) == 4 and max(groups.values()) < 2 * sum(groups.values()) / 4


def test_sequences(spark, plain):
    docs = documents(spark, [(1, words(1, 900), None, None), (2, words(2, 10), None, None), (3, None, None, None)])
    placed = packing.packed(packing.pieces(docs, size=64), size=64)
    placed = packing.materialize(placed, "placed")
    found = {r["sequence_id"]: r for r in packing.sequences(placed, 64, pad_id=50256).collect()}
    for s, rows in {s: [r for r in placed.collect() if r["sequence_id"] == s] for s in found}.items():
        rows.sort(key=lambda r: r["offset"])
        ids = [x for r in rows for x in r["ids"]]
        assert found[s]["input_ids"][: len(ids)] == ids and found[s]["segments"][: len(ids)] == [i + 1 for i, r in enumerate(rows) for _ in r["ids"]]
        assert len(found[s]["input_ids"]) == len(found[s]["segments"]) == (len(ids) if len(ids) & (len(ids) - 1) == 0 else 64)


def test_query(spark, plain):
    from tests.sql_twin import DATA

    docs = [(r["doc_id"], plain(r["text"])) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    placed = packing.packed(packing.pieces(spark.read.parquet(f"{DATA}/documents.parquet")))
    assert checked(placed.collect(), docs, packing.SIZE) < 0.02
    rows = packing.op11_packing(spark, DATA)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert rows.agg(F.sum("length")).first()[0] == sum(len(x) for _, x in docs)
