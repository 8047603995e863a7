"""Substring dedup by repeated-phrase automata: recurring word windows are removed from all but their first document.

1. Every run of ``WINDOW`` words has an anchor, the ``ANCHOR``-word shingle of least hash inside it; equal windows have equal
   anchors. Chunks send their distinct anchors to shards, which name those that more than one document holds.
2. Windows with such an anchor are confirmed: shards find, for each window (96-bit hash), the smallest document that holds
   it, and name it to each chunk that holds the window where more than one document does.
3. Each chunk cuts its recurring windows into passages (runs of consecutive windows), compiles them into an Aho-Corasick
   automaton and streams its documents through it; every occurrence of a passage that started in a smaller document is
   removed. The automata are shards of the whole dictionary: each holds the passages that its part of a chunk contains.

Defined results: null and blank texts have no words; ``kept_sha256`` of nothing is that of the empty string; rows that
repeat an id are the same document; a row without an id counts as the largest document; documents of fewer than 13 words are
kept whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

from dossier.llm.chunks import by_chunk, by_shard, dealt, joined, lookup, parts, runs, spread, unpack
from dossier.llm.common import rolling, sliding_argmin, table

WINDOW, ANCHOR = 13, 5
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LAST = np.iinfo(np.int64).max
_B1, _B2, _B3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
ENTRIES = "shard int, chunk int, hi binary, lo binary, doc binary, many binary"


class Chunk:
    """The words of a chunk's documents, ids ascending: windows start at `at`, each in the document `doc[at]`."""

    def __init__(self, pdf: pd.DataFrame, window: int) -> None:
        ids = pdf["id"].to_numpy("float64", na_value=np.nan) if pdf["id"].isna().any() else None
        keys = np.where(np.isnan(ids), _LAST, pdf["id"].fillna(0).to_numpy(np.int64)) if ids is not None else pdf["id"].to_numpy(np.int64)
        order = np.argsort(keys, kind="stable")
        self.raw, self.ids = pdf["id"].to_numpy(object)[order], keys[order]
        self.words = [_WORDS.findall(t) for t in pdf["text"].to_numpy(object)[order]]
        self.sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.starts = np.cumsum(self.sizes) - self.sizes
        codes, unique = pd.factorize(np.array([w for ws in self.words for w in ws], object))
        digest = xxhash.xxh64_intdigest
        self.h = np.fromiter((digest(w.encode()) for w in unique), np.uint64, len(unique))[codes] if len(unique) else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(self.ids)), self.sizes)
        n = len(self.h) - window + 1
        self.at = np.flatnonzero(self.doc[:n] == self.doc[window - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def anchors(self, window: int, anchor: int) -> np.ndarray:
        """Hash of the anchor of each window."""
        a = rolling(self.h, anchor, _B1)
        return a[sliding_argmin(a, window - anchor + 1)[self.at]] if len(self.at) else np.zeros(0, np.uint64)

    def windows(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each window, 96 bits together."""
        if not len(self.at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        return rolling(self.h, window, _B2)[self.at], rolling(self.h, window, _B3)[self.at].astype(np.uint32)


def _distinct(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """(hi, lo, smallest document, do several documents hold it) of each different (hi, lo) of entries (hi, lo, document)."""
    hi, lo, doc = (joined([f[k] for f in found], kind) for k, kind in enumerate((np.uint64, np.uint32, np.int64)))
    order, new = runs(hi, lo)
    first = np.flatnonzero(new)
    if not len(first):
        return hi, lo, doc, np.zeros(0, bool)
    least, most = np.minimum.reduceat(doc[order], first), np.maximum.reduceat(doc[order], first)
    return hi[order[first]], lo[order[first]], least, most > least


def _sent(key: tuple, shards: int, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], plain: bool = False) -> pd.DataFrame:
    """One row for each shard of a chunk's different entries; plain: without the second hash and the document."""
    hi, lo, doc, many = _distinct(found)
    rows = [(s, key[0], hi[i].tobytes(), b"" if plain else lo[i].tobytes(), b"" if plain else doc[i].tobytes(), many[i].tobytes()) for s, i in by_shard(hi, shards)]
    return pd.DataFrame(rows, columns=["shard", "chunk", "hi", "lo", "doc", "many"])


def send_anchors(shards: int, window: int, anchor: int):
    def send(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for part in parts(pdf):
            c = Chunk(part, window)
            a = c.anchors(window, anchor)
            hi, _, least, many = _distinct([(a, np.zeros(len(a), np.uint32), c.ids[c.doc[c.at]])])
            # A second document, where there is one, keeps the word of several.
            found.append((hi, np.zeros(len(hi), np.uint32), least))
            found.append((hi[many], np.zeros(int(many.sum()), np.uint32), least[many] + 1))
        return _sent(key, shards, found, plain=True)

    return send


def recurring(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """For each chunk, those of its entries that it must act on because more than one document holds them, with the smallest of all.

    An anchor of two chunks counts as one of two documents, though rows of one id may lie in both; windows carry their documents.
    """
    sizes = np.fromiter(map(len, pdf["hi"]), np.int64, len(pdf)) // 8
    hi, lo = joined(unpack(pdf["hi"], np.uint64), np.uint64), joined(unpack(pdf["lo"], np.uint32), np.uint32)
    doc, many = joined(unpack(pdf["doc"], np.int64), np.int64), joined(unpack(pdf["many"], bool), bool)
    plain = len(doc) < len(hi)
    if plain:
        lo, doc = np.zeros(len(hi), np.uint32), np.zeros(len(hi), np.int64)
    chunk = np.repeat(pdf["chunk"].to_numpy(np.int64), sizes)
    order, new = runs(hi, lo)
    rows = []
    if len(order):
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(doc[order], first)
        several = (np.diff(np.append(first, len(order))) > 1) | np.logical_or.reduceat(many[order], first)
        group = np.cumsum(new) - 1
        act = several[group] if plain else several[group] & ((doc[order] > least[group]) | many[order])  # the first document alone keeps all
        use, owner = order[act], least[group[act]]
        rows = [(c, hi[use[i]].tobytes(), b"" if plain else lo[use[i]].tobytes(), b"" if plain else owner[i].tobytes()) for c, i in by_chunk(chunk[use])]
    return pd.DataFrame(rows, columns=["chunk", "hi", "lo", "owner"])


def _answers(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hi, lo, owner) of what the shards told a chunk, sorted."""
    hi, lo, owner = joined(unpack(pdf["hi"], np.uint64), np.uint64), joined(unpack(pdf["lo"], np.uint32), np.uint32), joined(unpack(pdf["owner"], np.int64), np.int64)
    order = np.lexsort((lo, hi))
    return hi[order], lo[order], owner[order]


def send_windows(shards: int, window: int, anchor: int):
    def send(key: tuple, docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        shared = np.sort(joined(unpack(told["hi"], np.uint64), np.uint64))
        found = []
        for part in parts(docs) if len(shared) else ():
            c = Chunk(part, window)
            a = c.anchors(window, anchor)
            use = np.flatnonzero(shared[np.minimum(np.searchsorted(shared, a), len(shared) - 1)] == a)
            hi, lo = c.windows(window)
            found.append((hi[use], lo[use], c.ids[c.doc[c.at[use]]]))
        return _sent(key, shards, found)

    return send


def _passages(c: Chunk, repeated: np.ndarray, owner: np.ndarray, window: int):
    """(document, first word, last word, largest owner) of each maximal run of repeated windows in a document."""
    at = c.at[repeated]
    if not len(at):
        return []
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(c.doc[at]) != 0)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]) - 1
    most = np.maximum.reduceat(owner[repeated], first)
    d = c.doc[at[first]]
    return zip(d.tolist(), (at[first] - c.starts[d]).tolist(), (at[last] - c.starts[d] + window - 1).tolist(), most.tolist(), strict=True)


def strip(window: int):
    """The answer for each document of a chunk, located by the automata of its parts."""

    def locate(key: tuple, docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        hi, lo, owner = _answers(told)
        rows = []
        for part in parts(docs):
            c = Chunk(part, window)
            at = lookup((hi, lo), c.windows(window))
            doc = c.ids[c.doc[c.at]]
            own = np.where(at >= 0, owner[at], doc) if len(owner) else doc
            framed = [f" {' '.join(ws)} " for ws in c.words]
            edges = [np.cumsum([0, *map(len, ws)]) + np.arange(len(ws) + 1) for ws in c.words]  # the blank before each word
            automaton = ahocorasick.Automaton()
            for d, i, j, most in _passages(c, own < doc, own, window):
                passage = framed[d][edges[d][i] : edges[d][j + 1] + 1]
                automaton.add_word(passage, (len(passage), most))
            automaton.make_automaton()
            for d, ws in enumerate(c.words):
                kept, removed = ws, 0
                if len(automaton) and len(ws) >= window:
                    found = [(end - n + 1, end) for end, (n, most) in automaton.iter(framed[d]) if most < c.ids[d]]
                    if found:
                        gone = spread(np.searchsorted(edges[d], np.array(found)), len(ws))
                        removed = int(gone.sum())
                        kept = [w for w, g in zip(ws, gone.tolist(), strict=True) if not g]
                text = " ".join(kept)
                rows.append((c.raw[d], len(ws), removed, hashlib.sha256(text.encode()).hexdigest(), text))
        out = pd.DataFrame(rows, columns=["id", "n_words", "n_removed", "kept_sha256", "kept"])
        return out.astype({"id": "Int64"})

    return locate


def remove_repeats(docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256, kept): what stays of each document."""
    chunked, shards = dealt(docs, id_col, text_col, "string")
    chunks = chunked.groupBy("chunk")
    answer = "chunk int, hi binary, lo binary, owner binary"
    asked = chunks.applyInPandas(send_anchors(shards, window, anchor), ENTRIES)
    shared = asked.groupBy("shard").applyInPandas(recurring, answer)
    sent = chunks.cogroup(shared.groupBy("chunk")).applyInPandas(send_windows(shards, window, anchor), ENTRIES)
    told = sent.groupBy("shard").applyInPandas(recurring, answer)
    out = chunks.cogroup(told.groupBy("chunk")).applyInPandas(strip(window), "id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out.withColumnRenamed("id", id_col)


def op3_phrases(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "n_words", "n_removed", "kept_sha256")
