"""Helpers shared by the training-data operators: shared-folder tables, word rules and blocked hash exchange."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.sources.shared import discard, materialize, scratch

__all__ = ["discard", "lower_ascii", "materialize", "mix64", "rolling", "scratch", "shingle_hashes", "sliding_argmin", "table", "word_hashes", "words"]

#: ASCII white space that separates words; everything else belongs to words.
SPACE = "\\x20\\x09-\\x0D"
WORD_BYTES = rb"[^\x20\x09-\x0D]+"
_SPACES = (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")
PIECE = 1 << 20
_BASE, _SHINGLE_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of words ([^\\x20\\x09-\\x0D]+) of a text; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: spreads polynomial hashes over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, k: int, base: int) -> np.ndarray:
    """Polynomial hash (mod 2**64, mixed) of every run of k values; empty if there are fewer."""
    if len(values) < k:
        return np.zeros(0, np.uint64)
    out, span, place, base = None, 1, 0, np.uint64(base)
    power, left = values.astype(np.uint64), k  # hash of runs of `span` values, built by doubling
    powers = base
    while left:
        if left & 1:
            if out is None:
                out, place = power, span
            else:
                n = len(values) - place - span + 1
                out = out[:n] * powers + power[place : place + n]
                place += span
        left >>= 1
        if left:
            n = len(power) - span
            power = power[:n] * powers + power[span : span + n]
            powers, span = (np.array([powers]) ** 2)[0], span * 2
    return mix64(out[: len(values) - k + 1])


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        power = np.full(n, base, np.uint64)
        power[0] = 1
        out.append(np.cumprod(power, out=power))
    return out[0], out[1]


def word_hashes(text: bytes, lower: bool = False) -> np.ndarray:
    """64-bit hash of each word of a text in UTF-8, piece by piece, so memory does not grow with ten times the text."""
    out, at = [], 0
    while at < len(text):
        end = len(text) if at + PIECE >= len(text) else 1 + max(text.rfind(c, at + 1, at + PIECE) for c in _SPACES)
        if end <= at:  # a word longer than a piece
            end = min((i for c in _SPACES if (i := text.find(c, at + PIECE)) >= 0), default=len(text))
        data = np.frombuffer(text[at:end].lower() if lower else text, np.uint8, end - at, 0 if lower else at)
        at = end
        solid = np.zeros(len(data) + 2, bool)
        np.greater(data - np.uint8(9), 4, out=solid[1:-1])
        solid[1:-1] &= data != 32
        edge = np.flatnonzero(solid[1:] != solid[:-1])
        start, stop = edge[::2], edge[1::2]
        if not len(start):
            continue
        power, back = _powers(1 << max(20, len(data).bit_length()))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
        out.append(mix64((sums[stop] - sums[start]) * back[start] + (stop - start).astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """64-bit hash of each run of k words, A-Z lower-cased; fewer words: one hash of all; none: empty."""
    h = word_hashes(text, lower=True)
    return rolling(h, min(k, len(h)), _SHINGLE_BASE + 2 * min(k, len(h))) if len(h) else h


def _sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """The least value of each run of w, by minima of doubled spans, the last step overlapping."""
    best, span = values, 1
    while span < w:
        step = min(span, w - span)
        best = np.minimum(best[:-step], best[step:])
        span += step
    return best


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """Position of the least value in each run of w hashes, the leftmost of equal ones (fewer values than w: none).

    The rule is the same at every length, so equal runs pick the same offset wherever they lie. Minima first carry their
    place in the low bits; runs in which two hashes differ in those bits only are found by the true minimum and decided alone.
    """
    if len(values) < w:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << len(values).bit_length()) - 1)
    at = (_sliding_min((values & ~low) | np.arange(len(values), dtype=np.uint64), w) & low).astype(np.int64)
    for j in np.flatnonzero(values[at] != _sliding_min(values, w)).tolist():
        at[j] = j + int(values[j : j + w].argmin())
    return at
