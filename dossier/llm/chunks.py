"""Questions that chunks of documents put to shards of a hash space, and their answers.

Documents are dealt into chunks of bounded bytes by a hash of id and text, so rows without an id, or of one id, spread as far
as their texts differ; values that must meet (hashes of passages) are dealt
into shards of bounded size. A chunk sends each shard one row with packed arrays, distinct values only, so a passage that
very many documents share costs one entry a chunk, not one a document; a shard answers a chunk only what it must act on.
Chunks and shards both grow with the root of the input's bytes, so that the rows exchanged grow with the bytes, until they
reach ``CHUNK_MOST`` and ``SHARD_MOST`` (at about 0.25 TB and 30 GB); from there rows grow faster, but never beyond one an
entry. Inside a chunk, texts are worked on in parts of ``PART_BYTES``, so memory does not grow with the chunk. Nothing is kept
on the driver. All steps are one lazy plan: Spark shuffles the texts once and reuses that exchange, and recomputes what a
lost executor held.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES, CHUNK_LEAST, CHUNK_MOST = 2 << 20, 1 << 19, 32 << 20
SHARD_BYTES, SHARD_LEAST, SHARD_MOST = 24 << 20, 8 << 20, 128 << 20
PART_BYTES = 1 << 19


def sized(total: int) -> tuple[int, int]:
    """Numbers of chunks and of shards for so many bytes."""
    root = math.sqrt(total / (1 << 30))
    chunk = min(max(CHUNK_BYTES * root, CHUNK_LEAST), CHUNK_MOST)
    shard = min(max(SHARD_BYTES * root, SHARD_LEAST), SHARD_MOST)
    return int(total // chunk) + 1, int(total // shard) + 1


def dealt(docs: DataFrame, id_col: str, text_col: str, kind: str) -> tuple[DataFrame, int]:
    """(chunk, id, text cast to kind), and the number of shards, both from the total bytes."""
    chunks, shards = sized(docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0)
    id_ = F.col(id_col).cast("long")
    text = F.coalesce(F.col(text_col), F.lit("")).cast(kind)
    return docs.select(F.pmod(F.xxhash64(id_, text), F.lit(chunks)).cast("int").alias("chunk"), id_.alias("id"), text.alias("text")), shards


def parts(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows of a chunk in runs of about PART_BYTES of text; a longer text is a run of its own."""
    if len(pdf):
        ends = np.cumsum(np.fromiter(map(len, pdf["text"]), np.int64, len(pdf)))
        cut = np.flatnonzero(np.diff(ends // PART_BYTES)) + 1
        for start, end in zip([0, *cut.tolist()], [*cut.tolist(), len(pdf)], strict=True):
            yield pdf.iloc[start:end]


def by_shard(values: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions of its entries in order) for each shard of a hash that occurs."""
    own = (values % np.uint64(shards)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    cut = np.flatnonzero(np.diff(own[order])) + 1
    for at in np.split(order, cut) if len(order) else []:
        yield int(own[at[0]]), at


def by_chunk(chunks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(chunk, positions of its entries in order)."""
    order = np.argsort(chunks, kind="stable")
    cut = np.flatnonzero(np.diff(chunks[order])) + 1
    for at in np.split(order, cut) if len(order) else []:
        yield int(chunks[at[0]]), at


def unpack(blobs, dtype) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype) for b in blobs]


def joined(parts_: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(parts_) if parts_ else np.zeros(0, dtype)


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys (the first counts most), and where a new combination of them starts in it."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, new


def lookup(known: tuple[np.ndarray, np.ndarray], asked: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Place of each asked pair among known pairs, which are sorted by both and differ; -1 where it is not known."""
    a, b = known
    at = np.searchsorted(a, asked[0])
    out = np.full(len(asked[0]), -1, np.int64)
    live = np.flatnonzero(at < len(a))
    while len(live):  # pairs with the same first value lie in a row
        same = a[at[live]] == asked[0][live]
        live = live[same]
        hit = b[at[live]] == asked[1][live]
        out[live[hit]] = at[live[hit]]
        live = live[~hit]
        at[live] += 1
        live = live[at[live] < len(a)]
    return out


def spread(flags: np.ndarray, size: int) -> np.ndarray:
    """Coverage of 0 .. size - 1 by runs given as (from, to) rows."""
    delta = np.zeros(size + 1, np.int32)
    np.add.at(delta, flags[:, 0], 1)
    np.add.at(delta, flags[:, 1], -1)
    return delta[:-1].cumsum() > 0
