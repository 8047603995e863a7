"""Exact top-k inner-product search by distributed histogram selection.

Vectors are packed into blocks inside their partitions, without a shuffle; the queries, each id once, are packed into blocks
of ``QUERIES``, and ``GROUP`` such blocks at a time (a bounded size) are broadcast to all blocks of vectors. Scores are never
stored: a round scores everything, counts the scores of each query in ``BINS`` bins of its current range, adds the counts of
all tasks and keeps the bin that holds the k-th score, until a bin is one score wide or holds ``SPARE`` scores at most. The
last pass keeps the scores above that bin and those inside it; of equal scores only the smallest ids that are still needed. A
task reports only its upper bins up to k scores (lower ones cannot hold the k-th), so what meets in one place is bounded by k
and the number of tasks, whatever the data; the work is spread over the partitions of the vectors.

Scores are 64-bit integers as long as every squared norm is below 2**52. Beyond that (finite components of any size), pairs
whose norms may exceed it are multiplied in integers without limit, bins are taken over an order-preserving 64-bit key of
the scores (length in bits, then the leading 40 bits), and ties of that key are resolved by the full scores.

Defined results: vectors that are null or hold a null or non-finite component take no part; a shorter vector counts as
padded with zeros; fewer than k candidates give fewer rows; a query never meets rows with its own id; rows that repeat are
candidates of their own; a query id that repeats is asked once, by its least vector; a score beyond 64 bits ranks by its
true value and is returned as the nearest long; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import discard, materialize, table

TOP, SCALE, EVERY, BINS, BLOCK, QUERIES, GROUP, SPARE = 20, 64, 20, 256, 2048, 512, 32, 64
_LONG = (1 << 63) - 1
_SAFE = 2.0**26  # norms whose product is below 2**52: exact in floating point
STATE = "qblock int, qids binary, qmatrix binary, low binary, need binary, held long"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): the vectors that take part, as doubles."""
    x = F.col(vector_col)
    whole = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    return vectors.where(whole & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("x"))


def _packed(ids: list, vectors: list, dim: int) -> tuple[bytes, bytes]:
    """Ids, ascending, and the matrix of their vectors, as bytes."""
    order = np.argsort(np.array(ids, np.int64), kind="stable")
    m = np.zeros((len(ids), dim))
    for i, at in enumerate(order):
        m[i, : len(vectors[at])] = vectors[at]
    return np.array(ids, np.int64)[order].tobytes(), m.tobytes()


def _blocks(rows: DataFrame, dim: int) -> DataFrame:
    """(ids, matrix): the vectors of each partition in blocks of up to BLOCK rows."""
    size = BLOCK

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, xs = [], []
        for pdf in frames:
            ids.extend(pdf["id"])
            xs.extend(pdf["x"])
            while len(ids) >= size:
                yield pd.DataFrame([_packed(ids[:size], xs[:size], dim)], columns=["ids", "matrix"])
                ids, xs = ids[size:], xs[size:]
        if ids:
            yield pd.DataFrame([_packed(ids, xs, dim)], columns=["ids", "matrix"])

    return materialize(rows.mapInPandas(pack, "ids binary, matrix binary"), "vectors")


def _asked(rows: DataFrame, dim: int) -> tuple[DataFrame, int]:
    """STATE of the first round for each block of queries, and the number of blocks."""
    once = materialize(rows.groupBy("id").agg(F.min("x").alias("x")), "queries")
    n = -(-once.count() // QUERIES)

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, m = _packed(pdf["id"].tolist(), pdf["x"].tolist(), dim)
        return pd.DataFrame([(key[0], ids, m, None, None, 0)], columns=["qblock", "qids", "qmatrix", "low", "need", "held"])

    keyed = once.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, n))).cast("int"))
    return materialize(keyed.groupBy("block").applyInPandas(pack, STATE), "asked"), n


def _exact(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as integers without limit."""
    return np.array([math.floor(v * scale) if math.isfinite(v * scale) else int(v) * scale for v in x.ravel().tolist()] or [0], object)[: x.size].reshape(x.shape)


def _key(s: int) -> int:
    """Order-preserving 64-bit key of an integer; different ones may share a key only from 2**40 on."""
    n = abs(s)
    size = n.bit_length()
    key = (size << 40) | ((n << 40 >> size) & ((1 << 40) - 1))
    return key if s > 0 else -key if s else 0


def scores(q: np.ndarray, c: np.ndarray, scale: int, wide: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Integer inner products, or their keys and the products without limit."""
    with np.errstate(over="ignore", invalid="ignore"):
        a, b = np.floor(q * scale), np.floor(c * scale)
        if not wide:
            return (a @ b.T).astype(np.int64), None
        far = ~(np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :] < _SAFE * _SAFE)
        s = np.where(far, 0, a @ b.T).astype(np.int64).astype(object)
    big_q, big_c = far.any(1), far.any(0)
    a, b = _exact(q[big_q], scale), _exact(c[big_c], scale)
    columns = np.flatnonzero(big_c)
    for row, x in zip(np.flatnonzero(big_q), a, strict=True):
        mine = far[row, columns]
        s[row, columns[mine]] = b[mine] @ x if mine.any() else s[row, columns[mine]]
    return np.frompyfunc(_key, 1, 1)(s).astype(np.int64), s


def _frames(frames: Iterator[pd.DataFrame], dim: int, scale: int, wide: bool):
    """(state row, ids of the queries, ids of the vectors, scores, scores without limit, own-id mask) of each pair of blocks."""
    for pdf in frames:
        for row in pdf.itertuples(index=False):
            ids, qids = np.frombuffer(row.ids, np.int64), np.frombuffer(row.qids, np.int64)
            s, full = scores(np.frombuffer(row.qmatrix).reshape(-1, dim), np.frombuffer(row.matrix).reshape(-1, dim), scale, wide)
            yield row, qids, ids, s, full, qids[:, None] == ids[None, :]


def _sortable(s: int) -> str:
    """A text that sorts like the integer."""
    digits = str(abs(s))
    if s >= 0:
        return f"1{len(digits):05d}{digits}"
    return f"0{99_999 - len(digits):05d}" + "".join(chr(105 - ord(d)) for d in digits)


def top_k(vectors: DataFrame, id_col: str, vector_col: str, k: int = TOP, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each id divisible by `every`."""
    rows = usable(vectors, id_col, vector_col)
    square = F.aggregate("x", F.lit(0.0), lambda a, x: a + (F.abs(x) * scale + 1.0) * (F.abs(x) * scale + 1.0))
    facts = rows.agg(F.max(F.size("x")), F.max(square)).first()
    dim, norm = max(1, facts[0] or 0), float(facts[1] or 0.0)
    wide = not norm < _SAFE * _SAFE
    reach = _key(1 << 4400) if wide else int(norm) + 1  # no score exceeds the largest squared norm
    asked, n = _asked(rows.where(F.col("id") % every == 0), dim)
    found = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score long, full string")
    blocks = _blocks(rows, dim) if n else None
    bins, spare = BINS, SPARE

    def arrays(low: bytes | None, need: bytes | None, m: int) -> tuple[np.ndarray, np.ndarray]:
        return np.full(m, -reach, np.int64) if low is None else np.frombuffer(low, np.int64), np.full(m, k, np.int64) if need is None else np.frombuffer(need, np.int64)

    def counted(w: int, span: int):
        def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            grids: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for row, qids, _, s, _, own in _frames(frames, dim, scale, wide):
                low, need = arrays(row.low, row.need, len(qids))
                if row.qblock not in grids:
                    grids[row.qblock] = np.zeros((len(qids), bins + 1), np.int64), need
                s = s - low[:, None]
                place = np.where(own | (s < 0) | (s >= span), bins, s // w) + np.arange(len(qids))[:, None] * (bins + 1)
                grids[row.qblock][0].ravel()[:] += np.bincount(place.ravel(), minlength=len(qids) * (bins + 1))
            for block, (grid, need) in grids.items():
                counts = grid[:, :bins]
                above = counts[:, ::-1].cumsum(1)[:, ::-1] - counts
                i, b = np.nonzero((counts > 0) & (above < need[:, None]))
                yield pd.DataFrame({"qblock": np.int32(block), "place": i.astype(np.int32), "bin": b.astype(np.int32), "n": counts[i, b]})

        return count

    def narrowed(w: int):
        def narrow(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            row = left.iloc[0]
            m = len(row["qids"]) // 8
            low, need = arrays(row["low"], row["need"], m)
            grid = np.zeros((m, bins), np.int64)
            grid[right["place"], right["bin"]] = right["n"]
            above = grid[:, ::-1].cumsum(1)[:, ::-1] - grid
            reached = (above < need[:, None]) & (above + grid >= need[:, None])
            b = reached.argmax(1)  # bin of the k-th score; where there are fewer than k, all is kept
            at = np.arange(m)
            low = np.where(reached.any(1), low + b * w, low)
            held = np.where(reached.any(1), grid[at, b], 0)
            need = np.where(reached.any(1), need - above[at, b], need)
            return pd.DataFrame([(row["qblock"], row["qids"], row["qmatrix"], low.tobytes(), need.tobytes(), int(held.max(initial=0)))], columns=["qblock", "qids", "qmatrix", "low", "need", "held"])

        return narrow

    def chosen(last: bool):
        def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for row, qids, ids, s, full, own in _frames(frames, dim, scale, wide):
                low, need = arrays(row.low, row.need, len(qids))
                keep = ~own & (s >= low[:, None])
                if last:  # ids ascend within a block, so the first of equal scores are the ones to keep
                    tie = keep & (s == low[:, None])
                    if full is None:
                        keep &= ~tie | (tie.cumsum(1) <= need[:, None])
                    else:
                        for i in np.flatnonzero(tie.sum(1) > need):
                            at = np.flatnonzero(tie[i])
                            keep[i, sorted(at.tolist(), key=lambda j: -full[i, j])[need[i] :]] = False
                i, j = np.nonzero(keep)
                if len(i):
                    true = s[i, j] if full is None else full[i, j]
                    clamped = true if full is None else np.array([max(-_LONG - 1, min(_LONG, int(x))) for x in true], np.int64)
                    yield pd.DataFrame({"query_id": qids[i], "vec_id": ids[j], "score": clamped, "full": None if full is None else [_sortable(x) for x in true]})

        return choose

    for first in range(0, n, GROUP):
        state = asked.where(F.col("qblock").between(first, first + GROUP - 1))
        width, old = -(-(2 * reach + 1) // bins), None
        span = width * bins
        while True:
            # A group of queries is GROUP * QUERIES vectors at most: a bounded broadcast beside every block of vectors.
            grid = blocks.crossJoin(F.broadcast(state)).mapInPandas(counted(width, span), "qblock int, place int, bin int, n long")
            grid = grid.groupBy("qblock", "place", "bin").agg(F.sum("n").alias("n"))
            state = materialize(state.groupBy("qblock").cogroup(grid.groupBy("qblock")).applyInPandas(narrowed(width), STATE), "state")
            if old is not None:
                discard(old)
            old, last = state, width == 1
            if last or (state.agg(F.max("held")).first()[0] or 0) <= spare:
                break
            width, span = -(-width // bins), width  # scores above the bin are already deducted from `need`
        part = blocks.crossJoin(F.broadcast(state)).mapInPandas(chosen(last), "query_id long, vec_id long, score long, full string")
        found = found.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("full"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, embedding, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, arg_min(e, embedding) AS e FROM v WHERE vec_id % {EVERY} = 0 GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {TOP}
"""
