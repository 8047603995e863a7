"""Embedding whitening from an exact scatter matrix that is counted bit by bit.

Components become integers x = floor(SCALE * c) + OFFSET. One pass finds their number, and the least, the greatest and the
sum of each dimension. In a second pass every task packs its rows: a dimension less its least value is written as bit planes, one bit
a row, 64 rows a word. The number of common bits of plane a of dimension i and plane b of dimension j, weighted by 2**(a+b),
adds up to the sum of products of the two dimensions, exactly. Tasks return one triangle of sums each, which is added up by a partial aggregate.
On the driver (dimensions squared) the products are centred as integers, n * sum(xy) - sum(x) * sum(y), and only then divided,
so the covariance has no rounding but its last; eigh gives the components. A third pass projects, a fourth measures the
covariance of what came out.

Defined results: rows whose vector is null, or holds null or non-finite entries, are dropped, and so are those whose length is
not the most common one (of equally common ones the greatest). Repeated rows count as often as they occur; rows without an id
stay. Entries beyond 2**40 after scaling count as that bound. Components whose eigenvalue is below 1e-12 of the largest (fewer
rows than dimensions, constant or dependent dimensions) cannot be scaled to one and are left out; where all rows are equal
none is left. ``deviation`` is a long where n**2 times the squared range proves that it fits, else a decimal of 38 digits.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import materialize, table

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
_FAR, _NONE, _SLAB = 1 << 40, 1e-12, 1 << 21
_SUM = pa.decimal128(38, 0)


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, x) of all usable vectors of the most common length."""
    c = F.col(vector_col).cast("array<double>")
    usable = F.col(vector_col).isNotNull() & F.forall(c, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf")))
    x = F.transform(c, lambda y: F.greatest(F.least(F.floor(y * F.lit(float(scale))), F.lit(_FAR)), F.lit(-_FAR)).cast("long") + F.lit(offset).cast("long"))
    rows = materialize(vectors.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")), "integers")
    common = rows.groupBy(F.size("x").alias("m")).count().orderBy(F.desc("count"), F.desc("m")).first()
    return rows.where(F.size("x") == (common["m"] if common else 0))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def planes(x: np.ndarray, bits: int) -> np.ndarray:
    """[bit, dimension, word]: the bits of non-negative integers (rows x dimensions), one bit a row; rows are filled up with zeros."""
    n, dim = x.shape
    words = -(-n // 64)
    out = np.zeros((bits, dim, words * 8), np.uint8)
    for a in range(bits):
        packed = np.packbits(((x >> a) & 1).astype(np.uint8), axis=0)
        out[a, :, : len(packed)] = packed.T
    return out.view(np.uint64)


def products(x: np.ndarray, bits: int) -> np.ndarray:
    """Sums over the rows of the products of every two dimensions, as integers without limit, from common bits of planes."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    p = planes(x, bits)
    used = [a for a in range(bits) if p[a].any()]
    slab = max(1, _SLAB // max(1, p[0].size if bits else 1))
    for a in used:
        for b in used:
            if b < a:
                continue
            common = np.concatenate([np.bitwise_count(p[a, i : i + slab, None, :] & p[b][None]).sum(-1, dtype=np.int64) for i in range(0, x.shape[1], slab)])
            both = common + common.T if a < b else common
            total += both.astype(object) << (a + b)
    return total


@dataclass
class Facts:
    """Number of rows, and by dimension the least value, the sum, and the sums of products of values less the least."""

    n: int
    least: np.ndarray
    sums: list[int]
    products: np.ndarray
    reach: int

    def covariance(self) -> np.ndarray:
        """Centred as integers; the one rounding is the division."""
        s = [t - self.n * int(m) for t, m in zip(self.sums, self.least, strict=True)]
        centred = self.n * self.products - np.outer(np.array(s, object), np.array(s, object))
        return np.array([[v / self.n**2 for v in row] for row in centred.tolist()], float).reshape(len(s), len(s))


def scatter(rows: DataFrame) -> Facts | None:
    """Exact first and second moments of x; none if there are no rows or no dimensions."""
    each = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    found = each.orderBy("i").collect()  # a row for each dimension
    if not found:
        return None
    dim, least = len(found), np.array([r["lo"] for r in found], np.int64)
    reach = max(r["hi"] - r["lo"] for r in found)
    bits = reach.bit_length()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim), object)
        for batch in batches:
            x = _matrix(batch.column(0), dim) - least
            for i in range(0, len(x), 1024):
                total += products(x[i : i + 1024], bits)
        i, j = np.triu_indices(dim)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(v) for v in total[i, j].tolist()], _SUM)], ["i", "j", "s"])

    sums = rows.select("x").mapInArrow(count, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s"))
    matrix = np.zeros((dim, dim), object)
    for r in sums.collect():  # half the dimensions squared
        matrix[r["i"], r["j"]] = matrix[r["j"], r["i"]] = int(r["s"])
    return Facts(found[0]["n"], least, [int(r["s"]) for r in found], matrix, reach)


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns), the vanishing ones left out."""
    e, u = np.linalg.eigh(covariance)
    e, u = e[::-1], u[:, ::-1]
    kept = min(most, int((e > max(e[0], 0) * _NONE).sum()))
    return e[:kept], u[:, :kept]


def projected(rows: DataFrame, facts: Facts, e: np.ndarray, u: np.ndarray) -> DataFrame:
    """(vec_id, deviation, w): each row's exact squared deviation and its whitened components."""
    dim, n, least = len(facts.sums), facts.n, facts.least
    shift = [t - n * int(m) for t, m in zip(facts.sums, least, strict=True)]
    fits = n * n * facts.reach**2 * dim < 1 << 63
    exact = n * facts.reach < 1 << 62
    kind = pa.int64() if fits else _SUM
    axes = u / np.sqrt(e)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim) - least
            d = n * x - np.array(shift, np.int64) if exact else n * x.astype(object) - np.array(shift, object)
            square = (d * d).sum(1) if fits else [Decimal(min(v, 10**38 - 1)) for v in (d.astype(object) ** 2).sum(1).tolist()]
            w = (d.astype(float) / n) @ axes
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(square, kind), lists], ["vec_id", "deviation", "w"])

    return rows.select("vec_id", "x").mapInArrow(project, f"vec_id long, deviation {'long' if fits else 'decimal(38,0)'}, w array<double>")


def identity_error(whitened: DataFrame, n: int, m: int) -> float:
    """Largest absolute entry of the covariance of w less the identity, measured over all rows."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m + 1, m))
        for batch in batches:
            w = _matrix(batch.column(0), m)
            total += np.vstack([w.sum(0), w.T @ w])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["i", "s"])

    found = whitened.select("w").mapInArrow(moments, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    total = np.zeros((m + 1) * m)
    for r in found:
        total[r["i"]] = r["s"]
    total = total.reshape(m + 1, m) / n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(m)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component up to `most`."""
    rows = integers(vectors, id_col, vector_col, scale, offset)
    facts = scatter(rows)
    v = facts.covariance() if facts else np.zeros((0, 0))
    e, u = components(v, most) if facts else (np.zeros(0), v)
    if not len(e):
        return vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    whitened = materialize(projected(rows, facts, e, u), "whitened")
    error = identity_error(whitened, facts.n, len(e))
    share = F.array(*[F.lit(float(x / np.trace(v))) for x in e])
    long = whitened.select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened"))
    return long.select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(facts.n).cast("long").alias("n"), "deviation", "whitened", share[F.col("i")].alias("explained"), F.lit(error).alias("identity_error")
    )


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
