"""Greedy seeds in rounds: the clusters of an ordered pass over names, without the pass.

In order, a form joins the first seed that it matches, or becomes a seed. Matters of at most ``SMALL`` forms are passed over as they
are, many in one stream. Of a larger one, each round decides the first ``BLOCK`` forms among themselves, in order, and sends the new
seeds to all forms still open, which many tasks compare with them: a form that is open has met all earlier seeds, so the first new
seed that it matches is its seed. A round so takes one small group and one pass over the open forms, and rounds are as many as the
seeds need blocks.

Forms meet seeds in arrays. Two bounds rule out most pairs and no match (the loose score counts common subsequences, rounded from 84.5
on, so of the shorter form's n characters 0.7316 n must occur in the other, and 0.4632 n - 1 of its pairs of neighbours, in
the forms or in those with sorted words); what is left is scored in order until one matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions import fixed
from dossier.functions import names as N
from dossier.sources.shared import discard, materialize

SMALL, BLOCK, ROWS, KINDS = 2_000, 1_024, 512, 40
#: So few forms are compared without sketches.
PLAIN = 64
#: Blocks of seeds (one row a matter) are broadcast up to so many matters.
BROADCAST_MATTERS = 200


class Sketch:
    """Character counts and neighbour bits of forms, and of forms with sorted words."""

    def __init__(self, forms: list[str]) -> None:
        self.size = np.array([len(f) for f in forms], np.int64)
        self.counts = np.zeros((KINDS, len(forms)), np.uint8)
        for j, f in enumerate(forms):
            for c in f:
                k = ord(c) % KINDS
                self.counts[k, j] = min(255, self.counts[k, j] + 1)
        self.pairs = [self._bits(forms), self._bits([" ".join(sorted(f.split())) for f in forms])]

    def _bits(self, forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        bits = np.zeros((len(forms), 256), bool)
        for j, f in enumerate(forms):
            bits[j, [(ord(a) * 31 + ord(b)) % 256 for a, b in zip(f, f[1:], strict=False)]] = True
        spare = np.maximum(np.array([len(f) - 1 for f in forms]), 0) - bits.sum(1)  # repeated pairs may all be common
        return np.packbits(bits, axis=1).view(np.uint64), spare


def possible(a: Sketch, b: Sketch, least: int) -> np.ndarray:
    """[forms of a, forms of b]: may the loose score be `least` or more? Never false where it is."""
    share = (least - 0.5) / 200
    short = share / (1 - share)  # characters of the shorter form that must be common
    common = np.zeros((len(a.size), len(b.size)), np.int16)
    for x, y in zip(a.counts, b.counts, strict=True):
        if x.any() and y.any():
            common += np.minimum(x[:, None], y[None, :])
    n = np.minimum(a.size[:, None], b.size[None, :])
    out = common >= n * short - 1e-6
    need = n * (1 - (2 - 3 * share) + (3 * share - 1) * short) - 1  # (n - 1) less 2 n + k - 3 share (n + k) at the least k = short n
    met = np.zeros_like(out)
    for (p, spare_a), (q, spare_b) in zip(a.pairs, b.pairs, strict=True):
        same = sum(np.bitwise_count(p[:, None, w] & q[None, :, w]).astype(np.int16) for w in range(p.shape[1]))
        extra = np.where(a.size[:, None] <= b.size[None, :], spare_a[:, None], spare_b[None, :])
        extra = np.where(a.size[:, None] == b.size[None, :], np.maximum(spare_a[:, None], spare_b[None, :]), extra)
        met |= same + extra >= need - 1e-6
    return out & met


def in_order(forms: list[str], least: int) -> list[int]:
    """For each form the number of the form that is its seed (its own number: it is a seed)."""
    if len(forms) <= PLAIN:
        seed: list[int] = []
        for i, form in enumerate(forms):
            seed.append(next((j for j in range(i) if seed[j] == j and N.loose_score_of(forms[j], form) >= least), i))
        return seed
    sketch, seed = Sketch(forms), np.full(len(forms), -1)
    for start in range(0, len(forms), ROWS):
        rows = range(start, min(start + ROWS, len(forms)))
        part = Sketch(forms[start : start + ROWS])
        may = possible(part, sketch, least)
        for i in rows:
            hits = np.flatnonzero(may[i - start, :i] & (seed[:i] == np.arange(i)))
            seed[i] = next((int(j) for j in hits if N.loose_score_of(forms[j], forms[i]) >= least), i)
    return seed.tolist()


def _decided(block: DataFrame, least: int) -> DataFrame:
    """(matter_id, form, place, seed) of blocks of forms, each matter's at most BLOCK or SMALL rows; many matters in one stream."""
    schema = pa.schema([("matter_id", pa.int64()), ("form", pa.string()), ("place", pa.int64()), ("seed", pa.string())])

    def decide(rows: list[tuple]) -> list[tuple]:
        names = [r[1] for r in rows]
        return [(*r, names[j]) for r, j in zip(rows, in_order(names, least), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matter: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*[batch[c].to_pylist() for c in schema.names[:3]], strict=True):
                if matter and matter[0][0] != row[0]:
                    out += decide(matter)
                    matter = []
                matter.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
        if matter:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*decide(matter), strict=True), schema.types, strict=True)], schema=schema)

    rows = block.select("matter_id", "form", "place").repartition("matter_id").sortWithinPartitions("matter_id", F.col("place").asc_nulls_first(), "form")
    return rows.mapInArrow(run, "matter_id long, form string, place long, seed string")


def _matched(rows: DataFrame, least: int) -> DataFrame:
    """rows (matter_id, form, place, seeds) with the first of the seeds that the form matches, else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seeds, sketch = None, [], None
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                matters, forms, out = part["matter_id"].to_pylist(), part["form"].to_pylist(), []
                at = 0
                while at < len(forms):
                    end = next((k for k in range(at, len(forms)) if matters[k] != matters[at]), len(forms))
                    if matters[at] != last:
                        last, seeds = matters[at], part["seeds"][at].as_py()
                        sketch = Sketch(seeds)
                    may = possible(Sketch(forms[at:end]), sketch, least)
                    for row, form in zip(may, forms[at:end], strict=True):
                        out.append(next((seeds[j] for j in np.flatnonzero(row) if N.loose_score_of(seeds[j], form) >= least), None))
                    at = end
                yield pa.RecordBatch.from_arrays([part["matter_id"], part["form"], part["place"], pa.array(out, pa.string())], ["matter_id", "form", "place", "seed"])

    return rows.mapInArrow(run, "matter_id long, form string, place long, seed string")


def seeds(forms: DataFrame, least: int = fixed.LOOSE_MATCH, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """(matter_id, form, seed) for different forms (matter_id, form, place) in the order of place, then form."""
    forms = forms.select(F.col("matter_id").cast("long"), "form", F.col("place").cast("long"))
    sizes = forms.groupBy("matter_id").agg(F.count("*").alias("size"))
    sized = materialize(forms.join(sizes, "matter_id"), "forms")
    done = [materialize(_decided(sized.where(F.col("size") <= small).drop("size"), least), "seeds")]
    left = materialize(sized.where(F.col("size") > small).drop("size"), "open")
    while not left.isEmpty():
        rank = F.row_number().over(Window.partitionBy("matter_id").orderBy(F.col("place").asc_nulls_first(), "form"))  # limited in each task before it is shuffled
        head = materialize(_decided(left.withColumn("rank", rank).where(F.col("rank") <= block).drop("rank"), least), "seeds")
        new = head.where("form = seed").groupBy("matter_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "form"))), lambda x: x["form"]).alias("seeds"))  # BLOCK at most
        new = F.broadcast(new) if head.select("matter_id").distinct().count() <= BROADCAST_MATTERS else new
        rest = left.join(head.select("matter_id", "form"), ["matter_id", "form"], "left_anti").join(new, "matter_id")
        met = materialize(_matched(rest, least), "met")
        done += [head, materialize(met.where("seed IS NOT NULL"), "seeds")]
        discard(left)
        left = materialize(met.where("seed IS NULL").drop("seed"), "open")
        discard(met)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("matter_id", "form", "seed")
