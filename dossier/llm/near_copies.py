"""Near copies: all pairs of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

A Hamming limit alone cannot find them: at a similarity of 0.8 ten of 64 fingerprint bits differ on average, and no segment
index prunes at the twelve bits or more that would be needed. So the pairs of SimHash (see simhash: at most two differing bits, by
pigeonring filtering) are only the first candidates. Prefix filtering makes the others and loses none: under
any one order of all shingles, two sets of that similarity share a shingle among the first n - ceil(0.8 n) + 1 of each. The
order here has the shingles whose hash is a multiple of ``PART`` first, rare ones before frequent ones by their exact number
of documents, then all others by hash. A passage that many documents share so comes last, and only texts that are copies in
large part meet. An odd sketch prunes them before whole sets are compared, and loses none either: it has the parity of the
number of shingles in each of 256 parts of the hash space, two sets differ in at least as many shingles as their sketches in bits, and
similar ones in at most a ninth of their sizes' sum. Where texts share much, one of ``WIDE`` parts follows.

Equal sets collapse first. Documents with a common prefix shingle form a group, cut into cells of about ``CELL`` members. A
group of up to ``SMALL`` gives all pairs that fit. A larger one first gives each member its ``NEXT`` successors in hash order;
members that are then outside the cell's largest component meet some of its members; at last the pairs that still lie in
different components follow, in blocks. Texts that share many shingles meet in many groups; of these the least gives their pair, the
others do not. So a large group of copies costs a few pairs a document and loses no link.

Defined results: texts are lower-cased in A-Z; one of fewer than five words has one shingle; blank texts are copies of
each other. Rows without an id stay. An id with several texts stands for all of them. Of linked documents the least id stays.
Rows that repeat stay or go together; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import materialize, mix64, shingle_hashes
from dossier.operators.components import connected_components

SHINGLE, PART = 5, 4
SMALL, NEXT, FAR, CELL = 6, 2, 8, 4096
#: Parts of the hash space in the short and in the long odd sketch.
ODD, WIDE = 256, 2048
#: Tables of two numbers a row are broadcast up to so many rows (8 MB), else shuffled.
BROADCAST_ROWS = 500_000
_PAIRS = "u long, v long"
_CUT = "key binary, part long, n long, fp long, odd binary, k int, counted array<long>, rest array<long>"


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted different hashes of a text's word shingles."""
    h = np.sort(shingle_hashes(text or b"", shingle))
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def fingerprint(found: np.ndarray) -> int:
    """Signed 64-bit majority of hashes; ties give 0."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(found), 65_536):
        ones += np.unpackbits(found[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(found), bitorder="little").view(np.int64)[0])


def odd_sketch(found: np.ndarray, parts: int = ODD) -> bytes:
    """A bit for each part of the hash space: is the number of different hashes there odd?"""
    return np.packbits(np.bincount((found >> np.uint64(40)).astype(np.int64) % parts, minlength=parts) % 2 == 1).tobytes()


def prefix_size(n: int) -> int:
    return n + 4 * n // -5 + 1


def _cut(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        s = shingles(text)
        mine = s % np.uint64(PART) == 0
        counted, others = s[mine].view(np.int64), s[~mine].view(np.int64)
        missing = max(0, prefix_size(len(s)) - len(counted))
        key = xxhash.xxh128_digest(s.tobytes())
        rows.append((key, int.from_bytes(key[:8], "big", signed=True), len(s), fingerprint(s), odd_sketch(s), len(counted), counted, others[:missing]))
    return pd.DataFrame(rows, columns=["key", "part", "n", "fp", "odd", "k", "counted", "rest"])


def _whole(texts: pd.Series) -> pd.DataFrame:
    found = [shingles(x) for x in texts]
    return pd.DataFrame({"set": [s.view(np.int64) for s in found], "wide": [odd_sketch(s, WIDE) for s in found]})


def _few(df: DataFrame) -> DataFrame:
    """A materialised table, to be broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of ids whose shingle sets are similar; an id with several texts counts with each."""
    a, b = (sets.select(F.col("id").alias(k), F.col("set").alias(f"set_{k}")) for k in "uv")
    both = F.size(F.array_intersect("set_u", "set_v"))
    return a.join(_few(pairs), "u").join(b, "v").where(5 * both >= 4 * (F.size("set_u") + F.size("set_v") - both)).select("u", "v").distinct()


def _fitting(n: np.ndarray, odd: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """May these members be similar, by their sizes (0: unknown) and odd sketches? Never false of similar ones."""
    low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    differ = np.bitwise_count(odd[i] ^ odd[j]).sum(1, dtype=np.int64)
    return (low == 0) | ((5 * low >= 4 * high) & (9 * differ <= low + high))


def _met(way: str, ids: np.ndarray, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of a cell's members, each way as said above."""
    m = len(ids)
    if way == "all" or m <= SMALL:
        for i in range(0, m, 256):
            x, y = np.nonzero(c[i : i + 256, None] != c[None, :])
            yield x[y > x + i] + i, y[y > x + i]
        return
    order = np.argsort(mix64(ids.astype(np.uint64)), kind="stable")
    if way == "ring":
        yield np.tile(order, NEXT), np.concatenate([np.roll(order, -k) for k in range(1, NEXT + 1)])
        return
    labels, counts = np.unique(c, return_counts=True)
    main = c[order] == labels[counts.argmax()]
    inside, outside = order[main], np.flatnonzero(~main)
    at = np.cumsum(main)[outside]  # the members of the largest component that follow in hash order
    yield np.repeat(order[outside], FAR), inside[(at[:, None] + np.arange(FAR)[None, :]) % len(inside)].ravel()


def _candidates(way: str):
    """Pairs of the members of cells (of: id, n, odd, c; but for "ring" also wide, and for "all" part and before; own: both of its parts are one)."""

    def pairs(of: list, own: bool) -> Iterator[np.ndarray]:
        ids, n, c = (np.array([r[k] for r in of], np.int64) for k in ("id", "n", "c"))
        odd = np.frombuffer(b"".join(r["odd"] for r in of), np.uint64).reshape(len(of), -1)
        wide = None if way == "ring" else np.frombuffer(b"".join(r["wide"] for r in of), np.uint64).reshape(len(of), -1)
        part = np.array([r["part"] for r in of], np.int64) if way == "all" else None
        before = {}  # place: the groups before this one that a member is in
        for i, j in _met(way, ids, c):
            ok = (c[i] != c[j]) & _fitting(n, odd, i, j)
            if part is not None:
                ok &= own | (part[i] != part[j])
            i, j = i[ok], j[ok]
            if wide is not None:
                ok = _fitting(n, wide, i, j)
                i, j = i[ok], j[ok]
            if part is not None:
                for k in np.union1d(i, j).tolist():
                    if k not in before:
                        before[k] = frozenset(of[k]["before"].tolist())
                ok = np.array([before[x].isdisjoint(before[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
                i, j = i[ok], j[ok]
            yield np.column_stack([np.maximum(ids[i], ids[j]), np.minimum(ids[i], ids[j])])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def packed() -> pd.DataFrame:
            both = np.unique(np.concatenate(found), axis=0)
            return pd.DataFrame({"u": both[:, 0], "v": both[:, 1]})

        found, size = [], 0
        for pdf in frames:
            for of, own in zip(pdf["of"], pdf["own"], strict=True):
                for both in pairs(of, own):
                    found.append(both)
                    size += len(both)
                    if size >= 500_000:
                        yield packed()
                        found, size = [], 0
        if size:
            yield packed()

    return run


def _groups(each: DataFrame) -> DataFrame:
    """(s, id, n, odd, size): the members of each group of documents that share a prefix shingle."""
    counted = each.select("id", F.explode("counted").alias("s"))
    several = counted.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    shared = counted.join(several, "s").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("of"))  # at most the shingles of a text
    p = F.col("n") - F.ceil(F.col("n") * 4 / 5) + 1
    one = F.count("*") == 1
    info = each.groupBy("id").agg(F.when(one, F.max("n")).otherwise(0).alias("n"), F.first("odd").alias("odd"), F.when(one, F.max(p - F.col("k"))).alias("more"))
    # Shingles of one document come first in its order; ids with several texts give all that they share.
    need = F.coalesce(F.greatest(F.col("more") + F.size("of"), F.lit(0)), F.size("of")).cast("int")
    first = shared.join(info, "id").select("id", "n", "odd", F.explode(F.slice("of", F.lit(1), need)).alias("x")).select(F.col("x.s").alias("s"), "id", "n", "odd")
    rest = each.select("id", F.explode("rest").alias("s")).join(info, "id").select("s", "id", "n", "odd")
    entries = first.unionByName(rest).distinct()
    sizes = entries.groupBy("s").agg(F.count("*").alias("size")).where("size > 1")
    return materialize(entries.join(sizes, "s"), "groups")


def _open(left: DataFrame, wide: DataFrame) -> DataFrame:
    """Members of groups (s, id, n, odd, size, c) with their long sketches and, in order, the groups before this one that they are in."""
    of = left.groupBy("id", "n", "odd", "c").agg(F.array_sort(F.collect_list(F.struct("s", "size"))).alias("of"))  # at most the shingles of a text
    each = of.join(wide, "id").select("id", "n", "odd", "c", "wide", F.col("of.s").alias("all"), F.posexplode("of").alias("at", "x"))
    return each.select("id", "n", "odd", "c", "wide", "x.s", "x.size", F.slice("all", F.lit(1), F.col("at")).alias("before"))


def _cells(groups: DataFrame, whole: bool, cell: int = CELL) -> DataFrame:
    """(of, own): lists of members of one group, two times `cell` at most; whole: any two members meet, else most are connected. own: of one part alone."""
    parts = F.ceil(F.col("size") / cell)
    part = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), parts)
    if whole:
        other = groups.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).withColumn("p", part(0))
        keyed = other.withColumns({"a": F.least("p", "o"), "b": F.greatest("p", "o")}).withColumnRenamed("p", "part")
    else:
        turned = groups.withColumn("a", F.explode(F.sequence(F.lit(0), F.when(parts > 1, 1).otherwise(0))))
        keyed = turned.withColumn("b", F.when(F.col("a") == 0, part(0)).otherwise(part(1)))
    member = F.struct(*[k for k in ("id", "n", "odd", "c", "wide", "part", "before") if k in keyed.columns])
    own = (F.col("a") == F.col("b")).alias("own")
    return keyed.groupBy("s", "a", "b").agg(F.collect_list(member).alias("of")).where(F.size("of") > 1).select("of", own)


def links(docs: DataFrame, id_col: str, text_col: str, cell: int = CELL, first: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Links (u, v) between ids of docs whose components are those of all near copies. first: more candidates (u, v) from fingerprints (fp, id)."""
    given = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    each = materialize(given.withColumn("c", F.pandas_udf(_cut, _CUT)(F.col("text"))).select("id", "c.*"), "shingles")
    nodes = materialize(each.groupBy("key").agg(F.min("id").alias("id")), "distinct")
    copies = each.select("key", "part", "id").join(nodes.withColumnRenamed("id", "v"), "key").where("id <> v")
    copies = materialize(copies.select(F.col("id").alias("u"), "v", "part").distinct(), "equal")
    equal = copies.select("u", "v").distinct()
    groups = _groups(each.join(_few(copies).select(F.col("u").alias("id"), "part"), ["id", "part"], "left_anti"))
    met = materialize(groups.select("id").distinct(), "met")
    whole = F.pandas_udf(_whole, "set array<long>, wide binary")(F.col("text"))
    given = materialize(given.join(_few(met), "id", "left_semi").withColumn("c", whole).select("id", "c.*"), "sets")
    wide = given.groupBy("id").agg(F.first("wide").alias("wide"))  # an id with several texts fits any
    pairs = _cells(groups.withColumn("c", F.col("id")), False, cell).mapInPandas(_candidates("ring"), _PAIRS)
    if first is not None:
        prints = each.groupBy("fp").agg(F.min("id").alias("id"))
        same = each.select("id", "fp").join(prints.withColumnRenamed("id", "v"), "fp").where("id <> v").select(F.col("id").alias("u"), "v")
        pairs = pairs.unionByName(same).unionByName(first(prints))
    near = materialize(_confirmed(materialize(pairs.distinct(), "candidates"), given), "near")
    large = groups.where(F.col("size") > SMALL)
    for way in ("far", "all"):
        found = connected_components(near).withColumnRenamed("node", "id")
        labelled = large.join(found, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
        split = labelled.groupBy("s").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("s")
        left = materialize(labelled.join(split, "s", "left_semi"), "open")
        if left.isEmpty():
            break
        members = _open(left, wide)
        pairs = _cells(members if way == "all" else members.drop("before"), way == "all", cell).mapInPandas(_candidates(way), _PAIRS)
        pairs = materialize(pairs.distinct(), "candidates")  # of different components, so none is in near
        near = materialize(near.unionByName(_confirmed(pairs, given)), "near")
    return equal.unionByName(near)


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL, first: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """docs without the rows whose id is not the least of its component; rows without an id stay."""
    found = connected_components(links(docs, id_col, text_col, cell, first))
    gone = materialize(found.where("node <> component").select(F.col("node").alias(id_col)).distinct(), "copies")
    return docs.join(gone, id_col, "left_anti")
