"""Near-duplicate documents by SimHash fingerprints and pigeonring filtering.

A fingerprint is the bitwise majority of the XXH64 (seed 42) of a text's word shingles. Equal fingerprints collapse first.
For a Hamming limit of 2 the 64 bits form a ring of four segments; the pigeonring principle says that linked fingerprints
have a segment from which every chain of consecutive segments stays within its share of the differences (0, then 1, 1, 2).
So two segments are equal: either neighbours, or two opposite ones around a segment with one difference. Each pair of
equal segments is a block key, and the chain that led to the key must keep to its budgets before the full Hamming check: this
prunes most pairs that meet by chance, and those that meet under another key too. Only links leave the row. Blocks over ``block`` fingerprints (a hot group) take an exact other way: each fingerprint is sent to itself and
its 64 one-bit neighbours; fingerprints that meet are at most two bits apart, and any two at that distance meet. Such a
meeting point holds at most 65 fingerprints, so no group grows with the data.

Defined results: a null or blank text has fingerprint zero and links like any other. Rows that repeat get the same
component. A row without an id gets its fingerprint's component. Whole texts are read, whatever their length. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm import near_copies
from dossier.llm.common import WORD_BYTES, materialize, table
from dossier.operators.components import connected_components

SHINGLE, MAX_BITS, BLOCK, SEED, SEGMENTS = 3, 2, 256, 42, 4
_WORDS = re.compile(WORD_BYTES)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of one text."""
    found = _WORDS.findall((text or "").encode().lower())  # bytes.lower touches A-Z only
    if not found:
        return 0
    joined, k = b" ".join(found), min(shingle, len(found))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(found) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        ones += np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return of(text)


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))


#: The pairs of segments that make block keys.
PAIRS = [(i, j) for i in range(SEGMENTS) for j in range(i + 1, SEGMENTS)]


def _chain(pair: Column, a: Column, b: Column) -> Column:
    """Does the chain that led to a block key keep to its budgets (0, 1, 1, 2)? pair: the number of the equal segments.

    Equal neighbours are the head of a chain whose third segment may hold one difference. Equal opposite segments count only
    with one difference in each of the others: with none, three segments are equal and neighbours make the key.
    """
    x = a.bitwiseXOR(b)
    d = [F.bit_count(_segment(x, i)) for i in range(SEGMENTS)]
    out = F.lit(False)
    for n, (i, j) in enumerate(PAIRS):
        if j - i == 2:
            kept = (d[(i + 1) % SEGMENTS] == 1) & (d[(j + 1) % SEGMENTS] == 1)
        else:
            first = i if j - i == 1 else j  # the ring closes: the last segment stands before the first
            kept = d[(first + 2) % SEGMENTS] <= 1
        out = F.when(pair == n, kept).otherwise(out)
    return out


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS


def links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (u, v) between the ids of distinct fingerprints (fp, id) at most two bits apart, or links with the same components."""
    keys = F.array(*[F.shiftleft(F.lit(n).cast("long"), 32).bitwiseOR(F.shiftleft(_segment(F.col("fp"), i), 16)).bitwiseOR(_segment(F.col("fp"), j)) for n, (i, j) in enumerate(PAIRS)])
    keyed = nodes.select("fp", "id", F.explode(keys).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocked = materialize(keyed.join(sizes, "key"), "blocks")
    fp = F.struct("fp", "id")
    lists = blocked.where(F.col("n") <= block).groupBy("key").agg(F.collect_list(fp).alias("of"))  # at most `block` each
    pair = F.shiftright("key", 32)
    found = F.flatten(F.transform("of", lambda a: F.transform(F.filter("of", lambda b: (b["id"] < a["id"]) & _chain(pair, a["fp"], b["fp"]) & _near(a["fp"], b["fp"])), lambda b: F.struct(a["id"].alias("u"), b["id"].alias("v")))))
    near = lists.select(F.inline(found)).distinct()
    large = blocked.where(F.col("n") > block).select("fp", "id").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)])
    met = large.select("id", F.explode(flips).alias("hub")).groupBy("hub").agg(F.min("id").alias("v"), F.collect_list("id").alias("ids")).where(F.size("ids") > 1)
    return near.unionByName(met.select(F.explode("ids").alias("u"), "v").where("u <> v")).distinct()


def cluster(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(id_col, fp, component_id): component_id is the least id that links reach."""
    each = materialize(docs.select(F.col(id_col).alias("id"), fingerprints(F.col(text_col), shingle).alias("fp")), "fingerprints")
    nodes = materialize(each.groupBy("fp").agg(F.min("id").alias("id")), "distinct")
    found = connected_components(links(nodes.where("id is not null"), block)).withColumnRenamed("node", "id")
    classes = nodes.join(found, "id", "left").select(F.col("fp").alias("class_fp"), F.coalesce("component", "id").alias("component_id"))
    return each.join(classes, F.col("fp") == F.col("class_fp"), "left").select(F.col("id").alias(id_col), "fp", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = cluster(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near copies (five-word shingles, Jaccard similarity of 0.8 or more): candidates from fingerprints at most two
    bits apart and from rare common shingles, confirmed on whole shingle sets; see near_copies for why."""
    return near_copies.dedupe(docs, id_col, text_col, first=links)
