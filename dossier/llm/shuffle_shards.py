"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows get gapless numbers without a global sort: a hash bucket of the id and the first order column (a number that tells texts
apart, so rows without an id or of one id spread over all buckets; about ``BUCKET_ROWS`` rows each, ``BUCKETS`` of
them at least), the bucket's offset, and the row's rank in its bucket. Only the offsets, one row a bucket, meet in one task. A Feistel network over the smallest grid a x b >= N permutes the
numbers; a result outside [0, N) walks on until it falls inside. The place p that a row gets gives shard p mod n and slot
p div n, so shard sizes differ by one row at most (law ``rows``) and slots are gapless from 0. The round function is
cubing modulo a prime, so any engine with 64-bit integers computes the same shuffle.

Only DataFrame functions run. Defined results: rows that repeat in id and text are numbered one after another; rows without
an id count as id 0 in the choice of a bucket and come first in it; a null text counts as empty, and of texts of any length only
size and checksum are used; an empty table gives an empty result; existing columns named shard or slot are replaced, others are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import table

PRIME, BUCKETS, BUCKET_ROWS, ROUNDS, SHARDS, SEED = 2_147_483_647, 1024, 65_536, 4, 8, 20_240_229


def keys(seed: int, n: int = ROUNDS) -> list[tuple[int, int]]:
    """Two constants for each round, from a linear congruence."""
    out = []
    for _ in range(n):
        first = seed = (seed * 48_271 + 11) % PRIME
        seed = (seed * 48_271 + 11) % PRIME
        out.append((first, seed))
    return out


def mix(value: Column, key: tuple[int, int]) -> Column:
    """((v + k1)**3 + k2) modulo the prime, for any 64-bit integer; null counts as 0."""
    t = F.pmod(F.pmod(F.coalesce(value.cast("long"), F.lit(0)), F.lit(PRIME)) + key[0], F.lit(PRIME))
    return (t * t % PRIME * t + key[1]) % PRIME


def dealing(id_: Column, salt: Column) -> Column:
    """A number for mix() from an id and a number below 2**40."""
    return F.pmod(F.coalesce(id_.cast("long"), F.lit(0)), F.lit(PRIME)) + salt * F.lit(1 << 20)


def _feistel(df: DataFrame, x: str, a: int, b: int, seed: int, only: Column) -> DataFrame:
    """df with x permuted on [0, a * b) where `only` holds."""
    df = df.withColumns({"__l": F.expr(f"{x} div {b}"), "__r": F.col(x) % b})
    for i, key in enumerate(keys(seed)):
        left = i % 2 == 0
        to, by, n = ("__l", "__r", a) if left else ("__r", "__l", b)
        df = df.withColumn(to, (F.col(to) + mix(F.col(by), key)) % n)
    return df.withColumn(x, F.when(only, F.col("__l") * b + F.col("__r")).otherwise(F.col(x))).drop("__l", "__r")


def _image(x: int, a: int, b: int, seed: int) -> int:
    left, right = divmod(x, b)
    for i, (k, c) in enumerate(keys(seed)):
        t = ((right if i % 2 == 0 else left) % PRIME + k) % PRIME
        t = (t * t % PRIME * t + c) % PRIME
        left, right = ((left + t) % a, right) if i % 2 == 0 else (left, (right + t) % b)
    return left * b + right


def longest_walk(n: int, a: int, b: int, seed: int) -> int:
    """Passes after which every number below n is below n again: one more than the longest way back from outside.

    Fewer than a (about the root of n) numbers lie outside; some may form cycles that no number below n ever meets.
    """
    image = {z: _image(z, a, b, seed) for z in range(n, a * b)}
    met = {y for y in image.values() if y >= n}
    longest = 1
    for z in image:
        steps, at = 1, z
        if z in met:  # not the start of a way: a longer one leads over it, or it lies in a cycle
            continue
        while at >= n:
            at, steps = image[at], steps + 1
        longest = max(longest, steps)
    return longest


def permute(df: DataFrame, number: str, n: int, seed: int = SEED) -> DataFrame:
    """df whose column `number`, 0 to n - 1, is replaced by its place in the shuffle."""
    if n < 2:
        return df
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    walks = longest_walk(n, a, b, seed)
    df = _feistel(df, number, a, b, seed, F.lit(True))
    for _ in range(walks - 1):
        df = _feistel(df, number, a, b, seed, F.col(number) >= n)
    return df


def numbered(df: DataFrame, id_col: str, order: list[str], number: str, seed: int = SEED) -> tuple[DataFrame, int]:
    """df with gapless row numbers from 0 in a column, and their count. Order inside a bucket: the id, then `order`, whose first column is a number below 2**40."""
    total = df.count()
    bucket = (mix(dealing(F.col(id_col), F.coalesce(F.col(order[0]), F.lit(0)) if order else F.lit(0)), keys(seed + 1, 1)[0]) % max(BUCKETS, total // BUCKET_ROWS)).cast("int")
    counts = df.select(bucket.alias("__bucket")).groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))  # a row for each bucket
    offsets = counts.select("__bucket", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy(F.col(id_col).asc_nulls_first(), *order))
    out = df.withColumn("__bucket", bucket).withColumn(number, inside.cast("long"))
    # A row for each BUCKET_ROWS rows: 12 bytes each, broadcast up to a million of them.
    out = out.join(F.broadcast(offsets) if total < BUCKET_ROWS * 1_000_000 else offsets, "__bucket").withColumn(number, F.col(number) + F.col("__before") - 1)
    return out.drop("__bucket", "__before"), total


def assign(df: DataFrame, id_col: str, shards: int = SHARDS, seed: int = SEED, order: list[str] | None = None) -> DataFrame:
    """df with columns shard (0 to shards - 1) and slot (place in the shard)."""
    df = df.drop("shard", "slot")
    found, n = numbered(df, id_col, order or [], "__place", seed)
    found = permute(found, "__place", n, seed)
    return found.withColumns({"shard": (F.col("__place") % shards).cast("int"), "slot": F.expr(f"__place div {shards}")}).drop("__place")


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    found = assign(docs, "doc_id", order=["text_crc32", "size"])
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _sql_mix(value: str, key: tuple[int, int]) -> str:
    t = f"((((coalesce({value}, 0) % {PRIME}) + {PRIME}) % {PRIME} + {key[0]}) % {PRIME})"
    return f"(({t} * {t} % {PRIME} * {t} + {key[1]}) % {PRIME})"


def _sql_dealing(id_: str, salt: str) -> str:
    return f"(((coalesce({id_}, 0) % {PRIME}) + {PRIME}) % {PRIME} + {salt} * {1 << 20})"


def _sql_feistel(x: str) -> str:
    """One pass over the grid of table `grid` (a, b)."""
    left, right = f"(({x}) // b)", f"(({x}) % b)"
    sql = f"SELECT *, {left} AS l0, {right} AS r0 FROM walked"
    for i, key in enumerate(keys(SEED)):
        step = f"(l{i} + {_sql_mix(f'r{i}', key)}) % a AS l{i + 1}, r{i} AS r{i + 1}" if i % 2 == 0 else f"l{i} AS l{i + 1}, (r{i} + {_sql_mix(f'l{i}', key)}) % b AS r{i + 1}"
        sql = f"SELECT *, {step} FROM ({sql})"
    return sql


#: CRC-32 of a text from its bytes in hexadecimal; the table follows from the reversed polynomial.
_CRC = """(SELECT list(r ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r FROM range(256) AS x(i)))"""

ORACLE_SQL = f"""
WITH RECURSIVE crc AS {_CRC},
docs AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, crc),
sized AS (SELECT count(*)::BIGINT AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM docs),
grid AS (SELECT n, a, (n + a - 1) // a AS b FROM sized),
walked AS (
  SELECT doc_id, size, text_crc32, n, a, b, 0 AS step,
    row_number() OVER (ORDER BY {_sql_mix(_sql_dealing('doc_id', 'text_crc32'), keys(SEED + 1, 1)[0])} % greatest({BUCKETS}, n // {BUCKET_ROWS}), doc_id NULLS FIRST, text_crc32, size) - 1 AS p FROM docs, grid
  UNION ALL
  SELECT doc_id, size, text_crc32, n, a, b, step + 1, l{ROUNDS} * b + r{ROUNDS} FROM ({_sql_feistel('p')}) WHERE step = 0 OR p >= n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % {SHARDS})::INTEGER AS shard, p // {SHARDS} AS slot, NULL::INTEGER AS grown_shard
FROM walked WHERE step > 0 AND p < n
"""
