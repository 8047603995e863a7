"""Person names: normalisers, parts, similarity scores and the rule tiers of matching, as columns."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions import fixed


@F.pandas_udf(T.StringType())
def _decomposed(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


def fold(name: Column) -> Column:
    """NFKD of a name; only names with non-ASCII letters leave the JVM's plain path."""
    return F.when(name.rlike(r"[^\x00-\x7F]"), _decomposed(name)).otherwise(name)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strict(name: Column, compat: bool = False, folded: bool = False) -> Column:
    """Strict normal form: no titles, punctuation or single letters; null gives "".

    compat: titles also match at the start of a longer word ("Drew" gives "ew"); by default they must end there.
    folded: the name is known to be decomposed already.
    """
    out = F.lower(F.coalesce(name if folded else fold(name), F.lit("")))
    end = "" if compat else r"(?![\w])"
    for title in fixed.TITLES:
        out = F.regexp_replace(out, rf"(?U)\b{title}{end}\.?\s*", "")
    for title in fixed.WHOLE_TITLES:
        out = F.regexp_replace(out, rf"(?U)\b{title}\b", "")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}_\s]", "")
    return squeeze(F.regexp_replace(out, r"(?U)\b[a-z]\b", ""))


def loose(name: Column) -> Column:
    """Loose normal form: lower case, punctuation but hyphens dropped, leading prefixes and trailing suffixes dropped."""
    out = squeeze(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)[^\w\s\-]", ""))
    out = F.regexp_replace(out, f"^(?:(?:{'|'.join(fixed.LOOSE_PREFIXES)})(?: |$))+", "")
    return F.trim(F.regexp_replace(out, f"(?:(?:^| )(?:{'|'.join(fixed.LOOSE_SUFFIXES)}))+$", ""))


def tokens(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda t: t != "")


def parts(normal: Column) -> Column:
    """Struct first, middle, last of a normal form; one token is a first name."""
    t = tokens(normal)
    n = F.size(t)
    return F.struct(
        F.when(n > 0, t[0]).otherwise("").alias("first"),
        F.when(n > 2, F.array_join(F.slice(t, F.lit(2), n - 2), " ")).otherwise("").alias("middle"),
        F.when(n > 1, F.element_at(t, -1)).otherwise("").alias("last"),
    )


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro-Winkler with half transpositions and the prefix bonus at any score."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, left = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                left.append(x)
                break
    if not left:
        return 0.0
    right = [y for y, u in zip(b, used, strict=True) if u]
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(left, right, strict=True)) / 2) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Null counts as the empty text."""
    return pd.Series([jaro_winkler_of(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def fuzzy(a: Column, b: Column) -> Column:
    """0.6 Jaro-Winkler + 0.4 Levenshtein similarity of two normal forms."""
    return 0.6 * jaro_winkler(a, b) + 0.4 * levenshtein_similarity(a, b)


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table in the bits of one integer."""
    full = (1 << len(a)) - 1
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    row = full
    for y in b:
        met = row & masks.get(y, 0)
        row = (row + met) | (row - met)
    return len(a) - (row & full).bit_count()


def ratio_of(a: str, b: str) -> float:
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_of(a: str, b: str) -> float:
    """Best ratio of the shorter text against a window of the longer one, cut at its ends too."""
    a, b = sorted((a, b), key=len)
    if not a:
        return 0.0
    n = len(a)
    return max(ratio_of(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))


@lru_cache(100_000)
def loose_score_of(a: str | None, b: str | None) -> int:
    """0 to 100: the best of ratio, partial ratio and ratio of sorted tokens of loose normal forms; 0 if one is empty."""
    if not a or not b:
        return 0
    return round(max(ratio_of(a, b), partial_of(a, b), ratio_of(" ".join(sorted(a.split())), " ".join(sorted(b.split())))))


@F.pandas_udf(T.IntegerType())
def loose_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([loose_score_of(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def token_subset(a: Column, b: Column) -> Column:
    """0.95 when the tokens of one normal form are among the other's, two different tokens each at least; else null."""
    s, t = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    inside = (F.size(F.array_except(s, t)) == 0) | (F.size(F.array_except(t, s)) == 0)
    return F.when((F.size(s) >= 2) & (F.size(t) >= 2) & inside, F.lit(fixed.SUBSET_SCORE))


def _variants(token: Column) -> Column:
    table = F.create_map(*[x for k, v in fixed.NICKNAMES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(table[token], F.array(token))


def nicknames(a: Column, b: Column) -> Column:
    """Do the variants of two first names overlap?"""
    return F.arrays_overlap(_variants(F.lower(a)), _variants(F.lower(b)))


def lastname_priority(a: Column, b: Column) -> Column:
    """Score of two normal forms with the same last name whose other names agree, else null."""
    s, t = tokens(a), tokens(b)
    same = (F.size(s) > 1) & (F.size(t) > 1) & (F.element_at(s, -1) == F.element_at(t, -1))
    x, y = (F.array_distinct(F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0)))) for v in (s, t))
    unknown = F.array(*map(F.lit, fixed.UNKNOWN_NAMES))
    known_x, known_y = F.size(F.array_except(x, unknown)) > 0, F.size(F.array_except(y, unknown)) > 0
    wild = (F.arrays_overlap(x, unknown) & known_y) | (F.arrays_overlap(y, unknown) & known_x)
    nick = F.exists(x, lambda p: F.exists(y, lambda q: nicknames(p, q)))
    return F.when(~same, None).when(wild, F.lit(fixed.PLACEHOLDER_SCORE)).when(F.arrays_overlap(x, y) | nick, F.lit(fixed.LASTNAME_SCORE))
