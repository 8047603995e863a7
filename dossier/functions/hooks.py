"""Model calls as pluggable functions with deterministic offline defaults; replace them by columns that call a model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 256


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed(texts: pd.Series) -> pd.Series:
    """Hashing embedder of word counts, unit length; null gives null, a text without words zeros."""
    import xxhash

    def one(text: str | None):
        if text is None:
            return None
        v = np.zeros(DIM, np.float32)
        for w in text.lower().split():
            h = xxhash.xxh32_intdigest(w)
            v[h % DIM] += 1 if h >> 31 else -1
        n = np.linalg.norm(v)
        return (v / n if n else v).tolist()

    return texts.map(one)


def no_verdict(new: dict, known: dict) -> tuple[bool, float, str]:
    """Same-person verdict over name, role and observation of both, with its confidence and reason: never sure."""
    return False, 0.0, "no model"


def initials_verdict(new: dict, known: dict) -> tuple[bool, float, str]:
    """Same-person verdict of a simple kind: sure when last names and first initials are equal, surer when roles are too."""
    x, y = (v["name"].lower().split() for v in (new, known))
    same = bool(x and y) and x[-1] == y[-1] and x[0][0] == y[0][0]
    if not same:
        return False, 0.0, "other initials or last names"
    return (True, 0.9, "equal initials, last names and roles") if new["role"] == known["role"] else (True, 0.8, "equal initials and last names")


@F.pandas_udf(T.StructType([T.StructField("exclude", T.BooleanType()), T.StructField("is_fact_witness", T.BooleanType()), T.StructField("confidence", T.DoubleType()), T.StructField("reason", T.StringType())]))
def keep_attorney(names: pd.Series, observations: pd.Series) -> pd.DataFrame:
    """Attorney verdict: keep, unsure."""
    n = len(names)
    return pd.DataFrame({"exclude": [False] * n, "is_fact_witness": [False] * n, "confidence": [0.0] * n, "reason": ["no model"] * n})


def attorney_by_words(observation: Column) -> Column:
    """Attorney verdict by words, (exclude, is_fact_witness, confidence, reason): who saw or testified stays, counsel goes, else unsure."""
    low = F.lower(F.coalesce(observation, F.lit("")))
    saw, counsel = low.rlike(r"\b(saw|testified)\b"), low.rlike(r"\bcounsel\b")
    told = F.when(saw, "saw or testified").when(counsel, "counsel").otherwise("no sign")
    return F.struct((~saw & counsel).alias("exclude"), saw.alias("is_fact_witness"), F.when(saw | counsel, 0.9).otherwise(0.0).alias("confidence"), told.alias("reason"))


def people_in(text: Column) -> Column:
    """Person extraction: runs of two capitalised words, as records of the extraction format."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b(\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+)\b"), F.lit(1)))
    return F.transform(found, lambda x: F.struct(x.alias("fullName"), F.lit("mentioned").alias("role"), F.lit("relevant").alias("relevance"), F.lit(None).cast("string").alias("observation")))


def verified(people: Column, answer: Column) -> Column:
    """Verification pass: the model's list if there is one, else the input."""
    return F.coalesce(answer, people)


def claims_in(text: Column) -> Column:
    """Claim extraction: sentences that allege or deny, as (type, text)."""
    sentences = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+")
    kept = F.filter(sentences, lambda s: F.lower(s).rlike(r"\b(alleg|den)(es|ies|ed|y)?\b"))
    return F.transform(kept, lambda s: F.struct(F.when(F.lower(s).rlike(r"\balleg"), "allegation").otherwise("defense").alias("claim_type"), s.alias("claim_text")))


def query_lines(answer: Column, most: int = 5) -> Column:
    """Search queries from a model's lines: bullets and numbers off, 6 to 99 characters, the first `most`."""
    lines = F.transform(F.split(answer, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[\s\-*0-9.]+", "")))
    return F.slice(F.filter(lines, lambda x: (F.length(x) > 5) & (F.length(x) < 100)), 1, most)


def safe_query(answer: Column) -> Column:
    """Privacy-safe query: at most ten words, null where private data shows."""
    from dossier.functions.rules import has_pii

    short = F.array_join(F.slice(F.split(F.trim(answer), r"\s+"), 1, 10), " ")
    return F.when(has_pii(short) | (F.trim(answer) == ""), None).otherwise(short)


def case_analysis(case_name: Column, snippet: Column, concepts: Column) -> Column:
    """Case relevance and analysis as JSON: ten points less one for each asked concept that the snippet lacks, at least one."""
    low = F.lower(F.coalesce(snippet, F.lit("")))
    missing = F.size(F.filter(concepts, lambda c: ~F.contains(low, c)))
    score = F.greatest(F.lit(1), 10 - missing)
    return F.to_json(F.struct(score.alias("score"), F.concat(F.lit("About "), case_name).alias("reason")))
