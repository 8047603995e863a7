"""Rules over texts: work product, attorneys, staff, criminal cases, private data, courts and case characteristics."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions import fixed


def any_of(words) -> str:
    return "|".join(re.escape(w) for w in words)


def work_product(filename: Column, text: Column) -> Column:
    """Does a file name hold one of the phrases, or the first 2,048 characters one of the headers? Null counts as empty."""
    name = F.lower(F.coalesce(filename, F.lit("")))
    head = F.upper(F.substring(F.coalesce(text, F.lit("")), 1, 2048))
    return name.rlike(any_of(fixed.WORK_PRODUCT_NAMES)) | head.rlike(any_of(fixed.WORK_PRODUCT_HEADERS))


def attorney_rule(role: Column, observation: Column) -> Column:
    """Struct exclude, reason: attorneys of record go; fact-witness patterns win over representation patterns."""
    role, seen = F.lower(F.coalesce(role, F.lit(""))), F.lower(F.coalesce(observation, F.lit("")))
    attorney = role.rlike(any_of(fixed.ATTORNEY_ROLES))
    fact = F.lit(False)
    for p in fixed.FACT_WITNESS:
        fact = fact | seen.rlike(f"(?U){p}")
    reason = F.coalesce(*[F.when(seen.rlike(f"(?U){p}"), F.lit(p)) for p in fixed.REPRESENTATION])
    exclude = attorney & ~fact & reason.isNotNull()
    return F.struct(exclude.alias("exclude"), F.when(exclude, reason).alias("reason"))


def attorney_phrase(role: Column, observation: Column) -> Column:
    """The plain form: the role is attorney and a phrase occurs."""
    return (F.coalesce(role, F.lit("")) == "attorney") & F.lower(F.coalesce(observation, F.lit(""))).rlike(any_of(fixed.ATTORNEY_PHRASES))


def own_staff(email: Column, domain: Column) -> Column:
    """Is the part of the address after its last @ the firm's domain? Null is no."""
    mine = F.element_at(F.split(F.trim(F.lower(email)), "@"), -1)
    return F.coalesce(F.contains(email, F.lit("@")) & (mine == F.trim(F.lower(domain))), F.lit(False))


def hits(text: Column, words) -> Column:
    """How many of the words occur in a lower-cased text."""
    out = F.lit(0)
    for w in words:
        out = out + F.contains(text, F.lit(w)).cast("int")
    return out


def criminal(case_name: Column, snippet: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(case_name, F.lit("")), F.coalesce(snippet, F.lit(""))))
    starts = F.lit(False)
    for w in fixed.CRIMINAL_STARTS:
        starts = starts | F.startswith(text, F.lit(w))
    return starts | (hits(text, fixed.CRIMINAL_WORDS) >= 2)


def has_pii(text: Column) -> Column:
    """Does a pattern of private data occur, in any case? Null is no."""
    out = F.lit(False)
    for p in fixed.PII:
        out = out | F.coalesce(text, F.lit("")).rlike(f"(?i){p}")
    return out


def first_of(text: Column, table: dict[str, tuple]) -> Column:
    """The first key one of whose words occurs in a lower-cased text, else null."""
    return F.coalesce(*[F.when(text.rlike(any_of(words)), F.lit(key)) for key, words in table.items()])


def theories(text: Column) -> Column:
    """All legal theories of a text, in order."""
    found = F.array(*[F.when(F.lower(text).rlike(any_of(w)), F.lit(k)) for k, w in fixed.THEORIES.items()])
    return F.filter(found, lambda x: x.isNotNull())


def concept_queries(text: Column, most: int = 5) -> Column:
    """Search terms of the concepts named in a text, in order, at most `most`."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.array(*[F.when(low.rlike(any_of(c)), F.lit(c[0])) for c in fixed.CONCEPTS])
    return F.slice(F.filter(found, lambda x: x.isNotNull()), 1, most)


def jurisdiction(case_number: Column) -> Column:
    """Struct state, court_type from the first mark that a case number holds; else the default state court."""
    number = F.upper(F.coalesce(case_number, F.lit("")))

    def one(state: str | None, kind: str) -> Column:
        return F.struct(F.lit(state).cast("string").alias("state"), F.lit(kind).alias("court_type"))

    return F.coalesce(*[F.when(F.contains(number, F.lit(mark)), one(state, kind)) for mark, state, kind in fixed.JURISDICTIONS], one("cal", "state"))


def court_filter(court: Column) -> Column:
    """Filter text of a jurisdiction struct."""
    return F.when(court["court_type"] == "federal", F.when(court["state"] == "cal", "ca9 cacd cand casd caed").otherwise("scotus ca9")).when(court["state"] == "cal", "cal calctapp")


def defendant_name(case_name: Column) -> Column:
    """The text after "v." up to a dash or the end, else after the word defendant; null if neither occurs."""
    after = F.trim(F.regexp_extract(case_name, r"(?i)\bvs?\.\s*([^-]+)", 1))
    other = F.trim(F.regexp_extract(case_name, r"(?i)defendant\s+([^-]+)", 1))
    return F.coalesce(F.when(after != "", after), F.when(other != "", other))
