"""Texts: hashes, file types, chunks, markup, references and repair of model answers, as columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import fixed


def sha256(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def file_type(name: Column, content: Column) -> Column:
    """Type by leading bytes, then by extension; office containers by extension within their family."""
    head, low = F.hex(F.substring(content, 1, 8)), F.lower(F.coalesce(name, F.lit("")))
    extension = F.regexp_extract(low, r"\.([a-z0-9]+)$", 1)

    def begins(mark: str) -> Column:
        return F.startswith(head, F.lit(mark))

    opening = F.lower(F.trim(F.decode(F.substring(content, 1, 64), "ISO-8859-1")))
    html = F.startswith(opening, F.lit("<!doctype html")) | F.startswith(opening, F.lit("<html"))
    known = ("pdf", "msg", "eml", "docx", "doc", "xlsx", "xls", "pptx", "ppt", "csv", "txt", "rtf", "html", "png", "jpg", "tiff")
    by_name = F.when(extension.isin("jpeg"), "jpg").when(extension.isin("tif"), "tiff").when(extension.isin("htm"), "html").when(extension.isin(*known), extension).otherwise("unknown")
    return (
        F.when(begins("25504446"), "pdf")
        .when(begins("D0CF11E0A1B11AE1"), F.when(extension.isin("doc", "xls", "ppt"), extension).otherwise("msg"))
        .when(begins("504B0304"), F.when(F.startswith(extension, F.lit("xls")), "xlsx").when(F.startswith(extension, F.lit("ppt")), "pptx").otherwise("docx"))
        .when(begins("89504E47"), "png")
        .when(begins("FFD8FF"), "jpg")
        .when(begins("49492A00") | begins("4D4D002A"), "tiff")
        .when(begins("7B5C727466"), "rtf")
        .when(html, "html")
        .otherwise(by_name)
    )


def fixed_chunks(text: Column, size: int = 25_000) -> Column:
    """Array of pieces of `size` characters; an empty or null text has none."""
    n = F.length(text)
    starts = F.sequence(F.lit(1), n, F.lit(size))
    return F.when(n > 0, F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def sentence_chunks_of(text: str, size: int = 1_000, overlap: int = 200) -> list[str]:
    """Chunks that end after a sentence where one ends in their second half, each repeating the last `overlap` characters."""
    out, start = [], 0
    while text and start < len(text):
        end = start + size
        if end < len(text):
            ends = ((text.rfind(mark, start, end), len(mark)) for mark in (". ", ".\n", "? ", "?\n", "! ", "!\n"))
            end = next((at + n for at, n in ends if at > start + size // 2), end)
        if piece := text[start:end].strip():
            out.append(piece)
        start = end - overlap
    return out


def sentence_chunks(docs: DataFrame, keep: list[str], text_col: str, size: int = 1_000, overlap: int = 200) -> DataFrame:
    """(keep.., chunk_index, chunk_text): sequential inside a text, so a map over Arrow batches."""
    names = [*keep, "chunk_index", "chunk_text"]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(*r[:-1], i, piece) for r in pdf.itertuples(index=False, name=None) for i, piece in enumerate(sentence_chunks_of(r[-1] or "", size, overlap))]
            yield pd.DataFrame(rows, columns=names)

    kept = docs.select(*keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["chunk_index int", "chunk_text string"])
    return docs.select(*keep, text_col).mapInPandas(cut, schema)


def strip_tags(html: Column, most: int = 500) -> Column:
    """Tags dropped but <mark>; cut."""
    return F.substring(F.regexp_replace(html, r"<(?!/?mark>)[^>]+>", ""), 1, most)


def opinion_text(plain: Column, html: Column, most: int = 3_000) -> Column:
    """The plain text, else the markup with tags as blanks, squeezed; cut."""
    other = F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))
    return F.substring(F.coalesce(F.when(plain != "", plain), other, F.lit("")), 1, most)


def safe_filename(name: Column, most: int = 80) -> Column:
    return F.substring(F.trim(F.regexp_replace(name, r"(?U)[^\p{Alnum} \-_.,]", "")), 1, most)


def case_identifier(name: Column, number: Column) -> Column:
    """"name (number)", or the one that is there, or "Unknown case"."""
    a, b = F.when(F.trim(name) != "", F.trim(name)), F.when(F.trim(number) != "", F.trim(number))
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(a, F.lit(" ("), b, F.lit(")"))).otherwise(F.coalesce(a, b, F.lit("Unknown case")))


def claim_ref(ref: Column) -> Column:
    """Struct claim_type, claim_number of "A1" or "d12"; null if it is neither."""
    letter = F.upper(F.substring(F.trim(ref), 1, 1))
    number = F.expr("1") * F.try_to_number(F.regexp_extract(F.trim(ref), r"^.(\d{1,9})$", 1), F.lit("999999999"))
    kind = F.when(letter == "A", "allegation").when(letter == "D", "defense")
    return F.when(kind.isNotNull() & number.isNotNull(), F.struct(kind.alias("claim_type"), number.cast("int").alias("claim_number")))


def claim_label(claim_type: Column, number: Column) -> Column:
    return F.concat(F.upper(F.substring(claim_type, 1, 1)), number.cast("string"))


def role_of(text: Column) -> Column:
    """Role by name, blanks as underscores, any case; unknown is other."""
    name = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s", "_")
    return F.when(name.isin(*fixed.ROLES), name).otherwise("other")


def importance_of(text: Column, unknown: str = "medium") -> Column:
    name = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(name.isin(*fixed.IMPORTANCE), name).otherwise(unknown)


def importance_from_relevance(relevance: Column) -> Column:
    out = F.lit("medium")
    for name, importance in fixed.IMPORTANCE_OF.items():
        out = F.when(F.lower(relevance) == name, F.lit(importance)).otherwise(out)
    return out


def relevance_rank(relevance: Column) -> Column:
    """0 not, 1 somewhat, 2 relevant, 3 highly; unknown and null -1."""
    out = F.lit(-1)
    for i, name in enumerate(fixed.RELEVANCE):
        out = F.when(F.lower(relevance) == name, F.lit(i)).otherwise(out)
    return out


def role_rank(role: Column) -> Column:
    out = F.lit(len(fixed.ROLES))
    for i, name in enumerate(fixed.ROLES):
        out = F.when(F.lower(role) == name, F.lit(i)).otherwise(out)
    return out


def time_left(processed: Column, total: Column, elapsed_s: Column) -> Column:
    """"~2h 5m", "~7 min" or "< 1 min" from the pace so far; null before the first document."""
    left = elapsed_s / processed * (total - processed)
    minutes = F.round(left / 60).cast("long")
    return F.when(processed > 0, F.when(minutes >= 60, F.format_string("~%dh %dm", F.floor(minutes / 60), minutes % 60)).when(minutes >= 1, F.format_string("~%d min", minutes)).otherwise("< 1 min"))


def repaired_json(answer: Column) -> Column:
    """A JSON object from a model's answer as text: as it is, without code fence, the outermost braces, repaired commas and
    braces, or the complete inner objects as {"witnesses": [..]}; null if nothing parses."""
    bare = F.trim(F.regexp_replace(answer, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    outer = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    mended = F.regexp_replace(F.regexp_replace(outer, r",\s*([}\]])", "$1"), r"\}\s*\{", "},{")
    inner = F.filter(F.regexp_extract_all(bare, F.lit(r"\{[^{}]*\}"), F.lit(0)), lambda x: F.try_parse_json(x).isNotNull())
    salvaged = F.when(F.size(inner) > 0, F.concat(F.lit('{"witnesses": ['), F.array_join(inner, ","), F.lit("]}")))
    tries = [F.when(F.try_parse_json(x).isNotNull() & F.startswith(F.trim(x), F.lit("{")), x) for x in (answer, bare, outer, mended)]
    return F.coalesce(*tries, salvaged)


def cosine(a: Column, b: Column) -> Column:
    """Over the common length; 0 where a norm is 0."""
    zipped = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    dot = F.aggregate(zipped, F.lit(0.0), lambda s, x: s + x)

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot / lengths).otherwise(F.lit(0.0))


def hmac_sha256(body: Column, secret: str) -> Column:
    """Hex HMAC-SHA256 of a body under one secret: two rounds of the built-in hash around the padded key."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body.cast("binary")), 256))), 256)
