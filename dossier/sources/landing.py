"""Sources and sinks: landed pages of records, files of any type, model requests and answers."""

from __future__ import annotations

import csv
import email
import email.headerregistry
import email.policy
import html.parser
import io
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.functions.text import file_type, repaired_json, sha256
from dossier.operators.sync import last_by, text_or_name, until_repeat

ASSET = "name string, file_type string, asset_type string, text string, page int, parent string, context string, error string"


def pages(raw: DataFrame) -> DataFrame:
    """Items of paged responses (page, value as JSON text with data[]): page, pos, item, id; up to the first repeated id."""
    items = raw.select("page", F.posexplode(F.from_json(F.get_json_object("value", "$.data"), "array<string>")).alias("pos", "item"))
    items = items.withColumn("id", F.get_json_object("item", "$.id").cast("long"))
    return until_repeat(items, "id", ["page", "pos"])


def matters(items: DataFrame, only_open: bool = False) -> DataFrame:
    """Matters of JSON items; those without a client or named "No Client Associated" are skipped."""
    def of(name: str) -> Column:
        return text_or_name(F.get_json_object("item", f"$.{name}"))

    out = items.select(F.get_json_object("item", "$.id").alias("external_id"), F.get_json_object("item", "$.display_number").alias("display_number"), F.get_json_object("item", "$.description").alias("description"), of("status").alias("status"), of("practice_area").alias("practice_area"), of("client").alias("client_name"))
    out = out.where(F.col("client_name").isNotNull() & ~F.coalesce(F.contains("display_number", F.lit("No Client Associated")), F.lit(False)))
    return out.where(F.lower("status") == "open") if only_open else out


def documents(items: DataFrame) -> DataFrame:
    """Documents of JSON items: type after the last / of the MIME type, folder as text, name "unknown" by default."""
    def of(path: str) -> Column:
        return F.get_json_object("item", f"$.{path}")

    return items.select(of("id").alias("external_id"), F.coalesce(of("name"), F.lit("unknown")).alias("filename"), F.element_at(F.split(of("content_type"), "/"), -1).alias("file_type"), of("parent.id").alias("folder"), of("size").cast("long").alias("file_size"))


def folders(items: DataFrame) -> DataFrame:
    def of(path: str) -> Column:
        return F.get_json_object("item", f"$.{path}")

    return items.select(of("id").alias("id"), of("name").alias("name"), of("parent.id").alias("parent_id"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """Binary files below a path with name, SHA-256 and type."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select("path", name.alias("name"), "content", sha256(F.col("content")).alias("content_hash"), file_type(name, F.col("content")).alias("file_type"))


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 where valid, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


class _Text(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts, self.skip = [], 0

    def handle_starttag(self, tag, attrs) -> None:
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag) -> None:
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data) -> None:
        if not self.skip and data.strip():
            self.parts.append(data.strip())


def html_text(markup: str) -> str:
    """Text nodes outside script and style, one a line."""
    p = _Text()
    p.feed(markup)
    p.close()
    return "\n".join(p.parts)


def csv_text(text: str) -> str:
    """Rows that hold something, cells joined by " | "."""
    return "\n".join(" | ".join(r) for r in csv.reader(io.StringIO(text)) if any(c.strip() for c in r))


def _plain(content: bytes) -> str:
    try:
        return content.decode()
    except UnicodeDecodeError:
        return content.decode("latin-1")


def _nodes(data: bytes, tag: str) -> list:
    return [x for x in ElementTree.fromstring(data).iter() if x.tag.rpartition("}")[2] == tag]


def _texts(node, tag: str = "t") -> str:
    return "".join(x.text or "" for x in node.iter() if x.tag.rpartition("}")[2] == tag)


def _office(content: bytes, kind: str) -> list[tuple[int | None, str]]:
    """(page, text) of a word file, or of each sheet or slide."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if kind == "docx":
            body = ElementTree.fromstring(z.read("word/document.xml"))
            lines = [t for p in body.iter() if p.tag.endswith("}p") and (t := _texts(p).strip())]
            rows = [" | ".join(_texts(c).strip() for c in r if c.tag.endswith("}tc")) for r in body.iter() if r.tag.endswith("}tr")]
            return [(None, "\n".join(lines + (["[Table]", *rows] if rows else [])) or "[Empty document]")]
        marks = {"xlsx": "xl/worksheets/sheet", "pptx": "ppt/slides/slide"}[kind]
        names = sorted((n for n in z.namelist() if n.startswith(marks) and n.endswith(".xml")), key=lambda n: int("".join(c for c in n[len(marks) :] if c.isdigit()) or 0))
        shared = [_texts(x) for x in _nodes(z.read("xl/sharedStrings.xml"), "si")] if kind == "xlsx" and "xl/sharedStrings.xml" in z.namelist() else []
        out = []
        for i, n in enumerate(names, 1):
            if kind == "pptx":
                out.append((i, "\n".join(t for p in _nodes(z.read(n), "p") if (t := _texts(p).strip())) or "[Empty slide]"))
                continue
            lines = []
            for row in _nodes(z.read(n), "row"):
                cells = []
                for c in row:
                    v = _texts(c, "v") or _texts(c)
                    cells.append(shared[int(v)] if c.get("t") == "s" and v.isdigit() and int(v) < len(shared) else v)
                if any(x.strip() for x in cells):
                    lines.append(" | ".join(cells))
            out.append((None, "\n".join(lines) or "[Empty sheet]"))
        return out


_registry = email.headerregistry.HeaderRegistry()
_kept = lru_cache(2_000)(_registry)


def _header(name: str, value: str):
    """A parsed header. A message parses each header anew whenever it is asked for, so short ones are kept."""
    return _kept(name, value) if len(value) <= 1_000 else _registry(name, value)


MAIL = email.policy.default.clone(header_factory=_header)


def assets_of(name: str, kind: str, content: bytes, parent: str | None = None, context: str = "") -> Iterator[tuple]:
    """Asset rows of one file; what cannot be read gives an error row, never an exception."""
    try:
        if kind == "txt":
            yield name, kind, "text", _plain(content), None, parent, context, None
        elif kind == "html":
            yield name, kind, "text", html_text(_plain(content)), None, parent, context, None
        elif kind == "csv":
            yield name, kind, "text", csv_text(_plain(content)), None, parent, context, None
        elif kind in ("docx", "xlsx", "pptx"):
            for page, text in _office(content, kind):
                yield name, kind, "text", text, page, parent, context, None
        elif kind in ("png", "jpg", "tiff"):
            yield name, kind, "image", None, 1, parent, context, None
        elif kind == "eml":
            message = email.message_from_bytes(content, policy=MAIL)
            body = message.get_body(("plain",))
            head = "\n".join(f"{k}: {message.get(k, '')}" for k in ("From", "To", "Date", "Subject"))
            yield name, kind, "email_body", f"{head}\n\n{body.get_content() if body else ''}", None, parent, context, None
            inner = f"{context} > {name}" if context else name
            for part in message.iter_attachments():
                label = part.get_filename() or "attachment"
                data = part.get_payload(decode=True)
                if data is None:
                    data = bytes(part.get_payload(0)) if part.is_multipart() else b""
                yield from assets_of(label, label.rpartition(".")[2].lower() if "." in label else "unknown", data, parent or name, inner)
        else:
            yield name, kind, "error", None, None, parent, context, f"unsupported type: {kind}"
    except Exception as e:  # a broken file is a row, not a failed job
        yield name, kind, "error", None, None, parent, context, f"{type(e).__name__}: {e}"[:500]


def assets(found: DataFrame, parts: int | None = None) -> DataFrame:
    """Asset rows (ASSET) of files (name, file_type, content); parts spreads few large files over more tasks."""
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [a for r in pdf.itertuples(index=False) for a in assets_of(r.name, r.file_type, bytes(r.content or b""))]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in ASSET.split(", ")])
            yield out.astype({"page": "Int32"})

    rows = found.select("name", "file_type", "content")
    return (rows.repartition(parts) if parts else rows).mapInPandas(read, ASSET)


def requests(rows: DataFrame, record_id: Column, system: str, prompt: Column, max_tokens: int = 4096) -> DataFrame:
    """One JSON line (value) for each model request."""
    content = F.array(F.struct(F.lit("text").alias("type"), prompt.alias("text")))
    message = F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))
    body = F.struct(F.lit(max_tokens).alias("max_tokens"), F.lit(0.0).alias("temperature"), F.lit(system).alias("system"), message.alias("messages"))
    return rows.select(F.to_json(F.struct(record_id.alias("recordId"), body.alias("modelInput"))).alias("value"))


#: Kinds of requests about a case: what the model is, how much it may say, what is asked.
CASE_KINDS = {
    "relevance": ("You judge how relevant a case is.", 1000, "How relevant is this case, from 1 to 10, and why?"),
    "irac": ("You write case briefs for an attorney.", 2000, "Give issue, rule, application and conclusion."),
}


def case_requests(cases: DataFrame, allegations: DataFrame, job: int, most: int = 5, chars: int = 300) -> DataFrame:
    """One JSON line (value) for each (case, kind): cases (id, matter_id, case_name, court, snippet), allegations (matter_id, id, text).

    The first `most` allegations of the matter, by id, are named, each cut to `chars` characters; a matter without any says
    so. Record ids are kind-job-case. Snippets are cut to 1,500 characters, as the request format has it.
    """
    place = F.row_number().over(Window.partitionBy("matter_id").orderBy("id"))
    first = allegations.where("coalesce(text, '') <> ''").withColumn("n", place).where(F.col("n") <= most)
    line = F.concat(F.lit("- "), F.substring("text", 1, chars))
    told = first.groupBy("matter_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda x: x["l"]), "\n").alias("told"))  # `most` at most
    rows = cases.join(told, "matter_id", "left").withColumn("told", F.coalesce("told", F.lit("Not specified")))
    out = None
    for kind, (system, most_tokens, asked) in CASE_KINDS.items():
        case = F.concat_ws("\n", F.concat_ws(", ", "case_name", "court"), F.substring("snippet", 1, 1500), F.lit("Allegations:"), "told", F.lit(asked))
        part = requests(rows, F.concat(F.lit(f"{kind}-{job}-"), F.col("id").cast("string")), system, case, most_tokens)
        out = part if out is None else out.unionByName(part)
    return out


ANSWER = "recordId string, modelOutput struct<content: array<struct<type: string, text: string>>, stop_reason: string, usage: map<string, bigint>>, error struct<message: string, code: string>"


def answers(lines: DataFrame) -> DataFrame:
    """Model answers of JSON lines (file, line, value): one row for each recordId, from the last file and line; bad lines drop."""
    parsed = lines.withColumn("a", F.from_json("value", ANSWER)).where(F.col("a.recordId").isNotNull())
    newest = last_by(parsed.withColumn("record_id", F.col("a.recordId")), ["record_id"], [F.desc("file"), F.desc("line")])
    texts = F.filter("a.modelOutput.content", lambda c: c["type"] == "text")
    return newest.select("record_id", F.col("a.error").isNotNull().alias("is_error"), F.col("a.error.message").alias("message"), F.col("a.error.code").alias("code"), F.when(F.size(texts) > 0, texts[0]["text"]).alias("text"), F.col("a.modelOutput.stop_reason").alias("stop_reason"))


PERSON = "array<struct<fullName: string, role: string, importance: string, relevance: string, relevanceReason: string, observation: string, sourceQuote: string, sourcePage: int, email: string, phone: string, address: string, confidenceScore: double, claimLinks: array<struct<claimRef: string, claimNumber: int, claimType: string, relationship: string, explanation: string>>>>"


def people(found: DataFrame, text_col: str) -> DataFrame:
    """Mention rows of extraction answers, defaults filled in; unreadable answers give none."""
    from dossier.functions.text import importance_from_relevance, role_of

    listed = F.from_json(F.get_json_object(repaired_json(F.col(text_col)), "$.witnesses"), PERSON)
    rows = found.withColumn("p", F.explode(listed)).where("p.fullName IS NOT NULL")
    relevance = F.coalesce(F.lower("p.relevance"), F.lit("relevant"))
    return rows.withColumns(
        {
            "full_name": F.col("p.fullName"),
            "role": role_of(F.col("p.role")),
            "relevance": relevance,
            "importance": F.when(F.lower("p.importance").isin("high", "medium", "low"), F.lower("p.importance")).otherwise(importance_from_relevance(relevance)),
            "observation": F.col("p.observation"),
            "source_page": F.col("p.sourcePage"),
            "confidence_score": F.coalesce("p.confidenceScore", F.lit(0.5)),
            "claim_links": F.col("p.claimLinks"),
        }
    ).drop("p")


def claims(found: DataFrame, text_col: str) -> DataFrame:
    """Claim rows (claim_type, seq, claim_text, confidence) of answers with allegations[] and defenses[]."""
    json, kind = repaired_json(F.col(text_col)), "array<struct<text: string, confidence: double>>"
    parts = [found.select("*", F.posexplode(F.from_json(F.get_json_object(json, f"$.{name}"), kind)).alias("seq", "c")).withColumn("claim_type", F.lit(t)) for name, t in (("allegations", "allegation"), ("defenses", "defense"))]
    return parts[0].unionByName(parts[1]).withColumns({"claim_text": F.col("c.text"), "confidence": F.coalesce("c.confidence", F.lit(0.8))}).drop("c")


def upsert_texts(store: DataFrame, new: DataFrame) -> DataFrame:
    """Parsed texts by (organization_id, external_id); the size falls back to the length of the text."""
    from dossier.operators.sync import upsert

    sized = new.withColumn("file_size", F.coalesce("file_size", F.length("text").cast("long")))
    return upsert(store, sized, ["organization_id", "external_id"], ["content_hash", "text", "file_size"])


def write_store(texts: DataFrame, path: str) -> None:
    """Parsed texts (organization_id, external_id, content_hash, text), laid out by organization; an organization's rows are
    spread over tasks by their ids, so a large one is no single file."""
    texts.repartition("organization_id", F.pmod(F.xxhash64("external_id"), F.lit(8))).write.mode("overwrite").partitionBy("organization_id").parquet(path)


def stored_texts(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """asked (organization_id, external_id, content_hash) with found (external id in the store), found_by (id, hash or none)
    and text: by (organization, id), else the least id of (organization, hash). Organizations not asked for are not read."""
    store = spark.read.schema("external_id long, content_hash string, text string, organization_id long").parquet(path)
    key = F.col("organization_id").cast("long").alias("organization_id")
    by_id = store.select(key, "external_id", F.col("external_id").alias("a"), F.struct("text").alias("ta"))
    by_hash = store.groupBy(key, "content_hash").agg(F.min("external_id").alias("b"), F.min_by(F.struct("text"), "external_id").alias("tb"))
    rows = asked.withColumn("organization_id", F.col("organization_id").cast("long")).join(by_id, ["organization_id", "external_id"], "left").join(by_hash, ["organization_id", "content_hash"], "left")
    found_by = F.when(F.col("a").isNotNull(), "id").when(F.col("b").isNotNull(), "hash").otherwise("none")
    return rows.withColumns({"found_by": found_by, "found": F.coalesce("a", "b"), "text": F.coalesce("ta", "tb")["text"]}).drop("a", "b", "ta", "tb")
