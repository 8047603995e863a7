"""Sources, sinks, snapshots and folders: SRC, SNK, SYN, FLD, EXT."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions.text import file_type
from dossier.operators import sync as S
from dossier.plans.bindings import Tables
from dossier.plans.registry import query
from dossier.operators.sync import until_repeat
from dossier.sources import landing as L
from dossier.sources import paged_source
from dossier.sources import versioned as V
from dossier.sources.shared import scratch


def _pages(t: Tables) -> DataFrame:
    """Matters as pages of 200 JSON items; on a further page behind all others the last one comes again, and new ones after it."""
    item = F.to_json(F.struct("id", "display_number", "description", F.expr("CASE WHEN id % 2 = 0 THEN named_struct('name', client_name) END").alias("client"), F.struct(F.col("status").alias("name")).alias("status"), "practice_area"))
    rows = t.matters.select(F.floor(F.col("id") / 200).alias("page"), "id", item.alias("item"))
    last = t.matters.agg(F.max("id")).first()[0]
    again = rows.where(F.col("id") >= last - 1).select((F.floor(F.lit(last) / 200) + 1).alias("page"), "id", F.when(F.col("id") == last, F.regexp_replace("item", f'^\\{{"id":{last}', f'{{"id":{last + 1}')).otherwise(F.regexp_replace("item", f'^\\{{"id":{last - 1}', f'{{"id":{last}')).alias("item"))
    listed = rows.unionByName(again).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("id", "item"))).alias("of"))  # 200 a page
    return listed.select("page", F.concat(F.lit('{"data": ['), F.array_join(F.transform("of", lambda x: x["item"]), ","), F.lit("]}")).alias("value"))


@query("src_01_paged_scan", "SELECT id FROM matters")
def paged_scan(t: Tables) -> DataFrame:
    """The scan stops at the first repeated item: what comes on that page from there on is dropped."""
    return L.pages(_pages(t)).select("id")


@query("src_01_data_source", "SELECT id FROM matters")
def data_source(t: Tables) -> DataFrame:
    """The same pages, landed as files and read by the registered format."""
    folder = scratch(t.spark, "pages")
    paged_source.land(_pages(t), folder)
    items = paged_source.registered(t.spark).read.format("landed_pages").load(folder)
    return until_repeat(items, "id", ["page", "pos"]).select("id")


@query("src_02_matters", "SELECT id::VARCHAR AS external_id, client_name, status, practice_area FROM matters WHERE id % 2 = 0 AND client_name IS NOT NULL AND status = 'Open'")
def matters(t: Tables) -> DataFrame:
    return L.matters(L.pages(_pages(t)), only_open=True).select("external_id", "client_name", "status", "practice_area")


_MIME = "CASE id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 3 THEN 'message/rfc822' END"


@query("src_03_documents", f"SELECT id::VARCHAR AS external_id, CASE WHEN id % 10 = 0 THEN 'unknown' ELSE filename END AS filename, list_last(string_split({_MIME}, '/')) AS file_type, folder, floor(size)::BIGINT AS file_size FROM filings")
def documents(t: Tables) -> DataFrame:
    item = F.to_json(F.struct("id", F.expr("CASE WHEN id % 10 <> 0 THEN filename END").alias("name"), F.expr(_MIME).alias("content_type"), F.expr("CASE WHEN folder IS NOT NULL THEN named_struct('id', folder) END").alias("parent"), F.floor("size").alias("size")))
    return L.documents(t.filings.select(item.alias("item"))).select("external_id", "filename", "file_type", "folder", "file_size")


def _folders(t: Tables) -> DataFrame:
    regions = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_id"))
    nations = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"))
    customers = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"))
    return regions.unionByName(nations).unionByName(customers)


_FOLDERS = """folders AS (SELECT concat('r', r_regionkey) AS id, r_name AS name, NULL AS parent_id FROM region UNION ALL SELECT concat('n', n_nationkey), n_name, concat('r', n_regionkey) FROM nation
    UNION ALL SELECT concat('c', c_custkey), c_name, concat('n', c_nationkey) FROM customer)"""


@query("src_04_folders", f"WITH {_FOLDERS} SELECT * FROM folders")
def folders(t: Tables) -> DataFrame:
    items = _folders(t).select(F.to_json(F.struct("id", "name", F.expr("CASE WHEN parent_id IS NOT NULL THEN named_struct('id', parent_id) END").alias("parent"))).alias("item"))
    return L.folders(items)


#: Leading bytes, extension, and the type that they make.
_HEADS = (("25504446", "txt", "pdf"), ("D0CF11E0A1B11AE1", "xls", "xls"), ("D0CF11E0A1B11AE1", "doc", "doc"), ("D0CF11E0A1B11AE1", "ppt", "ppt"), ("D0CF11E0A1B11AE1", "pdf", "msg"), ("504B0304", "xlsx", "xlsx"), ("504B0304", "pptx", "pptx"),
    ("504B0304", "bin", "docx"), ("89504E47", "jpg", "png"), ("FFD8FF", "png", "jpg"), ("49492A00", "bin", "tiff"), ("4D4D002A", "bin", "tiff"), ("7B5C727466", "doc", "rtf"), ("", "jpeg", "html"), ("20", "TIF", "html"), ("00", "tif", "tiff"),
    ("00", "JPEG", "jpg"), ("00", "htm", "html"), ("00", "csv", "csv"), ("00", "exe", "unknown"), ("00", "", "unknown"))


def _of_head(k: int) -> str:
    return f"CASE page_id % {len(_HEADS)} " + " ".join(f"WHEN {i} THEN '{h[k]}'" for i, h in enumerate(_HEADS)) + " END"


@query("src_05_file_types", f"""SELECT page_id, sha256(unhex({_of_head(0)}) || encode(html)) AS content_hash, {_of_head(2)} AS file_type FROM pages""")
def file_types(t: Tables) -> DataFrame:
    """The pages behind the leading bytes of every kind of file, under names that agree or not."""
    content = F.concat(F.unhex(F.expr(_of_head(0))), F.col("html").cast("binary"))
    rows = t.pages.select("page_id", content.alias("content"), F.concat(F.lit("File."), F.expr(_of_head(1))).alias("name"))
    return rows.select("page_id", F.sha2("content", 256).alias("content_hash"), file_type(F.col("name"), F.col("content")).alias("file_type"))


@query("src_06_assets")
def assets(t: Tables) -> DataFrame:
    pages = t.pages.select(F.concat("page_id", F.lit(".html")).alias("name"), F.lit("html").alias("file_type"), F.col("html").cast("binary").alias("content"))
    mail = t.documents.select(F.concat("doc_id", F.lit(".eml")).alias("name"), F.lit("eml").alias("file_type"), F.concat(F.lit("From: a@b.c\nSubject: "), "source", F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), "text").cast("binary").alias("content"))
    found = L.assets(pages.unionByName(mail))
    return found.select("name", "asset_type", F.md5("text").alias("text_hash"), "error")


@query("src_06a_decoded_text", """SELECT doc_id, md5(CASE WHEN lang = 'en' THEN text ELSE regexp_replace(text, '[^\\x00-\\x{FF}]', '?', 'g') END) AS h FROM documents""")
def decoded_text(t: Tables) -> DataFrame:
    """English texts as UTF-8 bytes, the others as Latin-1 bytes: those with letters beyond ASCII are no valid UTF-8."""
    latin = F.encode(F.regexp_replace("text", r"[^\x00-\xFF]", "?"), "ISO-8859-1")
    content = F.when(F.col("lang") == "en", F.col("text").cast("binary")).otherwise(latin)
    return t.documents.select("doc_id", F.md5(L.decoded(content).cast("binary")).alias("h"))


@query("src_06c_csv_text", """SELECT doc_id, concat(concat_ws(' | ', lang, source, n_chars), chr(10), 'a, "b" | c') AS text FROM documents""")
def csv_text(t: Tables) -> DataFrame:
    """Rows without any content go; quoted cells keep their commas and quotes."""
    content = F.concat(F.concat_ws(",", "lang", "source", "n_chars"), F.lit('\n,,\n"a, ""b""",c\n')).cast("binary")
    found = L.assets(t.documents.select(F.concat("doc_id", F.lit(".csv")).alias("name"), F.lit("csv").alias("file_type"), content.alias("content")))
    return found.select(F.split("name", "[.]")[0].cast("long").alias("doc_id"), "text")


_INNER = "From: x@y.z\nSubject: inner\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=B2\n\n--B2\nContent-Type: text/plain\n\nhello\n--B2\nContent-Type: text/csv\nContent-Disposition: attachment; filename=deep.csv\n\na,b\n,\n1,2\n--B2--\n"


@query("src_06d_mail", """WITH k AS (SELECT * FROM (VALUES (1, 'eml', 'email_body', NULL, ''), (2, 'txt', 'text', '', ''), (3, 'eml', 'email_body', '', ''), (4, 'csv', 'text', '', ' > inner.eml')) AS v(i, file_type, asset_type, p, c))
    SELECT concat(CASE i WHEN 1 THEN doc_id || '.eml' WHEN 2 THEN 'note.txt' WHEN 3 THEN 'inner.eml' ELSE 'deep.csv' END) AS name, file_type, asset_type, CASE WHEN i > 1 THEN doc_id || '.eml' END AS parent, CASE WHEN i > 1 THEN doc_id || '.eml' || c ELSE '' END AS context,
      CASE i WHEN 1 THEN concat('From: a@b.c', chr(10), 'To: ', chr(10), 'Date: ', chr(10), 'Subject: ', source, chr(10), chr(10), lang) WHEN 2 THEN text
        WHEN 3 THEN concat('From: x@y.z', chr(10), 'To: ', chr(10), 'Date: ', chr(10), 'Subject: inner', chr(10), chr(10), 'hello') ELSE concat('a | b', chr(10), '1 | 2') END AS text FROM documents, k""")
def mail(t: Tables) -> DataFrame:
    """Mails with the document as an attached text, and with a mail that has an attachment itself."""
    head = F.concat(F.lit("From: a@b.c\nSubject: "), "source", F.lit("\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=B1\n\n--B1\nContent-Type: text/plain; charset=utf-8\n\n"), "lang")
    note = F.concat(F.lit("\n--B1\nContent-Type: application/octet-stream\nContent-Disposition: attachment; filename=note.txt\nContent-Transfer-Encoding: base64\n\n"), F.base64(F.col("text").cast("binary")))
    inner = F.lit(f"\n--B1\nContent-Type: message/rfc822\nContent-Disposition: attachment; filename=inner.eml\n\n{_INNER}\n--B1--\n")
    rows = t.documents.select(F.concat("doc_id", F.lit(".eml")).alias("name"), F.lit("eml").alias("file_type"), F.concat(head, note, inner).cast("binary").alias("content"))
    return L.assets(rows).select("name", "file_type", "asset_type", "parent", "context", "text")


def _answers(t: Tables) -> DataFrame:
    """Answers as JSON lines of two files; the later file repeats every third record, every seventh line is broken."""
    body = F.concat(F.lit('{"recordId":"rec-'), F.col("conv_id"), F.lit("-"), F.col("turn"), F.lit('","modelOutput":{"content":[{"type":"text","text":"'), F.col("role"), F.lit('"}],"stop_reason":"end_turn"}}'))
    one = t.conversations.select(F.lit("a.jsonl.out").alias("file"), (F.col("conv_id") * 100 + F.col("turn")).alias("line"), F.expr("(conv_id * 100 + turn) % 7 = 0").alias("bad"), body.alias("value"), "conv_id", "turn")
    two = one.where("(conv_id + turn) % 3 = 0").withColumns({"file": F.lit("b.jsonl.out"), "value": F.replace("value", F.lit('"text":"'), F.lit('"text":"again '))})
    return one.unionByName(two).withColumn("value", F.when(F.col("bad"), F.substring("value", 1, 20)).otherwise(F.col("value")))


@query("src_07_answers", """SELECT concat('rec-', conv_id, '-', turn) AS record_id, CASE WHEN (conv_id + turn) % 3 = 0 THEN concat('again ', role) ELSE role END AS text, 'end_turn' AS stop_reason
    FROM conversations WHERE (conv_id * 100 + turn) % 7 <> 0""")
def answers(t: Tables) -> DataFrame:
    return L.answers(_answers(t)).select("record_id", "text", "stop_reason")


@query("src_11_text_store", """WITH s AS (SELECT doc_id % 9 AS o, doc_id, sha256(text) AS h FROM documents WHERE doc_id % 4 > 0)
    SELECT d.doc_id, CASE WHEN i.doc_id IS NOT NULL THEN 'id' WHEN x.doc_id IS NOT NULL THEN 'hash' ELSE 'none' END AS found_by, coalesce(i.doc_id, x.doc_id) AS found FROM documents d
    LEFT JOIN s i ON i.doc_id = d.doc_id AND i.o = d.doc_id % 9 LEFT JOIN (SELECT o, h, min(doc_id) AS doc_id FROM s GROUP BY o, h) x ON x.o = d.doc_id % 9 AND x.h = sha256(d.text)""")
def text_store(t: Tables) -> DataFrame:
    """A store of parsed texts laid out by organization, read by id, else by content."""
    path = scratch(t.spark, "texts")
    org = (F.col("doc_id") % 9).alias("organization_id")
    L.write_store(t.documents.where("doc_id % 4 > 0").select(org, F.col("doc_id").alias("external_id"), F.sha2("text", 256).alias("content_hash"), "text"), path)
    asked = t.documents.select(org, F.col("doc_id").alias("external_id"), F.sha2("text", 256).alias("content_hash"))
    return L.stored_texts(t.spark, path, asked).select(F.col("external_id").alias("doc_id"), "found_by", "found")


@query("src_06e_office", """SELECT concat(doc_id, '.', f) AS name, p AS page, CASE f WHEN 'docx' THEN concat('About ', coalesce(source, ''), chr(10), coalesce(lang, ''), chr(10), n_chars, chr(10), '[Table]', chr(10), coalesce(lang, ''), ' | ', n_chars)
      WHEN 'xlsx' THEN CASE i WHEN 1 THEN concat(coalesce(lang, ''), ' | ', n_chars) ELSE '[Empty sheet]' END WHEN 'pptx' THEN CASE i WHEN 1 THEN concat('About ', coalesce(source, '')) ELSE '[Empty slide]' END END AS text, CASE WHEN f = 'bad' THEN 'error' ELSE 'text' END AS asset_type
    FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'docx' WHEN 1 THEN 'xlsx' WHEN 2 THEN 'pptx' ELSE 'bad' END AS f FROM documents) d
    JOIN (SELECT * FROM (VALUES ('docx', 1, NULL::INTEGER), ('xlsx', 1, NULL), ('xlsx', 2, NULL), ('pptx', 1, 1), ('pptx', 2, 2), ('bad', 1, NULL)) AS v(k, i, p)) ON k = f""")
def office(t: Tables) -> DataFrame:
    """Word, sheet and slide files made of the documents' columns, and files that are no zip at all."""
    kind = F.expr("CASE doc_id % 4 WHEN 0 THEN 'docx' WHEN 1 THEN 'xlsx' WHEN 2 THEN 'pptx' ELSE 'bad' END")
    told = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "lang", "n_chars")]
    files = t.documents.select(F.concat(F.col("doc_id").cast("string"), F.lit("."), kind).alias("name"), F.when(kind == "bad", "docx").otherwise(kind).alias("file_type"), _office_file(kind, *told).alias("content"))
    return L.assets(files).select("name", "page", "text", "asset_type")


@F.pandas_udf(T.BinaryType())
def _office_file(kind: pd.Series, source: pd.Series, lang: pd.Series, n: pd.Series) -> pd.Series:
    """The zip of a minimal office file."""
    from html import escape

    def one(kind: str, source: str, lang: str, n: str) -> bytes:
        source, lang = escape(source), escape(lang)
        if kind == "docx":
            line = lambda x: f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>"
            parts = {"word/document.xml": f'<w:document xmlns:w="w"><w:body>{line("About " + source)}<w:tbl><w:tr><w:tc>{line(lang)}</w:tc><w:tc>{line(n)}</w:tc></w:tr></w:tbl></w:body></w:document>'}
        elif kind == "xlsx":
            sheet = f'<worksheet xmlns="x"><sheetData><row><c t="s"><v>0</v></c><c><v>{n}</v></c></row></sheetData></worksheet>'
            parts = {"xl/worksheets/sheet1.xml": sheet, "xl/worksheets/sheet2.xml": '<worksheet xmlns="x"><sheetData/></worksheet>', "xl/sharedStrings.xml": f'<sst xmlns="x"><si><t>{lang}</t></si></sst>'}
        elif kind == "pptx":
            slide = '<p:sld xmlns:p="p" xmlns:a="a">{}</p:sld>'
            parts = {"ppt/slides/slide1.xml": slide.format(f"<a:p><a:r><a:t>About {source}</a:t></a:r></a:p>"), "ppt/slides/slide2.xml": slide.format("")}
        else:
            return b"no zip"
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in parts.items():
                z.writestr(name, data)
        return out.getvalue()

    return pd.Series([one(*x) for x in zip(kind, source, lang, n, strict=True)])


@query("snk_01_requests", """SELECT doc_id, concat('doc-', doc_id) AS record_id, length(text) AS chars FROM documents""")
def requests(t: Tables) -> DataFrame:
    lines = L.requests(t.documents, F.concat(F.lit("doc-"), "doc_id"), "List every person.", F.col("text"))
    read = lines.select(F.get_json_object("value", "$.recordId").alias("record_id"), F.get_json_object("value", "$.modelInput.messages[0].content[0].text").alias("t"))
    return read.select(F.regexp_extract("record_id", r"(\d+)$", 1).cast("long").alias("doc_id"), "record_id", F.length("t").cast("long").alias("chars"))


@query("snk_01_case_requests", """WITH a AS (SELECT matter_id, string_agg('- ' || substr(claim_text, 1, 300), chr(10) ORDER BY id) AS told FROM (SELECT *, row_number() OVER (PARTITION BY matter_id ORDER BY id) AS n FROM claims WHERE claim_type = 'allegation') WHERE n <= 5 GROUP BY matter_id)
    SELECT concat(k, '-7-', doc_id) AS record_id, CASE k WHEN 'relevance' THEN 1000 ELSE 2000 END AS max_tokens,
      md5(concat(concat_ws(', ', 'Case ' || doc_id, lang), chr(10), substr(text, 1, 1500), chr(10), 'Allegations:', chr(10), coalesce(told, 'Not specified'), chr(10), CASE k WHEN 'relevance' THEN 'How relevant is this case, from 1 to 10, and why?' ELSE 'Give issue, rule, application and conclusion.' END)) AS prompt
    FROM documents LEFT JOIN a ON a.matter_id = doc_id % 60, (SELECT unnest(['relevance', 'irac']) AS k)""")
def case_requests(t: Tables) -> DataFrame:
    """Two requests for each case, with the allegations of its matter."""
    cases = t.documents.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 60).alias("matter_id"), F.concat(F.lit("Case "), "doc_id").alias("case_name"), F.col("lang").alias("court"), F.col("text").alias("snippet"))
    said = t.claims.where("claim_type = 'allegation'").select("matter_id", "id", F.col("claim_text").alias("text"))
    lines = L.case_requests(cases, said, 7)
    of = lambda path: F.get_json_object("value", path)
    return lines.select(of("$.recordId").alias("record_id"), of("$.modelInput.max_tokens").cast("int").alias("max_tokens"), F.md5(of("$.modelInput.messages[0].content[0].text")).alias("prompt"))


@query("snk_04_upsert_texts", """SELECT doc_id % 9 AS organization_id, doc_id AS external_id, sha256(text) AS content_hash, CASE WHEN doc_id % 2 = 0 THEN length(text) ELSE n_chars END::BIGINT AS file_size FROM documents""")
def upsert_texts(t: Tables) -> DataFrame:
    """Two commits to a store with versions, read back: what was known, then new rows of which some have no size."""
    rows = t.documents.select(F.expr("doc_id % 9").alias("organization_id"), F.col("doc_id").alias("external_id"), F.sha2("text", 256).alias("content_hash"), "text", F.col("n_chars").cast("long").alias("file_size"))
    new = rows.where("external_id % 2 = 0").withColumn("file_size", F.lit(None).cast("long"))
    store = V.VersionedTable(t.spark, scratch(t.spark, "texts"), rows.schema, ["organization_id", "external_id"])
    store.upsert(rows.where("external_id % 3 > 0"), L.upsert_texts)
    store.upsert(new.unionByName(rows.where("external_id % 2 = 1")), L.upsert_texts)
    return store.read().drop("text")


@query("snk_05_matter_store", """SELECT user_id, id, CASE WHEN id % 3 = 0 THEN concat('new ', description) ELSE description END AS description, status FROM matters""")
def matter_store(t: Tables) -> DataFrame:
    """Matters in a store with versions: all of them, then the changed fields of some, committed and read back."""
    rows = t.matters.select("user_id", "id", "description", "status")
    new = rows.where("id % 3 = 0").withColumns({"description": F.concat(F.lit("new "), "description"), "status": F.lit(None).cast("string")})
    store = V.VersionedTable(t.spark, scratch(t.spark, "matters"), rows.schema, ["user_id", "id"], buckets=16)
    merge = lambda old, fresh: S.upsert(old, fresh, ["user_id", "id"], ["description", "status"])
    store.upsert(rows, merge)
    store.upsert(new, merge)
    return store.read()


_SYNC = """s AS (SELECT * FROM filings WHERE id % 7 <> 0 AND matter_id % 10 <> 4), l AS (SELECT * FROM filings WHERE id % 5 <> 0), n AS (SELECT DISTINCT matter_id FROM s)"""


@query("syn_01_merge", f"""WITH {_SYNC} SELECT coalesce(s.matter_id, l.matter_id) AS matter_id, coalesce(s.id, l.id) AS id, coalesce(s.filename, l.filename) AS filename,
    CASE WHEN s.id IS NOT NULL THEN false WHEN n.matter_id IS NULL THEN l.is_soft_deleted ELSE true END AS is_soft_deleted,
    CASE WHEN l.id IS NULL THEN 'insert' WHEN s.id IS NOT NULL THEN 'update' WHEN n.matter_id IS NULL OR l.is_soft_deleted THEN 'unchanged' ELSE 'soft_delete' END AS action
    FROM l FULL JOIN s ON l.id = s.id LEFT JOIN n ON n.matter_id = coalesce(s.matter_id, l.matter_id)""")
def merge(t: Tables) -> DataFrame:
    return S.merge_snapshot(t.filings.where("id % 5 <> 0"), t.filings.where("id % 7 <> 0 AND matter_id % 10 <> 4"), "matter_id", "id", ["filename"])


@query("syn_02_matter_upsert", "SELECT user_id, id, CASE WHEN id % 3 = 0 THEN concat('new ', description) ELSE description END AS description, status FROM matters")
def matter_upsert(t: Tables) -> DataFrame:
    new = t.matters.where("id % 3 = 0 OR id % 4 = 0").withColumns({"description": F.expr("CASE WHEN id % 3 = 0 THEN concat('new ', description) END"), "status": F.expr("CASE WHEN id % 8 > 0 THEN status END")})
    return S.upsert(t.matters, new, ["user_id", "id"], ["description", "status"])


@query("syn_03_reset", "SELECT d.id, d.is_processed AND d.matter_id <> 11 AS is_processed, count(m.id) FILTER (WHERE d.matter_id <> 11) AS mentions FROM filings d LEFT JOIN mentions m ON m.document_id = d.id GROUP BY ALL")
def reset(t: Tables) -> DataFrame:
    docs, said = S.reset_matter(t.filings, t.mentions, 11)
    per = said.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("mentions"))
    return docs.join(per, "id", "left").select("id", "is_processed", F.coalesce("mentions", F.lit(0)).alias("mentions"))


@query("syn_04_replace", "SELECT id, CASE WHEN document_id % 6 = 0 THEN concat(full_name, ' again') ELSE full_name END AS full_name FROM mentions WHERE NOT (document_id % 6 = 0 AND source_page IS NULL)")
def replace(t: Tables) -> DataFrame:
    rows = t.mentions.select("id", "document_id", "full_name", "source_page")
    new = rows.where("document_id % 6 = 0 AND source_page IS NOT NULL").withColumn("full_name", F.concat("full_name", F.lit(" again")))
    return S.replace_mentions(rows, new, rows.where("document_id % 6 = 0").select("document_id").distinct()).select("id", "full_name")


@query("syn_05_frozen_scope", "SELECT matter_id, count(*) AS n, min(id) AS first, max(id) AS last FROM filings WHERE NOT is_soft_deleted GROUP BY matter_id")
def frozen_scope(t: Tables) -> DataFrame:
    return S.frozen_scope(t.filings).select("matter_id", F.size("ids").cast("long").alias("n"), F.col("ids")[0].alias("first"), F.element_at("ids", -1).alias("last"))


@query("fld_01_tree", f"""WITH RECURSIVE {_FOLDERS}, tree AS (SELECT id, id AS root, 0 AS depth, name AS path FROM folders WHERE parent_id IS NULL
    UNION ALL SELECT c.id, t.root, t.depth + 1, concat(t.path, '/', c.name) FROM tree t JOIN folders c ON c.parent_id = t.id) SELECT * FROM tree""")
def tree(t: Tables) -> DataFrame:
    return S.folder_tree(_folders(t)).select("id", "root", "depth", "path")


@query("fld_02_documents_below", "SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 AND n_nationkey NOT IN (2, 7)")
def documents_below(t: Tables) -> DataFrame:
    docs = t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("folder"))
    return S.documents_below(docs, _folders(t), "r2", ["n2", "n7"]).select("id")


@query("agg_18_folder_counts", "SELECT n_nationkey::BIGINT AS nation, count(*) AS documents FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def folder_counts(t: Tables) -> DataFrame:
    tree = S.folder_tree(_folders(t)).where("depth = 2").select("id", F.split("path", "/")[1].alias("name"))
    docs = t.orders.select(F.concat(F.lit("c"), "o_custkey").alias("id")).join(tree, "id")
    return docs.groupBy(F.regexp_extract("name", r"(\d+)$", 1).cast("long").alias("nation")).agg(F.count("*").alias("documents"))


@query("ext_01_people", """SELECT conv_id, turn, concat('Person ', conv_id) AS full_name, CASE WHEN turn % 2 = 0 THEN 'police_officer' ELSE 'other' END AS role,
    CASE WHEN turn % 3 = 0 THEN 'high' ELSE 'medium' END AS importance, 0.5::DOUBLE AS confidence_score FROM conversations WHERE turn % 5 <> 4""")
def people(t: Tables) -> DataFrame:
    body = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("Person "), "conv_id").alias("fullName"), F.expr("CASE WHEN turn % 2 = 0 THEN 'Police Officer' ELSE 'wizard' END").alias("role"), F.expr("CASE WHEN turn % 3 = 0 THEN 'HIGHLY_RELEVANT' END").alias("relevance"))).alias("witnesses")))
    answer = F.expr("CASE turn % 5 WHEN 1 THEN concat('Sure: ', b) WHEN 2 THEN concat('```json\n', b, '\n```') WHEN 4 THEN 'none' ELSE b END")
    rows = t.conversations.withColumn("b", body).select("conv_id", "turn", answer.alias("answer"))
    return L.people(rows, "answer").select("conv_id", "turn", "full_name", "role", "importance", "confidence_score")


@query("ext_02_claims", """SELECT conv_id, turn, 'allegation' AS claim_type, role AS claim_text, 0.8::DOUBLE AS confidence FROM conversations UNION ALL SELECT conv_id, turn, 'defense', 'denies', 0.4 FROM conversations WHERE turn % 2 = 0""")
def claims(t: Tables) -> DataFrame:
    body = F.to_json(F.struct(F.array(F.struct(F.col("role").alias("text"))).alias("allegations"), F.expr("CASE WHEN turn % 2 = 0 THEN array(named_struct('text', 'denies', 'confidence', 0.4D)) END").alias("defenses")))
    return L.claims(t.conversations.select("conv_id", "turn", body.alias("answer")), "answer").select("conv_id", "turn", "claim_type", "claim_text", "confidence")


@query("ext_03_reuse", "SELECT doc_id FROM documents WHERE doc_id % 4 = 0 OR doc_id % 3 = 0")
def reuse(t: Tables) -> DataFrame:
    now = t.documents.select("doc_id", F.sha2("text", 256).alias("content_hash"))
    old = t.documents.select("doc_id", F.sha2(F.expr("CASE WHEN doc_id % 4 = 0 THEN text || 'x' ELSE text END"), 256).alias("content_hash"), F.expr("doc_id % 3 > 0").alias("is_processed"))
    return S.changed(now, old, "doc_id").select("doc_id")


