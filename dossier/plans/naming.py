"""Name and text functions: FN."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions import fixed
from dossier.functions import names as N
from dossier.functions import text as X
from dossier.plans.bindings import Tables
from dossier.plans.registry import query

_STRICT = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(full_name), '\b(mr|mrs|ms|dr|esq|jr|sr)\b\.?\s*', '', 'g'), '\b(iii|ii|iv|attorney|counsel)\b', '', 'g'), '[^\w\s]', '', 'g'), '\b[a-z]\b', '', 'g'), '\s+', ' ', 'g'))"
_NAMES = f"SELECT DISTINCT full_name, {_STRICT} AS n FROM mentions"


def _names(t: Tables) -> DataFrame:
    return t.mentions.select("full_name").distinct().withColumn("n", N.strict(F.col("full_name")))


def _pairs(t: Tables) -> DataFrame:
    """The different pairs of names that follow each other in a document, with their strict forms n and m."""
    lines = t.mentions.select("document_id", (F.col("id") % 10).alias("line"), "full_name")
    after = lines.select("document_id", (F.col("line") - 1).alias("line"), F.col("full_name").alias("other"))
    names = _names(t)
    found = lines.join(after, ["document_id", "line"]).select("full_name", "other").distinct()
    return found.join(names, "full_name").join(names.select(F.col("full_name").alias("other"), F.col("n").alias("m")), "other")


_PAIRS = f"""SELECT p.*, a.n, b.n AS m FROM (SELECT DISTINCT x.full_name, y.full_name AS other FROM mentions x JOIN mentions y ON x.document_id = y.document_id AND y.id % 10 = x.id % 10 + 1) p
    JOIN ({_NAMES}) a ON a.full_name = p.full_name JOIN ({_NAMES}) b ON b.full_name = p.other"""
_LEV = "CASE WHEN n = m THEN 1.0 ELSE 1 - levenshtein(n, m) / greatest(length(n), length(m)) END"
_NICK = "(VALUES " + ", ".join(f"('{k}', ['" + "', '".join(v) + "'])" for k, v in fixed.NICKNAMES.items()) + ") AS t(k, v)"


@query("fn_01_strict", f"SELECT id, {_STRICT} AS n FROM mentions")
def strict(t: Tables) -> DataFrame:
    return t.mentions.select("id", N.strict(F.col("full_name")).alias("n"))


@query("fn_02_loose", r"""WITH a AS (SELECT id, trim(regexp_replace(regexp_replace(lower(full_name), '[^\w\s\-]', '', 'g'), '\s+', ' ', 'g')) AS n FROM mentions),
    b AS (SELECT id, regexp_replace(n, '^(?:(?:mr|mrs|ms|miss|dr|prof|professor|hon|judge|esq)(?: |$))+', '') AS n FROM a)
    SELECT id, trim(regexp_replace(n, '(?:(?:^| )(?:jr|sr|ii|iii|iv|md|phd|esq|jd|llb|cpa))+$', '')) AS n FROM b""")
def loose(t: Tables) -> DataFrame:
    return t.mentions.select("id", N.loose(F.col("full_name")).alias("n"))


@query("fn_03_parts", f"""WITH s AS (SELECT full_name, string_split(n, ' ') AS p FROM ({_NAMES}))
    SELECT full_name, p[1] AS first, CASE WHEN len(p) > 2 THEN array_to_string(p[2:len(p) - 1], ' ') ELSE '' END AS middle, CASE WHEN len(p) > 1 THEN p[len(p)] ELSE '' END AS last FROM s""")
def parts(t: Tables) -> DataFrame:
    return _names(t).select("full_name", N.parts(F.col("n")).alias("p")).select("full_name", "p.*")


#: Letter after letter of n takes the first free equal letter of m within reach; then transpositions and the common start count.
_JARO = f"""WITH RECURSIVE p AS ({_PAIRS}),
    w AS (SELECT full_name, other, n, m, 0 AS i, '' AS hit, []::BIGINT[] AS used FROM p
      UNION ALL SELECT full_name, other, n, m, i + 1, CASE WHEN j IS NULL THEN hit ELSE concat(hit, n[i + 1]) END, CASE WHEN j IS NULL THEN used ELSE list_append(used, j) END
      FROM (SELECT *, list_filter(range(greatest(1, i + 1 - r), least(length(m), i + 1 + r) + 1), lambda j: m[j] = n[i + 1] AND NOT list_contains(used, j))[1] AS j
        FROM (SELECT *, greatest(0, greatest(length(n), length(m)) // 2 - 1) AS r FROM w WHERE i < length(n)))),
    d AS (SELECT *, length(hit) AS k, list_sort(used) AS u FROM w WHERE i = length(n)),
    s AS (SELECT *, (k / length(n) + k / length(m) + (k - len(list_filter(range(1, k + 1), lambda x: hit[x] <> m[u[x]])) / 2) / k) / 3 AS jaro,
      list_max(list_filter(range(0, least(4, length(n), length(m)) + 1), lambda x: n[1:x] = m[1:x])) AS start FROM d WHERE k > 0),
    jw AS (SELECT full_name, other, n, m, CASE WHEN n = m THEN 1.0 ELSE jaro + start * 0.1 * (1 - jaro) END::DOUBLE AS jw FROM s
      UNION ALL SELECT full_name, other, n, m, CASE WHEN n = m THEN 1.0 ELSE 0.0 END FROM d WHERE k = 0)"""


@query("fn_04_jaro_winkler", f"{_JARO} SELECT full_name, other, round(jw, 6) AS score FROM jw")
def jaro_winkler(t: Tables) -> DataFrame:
    return _pairs(t).select("full_name", "other", F.round(N.jaro_winkler("n", "m"), 6).alias("score"))


@query("fn_05_levenshtein", f"SELECT full_name, other, round({_LEV}, 6)::DOUBLE AS score FROM ({_PAIRS})")
def levenshtein(t: Tables) -> DataFrame:
    return _pairs(t).select("full_name", "other", F.round(N.levenshtein_similarity(F.col("n"), F.col("m")), 6).alias("score"))


@query("fn_06_fuzzy", f"{_JARO} SELECT full_name, other, round(0.6 * jw + 0.4 * CASE WHEN n = m THEN 1.0 WHEN n = '' OR m = '' THEN 0.0 ELSE 1 - levenshtein(n, m) / greatest(length(n), length(m)) END, 6)::DOUBLE AS score FROM jw")
def fuzzy(t: Tables) -> DataFrame:
    return _pairs(t).select("full_name", "other", F.round(N.fuzzy(F.col("n"), F.col("m")), 6).alias("score"))


@query("fn_07_loose_score")
def loose_score(t: Tables) -> DataFrame:
    return _pairs(t).select("full_name", "other", N.loose_score("n", "m").alias("score"))


@query("fn_08_token_subset", f"""WITH s AS (SELECT full_name, other, list_distinct(string_split(n, ' ')) AS a, list_distinct(string_split(m, ' ')) AS b FROM ({_PAIRS}))
    SELECT full_name, other, CASE WHEN len(a) > 1 AND len(b) > 1 AND (list_has_all(b, a) OR list_has_all(a, b)) THEN 0.95 END::DOUBLE AS score FROM s""")
def token_subset(t: Tables) -> DataFrame:
    return _pairs(t).select("full_name", "other", N.token_subset(F.col("n"), F.col("m")).alias("score"))


@query("fn_09_nicknames", f"""WITH s AS (SELECT full_name, other, string_split(n, ' ')[1] AS a, string_split(m, ' ')[1] AS b FROM ({_PAIRS}))
    SELECT full_name, other, list_has_any(coalesce(x.v, [a]), coalesce(y.v, [b])) AS same FROM s LEFT JOIN {_NICK.replace("t(", "x(")} ON x.k = a LEFT JOIN {_NICK.replace("t(", "y(")} ON y.k = b""")
def nicknames(t: Tables) -> DataFrame:
    return _pairs(t).select("full_name", "other", N.nicknames(N.tokens(F.col("n"))[0], N.tokens(F.col("m"))[0]).alias("same"))


@query("fn_10_lastname_priority", f"""WITH s AS (SELECT full_name, other, string_split(n, ' ') AS a, string_split(m, ' ') AS b FROM ({_PAIRS})), u AS (SELECT ['{"', '".join(fixed.UNKNOWN_NAMES)}'] AS u),
    p AS (SELECT s.*, list_distinct(a[1:len(a) - 1]) AS x, list_distinct(b[1:len(b) - 1]) AS y, u FROM s, u WHERE len(a) > 1 AND len(b) > 1 AND a[-1] = b[-1]),
    v AS (SELECT p.*, list_distinct(flatten(list_transform(x, lambda e: coalesce(m.nick[e], [e])))) AS vx, list_distinct(flatten(list_transform(y, lambda e: coalesce(m.nick[e], [e])))) AS vy
      FROM p, (SELECT map(list(k), list(v)) AS nick FROM {_NICK}) m)
    SELECT s.full_name, s.other, CASE WHEN v.x IS NULL THEN NULL WHEN (list_has_any(x, u) AND len(list_filter(y, lambda e: NOT list_contains(u, e))) > 0) OR (list_has_any(y, u) AND len(list_filter(x, lambda e: NOT list_contains(u, e))) > 0) THEN 0.85
      WHEN list_has_any(x, y) OR list_has_any(vx, vy) THEN 0.9 END::DOUBLE AS score FROM s LEFT JOIN v ON s.full_name = v.full_name AND s.other = v.other""")
def lastname_priority(t: Tables) -> DataFrame:
    return _pairs(t).select("full_name", "other", N.lastname_priority(F.col("n"), F.col("m")).alias("score"))


@query("fn_11_cosine", """WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (ORDER BY vec_id) AS f FROM embeddings)
    SELECT vec_id, round(list_cosine_similarity(e, f), 6) AS similarity FROM q WHERE f IS NOT NULL""")
def cosine(t: Tables) -> DataFrame:
    after = t.embeddings.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("f"))
    return t.embeddings.join(after, "vec_id").select("vec_id", F.round(X.cosine(F.col("embedding"), F.col("f")), 6).alias("similarity"))


@query("fn_12_sha256", "SELECT doc_id, sha256(text) AS h FROM documents")
def sha256(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.sha256(F.col("text")).alias("h"))


@query("fn_13_claim_ref", """WITH r AS (SELECT id, concat(CASE id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'd' WHEN 2 THEN 'X' ELSE '' END, claim_ref % 1000) AS r FROM mentions)
    SELECT id, CASE id % 4 WHEN 0 THEN 'allegation' WHEN 1 THEN 'defense' END AS claim_type, CASE WHEN id % 4 < 2 THEN substr(r, 2)::INTEGER END AS claim_number FROM r""")
def claim_ref(t: Tables) -> DataFrame:
    ref = F.expr("concat(CASE id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'd' WHEN 2 THEN 'X' ELSE '' END, claim_ref % 1000)")
    return t.mentions.select("id", X.claim_ref(ref).alias("r")).select("id", "r.claim_type", "r.claim_number")


@query("fn_14_claim_label", "SELECT id, concat(upper(substr(claim_type, 1, 1)), claim_number_raw::BIGINT) AS label FROM claims")
def claim_label(t: Tables) -> DataFrame:
    return t.claims.select("id", X.claim_label(F.col("claim_type"), F.col("claim_number_raw").cast("long")).alias("label"))


@query("fn_15_role", "SELECT id, CASE role WHEN 'expert' THEN 'police_officer' WHEN 'attorney' THEN 'other' ELSE role END AS role FROM mentions")
def role(t: Tables) -> DataFrame:
    said = F.when(F.col("role") == "expert", "Police Officer").when(F.col("role") == "attorney", "wizard").otherwise(F.upper("role"))
    return t.mentions.select("id", X.role_of(said).alias("role"))


@query("fn_16_importance", "SELECT id, CASE WHEN importance = 'low' THEN 'medium' ELSE importance END AS importance FROM mentions")
def importance(t: Tables) -> DataFrame:
    return t.mentions.select("id", X.importance_of(F.when(F.col("importance") == "low", "?").otherwise(F.upper("importance"))).alias("importance"))


@query("fn_17_importance_of_relevance", "SELECT id, CASE relevance WHEN 'highly_relevant' THEN 'high' WHEN 'relevant' THEN 'medium' WHEN 'somewhat_relevant' THEN 'low' WHEN 'not_relevant' THEN 'low' ELSE 'medium' END AS importance FROM mentions")
def importance_of_relevance(t: Tables) -> DataFrame:
    return t.mentions.select("id", X.importance_from_relevance(F.col("relevance")).alias("importance"))


@query("fn_20_strip_tags", r"SELECT page_id, substr(regexp_replace(replace(replace(replace(replace(html, '<p>', '<mark>'), '<mark>', chr(1)), '</mark>', chr(2)), 'x', 'x'), '<[^>]+>', '', 'g').replace(chr(1), '<mark>').replace(chr(2), '</mark>'), 1, 500) AS t FROM pages")
def strip_tags(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.strip_tags(F.replace("html", F.lit("<p>"), F.lit("<mark>"))).alias("t"))


@query("fn_21_opinion_text", r"SELECT page_id, substr(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 1, 3000) AS t FROM pages")
def opinion_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.opinion_text(F.lit(""), F.col("html")).alias("t"))


@query("fn_25_report_text", """SELECT id, concat(full_name, ', ', CASE role WHEN 'eyewitness' THEN 'Eyewitness' WHEN 'attorney' THEN 'Attorney' WHEN 'expert' THEN 'Expert' ELSE 'Other' END, ', ', coalesce(email, 'Contact info unknown at this time')) AS info,
    concat(document_id, CASE WHEN source_page IS NULL THEN '' ELSE concat(' (Page ', source_page, ')') END) AS source FROM mentions""")
def report_text(t: Tables) -> DataFrame:
    from dossier.operators import reports as P

    rows = t.mentions.withColumns({"phone": F.lit(None).cast("string"), "address": F.lit(None).cast("string"), "filename": F.col("document_id").cast("string")})
    return rows.select("id", P.witness_info().alias("info"), P.source_document().alias("source"))


@query("fn_26_safe_filename", r"SELECT id, trim(regexp_replace(concat(filename, '/?'), '[^0-9A-Za-z \-_.,]', '', 'g')) AS f FROM filings")
def safe_filename(t: Tables) -> DataFrame:
    return t.filings.select("id", X.safe_filename(F.concat("filename", F.lit("/?"))).alias("f"))


@query("fn_27_case_identifier", "SELECT id, CASE WHEN client_name IS NULL THEN display_number ELSE concat(client_name, ' (', display_number, ')') END AS c FROM matters")
def case_identifier(t: Tables) -> DataFrame:
    return t.matters.select("id", X.case_identifier(F.col("client_name"), F.col("display_number")).alias("c"))


@query("fn_28_time_left", """WITH m AS (SELECT id, round(value * 60 / processed_documents * (total_documents - processed_documents) / 60)::BIGINT AS m FROM jobs WHERE processed_documents > 0)
    SELECT id, CASE WHEN m >= 60 THEN concat('~', m // 60, 'h ', m % 60, 'm') WHEN m >= 1 THEN concat('~', m, ' min') ELSE '< 1 min' END AS left_text FROM m""")
def time_left(t: Tables) -> DataFrame:
    rows = t.jobs.where("processed_documents > 0")
    return rows.select("id", X.time_left(F.col("processed_documents"), F.col("total_documents"), F.col("value") * 60).alias("left_text"))


@query("fn_29_json_repair", "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def json_repair(t: Tables) -> DataFrame:
    wrapped = F.expr("""CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('```json\n', props, '\n```') WHEN 2 THEN concat('Here it is: ', props, ' Done.') ELSE replace(props, '}', ',}') END""")
    return t.events.select("event_id", F.get_json_object(X.repaired_json(wrapped), "$.k").cast("long").alias("k"))


@query("fn_31_fixed_chunks", "SELECT doc_id, i AS chunk, length(substr(text, i * 2000 + 1, 2000)) AS chars FROM (SELECT doc_id, text, unnest(range((length(text) + 1999) // 2000)) AS i FROM documents)")
def fixed_chunks(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(X.fixed_chunks(F.col("text"), 2000)).alias("p", "piece")).select("doc_id", F.col("p").cast("long").alias("chunk"), F.length("piece").cast("long").alias("chars"))


#: The end of the chunk that starts in a text: behind the last sentence mark in its second half, marks in order of trial.
_END = "CASE WHEN {0} + 1000 < length(text) THEN coalesce(" + ", ".join(f"CASE WHEN length(regexp_extract(substr(text, {{0}} + 1, 1000), '(?s)^(.*){mark}', 1)) > 500 THEN length(regexp_extract(substr(text, {{0}} + 1, 1000), '(?s)^(.*){mark}', 1)) + 2 END" for mark in ("\\. ", "\\.\\n", "\\? ", "\\?\\n", "! ", "!\\n")) + ", 1000) ELSE 1000 END"
#: (doc_id, start, piece) of the chunks of the texts in d.
CHUNKS = f"""c AS (SELECT doc_id, text, 0::BIGINT AS start, ({_END.format("0")})::BIGINT AS e FROM d WHERE length(text) > 0
    UNION ALL SELECT doc_id, text, s, ({_END.format("s")})::BIGINT FROM (SELECT doc_id, text, start + e - 200 AS s FROM c) WHERE s < length(text)),
    p AS (SELECT * FROM (SELECT doc_id, start, regexp_replace(substr(text, start + 1, e), '^\\s+|\\s+$', '', 'g') AS piece FROM c) WHERE piece <> '')"""


@query("fn_32_sentence_chunks", f"WITH RECURSIVE d AS (SELECT doc_id, text FROM documents), {CHUNKS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INTEGER AS chunk_index, sha256(piece) AS h FROM p")
def sentence_chunks(t: Tables) -> DataFrame:
    return X.sentence_chunks(t.documents, ["doc_id"], "text").select("doc_id", "chunk_index", F.sha2("chunk_text", 256).alias("h"))


@query("fn_33_prompt_text", "SELECT conv_id, string_agg(concat('[', n, '] ', role, ': ', text), chr(10) ORDER BY n) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations) GROUP BY conv_id")
def prompt_text(t: Tables) -> DataFrame:
    """All turns of each conversation, whole, as numbered lines."""
    from dossier.operators import research as S

    line = F.concat_ws(": ", "role", F.coalesce("text", F.lit("")))
    return S.context_text(t.conversations, ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")], line, most=None).withColumnRenamed("context", "prompt")


_INNER, _OUTER = (bytes(k ^ pad for k in b"secret".ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))


@query("fn_30_hmac", f"SELECT event_id, sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(props)))) AS h FROM events")
def hmac(t: Tables) -> DataFrame:
    return t.events.select("event_id", X.hmac_sha256(F.col("props"), "secret").alias("h"))


@query("fn_34_folder_path", "SELECT c_custkey AS id, concat(r_name, '/', n_name, '/', c_name) AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def folder_path(t: Tables) -> DataFrame:
    from dossier.operators.sync import folder_tree
    from dossier.plans.ingesting import _folders

    return folder_tree(_folders(t)).where("depth = 2").select(F.substring("id", 2, 20).cast("long").alias("id"), "path")
