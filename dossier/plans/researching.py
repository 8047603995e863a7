"""Case law, retrieval and rule functions over claims: RAG, RES, SRC-08, JN-12 to JN-14, FN-18, FN-19, FN-22 to FN-24, UDF-07, UDF-09."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions import fixed, hooks, rules
from dossier.functions.text import sentence_chunks
from dossier.operators import research as S
from dossier.operators import vector_index
from dossier.plans.bindings import Tables
from dossier.plans.naming import CHUNKS
from dossier.plans.registry import query
from dossier.sources.shared import scratch


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _case(column: str, table: dict) -> str:
    return "CASE " + " ".join(f"WHEN {_any(column, w)} THEN '{k}'" for k, w in table.items()) + " END"


@query("src_08_case_law", """SELECT id, claim_text AS case_name, CASE WHEN id % 2 = 0 THEN concat(id, ' Cal. 4th') ELSE 'single' END AS citation,
    concat('https://courts.example/opinion/', id) AS absolute_url, CASE WHEN id % 5 = 0 THEN 0.0 ELSE id / 10 END::DOUBLE AS score FROM claims""")
def case_law(t: Tables) -> DataFrame:
    return S.case_rows(_cases(t), "raw").select("id", "case_name", "citation", "absolute_url", "score")


def _cases(t: Tables) -> DataFrame:
    raw = F.concat(F.lit('{"id":'), "id", F.lit(',"caseName":"'), "claim_text", F.expr("""CASE WHEN id % 2 = 0 THEN concat('","citation":["', id, ' Cal. 4th"]') ELSE '","citation":"single"' END"""), F.lit(',"snippet":"<b>text</b> of <mark>it</mark>","absolute_url":"/opinion/'), "id", F.lit('","score":'), F.expr("CASE WHEN id % 5 = 0 THEN '\"n/a\"' ELSE cast(id / 10 AS string) END"), F.lit("}"))
    return t.claims.select("id", "matter_id", raw.alias("raw"))


@query("fn_18_jurisdiction", "SELECT id, CASE WHEN contains(display_number, 'CV') THEN 'federal' ELSE 'state' END AS court_type FROM matters")
def jurisdiction(t: Tables) -> DataFrame:
    return t.matters.select("id", rules.jurisdiction(F.col("display_number"))["court_type"].alias("court_type"))


@query("fn_19_court_filter", "SELECT id, CASE id % 3 WHEN 0 THEN 'ca9 cacd cand casd caed' WHEN 1 THEN 'scotus ca9' ELSE 'cal calctapp' END AS f FROM matters")
def court_filter(t: Tables) -> DataFrame:
    number = F.expr("CASE id % 3 WHEN 0 THEN display_number WHEN 1 THEN '2:24' ELSE 'X' END")
    return t.matters.select("id", rules.court_filter(rules.jurisdiction(number)).alias("f"))


@query("fn_22_defendant", "SELECT id, CASE WHEN client_name IS NOT NULL THEN concat(client_name, ' Inc.') END AS d FROM matters")
def defendant(t: Tables) -> DataFrame:
    name = F.expr("CASE WHEN client_name IS NULL THEN 'In re X' WHEN id % 2 = 0 THEN concat('Roe v. ', client_name, ' Inc. - 2024') ELSE concat('against defendant ', client_name, ' Inc. - late') END")
    return t.matters.select("id", rules.defendant_name(name).alias("d"))


@query("fn_23_characteristics", f"""WITH c AS (SELECT matter_id, id, {_case('lower(claim_text)', fixed.DEFENDANTS)} AS d, {_case('lower(claim_text)', fixed.HARMS)} AS h FROM claims)
    SELECT matter_id, arg_min(d, id) FILTER (WHERE d IS NOT NULL) AS defendant_type, arg_min(h, id) FILTER (WHERE h IS NOT NULL) AS harm_type FROM c GROUP BY matter_id""")
def characteristics(t: Tables) -> DataFrame:
    low = F.lower("claim_text")
    c = t.claims.select("matter_id", "id", rules.first_of(low, fixed.DEFENDANTS).alias("d"), rules.first_of(low, fixed.HARMS).alias("h"))
    return c.groupBy("matter_id").agg(*[F.min_by(x, F.when(F.col(x).isNotNull(), F.col("id"))).alias(n) for x, n in (("d", "defendant_type"), ("h", "harm_type"))])


@query("fn_23_theories", " UNION ALL ".join(f"SELECT id, '{k}' AS theory FROM claims WHERE {_any('lower(claim_text)', w)}" for k, w in fixed.THEORIES.items()))
def theories(t: Tables) -> DataFrame:
    return t.claims.select("id", F.explode(rules.theories(F.col("claim_text"))).alias("theory"))


_ASKED = """a AS (SELECT id AS matter_id, id, CASE WHEN id % 4 <> 2 THEN claim_text WHEN id % 3 = 0 THEN concat('They are liable for lost wages. A cause of action for deceit ', id, ', liable for lost wages') WHEN id % 3 = 1 THEN concat('Plaintiff says that it never happened here ', id) ELSE 'x' END AS claim_text FROM claims),
    o AS (SELECT id AS matter_id, id, concat('Saw, the crash! No. ', id, ' & more') AS observation FROM claims WHERE id % 5 > 0)"""


@query("fn_23_key_facts", "SELECT document_id AS matter_id, n::INTEGER AS fact_no, observation AS fact FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY id) AS n FROM mentions) WHERE n <= 5 AND observation IS NOT NULL")
def key_facts(t: Tables) -> DataFrame:
    return S.key_facts(t.mentions.withColumnRenamed("document_id", "matter_id"), ["matter_id"])


@query("fn_24_concept_queries", f"WITH {_ASKED}, f AS (" + " UNION ALL ".join(f"SELECT id, {i} AS n, '{c[0]}' AS q FROM a WHERE {_any('lower(claim_text)', c)}" for i, c in enumerate(fixed.CONCEPTS)) + """),
    k AS (SELECT id, string_agg(q, '|' ORDER BY n) AS queries FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) AS k FROM f) WHERE k <= 5 GROUP BY id),
    p AS (SELECT id, concat('deceit ', id, '|lost wages') AS queries FROM a WHERE id % 12 = 6),
    s AS (SELECT id, substr(concat('says that it never happened here'), 1, 100) AS queries FROM a WHERE id % 4 = 2 AND id % 3 = 1),
    w AS (SELECT id, trim(substr(regexp_replace(regexp_replace(observation, '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'), 1, 100)) AS queries FROM o WHERE id % 4 = 2 AND id % 3 = 2)
    SELECT id AS matter_id, coalesce(k.queries, p.queries, s.queries, w.queries) AS queries FROM a LEFT JOIN k USING (id) LEFT JOIN p USING (id) LEFT JOIN s USING (id) LEFT JOIN w USING (id) WHERE coalesce(k.queries, p.queries, s.queries, w.queries) IS NOT NULL""")
def concept_queries(t: Tables) -> DataFrame:
    """Search terms of each claim by concept, by phrase, from its plain words, or from an observation."""
    asked = F.expr("CASE WHEN id % 4 <> 2 THEN claim_text WHEN id % 3 = 0 THEN concat('They are liable for lost wages. A cause of action for deceit ', id, ', liable for lost wages') WHEN id % 3 = 1 THEN concat('Plaintiff says that it never happened here ', id) ELSE 'x' END")
    claims = t.claims.select(F.col("id").alias("matter_id"), "id", asked.alias("claim_text"))
    seen = t.claims.where("id % 5 > 0").select(F.col("id").alias("matter_id"), "id", F.concat(F.lit("Saw, the crash! No. "), "id", F.lit(" & more")).alias("observation"))
    return S.search_queries(claims, seen).select("matter_id", F.array_join("queries", "|").alias("queries"))


@query("udf_07_query_lines", """SELECT id, 1 AS pos, claim_text AS line FROM claims WHERE length(claim_text) BETWEEN 6 AND 99
    UNION ALL SELECT id, CASE WHEN length(claim_text) BETWEEN 6 AND 99 THEN 2 ELSE 1 END, concat('Roe v. ', id) FROM claims""")
def query_lines(t: Tables) -> DataFrame:
    """Bullets and numbers go, lines of under six characters too."""
    answer = F.concat(F.lit("1. "), "claim_text", F.lit("\n- abc\n  * Roe v. "), "id")
    return t.claims.select("id", F.posexplode(hooks.query_lines(answer)).alias("pos", "line")).withColumn("pos", F.col("pos") + 1)


@query("udf_09_safe_query", "SELECT id, id % 4 > 0 AS is_safe FROM claims")
def safe_query(t: Tables) -> DataFrame:
    answer = F.when(F.col("id") % 4 == 0, F.concat(F.lit("call 555-123-4567 "), "claim_text")).otherwise("breach of duty")
    return t.claims.select("id", hooks.safe_query(answer).isNotNull().alias("is_safe"))


@query("rag_01_authority_chunks", f"""WITH RECURSIVE f AS (SELECT source, min(doc_id) AS doc_id, arg_min(text, doc_id) AS text FROM documents GROUP BY source, sha256(text)), d AS (SELECT doc_id, text FROM f), {CHUNKS}
    SELECT source, doc_id, count(*) AS chunks FROM p JOIN f USING (doc_id) GROUP BY source, doc_id""")
def authority_chunks(t: Tables) -> DataFrame:
    first = t.documents.groupBy("source", F.sha2("text", 256).alias("h")).agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("doc_id"))
    chunks = sentence_chunks(first, ["source", "doc_id"], "text")
    return chunks.groupBy("source", "doc_id").agg(F.count("*").alias("chunks"))


@query("rag_02_nearest", """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(c.e, q.e), 9) AS s
      FROM v q JOIN v c ON q.label = c.label WHERE q.vec_id % 100 = 0)
    SELECT query_id, chunk_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM s) WHERE rank <= 5""")
def nearest(t: Tables) -> DataFrame:
    queries = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("matter_id"), F.col("embedding").alias("q"))
    chunks = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("matter_id"), F.col("embedding").alias("e"))
    return S.nearest_chunks(queries, chunks).select("query_id", "chunk_id", "rank")


@query("rag_02_indexed")
def indexed(t: Tables) -> DataFrame:
    """The same questions through an inverted-file index over all rows, which is written and probed."""
    queries = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("matter_id"), F.col("embedding").alias("q"))
    chunks = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("matter_id"), F.col("embedding").alias("e"))
    return vector_index.InvertedFile.build(chunks, scratch(t.spark, "index")).search(queries).select("query_id", "chunk_id", "rank")


@query("rag_03_context", """WITH c AS (SELECT source, lang, string_agg(concat('[', n, '] ', text), chr(10) ORDER BY n) AS x FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents) WHERE n <= 3 GROUP BY ALL)
    SELECT s.source, l.role AS lang, sha256(coalesce(c.x, 'external')) AS context FROM (SELECT DISTINCT source FROM documents) s CROSS JOIN (SELECT DISTINCT lang AS role FROM documents UNION SELECT 'none') l LEFT JOIN c ON c.source = s.source AND c.lang = l.role""")
def context(t: Tables) -> DataFrame:
    """The first three documents of each source and language as context; a combination without any falls back."""
    local = S.context_text(t.documents, ["source", "lang"], [F.col("doc_id")], F.col("text"), most=3)
    none = t.documents.select("source").distinct().withColumn("lang", F.lit("none"))
    langs = t.documents.select("lang").distinct().withColumn("k", F.lit(1))
    asked = none.unionByName(t.documents.select("source").distinct().withColumn("k", F.lit(1)).join(langs, "k").select("source", "lang"))
    return asked.join(local, ["source", "lang"], "left").select("source", "lang", F.sha2(F.coalesce("context", F.lit("external")), 256).alias("context"))


def _results(t: Tables) -> DataFrame:
    found = S.case_rows(_cases(t), "raw").select("id", "matter_id", "case_name", "snippet", "score", (F.col("id") % 300).alias("case_id"))
    return found.withColumns({"query_no": F.col("id") % 3, "pos": F.col("id")})


_RESULTS = """r AS (SELECT id, matter_id, id % 300 AS case_id, CASE WHEN id % 5 = 0 THEN 0.0 ELSE id / 10 END AS score, row_number() OVER (PARTITION BY matter_id, id % 300 ORDER BY id % 3, id) AS n FROM claims),
    k AS (SELECT *, row_number() OVER (PARTITION BY matter_id ORDER BY score DESC, case_id) AS rank FROM r WHERE n = 1)"""


@query("res_01_ranked_cases", f"WITH {_RESULTS} SELECT matter_id, id, rank::INTEGER AS rank FROM k WHERE rank <= 4")
def ranked_cases(t: Tables) -> DataFrame:
    return S.ranked_cases(_results(t), most=4).select("matter_id", "id", "rank")


@query("res_02_with_analysis", f"""WITH {_RESULTS} SELECT matter_id, id, CASE WHEN id % 4 = 0 THEN 5.0 ELSE id % 11 END::DOUBLE AS model_score FROM k WHERE rank <= 4 AND CASE WHEN id % 4 = 0 THEN 5.0 ELSE id % 11 END >= 5""")
def with_analysis(t: Tables) -> DataFrame:
    cases = S.ranked_cases(_results(t), most=4).drop("case_id").withColumn("case_id", F.col("id"))
    said = t.claims.where("id % 4 > 0").select(F.col("id").alias("case_id"), F.explode(F.array(F.lit("relevance"), F.lit("irac"))).alias("kind"), (F.col("id") % 11).cast("double").alias("score"), F.col("claim_text").alias("text"))
    return S.with_analysis(cases, said).select("matter_id", "id", "model_score")


@query("res_03_decisions", """SELECT id, CASE WHEN status = 'completed' AND id % 3 = 0 THEN 'approved' WHEN status IN ('completed', 'queued') AND id % 3 = 1 THEN 'dismissed' ELSE status END AS status FROM jobs""")
def decisions(t: Tables) -> DataFrame:
    decided = t.jobs.where("id % 3 < 2").select("id", F.expr("CASE WHEN id % 3 = 0 THEN 'approve' ELSE 'dismiss' END").alias("decision"))
    new = F.when((F.col("decision") == "approve") & (F.col("status") == "completed"), "approved").when((F.col("decision") == "dismiss") & F.col("status").isin("completed", "queued"), "dismissed")
    return t.jobs.join(decided, "id", "left").select("id", F.coalesce(new, "status").alias("status"))
