"""How the evidence tables are derived from the given tables: one SELECT each, the same text for Spark and the SQL twins."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_MENTION = "((l_orderkey * 100000 + l_partkey) * 1000 + l_suppkey % 1000) * 10 + l_linenumber"
VIEWS = {
    "matters": ("customer", """SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS user_id, concat('Matter ', c_custkey) AS description, concat('24-CV-', c_custkey) AS display_number,
        CASE WHEN c_acctbal < 0 THEN 'Closed' ELSE 'Open' END AS status, c_mktsegment AS practice_area,
        CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE concat('Client ', c_custkey % 97) END AS client_name, c_acctbal AS balance FROM customer"""),
    "filings": ("orders", """SELECT o_orderkey AS id, o_custkey AS matter_id,
        concat('doc ', o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN ' legal memo' ELSE '' END, '.pdf') AS filename,
        o_orderstatus = 'F' AS is_processed, o_orderkey % 11 = 0 AS is_soft_deleted, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS folder,
        o_orderkey % 12 AS retry_count, o_orderdate AS updated_at, CASE WHEN o_orderkey % 5 = 0 THEN 'failed to parse' END AS processing_error, o_totalprice AS size FROM orders"""),
    "mentions": ("lineitem", f"""SELECT {_MENTION} AS id, l_orderkey AS document_id, l_suppkey AS canonical_id, l_partkey AS claim_ref,
        concat(CASE l_suppkey % 7 WHEN 0 THEN 'John' WHEN 1 THEN 'Mike' WHEN 2 THEN 'Dr. Robert' WHEN 3 THEN 'Bob' WHEN 4 THEN 'Liz A.' WHEN 5 THEN 'FNU' ELSE 'Elizabeth' END,
          ' ', CASE l_partkey % 5 WHEN 0 THEN 'Carroll' WHEN 1 THEN 'Smith' WHEN 2 THEN 'O''Brien' WHEN 3 THEN 'Chen Jr.' ELSE 'Taylor' END) AS full_name,
        CASE l_linenumber % 4 WHEN 0 THEN 'eyewitness' WHEN 1 THEN 'attorney' WHEN 2 THEN 'expert' ELSE 'other' END AS role,
        CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'N' THEN 'medium' ELSE 'low' END AS importance,
        CASE l_partkey % 5 WHEN 0 THEN 'not_relevant' WHEN 1 THEN 'somewhat_relevant' WHEN 2 THEN 'relevant' WHEN 3 THEN 'highly_relevant' END AS relevance,
        CASE l_suppkey % 4 WHEN 0 THEN 'Counsel for the plaintiff, filed a motion' WHEN 1 THEN 'Testified that the attorney for defendant was late'
          WHEN 2 THEN 'Saw the accident' END AS observation,
        CASE WHEN l_partkey % 3 = 0 THEN concat('p', l_suppkey, '@Firm', l_suppkey % 4, '.com') END AS email,
        CASE WHEN l_partkey % 4 = 1 THEN concat('555-', l_partkey) END AS phone, CASE WHEN l_orderkey % 5 = 2 THEN concat(l_orderkey, ' Main St') END AS address,
        CASE WHEN l_partkey % 5 < 4 THEN concat('reason ', l_linenumber) END AS relevance_reason,
        CASE WHEN l_linenumber = 3 THEN NULL ELSE l_linenumber END AS source_page, l_discount * 10 AS confidence_score, l_shipdate AS created_at FROM lineitem"""),
    "canonicals": ("supplier", """SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS matter_id, s_name AS full_name, CASE s_suppkey % 3 WHEN 0 THEN 'expert' WHEN 1 THEN 'plaintiff' ELSE 'other' END AS role,
        CASE s_suppkey % 4 WHEN 0 THEN 'not_relevant' WHEN 1 THEN 'relevant' WHEN 2 THEN 'highly_relevant' END AS relevance, s_suppkey % 6 AS source_document_count FROM supplier"""),
    "claims": ("part", """SELECT p_partkey AS id, p_partkey % 50 AS matter_id, CASE WHEN p_size % 2 = 0 THEN 'allegation' ELSE 'defense' END AS claim_type,
        (p_partkey - p_partkey % 50) / 50 + 1 AS claim_number_raw, concat('Plaintiff alleges ', CASE p_partkey % 4 WHEN 0 THEN 'negligence and breach of contract' WHEN 1 THEN 'fraud by the employer'
          WHEN 2 THEN 'a ' ELSE 'wrongful death at the hospital, ' END, p_name) AS claim_text, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_retailprice / 2000 END AS confidence FROM part"""),
    "links": ("lineitem", f"""SELECT {_MENTION} AS witness_id, l_suppkey AS person_id, l_partkey AS case_claim_id,
        CASE WHEN l_returnflag = 'A' THEN 'undermines' WHEN l_returnflag = 'N' THEN 'supports' ELSE 'neutral' END AS relationship,
        concat('line ', l_linenumber) AS explanation FROM lineitem WHERE l_quantity < 5"""),
    "jobs": ("events", """SELECT event_id AS id, user_id, CASE event_type WHEN 'view' THEN 'completed' WHEN 'click' THEN 'processing' WHEN 'signup' THEN 'queued' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS status,
        event_id % 5 = 0 AS is_archived, event_id % 40 AS total_documents, CASE WHEN event_id % 3 = 0 THEN event_id % 40 ELSE event_id % 7 % (event_id % 40 + 1) END AS processed_documents,
        event_id % 700 + 1 AS matter_id, ts AS created_at, CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts END AS last_activity_at, value FROM events"""),
    "organizations": ("nation", """SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CASE n_nationkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'trialing' ELSE 'free' END AS subscription_status,
        CAST(n_nationkey % 5 AS BIGINT) AS bonus_credits FROM nation"""),
}


class Tables:
    """The given tables and the derived ones, read lazily by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            base, sql = VIEWS[name]
            return self.spark.sql(sql.replace(f"FROM {base}", "FROM {base}"), base=getattr(self, base))
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)

    @cached_property
    def now(self):
        """Reference time of the event log: never the clock."""
        return self.events.selectExpr("max(ts) AS now").first()["now"]


def with_views(sql: str) -> str:
    """The SQL twin with the derived tables that it names in front."""
    used = [f"{name} AS ({text})" for name, (_, text) in VIEWS.items() if name in sql]
    body = sql.strip()
    if not used:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(used)}, {body[15:]}"
    return f"WITH {', '.join(used)}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {', '.join(used)} {body}"
