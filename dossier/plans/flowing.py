"""Streams run over the event files until they have caught up: STR, SRC-09, SRC-10."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.names import strict
from dossier.plans.bindings import Tables
from dossier.plans.registry import query
from dossier.sources import landing as L
from dossier.sources import paged_source
from dossier.sources.shared import materialize, scratch
from dossier.streaming import flows as S
from dossier.streaming import timeouts as T


def _folder(t: Tables) -> str:
    return scratch(t.spark, "flow")


FILES, PER_BATCH, FILE_ROWS = 6, 2, 10_000_000


def _landed(t: Tables, df: DataFrame, form: str = "parquet") -> str:
    """Rows as they land: in several files, so that a stream over them takes several micro-batches."""
    folder = _folder(t)
    df.repartition(FILES).write.format(form).save(folder)
    return f"{folder}/part-*"


def _landed_in_order(t: Tables, df: DataFrame, order: str) -> str:
    """Rows as they land in the order of a column: file after file, so that no file has a row before those of the files ahead of it."""
    folder, place = _folder(t), F.col(order).cast("double")
    files = max(FILES, df.count() // FILE_ROWS + 1)
    cuts = df.select(place.alias("p")).approxQuantile("p", [i / files for i in range(1, files)], 0.01)
    number = sum((F.coalesce(place > c, F.lit(False)).cast("int") for c in sorted(set(cuts))), F.lit(0))
    for i in range(len(set(cuts)) + 1):
        df.where(number == i).repartition(1).write.parquet(f"{folder}/{i}")
    return f"{folder}/*/part-*"


def _arriving(t: Tables, table: str) -> DataFrame:
    rows = getattr(t, table)
    return S.arriving(t.spark, _landed(t, rows), rows.schema, PER_BATCH)


def _latest(t: Tables, flow: DataFrame, key: list[str]) -> DataFrame:
    folder = _folder(t)
    S.drain(flow, f"{folder}/out", "update", f"{folder}/checkpoint")
    return S.newest(t.spark, f"{folder}/out", key)


@query("str_01_changes", """WITH e AS (SELECT event_id % 1000 AS id, bool_or(event_type = 'click') AS u, bool_or(event_type = 'error') AS d FROM events GROUP BY 1)
    SELECT doc_id AS external_id, NOT coalesce(u, false) AS is_processed, coalesce(d, false) AS is_soft_deleted FROM documents LEFT JOIN e ON e.id = doc_id""")
def changes(t: Tables) -> DataFrame:
    """Webhook calls as JSON lines; purchases are calls of another type, views creations, and ids may be unknown."""
    kind = F.expr("CASE event_type WHEN 'click' THEN 'document.updated' WHEN 'error' THEN 'document.deleted' WHEN 'purchase' THEN 'matter.updated' ELSE 'document.created' END")
    calls = t.events.select(F.col("event_id").alias("id"), kind.alias("type"), F.struct((F.col("event_id") % 1000).alias("id")).alias("data"))
    hooks = S.arriving(t.spark, _landed(t, calls, "json"), S.WEBHOOK, PER_BATCH, "json")
    state = t.documents.select(F.col("doc_id").alias("external_id"), F.sha2("text", 256).alias("content_hash"), F.lit(True).alias("is_processed"), F.lit(False).alias("is_soft_deleted"))
    folder = _folder(t)
    return S.change_stream(S.document_changes(hooks), state, f"{folder}/state", f"{folder}/checkpoint").drop("content_hash")


@query("src_09_page_stream", "SELECT event_type, count(*) AS calls, sum(event_id)::BIGINT AS ids FROM events GROUP BY event_type")
def page_stream(t: Tables) -> DataFrame:
    """Webhook calls in landed pages, read as a stream of the registered format in two runs, the second from its offsets."""
    call = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")))
    pages = t.events.groupBy(F.floor(F.col("event_id") / 500).alias("page")).agg(F.concat(F.lit('{"data":['), F.array_join(F.array_sort(F.collect_list(call)), ","), F.lit("]}")).alias("value"))  # 500 a page
    pages, folder = materialize(pages, "pages"), _folder(t)
    half = (pages.agg(F.max("page")).first()[0] or 0) // 2
    calls = paged_source.registered(t.spark).readStream.format("landed_pages").load(f"{folder}/in")
    for part in ("page <= ", "page > "):
        paged_source.land(pages.where(f"{part}{half}"), f"{folder}/in")
        S.drain(calls, f"{folder}/out", "append", f"{folder}/checkpoint")
    rows = t.spark.read.parquet(f"{folder}/out/n=*")
    return rows.groupBy(F.get_json_object("item", "$.type").alias("event_type")).agg(F.count("*").alias("calls"), F.sum("id").alias("ids"))


@query("str_02_last_triggered", "SELECT event_type, max(ts) AS last_triggered_at FROM events GROUP BY event_type")
def last_triggered(t: Tables) -> DataFrame:
    return _latest(t, S.last_triggered(_arriving(t, "events")), ["event_type"])


@query("str_03_subscriptions", "SELECT user_id, max(ts) AS renewed_at, max(ts) + INTERVAL 31 DAY AS expires_at FROM events GROUP BY user_id")
def subscriptions(t: Tables) -> DataFrame:
    return _latest(t, S.subscriptions(_arriving(t, "events")), ["user_id"])


@query("str_04_progress", "SELECT user_id, least(count(*), 60) AS processed, max(ts) AS last_activity_at FROM events GROUP BY user_id")
def progress(t: Tables) -> DataFrame:
    return _latest(t, S.progress(_arriving(t, "events"), "user_id", 60), ["user_id"])


_RUNS = """SELECT {gap} AS minutes, user_id, min(ts) AS started, max(ts) + INTERVAL {gap} MINUTE AS ended, count(*) AS events, max(ts) + INTERVAL {gap} MINUTE <= (SELECT max(ts) FROM events) AS closed FROM (
    SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL {gap} MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, run"""


@query("str_05_inactivity", " UNION ALL ".join(_RUNS.replace("{gap}", str(g)) for g in (5, 30)))
def inactivity(t: Tables) -> DataFrame:
    """Both rules in one stream over the log as it came: jobs time out after 5 minutes, syncs after 30."""
    log = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    folder, arriving = _folder(t), S.arriving(t.spark, _landed_in_order(t, log, "ts"), log.schema, PER_BATCH)
    with T.rocks(t.spark):
        S.drain(T.time_outs(arriving, "user_id", [5, 30]), f"{folder}/out", "update", f"{folder}/checkpoint")
    return T.latest_runs(t.spark, f"{folder}/out", "user_id")


@query("str_06_daily_usage", "SELECT user_id, ts::DATE::VARCHAR AS day, count(*) AS used FROM events WHERE event_type = 'purchase' GROUP BY 1, 2")
def daily_usage(t: Tables) -> DataFrame:
    folder = _folder(t)
    S.count_stream(S.daily_usage(_arriving(t, "events").where("event_type = 'purchase'"), "user_id"), f"{folder}/out", f"{folder}/checkpoint")
    S.compacted(t.spark, f"{folder}/out")
    return S.counted(t.spark, f"{folder}/out").withColumn("day", F.col("day").cast("string"))


@query("str_07_billing", """SELECT user_id % 25 AS organization_id, arg_max(CASE event_type WHEN 'signup' THEN 'active' WHEN 'click' THEN 'trialing' WHEN 'error' THEN 'canceled' WHEN 'view' THEN 'past_due' END, (ts, event_id))
    FILTER (WHERE event_type <> 'purchase') AS status, sum(CASE WHEN event_type = 'purchase' THEN floor(value) ELSE 0 END)::BIGINT AS credits FROM events GROUP BY 1""")
def billing(t: Tables) -> DataFrame:
    """Billing calls as JSON lines, a call of an unknown type beside each third."""
    kind = F.expr("CASE event_type WHEN 'signup' THEN 'checkout.session.completed' WHEN 'click' THEN 'customer.subscription.updated' WHEN 'error' THEN 'customer.subscription.deleted' WHEN 'view' THEN 'invoice.payment_failed' ELSE 'credits.purchased' END")
    calls = t.events.select(F.col("event_id").alias("id"), F.col("ts").alias("created"), kind.alias("type"), (F.col("user_id") % 25).alias("organization_id"), F.lit("trialing").alias("status"), F.floor("value").alias("credits"))
    calls = calls.unionByName(calls.where("id % 3 = 0").withColumn("type", F.lit("invoice.created")))
    events = S.billing_events(S.arriving(t.spark, _landed(t, calls, "json"), S.BILLING, PER_BATCH, "json"))
    return _latest(t, S.subscription_state(events), ["organization_id"])


@query("str_08_answers", """SELECT role AS text, count(*) AS n FROM conversations GROUP BY role""")
def answers(t: Tables) -> DataFrame:
    body = F.concat(F.lit('{"recordId":"'), "conv_id", F.lit("-"), "turn", F.lit('","modelOutput":{"content":[{"type":"text","text":"'), "role", F.lit('"}]}}'))
    lines = _arriving(t, "conversations").select(F.from_json(body, L.ANSWER).alias("a")).where("a.recordId IS NOT NULL")
    return _latest(t, lines.groupBy(F.col("a.modelOutput.content")[0]["text"].alias("text")).agg(F.count("*").alias("n")), ["text"])


@query("str_09_incremental_people")
def incremental_people(t: Tables) -> DataFrame:
    """Mentions that come with the events fold into the people that stand; see resolve for the rules."""
    name = F.expr("concat(CASE user_id % 4 WHEN 0 THEN 'John' WHEN 1 THEN 'Mike' WHEN 2 THEN 'Bob' ELSE 'Robert' END, CASE event_id % 7 WHEN 0 THEN ' A.' ELSE '' END, ' ', CASE event_id % 3 WHEN 0 THEN 'Carroll' WHEN 1 THEN 'Smith' ELSE 'Chen' END)")
    mail = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("u"), "user_id", F.lit("@firm.com")))
    none = F.lit(None).cast("string")
    said = t.events.select(F.col("event_id").alias("id"), (F.col("event_id") % 50).alias("matter_id"), F.col("event_id").alias("place"), name.alias("full_name"), F.col("event_type").alias("role"), none.alias("observation"), mail.alias("email"), none.alias("phone"), none.alias("address"))
    folder = _folder(t)
    arriving = S.arriving(t.spark, _landed_in_order(t, said, "place"), said.schema, PER_BATCH).withColumn("form", strict(F.col("full_name"), folded=True))
    with T.rocks(t.spark):
        S.drain(T.standing_people(arriving), f"{folder}/out", "append", f"{folder}/checkpoint")
    return t.spark.read.parquet(f"{folder}/out/n=*").drop("batch")
