"""Streams: change events, progress, usage, billing and answers.

A flow takes a streaming DataFrame and returns one; drain() runs it over what has arrived (availableNow), each micro-batch
into a folder of its own under the output path. A batch that is run again overwrites its folder, so results are exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, path: str, schema, per_batch: int = 4, form: str = "parquet") -> DataFrame:
    """Files (parquet or json lines) as a stream; path is a glob, a few files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(form).load(path)


#: JSON of document webhooks, and of billing events.
WEBHOOK = "id bigint, type string, data struct<id: bigint>"
BILLING = "id bigint, created timestamp_ntz, type string, organization_id bigint, status string, credits bigint"
CHANGES = ("document.created", "document.updated", "document.deleted")


def document_changes(hooks: DataFrame) -> DataFrame:
    """(type, external_id) of document webhooks; other types, and calls without an id, are ignored."""
    return hooks.where(F.col("type").isin(*CHANGES) & F.col("data.id").isNotNull()).select("type", F.col("data.id").alias("external_id"))


def billing_events(calls: DataFrame) -> DataFrame:
    """(event_id, ts, organization_id, type, new_status, credits) of billing calls of the five known types."""
    kinds = {"checkout.session.completed": "checkout", "customer.subscription.updated": "updated", "customer.subscription.deleted": "deleted", "invoice.payment_failed": "failed", "credits.purchased": "top_up"}
    kind = F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in kinds.items()])
    return calls.withColumn("kind", kind).where("kind IS NOT NULL").select(F.col("id").alias("event_id"), F.col("created").alias("ts"), "organization_id", F.col("kind").alias("type"), F.col("status").alias("new_status"), "credits")


def drain(flow: DataFrame, out: str, mode: str, checkpoint: str) -> None:
    """Runs a flow until it has caught up."""
    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/n={number}")

    flow.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def newest(spark: SparkSession, out: str, key: list[str]) -> DataFrame:
    """Results in update mode: the last batch's row of each key."""
    rows = spark.read.parquet(f"{out}/n=*")
    values = [c for c in rows.columns if c not in (*key, "batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("r")).select(*key, "r.*")


def timed(events: DataFrame) -> DataFrame:
    """Events whose ts can carry a watermark (naive times count as the session's)."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def last_triggered(events: DataFrame) -> DataFrame:
    """(event_type, last_triggered_at), update mode."""
    return events.groupBy("event_type").agg(F.max("ts").alias("last_triggered_at"))


def subscriptions(events: DataFrame) -> DataFrame:
    """(user_id, renewed_at, expires_at): 31 days after the last renewal, update mode."""
    return events.groupBy("user_id").agg(F.max("ts").alias("renewed_at")).withColumn("expires_at", F.col("renewed_at") + F.expr("INTERVAL 31 DAYS"))


def progress(events: DataFrame, key: str, total: int) -> DataFrame:
    """(key, processed, last_activity_at), processed clamped at the total, update mode."""
    return events.groupBy(key).agg(F.least(F.count("*"), F.lit(total)).alias("processed"), F.max("ts").alias("last_activity_at"))


def daily_usage(events: DataFrame, key: str) -> DataFrame:
    """(key, day) of each event; see count_stream for the counts."""
    return timed(events).select(key, F.to_date("ts").alias("day"))


def _parts(spark: SparkSession, out: str) -> tuple[int, list[str]]:
    """The last batch that finished sums cover (-1: none), and the folders that make up the counts."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    folder = path(out)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
    done = [int(n[5:]) for n in names if n.startswith("upto=") and fs.exists(path(f"{out}/{n}", "_SUCCESS"))]
    last = max(done, default=-1)
    return last, ([f"{out}/upto={last}"] if done else []) + [f"{out}/n={n}" for n in sorted(int(x[2:]) for x in names if x.startswith("n=")) if n > last]


def count_stream(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Counts equal rows of a stream without any state: each micro-batch writes its own counts, which counted() adds up.

    So a row counts whenever it comes, however late, and what the stream keeps does not grow; compacted() folds the batches
    that are done into one. A batch that runs again overwrites its counts.
    """
    def save(batch: DataFrame, number: int) -> None:
        batch.groupBy(*batch.columns).agg(F.count("*").alias("used")).write.mode("overwrite").parquet(f"{out}/n={number}")

    rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def counted(spark: SparkSession, out: str) -> DataFrame:
    """The counts of all micro-batches so far."""
    rows = spark.read.parquet(*_parts(spark, out)[1])
    return rows.groupBy(*[c for c in rows.columns if c != "used"]).agg(F.sum("used").alias("used"))


def compacted(spark: SparkSession, out: str) -> None:
    """Writes the sums of the batches that are done as one folder, then deletes what it covers; readers see either, never both."""
    last, folders = _parts(spark, out)
    newest = max((int(f.rsplit("n=", 1)[1]) for f in folders if "/n=" in f), default=last)
    if newest > last:
        counted(spark, out).write.mode("overwrite").parquet(f"{out}/upto={newest}")
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def subscription_state(events: DataFrame) -> DataFrame:
    """(organization_id, status, credits): the last of checkout, update, delete or failure by time; top-ups add up."""
    status = F.when(F.col("type") == "checkout", "active").when(F.col("type") == "updated", F.col("new_status")).when(F.col("type") == "deleted", "canceled").when(F.col("type") == "failed", "past_due")
    marked = events.withColumn("s", status)
    last = F.max_by("s", F.when(F.col("s").isNotNull(), F.struct("ts", "event_id")))
    return marked.groupBy("organization_id").agg(last.alias("status"), F.sum(F.when(F.col("type") == "top_up", F.col("credits")).otherwise(0)).alias("credits"))


def apply_changes(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Documents (external_id, content_hash, is_processed, is_soft_deleted) after change events (type, external_id).

    An update clears hash and flag, a delete soft-deletes; creations and unknown ids change nothing. Applying a batch
    again gives the same.
    """
    folded = batch.groupBy("external_id").agg(F.bool_or(F.col("type") == "document.updated").alias("u"), F.bool_or(F.col("type") == "document.deleted").alias("d"))
    joined = state.join(folded, "external_id", "left")
    u, d = F.coalesce("u", F.lit(False)), F.coalesce("d", F.lit(False))
    return joined.select("external_id", F.when(~u, F.col("content_hash")).alias("content_hash"), (F.col("is_processed") & ~u).alias("is_processed"), (F.col("is_soft_deleted") | d).alias("is_soft_deleted"))


BUCKETS = 64


def _versions(spark: SparkSession, out: str) -> dict[int, list[int]]:
    """The versions of each bucket of a state folder; versions whose write was not finished do not count."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    folder, found = path(out), {}
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for v in fs.listStatus(folder) if fs.exists(folder) else []:
        if fs.exists(path(v.getPath(), "_SUCCESS")):
            for b in fs.listStatus(v.getPath()):
                if b.getPath().getName().startswith("bucket="):
                    found.setdefault(int(b.getPath().getName()[7:]), []).append(int(v.getPath().getName()[2:]))
    return found


def _state(spark: SparkSession, out: str, newest: dict[int, int], schema) -> DataFrame:
    paths = [f"{out}/v={v}/bucket={b}" for b, v in sorted(newest.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def change_stream(events: DataFrame, state: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs apply_changes over a stream: every batch reads the newest version of the buckets of ids that it touches and
    writes only those, as version n. With an existing checkpoint the state folder is kept as it is: the run goes on from
    the newest committed versions, and without new files it returns those. A repeated batch reads versions before its own."""
    spark, schema = state.sparkSession, state.schema
    bucket = F.pmod(F.xxhash64("external_id"), F.lit(BUCKETS)).cast("int")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    if not (path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) and _versions(spark, out)):
        folder = spark._jvm.org.apache.hadoop.fs.Path(out)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        state.withColumn("bucket", bucket).repartition(BUCKETS, "bucket").write.partitionBy("bucket").parquet(f"{out}/v=-1")

    def save(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("bucket", bucket)
        touched = {r["bucket"] for r in batch.select("bucket").distinct().collect()}  # BUCKETS at most
        before = {b: max((v for v in versions if v < number), default=None) for b, versions in _versions(spark, out).items() if b in touched}
        old = _state(spark, out, {b: v for b, v in before.items() if v is not None}, schema)
        new = apply_changes(old, batch.drop("bucket")).select(*schema.names).withColumn("bucket", bucket)
        new.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/v={number}")

    events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return _state(spark, out, {b: max(v) for b, v in _versions(spark, out).items()}, schema)
