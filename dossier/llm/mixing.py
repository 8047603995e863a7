"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets: the sources share the corpus's words by weight; no target exceeds ``MOST`` times its source's words, the excess is
shared again by weight until none is above (solved in closed form over the sources in the order in which they fill up).
Schedule: the words are cut into about ``SLOTS`` slots of equal size; golden-ratio points, mapped through the cumulative
slot counts, say which source each slot takes; the slots of a source are ranked. Blocks: a source's documents in shuffled
order are cut into blocks as large as a slot, and slot r takes block r mod (number of blocks), so a source that must give
more than it has starts its next epoch; the last slot stops at the target. A document is taken as often as slots cover its
words; its place is that of the slot of the block it starts in, and the mixed corpus is put in the order of places, so that
any stretch of it holds the sources in about their shares. The schedule is bounded by SLOTS and the number of sources (few
by nature: one row each meets in one task); running word counts are taken over hash buckets of about ``BUCKET_ROWS`` rows
and joined to bucket offsets, so no source is gathered in one task.

Defined results: null text or one without words: size 0, taken 0, no place. Whole texts of any length are counted; one
longer than a slot starts in one block and covers several. A null source is a source of its own, last in order.
Rows that repeat are documents of their own. The shuffled order hashes id and text, so rows without an id or of one id spread
over all buckets as far as their texts differ. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import SPACE, materialize, table
from dossier.llm.shuffle_shards import PRIME, _sql_dealing, _sql_mix, dealing, keys, mix

SLOTS, MOST, BUCKETS, BUCKET_ROWS, SEED = 16_384, 3, 512, 65_536, 77
#: Tables of a row for each source or bucket are broadcast up to so many rows, so that a large source is no join key.
BROADCAST_ROWS = 200_000
#: 2**32 divided by the golden ratio, rounded to an odd number.
GOLDEN = 2_654_435_769


def _few(df: DataFrame, rows: int) -> DataFrame:
    """A table whose rows have been counted, broadcast where they are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def place_key(id_: Column, text: Column) -> Column:
    """The place of a row in the shuffled order of its source."""
    digits = F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 7)
    return mix(dealing(id_, F.conv(digits, 16, 10).cast("long")), keys(SEED, 1)[0])


def targets(sizes: DataFrame) -> DataFrame:
    """(source, sid, source_size, weight, target) from (source, size); one row for each source, few by nature."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("sid", F.row_number().over(order) - 1).withColumn("weight", (F.col("sid") % 3 + 1).cast("long"))
    # Sources fill up in the order of (most they may give) / weight; until then each gives level * weight.
    sources = sources.withColumns({"most": F.col("source_size") * MOST, "total": F.sum("source_size").over(everything)})
    filling = everything.orderBy(F.col("most") / F.col("weight"), "sid")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    sources = sources.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(rest))
    full_at = F.col("most") / F.col("weight")
    level = F.min(F.when(full_at >= F.col("level"), F.struct(full_at.alias("at"), "sid", "level"))).over(everything)["level"]
    target = F.least(F.col("most").cast("double"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return sources.withColumn("target", target).select("source", "sid", "source_size", "weight", "target", "total")


def schedule(found: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(place, sid, epoch, block, cut): the source, epoch and block of each slot; cut is the words a last slot takes, else null."""
    size = F.greatest(F.lit(1), F.expr(f"total div {slots}"))
    plan = found.where("source_size > 0").withColumns({"slot": size, "whole": F.floor(F.col("target") + 1e-6).cast("long")})
    plan = plan.withColumns({"blocks": F.expr("(source_size + slot - 1) div slot"), "rest": F.col("whole") % F.col("source_size")})
    plan = plan.withColumns({"full": F.expr("(whole div source_size) * blocks"), "tail": F.expr("(rest + slot - 1) div slot")})
    plan = plan.withColumn("n", F.col("full") + F.col("tail")).where("n > 0")
    everything = Window.partitionBy(F.lit(0))
    plan = plan.withColumn("m", F.sum("n").over(everything)).withColumn("low", F.coalesce(F.sum("n").over(everything.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    owners = plan.withColumn("at", F.explode(F.expr("sequence(low, low + n - 1)")))
    top = (plan.agg(F.max("m")).first()[0] or 0) * 3 + 16  # gaps between so many points are below 1 / m, so each source gets its slots
    spark = found.sparkSession
    # (point * m) >> 32 without floating point: the same in any engine.
    points = spark.range(top).select(F.col("id").alias("place"), F.pmod((F.col("id") + 1) * F.lit(GOLDEN), F.lit(1 << 32)).alias("point"))
    m = F.lit((top - 16) // 3)
    hit = points.withColumn("at", F.shiftright(F.col("point") * m, 32)).join(owners, "at")
    ranked = hit.withColumn("rank", F.row_number().over(Window.partitionBy("sid").orderBy("place")) - 1).where("rank < n")
    last = (F.col("rank") == F.col("n") - 1) & (F.col("tail") > 0)
    cut = F.when(last, F.expr("rest - (tail - 1) * slot"))
    return ranked.select("place", "sid", F.expr("rank div blocks").alias("epoch"), (F.col("rank") % F.col("blocks")).alias("block"), cut.alias("cut"), "slot")


def _taken(docs: DataFrame, id_col: str, source_col: str, text_col: str, slots: int = SLOTS) -> tuple[DataFrame, DataFrame, int]:
    """(id, none, name, key, bucket, size, source_size, target, sid, block, taken) for each row of docs, the schedule, and the
    width of a bucket; none and name stand for the source, block is the one that the row starts in."""
    each = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), place_key(F.col(id_col), F.col(text_col)).alias("key"))
    each = materialize(each, "sizes")
    found = materialize(targets(each), "targets")
    plan = materialize(schedule(found, slots), "schedule")
    slot = F.greatest(F.lit(1), F.expr(f"total div {slots}"))
    named = found.select("sid", "source_size", "target", slot.alias("slot"), F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    each = each.withColumns({"none": F.col("source").isNull(), "name": F.coalesce("source", F.lit(""))}).join(_few(named, found.count()), ["none", "name"])
    width = PRIME // max(BUCKETS, each.count() // BUCKET_ROWS) + 1
    each = each.withColumn("bucket", F.expr(f"key div {width}"))
    sums = each.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    offsets = sums.select("sid", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("sid", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["sid", "bucket"])
    placed = placed.select("id", "none", "name", "key", "bucket", "size", "source_size", "target", "sid", "slot", (F.col("inside") + F.col("offset")).alias("start"))
    held = placed.where("size > 0").withColumn("block", F.explode(F.expr("sequence(start div slot, (start + size - 1) div slot)")))
    uses = plan.groupBy("sid", "block").agg(F.count_if(F.col("cut").isNull()).alias("full"), F.coalesce(F.max("cut"), F.lit(0)).alias("cut"))
    low = F.greatest(F.col("start") - F.col("block") * F.col("slot"), F.lit(0))
    high = F.least(F.col("start") + F.col("size") - F.col("block") * F.col("slot"), F.col("slot"))
    part = F.col("full") * (high - low) + F.greatest(F.least(high, F.col("cut")) - low, F.lit(0))
    taken = held.join(uses, ["sid", "block"], "left").withColumn("part", F.coalesce(part, F.lit(0)))
    keyed = ["id", "none", "name", "key", "bucket", "size", "source_size", "target", "sid", "start", "slot"]
    taken = taken.groupBy(keyed).agg(F.sum("part").alias("taken"))
    none = placed.where("size = 0").select(*keyed, F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(none).withColumn("block", F.expr("start div slot")).drop("start", "slot"), plan, width


def mix_sources(docs: DataFrame, id_col: str, source_col: str, text_col: str, slots: int = SLOTS) -> DataFrame:
    """(id_col, size, source_size, target, taken, place) for each row of docs; place: of its first slot, null if not taken."""
    found, plan, _ = _taken(docs, id_col, source_col, text_col, slots)
    first = plan.where("epoch = 0").select("sid", "block", F.col("place").alias("at"))
    placed = found.join(F.broadcast(first), ["sid", "block"], "left")  # SLOTS rows and one for each source at most
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", F.when(F.col("taken") > 0, F.col("at")).alias("place"))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), "doc_id", "source", "text")


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with each row as often as the mix takes it whole (taken / size, rounded half up); rows never taken go.

    A source's schedule takes whole epochs and then the first blocks of one more, so along the shuffled order the number of
    copies falls once, by one. The last place before that fall says it all: the texts meet one row a source and are not
    shuffled. Rows of equal id that lie on that very place are taken alike.
    """
    place = lambda key, i: F.struct(key.alias("key"), F.coalesce(i.cast("long"), F.lit(-(1 << 63))).alias("id"))
    taken, slots, width = _taken(docs, id_col, source_col, text_col)
    plan = materialize(taken.where("size > 0").withColumn("copies", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")), "taken")
    last = [F.max(F.when(F.col("copies") == n, place(F.col("key"), F.col("id")))) for n in range(MOST + 1)]
    cuts = plan.groupBy("none", "name").agg(F.first("sid").alias("__sid"), F.min("copies").alias("low"), F.max("copies").alias("high"), *[x.alias(f"last{n}") for n, x in enumerate(last)])
    cut = F.element_at(F.array(*[f"last{n}" for n in range(MOST + 1)]), F.col("high") + 1)
    cuts = materialize(cuts.select(F.col("none").alias("__none"), F.col("name").alias("__name"), "__sid", "low", "high", cut.alias("cut")).withColumnsRenamed({"low": "__low", "high": "__high", "cut": "__cut"}), "cuts")
    # Where each block starts: a row for each bucket, with the blocks that start inside it and the last one before.
    starts = plan.groupBy("sid", "bucket", "block").agg(F.min(place(F.col("key"), F.col("id"))).alias("at"))
    inside = starts.groupBy("sid", "bucket").agg(F.array_sort(F.collect_list(F.struct("at", "block"))).alias("__blocks"))  # SLOTS blocks in all
    inside = materialize(inside.select(F.col("sid").alias("__sid"), F.col("bucket").alias("__bucket"), "__blocks"), "blocks")
    at = place(place_key(F.col(id_col), F.col(text_col)), F.col(id_col))
    rows = docs.withColumns({"__none": F.col(source_col).isNull(), "__name": F.coalesce(F.col(source_col), F.lit("")), "__at": at}).join(_few(cuts, cuts.count()), ["__none", "__name"])
    rows = rows.where(F.col(text_col).rlike(f"[^{SPACE}]")).withColumn("__copies", F.when(F.col("__at") <= F.col("__cut"), F.col("__high")).otherwise(F.col("__low")))
    rows = rows.where("__copies > 0").withColumn("__bucket", F.expr(f"__at.key div {width}")).join(_few(inside, inside.count()), ["__sid", "__bucket"])
    block = F.element_at(F.filter("__blocks", lambda b: b["at"] <= F.col("__at")), -1)["block"]
    rows = rows.withColumn("__block", block).drop("__blocks").withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    points = slots.select(F.col("sid").alias("__sid"), F.col("epoch").cast("int").alias("__epoch"), F.col("block").alias("__block"), F.col("place").alias("__place"))
    # A copy that half a slot more would have given has no slot of its own: it comes last.
    rows = rows.join(F.broadcast(points), ["__sid", "__epoch", "__block"], "left").withColumn("__place", F.coalesce("__place", F.lit(1 << 40)))
    return rows.repartitionByRange(F.col("__place"), F.col("__at")).sortWithinPartitions("__place", "__at").select(*docs.columns)


ORACLE_SQL = f"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, {_sql_mix(_sql_dealing('doc_id', "('0x' || substr(md5(coalesce(text, '')), 1, 7))::BIGINT"), keys(SEED, 1)[0])} AS k FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w,
    sum(sum(size)) OVER ()::BIGINT AS total FROM docs GROUP BY source),
levels AS (
  SELECT *, {MOST} * source_size / w AS full_at,
    (total - coalesce(sum({MOST} * source_size) OVER (ORDER BY {MOST} * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY {MOST} * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM sources),
targets AS (
  SELECT source, source_size, least({MOST} * source_size, w * (SELECT arg_min(level, full_at) FROM levels WHERE full_at >= level))::DOUBLE AS target FROM levels),
plan AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid, greatest(1, (sum(source_size) OVER ())::BIGINT // {SLOTS}) AS slot, floor(target + 1e-6)::BIGINT AS whole FROM targets WHERE source_size > 0),
counts AS (
  SELECT *, (source_size + slot - 1) // slot AS blocks, (whole // source_size) * ((source_size + slot - 1) // slot) + (whole % source_size + slot - 1) // slot AS n FROM plan),
ranges AS (SELECT *, sum(n) OVER (ORDER BY sid)::BIGINT - n AS low, sum(n) OVER ()::BIGINT AS m FROM counts WHERE n > 0),
points AS (SELECT i AS place, (((i + 1) * {GOLDEN} % 4294967296) * m) >> 32 AS spot FROM (SELECT max(m) AS m, unnest(range(max(m) * 3 + 16)) AS i FROM ranges)),
ranked AS (SELECT source, slot, n, blocks, place, row_number() OVER (PARTITION BY sid ORDER BY place) - 1 AS rank FROM points JOIN ranges ON spot >= low AND spot < low + n),
placed AS (
  SELECT doc_id, d.source, size, source_size, target, floor(target + 1e-6)::BIGINT AS whole,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
given AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE (whole // source_size) * size + greatest(least(c + size, whole % source_size) - c, 0) END::BIGINT AS taken FROM placed)
SELECT doc_id, size, g.source_size, target, taken, CASE WHEN taken > 0 THEN place END AS place
FROM given g LEFT JOIN ranked r ON g.source IS NOT DISTINCT FROM r.source AND g.c // slot = rank AND rank < least(n, blocks)
"""
