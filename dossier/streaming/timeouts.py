"""Stateful streams with one state a key: time-outs of activity, and people that stand while new mentions come.

Both keep their state in a store on disk (RocksDB), which the session must name before the query starts: rocks() does.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from dossier.operators.resolve import People, Verdict

_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
MINUTE = 60_000_000


@contextmanager
def rocks(spark: SparkSession):
    """State stores of queries started inside are kept on disk; the session's setting comes back afterwards."""
    name, value = _PROVIDER
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Keys share their state by hash: what a call of the state store costs is paid once a bucket, not once a key.
BUCKETS = 1_024
_RUN = pa.schema([("key", pa.string()), ("minutes", pa.int32()), ("first", pa.int64()), ("final", pa.int64()), ("n", pa.int64())])


def merged_runs(runs: list[tuple]) -> list[tuple]:
    """Runs (key, minutes, first, final, events) of which those of one (key, minutes) at most so many minutes apart become one."""
    out: list[tuple] = []
    for run in sorted(runs):
        key, minutes, first, final, n = run
        if out and out[-1][0] == key and out[-1][1] == minutes and first - out[-1][3] <= minutes * MINUTE:
            out[-1] = (*out[-1][:3], max(out[-1][3], final), out[-1][4] + n)
        else:
            out.append(run)
    return out


class TimeOuts(StatefulProcessor):
    """The open runs of the keys of one bucket. A run is told when it changes, and as closed when the watermark passes its end.

    One timer stands at the earliest end. A late event can join two open runs: then the start that is gone is told with no events.
    """

    def init(self, handle) -> None:
        self.handle, self.runs = handle, handle.getValueState("runs", "runs binary")  # as one Arrow stream: a row of a list state costs far more

    def _read(self) -> list[tuple]:
        if not self.runs.exists():
            return []
        table = pa.ipc.open_stream(bytes(self.runs.get()[0])).read_all()
        return list(zip(*[table[c].to_pylist() for c in _RUN.names], strict=True))

    def _keep(self, runs: list[tuple]) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if not runs:
            self.runs.clear()
            return
        sink, batch = pa.BufferOutputStream(), pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*runs, strict=True), _RUN, strict=True)], schema=_RUN)
        with pa.ipc.new_stream(sink, _RUN) as out:
            out.write_batch(batch)
        self.runs.update((sink.getvalue().to_pybytes(),))
        self.handle.registerTimer(-(-min(r[3] + r[1] * MINUTE for r in runs) // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self._read()
        came = [t for pdf in rows for t in zip(*[pdf[c].tolist() for c in _RUN.names], strict=True)]
        now = merged_runs([*before, *came])
        self._keep(now)
        known, starts = set(before), {r[:3] for r in now}
        gone = [(*r[:3], r[2], 0) for r in before if r[:3] not in starts]
        yield self._told([r for r in now if r not in known] + gone, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        runs, mark = self._read(), timerValues.getCurrentWatermarkInMs() * 1000
        over = [r[3] + r[1] * MINUTE <= mark for r in runs]
        self._keep([r for r, o in zip(runs, over, strict=True) if not o])
        yield self._told([r for r, o in zip(runs, over, strict=True) if o], True)

    def _told(self, runs: list[tuple], closed: bool) -> pd.DataFrame:
        rows = [(key, minutes, first, final + minutes * MINUTE, n, closed) for key, minutes, first, final, n in runs]
        return pd.DataFrame(rows, columns=["key", "minutes", "started", "ended", "events", "closed"])

    def close(self) -> None:
        pass


def time_outs(events: DataFrame, key: str, minutes: list[int], delay: str = "0 seconds") -> DataFrame:
    """A stream of (key, minutes, started, ended, events, closed): runs of activity of each key, for each length of silence.

    An end is the last event plus the silence; runs are told open (closed false) as they grow, and closed once the
    watermark, the latest event less `delay`, reaches their end (to the millisecond). Update mode; see latest_runs. The state is the
    runs still open, those of a bucket of keys together. Events in one Arrow batch become runs before the shuffle, so a key with very many events sends few rows. Events
    behind the watermark are dropped, unless their batch holds one ahead of it in the same run. Events without a time take no part;
    events without a key are a key of their own.
    """
    kind = dict(events.dtypes)[key]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ts = batch.column(0), batch.column(1).cast(pa.int64()).to_numpy(zero_copy_only=False)
            codes = keys.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            order = np.lexsort((ts, codes))
            code, at = codes[order], ts[order]
            for m in minutes:
                new = np.ones(len(at), bool)
                new[1:] = (code[1:] != code[:-1]) | (np.diff(at) > m * MINUTE)
                start = np.flatnonzero(new)
                end = np.append(start[1:], len(at)) - 1 if len(start) else start
                last = at[end]
                columns = [keys.take(pa.array(order[start])), pa.array(np.full(len(start), m, np.int32)), pa.array(at[start]), pa.array(last), pa.array(end - start + 1), pa.array(last, pa.timestamp("us", tz="UTC"))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "minutes", "first", "final", "n", "last"])

    # The key goes as text, as rows with a null key would not meet their state.
    timely = events.where(F.col("ts").isNotNull()).select(F.to_json(F.struct(F.col(key).alias("key"))).alias("key"), F.col("ts").cast("timestamp"))
    runs = timely.mapInArrow(partial, "key string, minutes int, first long, final long, n long, last timestamp").withWatermark("last", delay)
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")
    told = runs.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(TimeOuts(), "key string, minutes int, started long, ended long, events long, closed boolean", "Update", "EventTime")
    times = [F.timestamp_micros(c).alias(c) for c in ("started", "ended")]
    return told.select(F.from_json("key", f"key {kind}")["key"].alias(key), "minutes", *times, "events", "closed")


def latest_runs(spark: SparkSession, out: str, key: str) -> DataFrame:
    """What a drained stream of time_outs told last of each run."""
    rows = spark.read.parquet(f"{out}/n=*")
    last = rows.groupBy(key, "minutes", "started").agg(F.max_by(F.struct("ended", "events", "closed"), F.struct("batch", "closed")).alias("r"))
    return last.select(key, "minutes", "started", "r.*").where("events > 0")


_PERSON = ("form", "name", "role", "observation", "email", "phone", "address")


class Standing(StatefulProcessor):
    """The people of one matter as map state, a row each; a micro-batch reads them once and writes those that it changed."""

    def __init__(self, verdict: Verdict | None) -> None:
        self.verdict = verdict

    def init(self, handle) -> None:
        self.people = handle.getMapState("people", "person int", ", ".join(f"{c} string" for c in _PERSON))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows))  # one matter's mentions of one micro-batch
        arrived = arrived.assign(number=pd.to_numeric(arrived["id"])).sort_values(["place", "number"], kind="stable", na_position="first").replace({np.nan: None})
        stood = dict(sorted((k[0], dict(zip(_PERSON, v, strict=True))) for k, v in self.people.iterator()))
        fold, out = People(self.verdict), []
        fold.people = [dict(p) for p in stood.values()]
        for r in arrived.itertuples(index=False):
            person, how, score, _ = fold.add(r.form, r.full_name, r.role, r.observation, None)
            p = fold.people[person]
            p.update({c: p.get(c) or getattr(r, c) or None for c in ("email", "phone", "address")})
            out.append((r.id, key[0], person, how, score, p["name"], p["email"], p["phone"], p["address"]))
        for i, p in enumerate(fold.people):
            if stood.get(i) != p:
                self.people.updateValue((i,), tuple(p[c] for c in _PERSON))
        yield pd.DataFrame(out, columns=["id", "matter_id", "person", "match_type", "match_score", "person_name", "email", "phone", "address"])

    def close(self) -> None:
        pass


def standing_people(mentions: DataFrame, verdict: Verdict | None = None) -> DataFrame:
    """Incremental person resolution: a stream of mentions (id, matter_id, place, form, full_name, role, observation, email, phone,
    address) folds into the people of their matters, by the tiers and the name replacement of resolve.People.

    Emits (id, matter_id, person, match_type, match_score, person_name, email, phone, address) for each mention, append mode: the person
    it was given and how that person stood then; contacts are the first known ones. Mentions of one micro-batch come in the order of
    (place, id), micro-batches in that of their arrival, so any split into files gives what the ordered fold gives over that order.
    Mentions without a name or a matter take no part; those without a place or an id come first of their batch; one matter's mentions of one micro-batch meet in one task.
    """
    # Ids go as text: beside a null, pandas would hold them as floating point numbers.
    rows = mentions.where("matter_id IS NOT NULL AND full_name IS NOT NULL").select(F.col("id").cast("string"), "matter_id", "place", "form", "full_name", "role", "observation", "email", "phone", "address")
    schema = "id string, matter_id long, person int, match_type string, match_score double, person_name string, email string, phone string, address string"
    return rows.groupBy("matter_id").transformWithStateInPandas(Standing(verdict), schema, "Append", "None").withColumn("id", F.col("id").cast("long"))
