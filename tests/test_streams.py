"""Streams over many small files of mixed times against plain results."""

import datetime as dt
import random
from collections import Counter

from dossier.plans import registry


def test_many_files(spark, tmp_path):
    r, start = random.Random(4), dt.datetime(2024, 1, 1)
    rows = [(i, r.randrange(6), start + dt.timedelta(minutes=r.randrange(6_000)), "purchase", 1.0) for i in range(900)]
    for n in range(12):
        spark.createDataFrame(rows[n::12], "event_id long, user_id long, ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    # session_window merges an event at the very end of a run into it.
    gap, last, runs = dt.timedelta(minutes=30), max(x[2] for x in rows), []
    for user in range(6):
        times = sorted(x[2] for x in rows if x[1] == user)
        for t in times:
            if runs and runs[-1][0] == user and t <= runs[-1][2]:
                runs[-1] = (user, runs[-1][1], t + gap, runs[-1][3] + 1)
            else:
                runs.append((user, t, t + gap, 1))
    found = registry.queries()["str_05_inactivity"](spark, str(tmp_path)).collect()
    told = [tuple(x[c] for c in ("user_id", "started", "ended", "events", "closed")) for x in found if x["minutes"] == 30]
    assert sorted(told) == sorted((*x, x[2] <= last) for x in runs) and {x[-1] for x in told} == {True, False}
    assert sum(x["events"] for x in found if x["minutes"] == 5) == 900
    used = registry.queries()["str_06_daily_usage"](spark, str(tmp_path)).collect()
    assert {(x["user_id"], x["day"]): x["used"] for x in used} == Counter((x[1], str(x[2].date())) for x in rows)


def test_change_stream_goes_on_after_a_restart(spark, tmp_path):
    """Runs with the same checkpoint: without new files nothing is lost, new files apply to what was there."""
    from dossier.streaming import flows as S

    state = spark.createDataFrame([(i, f"h{i}", True, False) for i in range(200)], "external_id long, content_hash string, is_processed boolean, is_soft_deleted boolean")

    def land(name, rows):
        spark.createDataFrame(rows, "type string, external_id long").coalesce(1).write.parquet(f"{tmp_path}/in/{name}.parquet")

    def run():
        events = S.arriving(spark, f"{tmp_path}/in/*.parquet", "type string, external_id long", 1)
        return {r["external_id"]: (r["content_hash"], r["is_processed"], r["is_soft_deleted"]) for r in S.change_stream(events, state, f"{tmp_path}/state", f"{tmp_path}/checkpoint").collect()}

    land("a", [("document.deleted", 7), ("document.updated", 8)])
    land("b", [("document.deleted", 9), ("document.created", 5), ("document.deleted", 999)])
    first = run()
    assert len(first) == 200 and first[7] == ("h7", True, True) and first[8] == (None, False, False) and first[9][2] and first[5] == ("h5", True, False)
    assert run() == first
    land("c", [("document.updated", 7)])
    assert run() == first | {7: (None, False, True)}


def runs_by_hand(rows, gap, now):
    out = []
    for key in {k for k, _ in rows}:
        runs = []
        for t in sorted(t for k, t in rows if k == key):
            if runs and t <= runs[-1][1]:
                runs[-1] = (runs[-1][0], t + gap, runs[-1][2] + 1)
            else:
                runs.append((t, t + gap, 1))
        out += [(key, *r, r[1] <= now) for r in runs]
    return sorted(out, key=repr)


def test_time_outs_in_batches_with_late_events_and_a_restart(spark, tmp_path):
    """Time-outs after 5 and 30 minutes: late events join runs while the delay lasts, later ones are dropped, a restart goes on."""
    from dossier.streaming import flows as S
    from dossier.streaming import timeouts as T

    r, start = random.Random(8), dt.datetime(2024, 1, 1)
    rows = sorted(((r.choice([None, 1, 2, 3]), start + dt.timedelta(seconds=r.randrange(40_000))) for _ in range(500)), key=lambda x: x[1])
    rows = [rows[i] for i in sorted(range(500), key=lambda i: i + r.randrange(12))]  # arrival: some minutes out of order
    schema = "user_id long, ts timestamp"

    def land(name, part):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        events = S.arriving(spark, f"{tmp_path}/in/*/*.parquet", schema, 1)
        with T.rocks(spark):
            S.drain(T.time_outs(events, "user_id", [5, 30], "45 minutes"), f"{tmp_path}/out", "update", f"{tmp_path}/checkpoint")
        found = T.latest_runs(spark, f"{tmp_path}/out", "user_id").collect()
        return {m: sorted(((x["user_id"], x["started"], x["ended"], x["events"], x["closed"]) for x in found if x["minutes"] == m), key=repr) for m in (5, 30)}

    def want(part, m):
        mark = max(t for _, t in part) - dt.timedelta(minutes=45)
        return runs_by_hand(part, dt.timedelta(minutes=m), mark)

    for i in range(3):
        land(str(i), rows[i * 100 : i * 100 + 100])
    found = run()
    assert found == {m: want(rows[:300], m) for m in (5, 30)} and {x[-1] for x in found[5]} == {True, False}
    land("3", rows[300:400] + [(1, rows[0][1] - dt.timedelta(days=1)), (2, None)])  # far behind the watermark, and without a time
    land("4", rows[400:])
    assert run() == {m: want(rows, m) for m in (5, 30)}


def test_standing_people_equal_the_batch_fold(spark, tmp_path):
    """Mentions in any split into files, with a restart, against the ordered fold over all of them; contacts are the first known."""
    from dossier.operators import resolve as P
    from dossier.streaming import flows as S
    from dossier.streaming import timeouts as T

    r = random.Random(5)
    pool = ["John Smith", "Jon Smith", "John Q Smith", "J. Smith", "Mike Carroll", "Michael Carroll", "Mikey Carol", "FNU Carroll", "Ann Lee", "Lee Ann", "Anne Leigh", "Dr. Ann Lee Stone", ""]
    rows = [(i, r.randrange(3), i, r.choice(pool), "other", None, r.choice([None, "", f"m{i}@x.y"]), r.choice([None, f"{i}"]), None) for i in range(240)]
    schema = "id long, matter_id long, place long, full_name string, role string, observation string, email string, phone string, address string"
    batch = spark.createDataFrame(rows, schema).withColumnsRenamed({"place": "document_id"}).selectExpr("*", "cast(null as int) as source_page")
    want = {x["id"]: (x["person"], x["match_type"]) for x in P.resolved(batch).collect()}
    first = {}
    for row in rows:
        known = first.setdefault((row[1], want[row[0]][0]), [None, None])
        known[:] = [k or v or None for k, v in zip(known, row[6:8], strict=True)]
    for n, cuts in enumerate(([], [50, 60, 170], [1, 2, 3, 239])):
        edges = [0, *cuts, 240]
        parts = [rows[a:b] for a, b in zip(edges, edges[1:], strict=False)]

        def land(i, part, n=n):
            r.shuffle(part)
            P.forms(spark.createDataFrame(part, schema)).coalesce(1).write.parquet(f"{tmp_path}/in{n}/{i}")

        def run(n=n):
            arriving = S.arriving(spark, f"{tmp_path}/in{n}/*/*.parquet", spark.read.parquet(f"{tmp_path}/in{n}/0").schema, 1)
            with T.rocks(spark):
                S.drain(T.standing_people(arriving), f"{tmp_path}/out{n}", "append", f"{tmp_path}/checkpoint{n}")

        for i, part in enumerate(parts[:-1]):
            land(i, part)
        if len(parts) > 1:
            run()
        land(len(parts) - 1, parts[-1])
        run()
        found = spark.read.parquet(f"{tmp_path}/out{n}/n=*").collect()
        assert {x["id"]: (x["person"], x["match_type"]) for x in found} == want and len(found) == 240
        last = {}
        for x in sorted(found, key=lambda x: x["id"]):
            last[x["matter_id"], x["person"]] = [x["email"], x["phone"]]
        assert last == first


def test_standing_people_without_ids(spark, tmp_path):
    """Rows without an id count, and do not blur the large ids beside them."""
    from dossier.operators import resolve as P
    from dossier.streaming import flows as S
    from dossier.streaming import timeouts as T

    big = (1 << 62) + 1
    rows = [(big, 1, 2, "Ann Lee", None, None, None, None, None), (None, 1, 2, "Ann Lee", None, None, None, None, None), (big + 1, 1, None, "Bob Stone", None, None, None, None, None), (5, None, 1, "X Y", None, None, None, None, None), (6, 1, 1, None, None, None, None, None, None)]
    schema = "id long, matter_id long, place long, full_name string, role string, observation string, email string, phone string, address string"
    P.forms(spark.createDataFrame(rows, schema)).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    arriving = S.arriving(spark, f"{tmp_path}/in/*/*.parquet", spark.read.parquet(f"{tmp_path}/in/0").schema, 1)
    with T.rocks(spark):
        S.drain(T.standing_people(arriving), f"{tmp_path}/out", "append", f"{tmp_path}/checkpoint")
    found = spark.read.parquet(f"{tmp_path}/out/n=*").collect()
    assert sorted((r["id"] or 0, r["person"], r["match_type"]) for r in found) == [(0, 1, "none"), (big, 1, "exact"), (big + 1, 0, "none")]


def test_daily_use_keeps_no_state_and_counts_late_rows(spark, tmp_path):
    """Rows of long ago count, a restart and compaction lose nothing, a repeated batch counts once, and no state rows are held."""
    from dossier.streaming import flows as S

    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=5)

    def land(name, rows):
        spark.createDataFrame(rows, "user_id long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        events = S.arriving(spark, f"{tmp_path}/in/*/*.parquet", "user_id long, ts timestamp", 1)
        S.count_stream(S.daily_usage(events, "user_id"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        return {(r["user_id"], str(r["day"])): r["used"] for r in S.counted(spark, f"{tmp_path}/out").collect()}

    land("a", [(1, day(40)), (1, day(40)), (None, day(3))])
    land("b", [(1, day(0)), (2, day(40)), (1, day(40))])
    first = {(1, "2024-02-10"): 3, (None, "2024-01-04"): 1, (1, "2024-01-01"): 1, (2, "2024-02-10"): 1}
    assert run() == first
    S.compacted(spark, f"{tmp_path}/out")
    assert run() == first and S._parts(spark, f"{tmp_path}/out")[1] == [f"{tmp_path}/out/upto=1"]
    land("c", [(1, day(0)), (9, None)])
    assert run() == first | {(1, "2024-01-01"): 2, (9, "None"): 1}
    spark.read.parquet(f"{tmp_path}/out/upto=1").where("user_id = 1").write.parquet(f"{tmp_path}/out/upto=2")  # sums that were cut off do not count
    import os

    os.remove(f"{tmp_path}/out/upto=2/_SUCCESS")
    assert run() == first | {(1, "2024-01-01"): 2, (9, "None"): 1}
    flow = S.daily_usage(S.arriving(spark, f"{tmp_path}/in/*/*.parquet", "user_id long, ts timestamp", 1), "user_id")
    done = flow.writeStream.foreachBatch(lambda batch, n: None).option("checkpointLocation", f"{tmp_path}/other").trigger(availableNow=True).start()
    done.awaitTermination()
    assert all(p["stateOperators"] == [] for p in done.recentProgress)
