"""Streams give the batch rows, whatever the trigger and the layout of the table."""

import json
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from twinline.operators import ordered
from twinline.sources import files
from twinline.streaming import live

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parted(spark, tmp_path_factory):
    """`events` and `orders` as folders of part files, their rows in no order of time."""
    root = str(tmp_path_factory.mktemp("parted"))
    for t in ("events", "orders"):
        spark.read.parquet(f"{D}/{t}.parquet").repartition(5, F.rand(3)).write.parquet(f"{root}/{t}.parquet")
    return root


@pytest.mark.parametrize("files_per_trigger", [1, 3])
def test_any_trigger_gives_the_same_rows(spark, parted, files_per_trigger, monkeypatch):
    from twinline.streaming import live
    whole = live.source
    monkeypatch.setattr(live, "source", lambda s, folder, table: whole(s, folder, table, files_per_trigger))
    for name in ("stream_status", "stream_latest", "stream_cuts", "stream_match"):
        want = sorted(map(str, entry.queries()[name](spark, D).collect()))
        assert sorted(map(str, entry.queries()[name](spark, parted).collect())) == want and want, name
    assert sorted(map(str, entry.queries()["batch_cuts"](spark, D).collect())) == sorted(map(str, entry.queries()["stream_cuts"](spark, parted).collect()))


def test_catalog_scan(spark, tmp_path):
    (tmp_path / "a.mkv").write_bytes(b"123")
    (tmp_path / "b.txt").write_bytes(b"1")
    assert [(r.file_name, r.size_bytes) for r in files.catalog_scan(spark, str(tmp_path), ["mkv", "mp4"]).collect()] == [("a.mkv", 3)]


@pytest.fixture(scope="module")
def jittered(spark, tmp_path_factory):
    """A stream of 12 files in order of time but for 20 minutes of jitter: key, pos (minutes), record_id, status, ts."""
    rng, root, rows = random.Random(6), str(tmp_path_factory.mktemp("jittered")), []
    for i in range(900):
        minute = i * 5 + rng.randrange(5)
        rows.append((rng.choice([1, 1, 1, 2, 3, None]), minute, i, rng.choice(["Pending", "Done", "Error"]), minute * 60 + rng.randrange(60)))
    rows.append((4, 7, 1000, "Done", 7 * 60))
    rows.sort(key=lambda r: r[4] + rng.randrange(1200))
    for part in range(12):
        some = rows[part * len(rows) // 12 : (part + 1) * len(rows) // 12]
        frame = spark.createDataFrame(some, "key long, pos long, record_id long, status string, s long").selectExpr("key", "pos", "record_id", "status", "timestamp_seconds(s) as ts")
        frame.coalesce(1).write.mode("append").parquet(f"{root}/events.parquet")
    return root, rows


def picks(rows, spacing, until=None):
    out = []
    for k in {r[0] for r in rows}:
        last = None
        for _, p, *_ in sorted((r for r in rows if r[0] == k), key=lambda r: r[4]):
            if last is None or p - last >= spacing:
                last = p
                out.append((k, p))
    return sorted(map(str, out))


@pytest.mark.parametrize("per_trigger", [1, 4])
def test_picks_while_running(spark, jittered, per_trigger):
    """Rows are told before the input ends, the state holds what is within the delay, and the end gives the batch rows."""
    root, rows = jittered
    events = live.source(spark, root, "events", per_trigger).select("key", "pos", "ts")
    stream = live.spaced_pick(events, "key", "pos", 30, late="30 minutes")
    folder = live.work_folder(spark)
    query = live.run_once(stream, folder)
    told = [str((r.key, r.pos)) for r in spark.read.schema(stream.schema).parquet(f"{folder}/out").collect()]
    newest = max(r[4] for r in rows)
    want = picks(rows, 30)
    assert sorted(told) == sorted(x for x in want if _second(rows, x) <= newest - 1800)
    if per_trigger == 1:
        progress = [json.loads(p.json) for p in query.recentProgress]
        assert len(progress) >= 12
        held = [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in progress]
        assert max(held) < len(rows) / 3  # keys, timers and waiting rows, far fewer than all rows
    ended = live.drain_to_the_end(events, lambda e: live.spaced_pick(e, "key", "pos", 30, late="30 minutes"))
    assert sorted(str((r.key, r.pos)) for r in ended.collect()) == want


def _second(rows, pick):
    return min(r[4] for r in rows if str((r[0], r[1])) == pick)


def moves(rows, passed, expire):
    out = []
    for k in {r[0] for r in rows}:
        kept = None
        for r in sorted((r for r in rows if r[0] == k and r[4] <= passed), key=lambda r: (r[4], r[2])):
            if kept and r[4] >= kept[0] + expire:
                out.append((k, kept[0] + expire, kept[1], -1))
                kept = None
            if kept is None or kept[1] != r[3]:
                out += [(k, r[4], kept[1], -1)] if kept else []
                out.append((k, r[4], r[3], 1))
            kept = (r[4], r[3])
        if kept and kept[0] + expire <= passed:
            out.append((k, kept[0] + expire, kept[1], -1))
    return sorted(map(str, out))


@pytest.mark.parametrize("per_trigger,minutes", [(1, 25), (5, 600)])
def test_moves_of_records(spark, jittered, per_trigger, minutes):
    """Each move takes a record out of one status and into another, idle records go, whatever the trigger."""
    root, rows = jittered
    updates = live.source(spark, root, "events", per_trigger).selectExpr("key as episode_id", "record_id", "status", "ts")
    got = live.drain(live.record_moves(updates, late="30 minutes", expire=f"{minutes} minutes"))
    newest = max(r[4] for r in rows)
    told = got.selectExpr("episode_id", "unix_seconds(at) as at", "status", "change").collect()
    want = moves(rows, newest - 1800, minutes * 60)
    assert sorted(str(tuple(r)) for r in told) == want
    counts = {r.status: (r.records, r.entered, r.departed) for r in live.live_counts(got).collect()}
    assert sum(c[0] for c in counts.values()) <= 5 and all(a == b - c for a, b, c in counts.values())


def test_late_rows_are_dropped_alike(spark, tmp_path):
    """A row behind the watermark changes nothing; one within the delay is put in its place."""
    for minutes in ([1000, 1100], [1090, 1300], [1295, 1040, 1400]):
        frame = spark.createDataFrame([(1, m) for m in minutes], "key long, pos long").selectExpr("key", "pos", "timestamp_seconds(pos * 60) as ts")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    events = live.source(spark, str(tmp_path), "events", 1)
    got = live.drain_to_the_end(events, lambda e: live.spaced_pick(e, "key", "pos", 10, late="30 minutes"))
    # 1090 is within the delay; 1040 is late; 1295 is within the delay and takes the place of 1300
    assert sorted(r.pos for r in got.collect()) == [1000, 1090, 1100, 1295, 1400]
    batch = ordered.pick_spaced(spark.createDataFrame([(1, p) for p in (1000, 1100, 1090, 1300, 1295, 1400)], "key long, pos long"), ["key"], "pos", 10)
    assert sorted(r.pos for r in batch.collect()) == [1000, 1090, 1100, 1295, 1400]


def test_state_is_shared_by_groups_of_keys(spark, tmp_path):
    """Many keys have few state values, each key its own moves, also keys beside a null that no double can hold."""
    far, n = 2**53 + 1, 5000
    rows = [(far + i if i else None, 0, i, "Pending", 60 + 60 * (i % 50)) for i in range(n)] + [(far + i if i else None, 0, n + i, "Done" if i % 2 else "Pending", 6000 + 60 * (i % 50)) for i in range(n)]
    rows.append((7, 0, 2 * n, "Done", 20000))
    frame = spark.createDataFrame(rows, "key long, pos long, record_id long, status string, s long").selectExpr("key", "record_id", "status", "timestamp_seconds(s) as ts")
    frame.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    updates = live.source(spark, str(tmp_path), "events").selectExpr("key as episode_id", "record_id", "status", "ts")
    stream = live.record_moves(updates, late="30 minutes", expire="4 hours")
    folder = live.work_folder(spark)
    query = live.run_once(stream, folder)
    told = spark.read.schema(stream.schema).parquet(f"{folder}/out").selectExpr("episode_id", "unix_seconds(at) as at", "status", "change").collect()
    assert sorted(str(tuple(r)) for r in told) == moves(rows, 20000 - 1800, 4 * 3600)
    held = [sum(op["numRowsTotal"] for op in json.loads(p.json)["stateOperators"]) for p in query.recentProgress]
    assert max(held) <= 4 * live.GROUPS < n
