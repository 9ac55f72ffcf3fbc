"""Whole jobs against the known truth of their inputs, on the smallest test data."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from twinline.sources import files

D = "/root/testdata/sf0.001"
ROOT = str(Path(__file__).resolve().parent.parent)


def test_registry_needs_no_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_constant_offset(spark):
    rows = entry.queries()["job_frame_sync"](spark, D).collect()
    assert len(rows) == 10
    assert {(r["sync_ms"], r["initial_delay_ms"], r["valid_points"]) for r in rows} == {(1480, -1480, 9)}


def test_speed_of_mixed_rates(spark):
    """37 source frames of each file's own length; files of equal speeds drop out."""
    rows = {r["file_id"]: r for r in entry.queries()["job_speed_mixed"](spark, D).collect()}
    assert sorted(rows) == [0, 1, 2, 4, 5, 6, 8, 9]
    for n, r in rows.items():
        src, lang = map(int, r["stretch"].split("/"))
        assert src == (40000000 if n % 2 == 0 else 33366667) and lang != src and r["verified"] and r["valid_points"] == 9
        assert abs(r["sync_ms"] - 37 * src / 1e6) <= 1 and abs(r["initial_delay_ms"] + 37 * lang / 1e6) <= 1


def test_offset_regions_hit_the_truth(spark):
    got = {}
    for r in entry.queries()["offset_regions"](spark, D).orderBy("pair_id", "start_ms").collect():
        got.setdefault(r["pair_id"], []).append(r["offset_ms"])
    assert len(got) == 15
    for pair, offsets in got.items():
        first = (pair % 11 - 5) * 1000
        want = [first] if pair % 3 == 1 else [first, first + (pair % 3 - 1) * 4000]
        assert len(offsets) == len(want) and all(abs(a - b) <= 250 for a, b in zip(offsets, want))


@pytest.mark.parametrize("name", ["job_match", "remux_plan", "lang_suggest", "scene_cuts", "probe_tracks", "region_split", "stream_match", "stream_cuts"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in "part supplier orders lineitem events documents embeddings conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = entry.queries()[name](spark, D)
    res = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(cols)
    show = lambda v: repr(round(v, 9)) if isinstance(v, float) else str(v)
    got = sorted(tuple(map(show, r)) for r in df.select(*cols).collect())
    assert got == sorted(tuple(map(show, r)) for r in res.fetchall())


def test_report_sink(spark, tmp_path):
    df = spark.range(3)
    files.write_report({"source": df, "result": df.withColumn("x", F.lit(1))}, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r/table=result")).count() == 3


def test_report_runs_stay_apart(spark, tmp_path):
    """A run written again replaces its own partitions only, also with fewer tables."""
    out, df = str(tmp_path / "r"), spark.range(3)
    files.write_report({"source": df, "result": df.withColumn("x", F.lit(1))}, out, "a")
    files.write_report({"source": df.limit(1)}, out, "b")
    for _ in range(2):
        files.write_report({"source": df.limit(2)}, out, "a")
    assert {(r["run"], r["table"]): r["count"] for r in spark.read.parquet(out).groupBy("run", "table").count().collect()} == {("a", "source"): 2, ("a", "result"): 3, ("b", "source"): 1}
    assert files.read_report(spark, out, "a", "result").count() == 3


def test_stored_frames_do_not_move(spark):
    """A slice of stored frames has the rows of a plain slice, and only the table of segments is exchanged."""
    from twinline import fixtures as fx
    from twinline.operators import frames as fr
    plain = fx.frames(spark, D)
    stored = fr.store_frames(plain)
    seg = spark.createDataFrame([(f, s, n) for f in range(4) for s, n in ((0, 3000), (9500, 1500), (11000, 9000))], "file_id int, start int, dur int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = fr.slice_segments(stored, seg, "start", "dur")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        assert fr.slice_segments(plain, seg, "start", "dur")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") > 1
        cols = ["file_id", "frame_idx", "start"]
        assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, fr.slice_segments(plain, seg, "start", "dur").select(cols).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_speed_of_one_rate(spark):
    """Every file has the same two rates: 37 source frames of 40 ms, found at the language's own speed."""
    rows = entry.queries()["job_speed"](spark, D).collect()
    assert len(rows) == 10
    for r in rows:
        assert r["stretch"] == "40000000/41708000" and r["verified"] and r["valid_points"] == 9
        assert abs(r["sync_ms"] - 1480) <= 1 and abs(r["initial_delay_ms"] + 37 * 41.708) <= 1


def test_track_text_goes_by_position(spark):
    """Two tracks with far ids share a row; a long list is cut by position, in order."""
    from twinline.operators import tracks as tr
    rows = [(1, 5), (1, 2000)] + [(2, i) for i in range(0, 4200, 2)]
    t = spark.createDataFrame([(f, i, "eng", "FLAC", "n", 2) for f, i in rows], "file_id long, track_id long, language string, codec string, name string, channels int")
    got = {(r["file_id"], r["part"]): r["tracks"].count(" | ") + 1 for r in tr.track_texts(t, "").collect()}
    assert got == {(1, 0): 2, (2, 0): 1024, (2, 1): 1024, (2, 2): 52}


def test_too_few_language_frames_are_no_dip(spark):
    """A region whose language side has under four frames keeps its frames unjudged, matched or not."""
    from twinline.operators import frames as fr
    from twinline.params import PiecewiseSettings
    from twinline.plans import align
    kind = "file_id long, frame_idx long, ts_ms double, px array<int>"
    px = [[(7 * i + 3 * j) % 200 for j in range(64)] for i in range(200)]
    src = spark.createDataFrame([(f, i, i * 500.0, px[i]) for f in (1, 2, 3) for i in range(120)], kind)
    lang = spark.createDataFrame([(2, i, i * 500.0, px[i]) for i in range(2)] + [(3, i, i * 500.0, px[199 - i]) for i in range(60)], kind)
    seg = spark.createDataFrame([(f, 0, 0, 60000) for f in (1, 2, 3)], "file_id long, src_start long, lang_start long, dur_ms long")
    got = fr.timed_matches(src, lang, seg, ["file_id"], 400.0).groupBy("file_id").agg(F.min("lang_frames").alias("lo"), F.max("lang_frames").alias("hi"), F.count("lang_idx").alias("m")).collect()
    assert {r["file_id"]: (r["lo"], r["hi"], r["m"]) for r in got} == {1: (0, 0, 0), 2: (2, 2, 2), 3: (60, 60, 60)}
    regions = spark.createDataFrame([(1, 0.0, 60000.0, 0.0), (2, 0.0, 60000.0, 0.0)], "pair_id long, start_ms double, end_ms double, offset_ms double")
    assert align.confirm_dips(src, lang, regions, PiecewiseSettings()).count() == 0


def test_container_times_of_long_files(spark):
    """Container times follow the frame rates also where their product passes 2^63; short files keep their values."""
    from twinline.suite.job_queries import with_rates
    d = spark.createDataFrame([(1, 80_000), (2, 960_000), (3, 400_000_000)], "file_id int, duration_ms long")
    got = {r["file_id"]: r["lang_container_ns"] for r in with_rates(d, F.lit(40000000), F.lit(41708000)).collect()}
    assert got == {1: 83_416_000_000, 2: 1_000_992_000_000, 3: 417_080_000_000_000}


def test_pictures_are_compared_by_many_tasks(spark, tmp_path):
    """Matches that lie in one small file are dealt out before their pictures are compared, and have the same sums."""
    from twinline.operators import frames as fr
    px = [[(7 * i + 3 * j) % 256 for j in range(16)] for i in range(120)]
    frames = spark.createDataFrame([(f, i, px[i]) for f in (1, 2) for i in range(120)], "file_id long, frame_idx long, px array<int>")
    spark.createDataFrame([(f, i, 119 - i) for f in (1, 2) for i in range(120)], "file_id long, src_idx long, lang_idx long").coalesce(1).write.parquet(str(tmp_path / "m"))
    rows = fr.matched_pixels(spark.read.parquet(str(tmp_path / "m")), frames, frames).select("*", F.spark_partition_id().alias("task")).collect()
    assert len(rows) == 240 and len({r["task"] for r in rows}) > 1
    for r in rows:
        a, b = px[r["src_idx"]], px[r["lang_idx"]]
        assert tuple(r["s"]) == (16, sum(a), sum(b), sum(x * x for x in a), sum(x * x for x in b), sum(x * y for x, y in zip(a, b)))


def test_sums_of_odd_pictures(spark):
    """Null arrays and elements, other lengths and empty arrays have the sums that SQL gives them."""
    from twinline.functions import pixels
    rows = [(0, [1, 2], [3, 4]), (1, None, [3]), (2, [1, None], [3, 4]), (3, [1, 2], [3]), (4, [], []), (5, [300, -2], [5, None])]
    df = spark.createDataFrame(rows, "i int, a array<int>, b array<int>").coalesce(1)
    got = {r["i"]: (tuple(r["s"]), r["e"]) for r in df.select("i", pixels.sums("a", "b").alias("s"), pixels.squared_error(F.col("a"), F.col("b")).alias("e")).collect()}
    assert got == {0: ((2, 3, 7, 5, 25, 11), 8), 1: ((None, None, 3, None, 9, None), None), 2: ((2, None, 7, None, 25, None), None),
                   3: ((2, 3, 3, 5, 9, None), None), 4: ((0, 0, 0, 0, 0, 0), 0), 5: ((2, 298, None, 90004, None, None), None)}
