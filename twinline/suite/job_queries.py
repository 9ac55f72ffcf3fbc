"""Whole jobs and streams."""

from pyspark.sql import functions as F

from twinline import fixtures as fx
from twinline.operators import catalog
from twinline.operators import frames as fr
from twinline.operators import ordered
from twinline.params import DEFAULTS, VECTOR_FRAMES
from twinline.plans import align, ladder, sweep
from twinline.session import settled
from twinline.streaming import live
from twinline.suite.region_queries import REGION_ARGS
from twinline.suite.registry import query


def frame_inputs(spark, d, lang):
    src = settled(fx.frames(spark, d))
    durations = fr.frame_counts(src).select("file_id", (F.col("frame_count") * 40).alias("duration_ms"))
    return src, settled(lang(spark, d)), durations


def with_rates(durations, src_ns, lang_ns):
    """Frame durations of both sides, and containers far enough apart to be no soft telecine."""
    return (durations.withColumn("src_video_ns", src_ns.cast("long")).withColumn("lang_video_ns", lang_ns.cast("long"))
            .withColumn("src_container_ns", F.col("duration_ms") * 1_000_000)
            # in doubles: the product of two long counts of nanoseconds passes 2^63 from some four minutes on
            .withColumn("lang_container_ns", (F.col("src_container_ns").cast("double") * F.col("lang_video_ns") / F.col("src_video_ns")).cast("long")))


@query("job_frame_sync")
def job_frame_sync(spark, d):
    src, lang, durations = frame_inputs(spark, d, fx.lang_frames)
    return align.frame_sync_job(src, lang, durations.withColumn("src_video_ns", F.lit(40000000)), VECTOR_FRAMES)


@query("job_speed")
def job_speed(spark, d):
    src, lang, durations = frame_inputs(spark, d, fx.speed_lang_frames)
    return align.speed_job(src, lang, with_rates(durations, F.lit(40000000), F.lit(41708000)), VECTOR_FRAMES)


def mixed_rates(n):
    """Frame durations of the files: two on the source side, three ratios and no difference on the other."""
    src = F.when(n % 2 == 0, 40000000).otherwise(33366667)
    return src, F.when(n % 4 == 3, src).when(n % 4 == 2, 41708000).when(n % 4 == 1, 34800000).otherwise(38500000)


@query("job_speed_mixed")
def job_speed_mixed(spark, d):
    """One run over files of different rates and ratios; files of equal speeds have no row."""
    src_ns, lang_ns = mixed_rates(F.col("file_id").cast("long"))
    src = settled(fx.frames(spark, d).withColumn("ts_ms", F.col("frame_idx") * src_ns / F.lit(1e6)))
    lang = settled(fx.lang_frames(spark, d).withColumn("ts_ms", F.col("frame_idx") * lang_ns / F.lit(1e6)))
    durations = fr.frame_counts(src).select("file_id", (F.col("frame_count") * src_ns / F.lit(1e6)).cast("long").alias("duration_ms"))
    return align.speed_job(src, lang, with_rates(durations, src_ns, lang_ns), VECTOR_FRAMES)


@query("job_deep", fx.sql_with(["cuts"], """SELECT pair_id, n AS op_count, src AS source_cuts, lang AS lang_cuts, matched AS matched_cuts, CAST(round_even(first_off, 0) AS BIGINT) AS initial_delay_ms, CAST(0 AS DOUBLE) AS baseline_mse
FROM (SELECT pair_id, count(*) - 1 AS n, CAST(sum(match_count) AS BIGINT) AS matched, arg_min(offset_ms, start_ms) AS first_off FROM regs GROUP BY pair_id)
JOIN (SELECT pair_id, count(*) FILTER (side = 'src') AS src, count(*) FILTER (side = 'lang') AS lang FROM cuts GROUP BY pair_id) USING (pair_id)""", REGION_ARGS))
def job_deep(spark, d):
    c = settled(fx.cuts(spark, d))
    return align.piecewise_job(c.filter("side = 'src'").drop("side"), c.filter("side = 'lang'").drop("side"))


def slow(frames):
    """The same frames at 2.5 per second, so that scenes last seconds."""
    return frames.withColumn("ts_ms", F.col("frame_idx") * 400)


def piecewise_inputs(spark, d):
    """Slow frames; the language side is noisy and lacks source frames 330 to 339.

    Known truth: offset 0, and 4000 ms after the gap at source second 132. The gap lies past
    the middle, so that the initial vote falls on the first offset.
    """
    n = F.col("frame_idx")
    lang = fx.noisy_frames(spark, d).filter((n < 330) | (n >= 340))
    src = settled(slow(fx.frames(spark, d)))
    durations = fr.frame_counts(src).select("file_id", (F.col("frame_count") * 400).alias("duration_ms"))
    return src, settled(slow(lang.withColumn("frame_idx", F.when(n >= 340, n - 10).otherwise(n)))), durations


@query("job_deep_frames")
def job_deep_frames(spark, d):
    summary, ops = align.piecewise_frames_job(*piecewise_inputs(spark, d), VECTOR_FRAMES)
    return summary.select("pair_id", "op_count", "matched_cuts", "initial_delay_ms", F.bround("baseline_mse", 6).alias("baseline_mse")).join(
        ops.select("pair_id", "type", "lang_ts_ms", "duration_ms", "source_ts_ms"), "pair_id", "left")


BASE_SQL = """SELECT record_id, status, record_id % 5 = 0 AS mismatch, CASE WHEN record_id % 5 = 0 OR record_id % 7 = 0 THEN 25.0 ELSE 0.0 END AS fps,
  record_id % 11 <> 0 AS has_durations, CASE WHEN record_id % 2 = 0 THEN sync_ms * 2 END AS spd, CASE WHEN record_id % 3 <> 0 THEN sync_ms * 3 END AS pcs,
  CASE WHEN record_id % 4 <> 1 THEN sync_ms END AS con, (record_id % 3) * 40 AS man_a, (record_id % 2) * 10 AS man_s FROM fx7"""
RUNG_SQL = """SELECT record_id, '{mode}' AS run_mode, m AS method, CASE WHEN m IS NULL THEN status WHEN starts_with(m, 'failed') THEN 'Error' ELSE 'Analyzed' END AS new_status,
  CASE m WHEN 'failed_speed' THEN 'Speed correction failed' WHEN 'failed_both' THEN 'Frame sync and speed correction failed' WHEN 'failed_constant' THEN 'Frame sync failed' ELSE '' END AS error,
  s AS sync_offset_ms, s + 120 + man_a AS audio_delay_ms, s - 80 + man_s AS subtitle_delay_ms FROM (
  SELECT *, CAST(CASE WHEN m IN ('speed', 'speed_fallback') THEN spd WHEN m = 'piecewise' THEN pcs WHEN m = 'constant' THEN con WHEN m = 'none' THEN 0 END AS BIGINT) AS s FROM (
   SELECT *, CASE WHEN status NOT IN ('Pending', 'Error') THEN NULL WHEN mismatch AND spd IS NOT NULL THEN 'speed' WHEN mismatch THEN 'failed_speed' {rest} END AS m FROM b))"""


@query("job_analyze", fx.sql_with(["fx7"], " UNION ALL ".join([
    RUNG_SQL.format(mode="piecewise", rest="WHEN pcs IS NOT NULL THEN 'piecewise' ELSE 'none'"),
    RUNG_SQL.format(mode="constant", rest="WHEN con IS NOT NULL THEN 'constant' WHEN fps > 0 AND has_durations AND spd IS NOT NULL THEN 'speed_fallback' WHEN fps > 0 AND has_durations THEN 'failed_both' ELSE 'failed_constant'")]),
    [("b", BASE_SQL)]))
def job_analyze(spark, d):
    n, s = F.col("record_id"), F.col("sync_ms")
    fps = F.when((n % 5 == 0) | (n % 7 == 0), 25.0).otherwise(0.0)
    r = fx.records(spark, d).select(
        "record_id", "status", (n % 5 == 0).alias("mismatch"), fps.alias("src_fps"), fps.alias("lang_fps"), (n % 11 != 0).alias("has_durations"),
        F.when(n % 2 == 0, s * 2).alias("speed_sync_ms"), F.when(n % 3 != 0, s * 3).alias("piecewise_sync_ms"), F.when(n % 4 != 1, s).alias("constant_sync_ms"),
        ((n % 3) * 40).alias("manual_audio_ms"), ((n % 2) * 10).alias("manual_sub_ms"))
    def run(mode):
        out = ladder.analyse(r, True, mode == "piecewise", mode == "constant", 120, -80)
        return out.select("record_id", F.lit(mode).alias("run_mode"), "method", "new_status", "error", "sync_offset_ms", "audio_delay_ms", "subtitle_delay_ms")
    return run("piecewise").unionByName(run("constant"))


def updates(spark, d):
    r = fx.as_records(live.source(spark, d, "events"))
    return r.withColumn("ts", r["ts"].cast("timestamp"))


@query("stream_status", fx.sql_with(["fx7"], """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, status, count(*) AS updates FROM (SELECT date_trunc('hour', ts) AS w, status FROM fx7)
WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM fx7) GROUP BY w, status"""))
def stream_status(spark, d):
    out = live.status_counts(updates(spark, d).select("ts", "status"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "status", "updates")


@query("stream_latest", fx.sql_with(["fx7"], """SELECT episode_id, record_id, status FROM fx7 QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY ts DESC, record_id DESC) = 1"""))
def stream_latest(spark, d):
    return live.latest_states(updates(spark, d))


#: The statuses of records as they were a day before the newest update: what is later still waits for the watermark.
LIVE_SQL = """SELECT status, CAST(sum(change) AS BIGINT) AS records, CAST(sum(greatest(change, 0)) AS BIGINT) AS entered, CAST(sum(greatest(-change, 0)) AS BIGINT) AS departed FROM (
  SELECT status, 1 AS change FROM moves WHERE enters UNION ALL SELECT old_status, -1 FROM moves WHERE enters AND old_status IS NOT NULL AND NOT gap
  UNION ALL SELECT status, -1 FROM moves WHERE (next_us IS NULL AND us + 432000000000 <= passed) OR next_us >= us + 432000000000) GROUP BY status"""
MOVES_SQL = """SELECT *, old_us IS NOT NULL AND us >= old_us + 432000000000 AS gap, old_us IS NULL OR status <> old_status OR us >= old_us + 432000000000 AS enters FROM (
  SELECT *, lag(status) OVER w AS old_status, lag(us) OVER w AS old_us, lead(us) OVER w AS next_us FROM (
   SELECT episode_id, record_id, status, epoch_us(ts) AS us, (SELECT (epoch_us(max(ts)) // 1000 - 86400000) * 1000 FROM fx7) AS passed FROM fx7) WHERE us <= passed
  WINDOW w AS (PARTITION BY episode_id ORDER BY us, record_id))"""


@query("stream_live", fx.sql_with(["fx7"], LIVE_SQL, [("moves", MOVES_SQL)]))
def stream_live(spark, d):
    return live.live_counts(live.drain(live.record_moves(updates(spark, d), late="1 day", expire="5 days")))


SPACING_MIN = 360
#: How late a row of the table may come; its files may be read in any order, so a whole month.
ARRIVAL = "31 days"
PICK_SQL = """/*RECURSIVE*/SELECT user_id, min(pos) AS pos FROM ev GROUP BY user_id
UNION ALL SELECT p.user_id, min(e.pos) FROM pk p JOIN ev e ON e.user_id = p.user_id AND e.pos >= p.pos + 360 GROUP BY p.user_id, p.pos"""
PICK_ARGS = [("ev", "SELECT user_id, epoch_us(ts) // 60000000 AS pos FROM events WHERE value > 50"), ("pk", PICK_SQL)]


def loud_minutes(events):
    """Minutes of loud events; as a stream they keep their time."""
    ts = [F.col("ts").cast("timestamp").alias("ts")] if events.isStreaming else []
    return events.filter("value > 50").select("user_id", F.floor(fx.micros(F.col("ts")) / 60000000).alias("pos"), *ts)


@query("stream_cuts", fx.sql_with([], "SELECT user_id, pos FROM pk", PICK_ARGS))
def stream_cuts(spark, d):
    events = loud_minutes(live.source(spark, d, "events"))
    return live.drain_to_the_end(events, lambda e: live.spaced_pick(e, "user_id", "pos", SPACING_MIN, late=ARRIVAL))


@query("batch_cuts", fx.sql_with([], "SELECT user_id, pos FROM pk", PICK_ARGS))
def batch_cuts(spark, d):
    return ordered.pick_spaced(loud_minutes(fx.table(spark, d, "events")), ["user_id"], "pos", SPACING_MIN)


PICK_GRID = sweep.grid(floor=[20.0, 50.0, 150.0], spacing=[90, 360, 1440], limit=[1, 12])
DIP_GRID = sweep.grid(threshold=[10.0, 20.0, 50.0, 80.0], min_dip=[1, 2, 3, 5])
NUMBERED = "SELECT (row_number() OVER () - 1)::INTEGER AS setting, * FROM "


@query("sweep_picks", fx.sql_with([], """SELECT setting, "floor", spacing, "limit", user_id, picks, first, last FROM st JOIN (
  SELECT "floor", spacing, user_id, count(*) AS picks, min(pos) AS first, max(pos) AS last FROM pk GROUP BY ALL) USING ("floor", spacing) WHERE picks >= "limit\"""", [
    ("st", NUMBERED + """(VALUES (20.0::DOUBLE, 90, 1), (20.0, 90, 12), (20.0, 360, 1), (20.0, 360, 12), (20.0, 1440, 1), (20.0, 1440, 12), (50.0, 90, 1), (50.0, 90, 12), (50.0, 360, 1), (50.0, 360, 12),
      (50.0, 1440, 1), (50.0, 1440, 12), (150.0, 90, 1), (150.0, 90, 12), (150.0, 360, 1), (150.0, 360, 12), (150.0, 1440, 1), (150.0, 1440, 12)) v("floor", spacing, "limit")"""),
    ("ev", """SELECT DISTINCT "floor", spacing, user_id, epoch_us(ts) // 60000000 AS pos FROM events JOIN (SELECT DISTINCT "floor", spacing FROM st) ON value > "floor\""""),
    ("pk", """/*RECURSIVE*/SELECT "floor", spacing, user_id, min(pos) AS pos FROM ev GROUP BY ALL
  UNION ALL SELECT "floor", spacing, p.user_id, min(e.pos) FROM pk p JOIN ev e USING ("floor", spacing, user_id) WHERE e.pos >= p.pos + spacing GROUP BY "floor", spacing, p.user_id, p.pos""")]))
def sweep_picks(spark, d):
    e = fx.table(spark, d, "events").select("user_id", "value", F.floor(fx.micros(F.col("ts")) / 60000000).alias("pos"))
    return sweep.sweep_picks(e, ["user_id"], "pos", "value", PICK_GRID)


@query("sweep_dips", fx.sql_with([], """SELECT setting, threshold, min_dip, user_id, count(*) AS dips, max(n) AS longest, min(start) AS first_dip FROM st JOIN (
  SELECT threshold, user_id, g, count(*) AS n, min(us) AS start FROM (
    SELECT threshold, user_id, us, low, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (PARTITION BY threshold, user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT threshold, user_id, event_id, epoch_us(ts) AS us, value < threshold AS low FROM events, (SELECT DISTINCT threshold FROM st))) WHERE low GROUP BY ALL) USING (threshold)
WHERE n >= min_dip GROUP BY ALL""", [
    ("st", "SELECT (row_number() OVER (ORDER BY threshold, min_dip) - 1)::INTEGER AS setting, * FROM (SELECT unnest([10.0::DOUBLE, 20.0, 50.0, 80.0]) AS threshold), (SELECT unnest([1, 2, 3, 5]) AS min_dip)")]))
def sweep_dips(spark, d):
    e = fx.table(spark, d, "events").select("event_id", "user_id", "value", fx.micros(F.col("ts")).alias("us"))
    return sweep.sweep_dips(e, ["user_id"], "us", "event_id", "value", DIP_GRID)


@query("stream_match", fx.sql_with(["eps", "lang_idx"], """SELECT s.scan_pos AS src_file, s.episode_id, l.lang_file,
  CASE WHEN s.episode_id = '' THEN 'No episode ID' WHEN l.lang_file IS NULL THEN 'No match' ELSE '' END AS skip_reason,
  CASE WHEN s.episode_id = '' OR l.lang_file IS NULL THEN 'Skipped' ELSE 'Pending' END AS status
FROM eps s LEFT JOIN lang_idx l ON s.episode_id = l.episode_id AND s.episode_id <> '' WHERE s.side = 'source'"""))
def stream_match(spark, d):
    files = fx.as_catalog(live.source(spark, d, "orders")).filter("side = 'source'").select("scan_pos", "file_name")
    index = catalog.language_index(catalog.with_episode(fx.catalog(spark, d).filter("side = 'language'")))
    return live.drain(live.arrivals(files, index.select("episode_id", "lang_file")))
