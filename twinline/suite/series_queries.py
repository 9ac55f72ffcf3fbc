"""Nearest joins, medians, votes, consensus, runs and checkpoints on event series."""

from pyspark.sql import functions as F

from twinline import fixtures as fx
from twinline.operators import offsets, ordered, series
from twinline.params import DEFAULTS
from twinline.suite.registry import query

US = "epoch_us(ts)"


def events(spark, d, *kinds):
    e = fx.table(spark, d, "events").select("event_id", "user_id", "event_type", "value", fx.micros(F.col("ts")).alias("us"))
    return e.filter(F.col("event_type").isin(*kinds)) if kinds else e


NEAR_SQL = """SELECT t.{key}, t.{x}, CASE WHEN nx IS NULL OR (pv IS NOT NULL AND t.{x} - pv {op} nx - t.{x}) THEN pv ELSE nx END AS near
FROM (SELECT t.{key}, t.{x}, max(a.p) AS pv FROM t LEFT JOIN p a ON a.{key} = t.{key} AND a.p <= t.{x} GROUP BY ALL) t
JOIN (SELECT t.{key}, t.{x}, min(b.p) AS nx FROM t LEFT JOIN p b ON b.{key} = t.{key} AND b.p > t.{x} GROUP BY ALL) n USING ({key}, {x})"""


@query("nearest_ts", fx.sql_with([], NEAR_SQL.format(key="user_id", x="us", op="<"), [
    ("t", f"SELECT DISTINCT user_id, {US} AS us FROM events WHERE event_type = 'click'"),
    ("p", f"SELECT DISTINCT user_id, {US} AS p FROM events WHERE event_type = 'view'")]))
def nearest_ts(spark, d):
    return ordered.nearest(events(spark, d, "click"), events(spark, d, "view"), ["user_id"], "us", "us", "later",
                           series.DAY_US, series.SECOND_US)


SRC_SQL = "SELECT pair_id, t_ms FROM cuts WHERE side = 'src'"
LANG_SQL = "SELECT pair_id, t_ms FROM cuts WHERE side = 'lang'"
SPAN_MS = 1 << 20


def near_cuts(spark, d, tolerance):
    c = fx.cuts(spark, d)
    off = (F.col("pair_id") % 11 - 5) * 1000 + F.when(F.col("t_ms") < 2880000, 0).otherwise((F.col("pair_id") % 3 - 1) * 4000)
    targets = c.filter("side = 'src'").select("pair_id", (F.col("t_ms") - off + 40).alias("target_ms"))
    near = ordered.nearest(targets, c.filter("side = 'lang'"), ["pair_id"], "target_ms", "t_ms", "earlier", SPAN_MS)
    return near.filter(F.abs(F.col("near") - F.col("target_ms")) <= tolerance)


TARGET_SQL = """SELECT DISTINCT pair_id, t_ms - ((pair_id % 11 - 5) * 1000 + CASE WHEN t_ms < 2880000 THEN 0 ELSE (pair_id % 3 - 1) * 4000 END) + 40 AS target_ms
  FROM cuts WHERE side = 'src'"""


@query("nearest_cut", fx.sql_with(["cuts"], f"SELECT * FROM ({NEAR_SQL.format(key='pair_id', x='target_ms', op='<=')}) WHERE abs(near - target_ms) <= 250",
                                  [("t", TARGET_SQL), ("p", "SELECT DISTINCT pair_id, t_ms AS p FROM cuts WHERE side = 'lang'")]))
def nearest_cut(spark, d):
    return near_cuts(spark, d, DEFAULTS.piecewise.match_tolerance_ms)


@query("region_lookup", fx.sql_with([], """SELECT t.user_id, t.us, coalesce(m.off, 0) AS offset_ms FROM t ASOF LEFT JOIN m ON t.user_id = m.user_id AND t.us >= m.us""", [
    ("t", f"SELECT DISTINCT user_id, {US} AS us FROM events WHERE event_type = 'click'"),
    ("m", f"SELECT user_id, {US} AS us, max(CAST(floor(value * 10) AS BIGINT)) AS off FROM events WHERE event_type = 'purchase' GROUP BY ALL")]))
def region_lookup(spark, d):
    marks = events(spark, d, "purchase").withColumn("off", F.floor(F.col("value") * 10))
    found = ordered.last_at_or_before(events(spark, d, "click"), marks, ["user_id"], "us", "us", ["off"], series.DAY_US, series.SECOND_US)
    return found.select("user_id", "us", F.coalesce("off", F.lit(0)).alias("offset_ms"))


@query("offset_candidates", fx.sql_with(["cuts"], """SELECT s.pair_id, l.t_ms - s.t_ms AS "offset", count(*) AS n FROM cuts s JOIN cuts l USING (pair_id)
WHERE s.side = 'src' AND l.side = 'lang' AND s.t_ms >= 1000 AND s.t_ms < 121000 AND l.t_ms < 180000 GROUP BY ALL"""))
def offset_candidates(spark, d):
    c, k = fx.cuts(spark, d), DEFAULTS.constant
    start = k.source_start_sec * 1000
    src = c.filter((F.col("side") == "src") & (F.col("t_ms") >= start) & (F.col("t_ms") < start + k.source_duration_sec * 1000))
    lang = c.filter((F.col("side") == "lang") & (F.col("t_ms") < k.lang_duration_sec * 1000))
    return offsets.candidates(src.select("pair_id", "t_ms"), lang.select("pair_id", "t_ms"), "pair_id", "t_ms")


CAND_SQL = """SELECT s.pair_id, l.t_ms - s.t_ms AS x FROM cuts s JOIN cuts l USING (pair_id)
WHERE s.side = 'src' AND l.side = 'lang' AND s.t_ms >= 1000 AND s.t_ms < 121000 AND l.t_ms < 180000"""


@query("offset_cluster", fx.sql_with(["cuts"], """SELECT pair_id, x AS "offset", votes FROM (
  SELECT b.pair_id, r.x, b.votes, row_number() OVER (PARTITION BY b.pair_id ORDER BY r.x) AS rn FROM best b
  JOIN ranked r ON r.pair_id = b.pair_id AND r.x BETWEEN b.top - 40 AND b.top) WHERE rn = votes // 2 + 1""", [
    ("ranked", CAND_SQL),
    ("best", """SELECT pair_id, x AS top, votes FROM (SELECT pair_id, x, votes, row_number() OVER (PARTITION BY pair_id ORDER BY votes DESC, x) AS k FROM (
       SELECT DISTINCT pair_id, x, count(*) OVER (PARTITION BY pair_id ORDER BY x RANGE BETWEEN 40 PRECEDING AND CURRENT ROW) AS votes FROM ranked)) WHERE k = 1""")]))
def offset_cluster(spark, d):
    return offsets.densest_cluster(offset_candidates(spark, d), ["pair_id"], 40).select("pair_id", "offset", "votes")


VOTES_SQL = """SELECT pair_id, offset_ms, count(*) AS votes, any_value(tested) AS tested FROM (
  SELECT f.pair_id, o.offset_ms, f.rn, f.tested FROM f, (SELECT unnest(range(-30000, 30001, 500)) AS offset_ms) o
  WHERE EXISTS (SELECT 1 FROM l WHERE l.pair_id = f.pair_id AND l.t_ms BETWEEN f.t_ms - o.offset_ms - 250 AND f.t_ms - o.offset_ms + 250)) GROUP BY pair_id, offset_ms"""
VOTES_ARGS = [("l", LANG_SQL), ("f", f"""SELECT *, count(*) OVER (PARTITION BY pair_id) AS tested FROM (
  SELECT pair_id, t_ms, row_number() OVER (PARTITION BY pair_id ORDER BY t_ms) AS rn FROM ({SRC_SQL})) WHERE rn <= 50""")]


@query("offset_grid_votes", fx.sql_with(["cuts"], VOTES_SQL, VOTES_ARGS))
def offset_grid_votes(spark, d):
    c = fx.cuts(spark, d)
    return offsets.grid_votes(c.filter("side = 'src'"), c.filter("side = 'lang'"), DEFAULTS.piecewise) \
        .select("pair_id", F.col("offset_ms").cast("bigint").alias("offset_ms"), "votes", "tested")


@query("initial_offset", fx.sql_with(["cuts"], f"""SELECT pair_id, offset_ms, votes, tested FROM (
  SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY votes DESC, offset_ms) AS k FROM ({VOTES_SQL})) WHERE k = 1 AND votes >= tested * 0.3""", VOTES_ARGS))
def initial_offset(spark, d):
    return offsets.initial_offset(offset_grid_votes(spark, d))


@query("upper_median", """SELECT event_type, cents AS median_cents, n AS total FROM (SELECT event_type, cents,
  row_number() OVER (PARTITION BY event_type ORDER BY cents) AS rn, count(*) OVER (PARTITION BY event_type) AS n
  FROM (SELECT event_type, CAST(round_even(value * 100, 0) AS BIGINT) AS cents FROM events)) WHERE rn = n // 2 + 1""")
def upper_median(spark, d):
    e = events(spark, d).withColumn("cents", F.bround(F.col("value") * 100, 0).cast("long"))
    return ordered.upper_median(ordered.histogram(e, ["event_type"], "cents"), ["event_type"], "cents", "median_cents", 256)


@query("region_median", """SELECT user_id, median(cents) AS median_cents, count(*) AS total
  FROM (SELECT user_id, CAST(round_even(value * 100, 0) AS BIGINT) AS cents FROM events) GROUP BY user_id""")
def region_median(spark, d):
    e = events(spark, d).withColumn("cents", F.bround(F.col("value") * 100, 0).cast("long"))
    return ordered.true_median(ordered.histogram(e, ["user_id"], "cents"), ["user_id"], "cents", "median_cents", 256)


@query("delay_consistency", fx.sql_with(["fx7"], """SELECT episode_id, median, n AS total, CAST(sum(CASE WHEN abs(sync_ms - median) <= 40 THEN 1 ELSE 0 END) AS BIGINT) AS consistent FROM (
  SELECT episode_id, sync_ms, n, max(CASE WHEN rn = n // 2 + 1 THEN sync_ms END) OVER (PARTITION BY episode_id) AS median FROM (
   SELECT episode_id, CAST(sync_ms AS BIGINT) AS sync_ms, row_number() OVER (PARTITION BY episode_id ORDER BY sync_ms) AS rn, count(*) OVER (PARTITION BY episode_id) AS n FROM fx7))
  GROUP BY ALL HAVING n >= 3 AND sum(CASE WHEN abs(sync_ms - median) <= 40 THEN 1 ELSE 0 END) >= 3"""))
def delay_consistency(spark, d):
    return offsets.consistency(fx.records(spark, d), ["episode_id"], "sync_ms", 40, DEFAULTS.frames.min_scene_cuts)


@query("offset_consensus", fx.sql_with(["fx7"], """SELECT episode_id, members, total, "offset" FROM (
  SELECT a.episode_id, a.v, count(*) AS members, CAST(trunc(sum(b.v) / count(*)) AS BIGINT) AS "offset", any_value(a.total) AS total,
   row_number() OVER (PARTITION BY a.episode_id ORDER BY count(*) DESC, a.record_id) AS k
  FROM (SELECT episode_id, record_id, CAST(sync_ms AS BIGINT) AS v, count(*) OVER (PARTITION BY episode_id) AS total FROM fx7) a
  JOIN (SELECT episode_id, CAST(sync_ms AS BIGINT) AS v FROM fx7) b ON a.episode_id = b.episode_id AND abs(a.v - b.v) <= 40
  GROUP BY a.episode_id, a.record_id, a.v) WHERE k = 1 AND members >= 5"""))
def offset_consensus(spark, d):
    return offsets.consensus(fx.records(spark, d), ["episode_id"], "sync_ms", F.col("record_id"), 40, DEFAULTS.constant.min_valid_points)


RUNS_SQL = """SELECT user_id, g AS run_id, count(*) AS run_length, min(us) AS run_start FROM (
  SELECT user_id, us, low, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT user_id, event_id, epoch_us(ts) AS us, value < {t} AS low FROM events {w})) WHERE low GROUP BY user_id, g"""


@query("dip_runs", f"SELECT user_id, run_start, run_length FROM ({RUNS_SQL.format(t=20, w='')}) WHERE run_length >= 2")
def dip_runs(spark, d):
    runs = series.low_runs(events(spark, d), ["user_id"], "us", "event_id", "value", 20.0)
    return series.dip_runs(runs, DEFAULTS.piecewise.dense_scan_min_dip).select("user_id", "run_start", "run_length")


@query("first_dip", f"""SELECT user_id, coalesce(dip, lowest) AS position, dip IS NOT NULL AS is_dip FROM
  (SELECT user_id, first(us ORDER BY value, us, event_id) AS lowest FROM (SELECT *, {US} AS us FROM events) GROUP BY user_id)
  LEFT JOIN (SELECT user_id, min(run_start) AS dip FROM ({RUNS_SQL.format(t=50, w='')}) WHERE run_length >= 2 GROUP BY user_id) USING (user_id)""")
def first_dip(spark, d):
    e = events(spark, d)
    runs = series.low_runs(e, ["user_id"], "us", "event_id", "value", 50.0)
    return series.first_dip(e, runs, ["user_id"], "us", "event_id", "value", DEFAULTS.piecewise.dense_scan_min_dip)


@query("confirmed_run", f"""SELECT user_id, coalesce(run, est) AS position, run IS NOT NULL AS confirmed FROM
  (SELECT user_id, max({US}) AS est FROM events GROUP BY user_id)
  LEFT JOIN (SELECT user_id, min(run_start) AS run FROM ({RUNS_SQL.format(t=50, w="WHERE event_type <> 'error'")}) WHERE run_length >= 5 GROUP BY user_id) USING (user_id)""")
def confirmed_run(spark, d):
    e = events(spark, d)
    matched = e.filter("event_type <> 'error'")  # samples without a match do not break a run
    runs = series.low_runs(matched, ["user_id"], "us", "event_id", "value", 50.0)
    return series.confirmed_run(e.groupBy("user_id").agg(F.max("us").alias("est")), runs, ["user_id"], "est", DEFAULTS.piecewise.linear_scan_confirm)


@query("resample_grid", f"""SELECT user_id, cell, value FROM (SELECT user_id, us // 3600000000 AS cell, value,
  row_number() OVER (PARTITION BY user_id, us // 3600000000 ORDER BY us, event_id) AS k FROM (SELECT *, {US} AS us FROM events)) WHERE k = 1""")
def resample_grid(spark, d):
    from twinline.operators import frames
    return frames.resample(events(spark, d), ["user_id"], F.col("us") / 1000, 1 / 3600, ["value"], F.struct("us", "event_id"))


DUR_SQL = "SELECT pair_id, max(t_ms) AS dur FROM cuts GROUP BY pair_id"


def durations(spark, d):
    return fx.cuts(spark, d).groupBy("pair_id").agg(F.max("t_ms").alias("dur"))


@query("checkpoints", fx.sql_with(["cuts"], f"""SELECT pair_id, 'tenth' AS kind, CAST(p AS INTEGER) AS point, CAST(dur * (p + 1) * 10 // 100 AS DOUBLE) AS point_ms FROM ({DUR_SQL}), range(9) r(p)
UNION ALL SELECT pair_id, 'even', CAST(p AS INTEGER), round_even(dur / 31.0 * p, 6) FROM ({DUR_SQL}), range(1, 31) r(p)"""))
def checkpoints(spark, d):
    dur = durations(spark, d)
    a = series.checkpoints(dur, ["pair_id"], "dur").select("pair_id", F.lit("tenth").alias("kind"), "point", F.col("point_ms").cast("double"))
    return a.unionByName(series.even_points(dur, ["pair_id"], "dur").select(
        "pair_id", F.lit("even").alias("kind"), "point", F.bround("point_ms", 6).alias("point_ms")))


@query("duration_gate", fx.sql_with(["cuts"], f"""SELECT pair_id, duration_ms, CASE WHEN duration_ms < 10000 THEN 'too short' WHEN fps <= 0 THEN 'no rate' ELSE '' END AS gate FROM (
  SELECT pair_id, dur % 20001 AS duration_ms, CASE WHEN pair_id % 5 = 0 THEN 0 ELSE 25 END AS fps FROM ({DUR_SQL}))"""))
def duration_gate(spark, d):
    """Durations of the cut timelines, folded to both sides of the ten seconds that a search needs."""
    from twinline.plans import align
    pairs = durations(spark, d).select("pair_id", (F.col("dur") % 20001).alias("duration_ms"), F.when(F.col("pair_id") % 5 == 0, 0.0).otherwise(25.0).alias("fps"))
    return align.duration_gate(pairs).select("pair_id", "duration_ms", "gate")


@query("drift_offset", fx.sql_with(["fx7"], """SELECT record_id, sync_ms + CAST(round_even(record_id * (41708000 / 40000000.0::DOUBLE - 1.0), 0) AS BIGINT) AS expected_ms,
  CAST(round_even(-sync_ms * (40000000.0::DOUBLE / 41708000), 0) AS BIGINT) AS speed_delay_ms FROM fx7"""))
def drift_offset(spark, d):
    return fx.records(spark, d).select(
        "record_id", series.expected_offset(F.col("sync_ms"), F.col("record_id"), 41708000 / 40000000).alias("expected_ms"),
        F.bround(-F.col("sync_ms") * (40000000 / 41708000), 0).cast("bigint").alias("speed_delay_ms"))


@query("drift_normalise", fx.sql_with(["fx7"], """SELECT record_id, round_even(sync_ms - (record_id - 5000) * (41708000 / 40000000.0::DOUBLE - 1.0), 6) AS offset_ms FROM fx7"""))
def drift_normalise(spark, d):
    return fx.records(spark, d).select("record_id", F.bround(series.drift_normalised(
        F.col("sync_ms"), F.col("record_id"), F.lit(5000), 41708000 / 40000000), 6).alias("offset_ms"))


# checkpoint results made of records: one row per episode and checkpoint number
POINTS_SQL = """SELECT episode_id, CAST(record_id % 9 AS INTEGER) AS point, CAST(first(sync_ms ORDER BY record_id) AS BIGINT) AS "offset",
  first((record_id % 1000) / 1000.0::DOUBLE + 0.0003 ORDER BY record_id) AS score, CASE WHEN first(record_id ORDER BY record_id) % 2 = 0 THEN 'ssim' ELSE 'corr' END AS method,
  abs(first(sync_ms ORDER BY record_id)) <= 250 AS valid, abs(first(sync_ms ORDER BY record_id)) <= 400 AS valid2 FROM fx7 GROUP BY episode_id, record_id % 9"""


def points(spark, d, bound=250):
    first = F.min_by(F.struct("record_id", "sync_ms"), "record_id")
    p = (fx.records(spark, d).groupBy("episode_id", (F.col("record_id") % 9).cast("int").alias("point")).agg(first.alias("f"))
         .select("episode_id", "point", F.col("f.sync_ms").cast("bigint").alias("offset"), ((F.col("f.record_id") % 1000) / 1000.0 + 0.0003).alias("score"),
                 F.when(F.col("f.record_id") % 2 == 0, "ssim").otherwise("corr").alias("method")))
    return p.withColumn("valid", F.abs("offset") <= bound)


@query("checkpoint_score", fx.sql_with(["fx7"], """SELECT episode_id, CAST(record_id % 9 AS INTEGER) AS point,
  CASE WHEN count(*) FILTER (record_id % 2 = 0) > 0 THEN 'ssim' ELSE 'corr' END AS method,
  coalesce(max((record_id % 1000) / 1000.0::DOUBLE) FILTER (record_id % 2 = 0), max((record_id % 1000) / 1000.0::DOUBLE)) AS score FROM fx7 GROUP BY episode_id, record_id % 9"""))
def checkpoint_score(spark, d):
    rows = fx.records(spark, d).select("episode_id", (F.col("record_id") % 9).cast("int").alias("point"),
                                       F.when(F.col("record_id") % 2 == 0, "ssim").otherwise("corr").alias("method"),
                                       ((F.col("record_id") % 1000) / 1000.0).alias("score"))
    return series.checkpoint_scores(rows, ["episode_id", "point"])


@query("checkpoint_validity", fx.sql_with(["fx7"], """SELECT episode_id, count(*) FILTER (valid) AS valid_points, count(*) AS points, count(*) FILTER (valid) >= 5 AS verified FROM p GROUP BY episode_id""", [("p", POINTS_SQL)]))
def checkpoint_validity(spark, d):
    return series.validity(points(spark, d), ["episode_id"], DEFAULTS.frames.min_valid_points)


RETRY_SQL = """SELECT episode_id, point, CASE WHEN retried THEN "offset" + 1 ELSE "offset" END AS "offset", score, method, CASE WHEN retried THEN valid2 ELSE valid END AS valid, retried FROM (
  SELECT *, NOT valid AND count(*) FILTER (NOT valid) OVER (PARTITION BY episode_id) < count(*) OVER (PARTITION BY episode_id) AS retried FROM p)"""


@query("retry_points", fx.sql_with(["fx7"], RETRY_SQL, [("p", POINTS_SQL)]))
def retry_points(spark, d):
    second = points(spark, d, 400).withColumn("offset", F.col("offset") + 1)
    return series.with_retry(points(spark, d), second, ["episode_id"])


@query("detail_summary", fx.sql_with(["fx7"], """SELECT episode_id, string_agg(((point + 1) * 10) || '%=' || CASE WHEN NOT valid THEN 'FAIL'
  WHEN method = 'corr' THEN "offset" || 'ms(corr:' || printf('%.2f', score) || ')' ELSE "offset" || 'ms(SSIM:' || printf('%.3f', score) || ')' END, ', ' ORDER BY point) AS summary
  FROM p GROUP BY episode_id""", [("p", POINTS_SQL)]))
def detail_summary(spark, d):
    return series.detail_summary(points(spark, d), ["episode_id"])
