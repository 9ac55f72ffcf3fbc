"""Piecewise offsets: regions, splits, merges, edit operations, segments, probes, verification."""

from pyspark.sql import functions as F

from twinline import fixtures as fx
from twinline.operators import frames as fr
from twinline.operators import offsets, ordered, regions, series
from twinline.params import DEFAULTS, PiecewiseSettings
from twinline.suite.frame_queries import SSIM_SQL, sums_sql
from twinline.suite.registry import query
from twinline.suite.series_queries import VOTES_ARGS, VOTES_SQL

RG_SQL = """SELECT pair_id, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY pair_id ORDER BY start_ms), last_ms) AS end_ms, offset_ms, match_count,
  row_number() OVER (PARTITION BY pair_id ORDER BY start_ms) AS idx FROM (
  SELECT pair_id, t_ms // 600000 AS w, CAST(min(t_ms) AS DOUBLE) AS start_ms, count(*) AS match_count,
   ((pair_id % 11 - 5) * 1000 + ((w * w) % 3) * 500) + (pair_id % 4) * w * 0.4::DOUBLE AS offset_ms FROM cuts WHERE side = 'src' GROUP BY pair_id, t_ms // 600000)
  JOIN (SELECT pair_id, CAST(max(t_ms) AS DOUBLE) AS last_ms FROM cuts WHERE side = 'src' GROUP BY pair_id) USING (pair_id)"""


def region_table(spark, d):
    """Regions with equal, nearly equal and different neighbours, made of the cut timeline."""
    src = fx.cuts(spark, d).filter("side = 'src'")
    w = F.floor(F.col("t_ms") / 600000)
    g = src.groupBy("pair_id", w.alias("w")).agg(F.min("t_ms").cast("double").alias("start_ms"), F.count(F.lit(1)).alias("match_count"))
    g = g.withColumn("offset_ms", ((F.col("pair_id") % 11 - 5) * 1000 + ((F.col("w") * F.col("w")) % 3) * 500) + (F.col("pair_id") % 4) * F.col("w") * F.lit(0.4))
    g = ordered.with_neighbour(g, ["pair_id"], "w", ["start_ms"], 4096, "next_", following=True)
    last = src.groupBy("pair_id").agg(F.max("t_ms").cast("double").alias("last_ms"))
    return g.join(last, "pair_id").select("pair_id", "start_ms", F.coalesce("next_start_ms", "last_ms").alias("end_ms"), "offset_ms", "match_count")


OUT = "pair_id, start_ms, end_ms, round_even(offset_ms, 6) AS offset_ms, match_count"


def shown(df):
    return df.select("pair_id", "start_ms", "end_ms", F.bround("offset_ms", 6).alias("offset_ms"), "match_count")


def closest_sql(x, limit):
    return f"list_sort(list_transform(list_filter(lg.l, lambda v: abs(v - ({x})) <= {limit}), lambda v: {{'d': abs(v - ({x})), 'v': v}}))[1].v"


# one step per source cut: f, c, w are the language cuts near the current offset, near the candidate, and in the wide search
SCAN_SQL = f"""/*RECURSIVE*/SELECT pair_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS hit, CAST(-1 AS BIGINT) AS hit_region, false AS changed, CAST(offset_ms AS BIGINT) AS cur,
  CAST(0 AS BIGINT) AS run, CAST(0 AS BIGINT) AS cand, CAST(0 AS BIGINT) AS run_t, CAST(-1 AS BIGINT) AS region_t FROM init
UNION ALL SELECT pair_id, i, CASE WHEN f IS NOT NULL AND NOT jump THEN t - f END, region_t, run2 >= 5, CASE WHEN run2 >= 5 THEN cand2 ELSE cur END,
  CASE WHEN run2 >= 5 THEN 0 ELSE run2 END, cand2, run_t2, CASE WHEN run2 >= 5 THEN run_t2 ELSE region_t END FROM (
  SELECT *, CASE WHEN jump AND (run = 0 OR abs(t - f - cand) < 250) THEN run + 1 WHEN jump THEN 1 WHEN f IS NOT NULL THEN 0 WHEN run > 0 AND c IS NOT NULL THEN run + 1
      WHEN run > 0 THEN 0 WHEN wide THEN 1 ELSE 0 END AS run2,
    CASE WHEN jump AND (run = 0 OR abs(t - f - cand) >= 250) THEN t - f WHEN f IS NULL AND run = 0 AND wide THEN t - w ELSE cand END AS cand2,
    CASE WHEN (jump AND (run = 0 OR abs(t - f - cand) >= 250)) OR (f IS NULL AND run = 0 AND wide) THEN t ELSE run_t END AS run_t2 FROM (
    SELECT *, f IS NOT NULL AND abs(t - f - cur) > 500 AS jump, w IS NOT NULL AND abs(t - w - cur) > 500 AS wide FROM (
      SELECT scan.pair_id, s.i, s.t, cur, run, cand, run_t, region_t, {closest_sql('s.t - cur', 250)} AS f, {closest_sql('s.t - cand', 250)} AS c, {closest_sql('s.t - cur', 15000)} AS w
      FROM scan JOIN s ON s.pair_id = scan.pair_id AND s.i = scan.i + 1 JOIN lg ON lg.pair_id = scan.pair_id)))"""
REGION_ARGS = [*VOTES_ARGS,
               ("s", "SELECT pair_id, t_ms AS t, row_number() OVER (PARTITION BY pair_id ORDER BY t_ms) AS i, count(*) OVER (PARTITION BY pair_id) AS n, max(t_ms) OVER (PARTITION BY pair_id) AS last_ms FROM cuts WHERE side = 'src'"),
               ("lg", "SELECT pair_id, list(DISTINCT t_ms) AS l FROM cuts WHERE side = 'lang' GROUP BY pair_id HAVING count(*) >= 3"),
               ("init", f"""SELECT pair_id, offset_ms FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY votes DESC, offset_ms) AS k FROM ({VOTES_SQL}))
                  WHERE k = 1 AND votes >= tested * 0.3 AND pair_id IN (SELECT pair_id FROM lg) AND pair_id IN (SELECT pair_id FROM s WHERE n >= 3)"""),
               ("scan", SCAN_SQL),
               ("regs", """SELECT pair_id, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY pair_id ORDER BY region_t), last_ms) AS end_ms, offset_ms, match_count FROM (
                  SELECT o.pair_id, region_t, CAST(greatest(region_t, 0) AS DOUBLE) AS start_ms, CAST(coalesce(med, base) AS DOUBLE) AS offset_ms, CAST(opening + coalesce(n, 0) AS BIGINT) AS match_count FROM (
                    SELECT pair_id, CAST(-1 AS BIGINT) AS region_t, offset_ms AS base, 0 AS opening FROM init UNION ALL SELECT pair_id, region_t, cur, 5 FROM scan WHERE changed) o
                  LEFT JOIN (SELECT pair_id, hit_region AS region_t, median(hit) AS med, count(*) AS n FROM scan WHERE hit IS NOT NULL GROUP BY ALL) h USING (pair_id, region_t))
                  JOIN (SELECT pair_id, CAST(max(last_ms) AS DOUBLE) AS last_ms FROM s GROUP BY pair_id) USING (pair_id)""")]


@query("offset_regions", fx.sql_with(["cuts"], f"SELECT {OUT} FROM regs", REGION_ARGS))
def offset_regions(spark, d):
    from twinline.plans import align
    c = fx.cuts(spark, d)
    return shown(align.offset_regions(c.filter("side = 'src'"), c.filter("side = 'lang'"), DEFAULTS.piecewise))


DIP_SQL = """SELECT r.pair_id, r.start_ms AS region_start, e.t_ms AS dip_ms, e.delta_ms FROM rg r JOIN (
  SELECT user_id AS pair_id, t_ms, arg_min((event_id % 3 - 1) * 1000, event_id) AS delta_ms FROM (
   SELECT *, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 600000) AS BIGINT) AS t_ms FROM events WHERE event_type = 'error') GROUP BY ALL) e
  ON e.pair_id = r.pair_id AND e.t_ms > r.start_ms AND e.t_ms < r.end_ms AND r.end_ms - r.start_ms >= 20000"""


def dip_table(spark, d, rg):
    e = fx.table(spark, d, "events").filter("event_type = 'error'").select(
        F.col("user_id").alias("pair_id"), F.floor((fx.micros(F.col("ts")) - 1704067200000000) / 600000).alias("t"), "event_id")
    dips = e.groupBy("pair_id", "t").agg(F.min_by((F.col("event_id") % 3 - 1) * 1000, "event_id").alias("delta_ms"))
    marks = rg.select("pair_id", F.col("start_ms").cast("long").alias("s"), "start_ms", "end_ms")
    at = ordered.last_at_or_before(dips, marks, ["pair_id"], "t", "s", ["start_ms", "end_ms"], regions.CHUNK_MS)
    return (dips.join(at, ["pair_id", "t"]).filter((F.col("t") > F.col("start_ms")) & (F.col("t") < F.col("end_ms")))
            .select("pair_id", F.col("start_ms").alias("region_start"), F.col("t").alias("dip_ms"), "delta_ms"))


@query("region_split", fx.sql_with(["cuts"], f"""SELECT pair_id, start_ms, coalesce(nxt, end_ms) AS end_ms, round_even(offset_ms + shift, 6) AS offset_ms, match_count // (n + 1) AS match_count FROM (
  SELECT *, sum(delta_ms) OVER (PARTITION BY pair_id, region_start ORDER BY start_ms) AS shift, lead(start_ms) OVER (PARTITION BY pair_id, region_start ORDER BY start_ms) AS nxt FROM (
    SELECT pair_id, start_ms AS region_start, start_ms, 0 AS delta_ms FROM rg UNION ALL SELECT pair_id, region_start, CAST(dip_ms AS DOUBLE), delta_ms FROM dips WHERE delta_ms <> 0))
  JOIN (SELECT pair_id, start_ms AS region_start, end_ms, offset_ms, match_count FROM rg) USING (pair_id, region_start)
  JOIN (SELECT rg.pair_id, rg.start_ms AS region_start, count(dip_ms) AS n FROM rg LEFT JOIN dips ON dips.pair_id = rg.pair_id AND dips.region_start = rg.start_ms GROUP BY ALL) USING (pair_id, region_start)""",
                               [("rg", RG_SQL), ("dips", DIP_SQL)]))
def region_split(spark, d):
    rg = region_table(spark, d)
    return shown(regions.split_at_dips(rg, dip_table(spark, d, rg)))


MERGE_SQL = """/*RECURSIVE*/SELECT pair_id, idx, offset_ms AS head, start_ms AS head_start FROM rg WHERE idx = 1
  UNION ALL SELECT r.pair_id, r.idx, CASE WHEN abs(r.offset_ms - m.head) < 1 THEN m.head ELSE r.offset_ms END, CASE WHEN abs(r.offset_ms - m.head) < 1 THEN m.head_start ELSE r.start_ms END
  FROM m JOIN rg r ON r.pair_id = m.pair_id AND r.idx = m.idx + 1"""


@query("region_merge", fx.sql_with(["cuts"], """SELECT pair_id, head_start AS start_ms, arg_max(end_ms, idx) AS end_ms, round_even(any_value(head), 6) AS offset_ms, CAST(sum(match_count) AS BIGINT) AS match_count
FROM m JOIN rg USING (pair_id, idx) GROUP BY pair_id, head_start""", [("rg", RG_SQL), ("m", MERGE_SQL)]))
def region_merge(spark, d):
    return shown(regions.merge_equal(region_table(spark, d)))


OPS_SQL = """SELECT pair_id, CASE WHEN n_off > offset_ms THEN 'INSERT_SILENCE' ELSE 'CUT_SEGMENT' END AS type, CAST(round_even(x - offset_ms, 0) AS BIGINT) AS lang_ts_ms,
  abs(CAST(round_even(n_off - offset_ms, 0) AS BIGINT)) AS duration_ms, CAST(round_even(x, 0) AS BIGINT) AS source_ts_ms FROM (
  SELECT *, (greatest(start_ms + CASE WHEN idx > 1 THEN 10000 ELSE 0 END, 5000.0) + least(end_ms + 10000, n_end)) / 2.0 AS x FROM (
   SELECT *, lead(offset_ms) OVER w AS n_off, lead(end_ms) OVER w AS n_end FROM rg WINDOW w AS (PARTITION BY pair_id ORDER BY idx)) WHERE n_off IS NOT NULL)"""


@query("edit_ops", fx.sql_with(["cuts"], OPS_SQL, [("rg", RG_SQL)]))
def edit_ops(spark, d):
    return regions.edit_operations(regions.search_range(regions.transitions(region_table(spark, d))), "crossover_ms")


@query("edit_map_summary", fx.sql_with(["cuts"], f"""SELECT pair_id, n AS op_count, src AS source_cuts, lang AS lang_cuts, matched AS matched_cuts, CAST(round_even(first_off, 0) AS BIGINT) AS initial_delay_ms, round_even(base, 6) AS baseline_mse
FROM (SELECT pair_id, count(*) - 1 AS n, CAST(sum(match_count) AS BIGINT) AS matched, arg_min(offset_ms, idx) AS first_off FROM rg GROUP BY pair_id)
JOIN (SELECT pair_id, count(*) FILTER (side = 'src') AS src, count(*) FILTER (side = 'lang') AS lang FROM cuts GROUP BY pair_id) USING (pair_id)
JOIN (SELECT user_id AS pair_id, avg(value) AS base FROM events GROUP BY user_id) USING (pair_id)""", [("rg", RG_SQL)]))
def edit_map_summary(spark, d):
    from twinline.plans import align
    rg = region_table(spark, d)
    ops = regions.edit_operations(regions.search_range(regions.transitions(rg)), "crossover_ms")
    base = fx.table(spark, d, "events").groupBy(F.col("user_id").alias("pair_id")).agg(F.avg("value").alias("baseline_mse"))
    s = align.edit_map(rg, ops, fx.cuts(spark, d), base)
    return s.withColumn("baseline_mse", F.bround("baseline_mse", 6))


CUE_OPS_SQL = """SELECT pair_id, cue_id AS op_idx, CASE WHEN cue_id % 2 = 0 THEN 'INSERT_SILENCE' ELSE 'CUT_SEGMENT' END AS type,
  start_ms + 2500 AS lang_ts_ms, 3000 + (cue_id % 3) * 4000 AS duration_ms FROM fx6 WHERE cue_id % 3 <> 1"""
SEG_SQL = """SELECT pair_id, op_idx, 0 AS part, 'keep' AS kind, s AS start_ms, lang_ts_ms AS end_ms FROM o WHERE lang_ts_ms > s
UNION ALL SELECT pair_id, op_idx, 1, 'silence', 0, duration_ms FROM o WHERE type = 'INSERT_SILENCE'
UNION ALL SELECT pair_id, max(op_idx) + 1, 0, 'keep', arg_max(e, op_idx), NULL FROM o GROUP BY pair_id"""
SEG_ARGS = [("ops", CUE_OPS_SQL), ("o", """SELECT *, coalesce(lag(e) OVER (PARTITION BY pair_id ORDER BY op_idx), 0) AS s FROM (
  SELECT *, lang_ts_ms + CASE WHEN type = 'CUT_SEGMENT' THEN duration_ms ELSE 0 END AS e FROM ops)"""), ("seg", SEG_SQL)]


def cue_ops(spark, d):
    n = F.col("cue_id")
    return fx.cues(spark, d).filter(n % 3 != 1).select(
        "pair_id", n.alias("op_idx"), F.when(n % 2 == 0, "INSERT_SILENCE").otherwise("CUT_SEGMENT").alias("type"),
        (F.col("start_ms") + 2500).alias("lang_ts_ms"), (3000 + (n % 3) * 4000).alias("duration_ms"))


@query("segments", fx.sql_with(["fx6"], "SELECT pair_id, op_idx, part, kind, start_ms, end_ms FROM seg", SEG_ARGS))
def segments(spark, d):
    return regions.kept_segments(cue_ops(spark, d))


@query("retime_cues", fx.sql_with(["fx6"], """SELECT 'reference' AS gap_mode, pair_id, cue_id, CAST(min(os + greatest(c.start_ms, g.start_ms) - g.start_ms) AS BIGINT) AS new_start_ms, CAST(max(os + least(c.end_ms, g.end_ms) - g.start_ms) AS BIGINT) AS new_end_ms
FROM fx6 c JOIN g1 g USING (pair_id) WHERE greatest(c.start_ms, g.start_ms) < least(c.end_ms, g.end_ms) GROUP BY ALL
UNION ALL SELECT 'shift', pair_id, cue_id, CAST(min(os + greatest(c.start_ms, g.start_ms) - g.start_ms) AS BIGINT), CAST(max(os + least(c.end_ms, g.end_ms) - g.start_ms) AS BIGINT)
FROM fx6 c JOIN g2 g USING (pair_id) WHERE kind = 'keep' AND greatest(c.start_ms, g.start_ms) < least(c.end_ms, g.end_ms) GROUP BY ALL
UNION ALL SELECT m, pair_id, cue_id, start_ms, end_ms FROM fx6, (VALUES ('reference'), ('shift')) v(m) WHERE pair_id NOT IN (SELECT pair_id FROM ops)""", SEG_ARGS + [
    ("g1", "SELECT *, coalesce(sum(end_ms - start_ms) OVER (PARTITION BY pair_id ORDER BY op_idx, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS os FROM (SELECT * REPLACE (coalesce(end_ms, 1000000000000) AS end_ms) FROM seg WHERE kind = 'keep')"),
    ("g2", "SELECT *, coalesce(sum(end_ms - start_ms) OVER (PARTITION BY pair_id ORDER BY op_idx, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS os FROM (SELECT * REPLACE (coalesce(end_ms, 1000000000000) AS end_ms) FROM seg)")]))
def retime_cues(spark, d):
    cues, seg = fx.cues(spark, d), regions.kept_segments(cue_ops(spark, d))
    return regions.retime(cues, seg, ("reference", "shift")).select("gap_mode", "pair_id", "cue_id", "new_start_ms", "new_end_ms")


SHORT_PROBES = PiecewiseSettings(probe_margins_sec=(1.0, 2.0, 3.0), probe_duration_sec=1.0)
PROBE_ARGS = [("pr", """SELECT file_id, m.no AS margin_no, x.no AS delta_no, x.delta AS delta_ms, 5000 + m.ms AS src_start, 5000 + m.ms - 480 - x.delta AS lang_start FROM (SELECT DISTINCT file_id FROM fx1),
   (VALUES (0, 1000), (1, 2000), (2, 3000)) m(no, ms), (SELECT generate_subscripts(v, 1) - 1 AS no, unnest(v) AS delta FROM (SELECT [1000, 2000, 3000, 4000, 5000, -1000, -2000, -3000, -4000, -5000] AS v)) x"""),
              ("a", "SELECT pr.file_id, margin_no, delta_no, f.frame_idx, f.ts_ms - min(f.ts_ms) OVER (PARTITION BY pr.file_id, margin_no, delta_no) AS rel, px FROM pr JOIN fx1 f ON f.file_id = pr.file_id AND ts_ms >= src_start AND ts_ms < src_start + 1000 WHERE lang_start >= 0"),
              ("b", "SELECT pr.file_id, margin_no, delta_no, f.ts_ms - min(f.ts_ms) OVER (PARTITION BY pr.file_id, margin_no, delta_no) AS rel, px FROM pr JOIN fx2 f ON f.file_id = pr.file_id AND ts_ms >= lang_start AND ts_ms < lang_start + 1000 WHERE lang_start >= 0"),
              ("m", f"""SELECT file_id, margin_no, delta_no, {sums_sql('apx', 'bpx')} FROM (SELECT a.file_id, a.margin_no, a.delta_no, a.px AS apx, b.px AS bpx, abs(a.rel - b.rel) AS dist,
                 row_number() OVER (PARTITION BY a.file_id, a.margin_no, a.delta_no, a.frame_idx ORDER BY abs(a.rel - b.rel), b.rel DESC) AS k FROM a JOIN b USING (file_id, margin_no, delta_no)) WHERE k = 1 AND dist <= 500"""),
              ("sc", f"""SELECT pr.file_id, pr.margin_no, pr.delta_no, pr.delta_ms, coalesce(na, 0) AS src_frames, coalesce(nb, 0) AS lang_frames, coalesce(s, 0.0) AS mean_ssim FROM pr
                 LEFT JOIN (SELECT file_id, margin_no, delta_no, count(*) AS na FROM a GROUP BY ALL) USING (file_id, margin_no, delta_no)
                 LEFT JOIN (SELECT file_id, margin_no, delta_no, count(*) AS nb FROM b GROUP BY ALL) USING (file_id, margin_no, delta_no)
                 LEFT JOIN (SELECT file_id, margin_no, delta_no, avg({SSIM_SQL}) AS s FROM m GROUP BY ALL) USING (file_id, margin_no, delta_no) WHERE lang_start >= 0""")]
PROBE_KEYS = ["file_id", "margin_no", "delta_no"]


def probes(spark, d):
    from twinline.plans import align
    src, lang = fx.frames(spark, d), fx.lang_frames(spark, d)
    dips = src.select("file_id").distinct().select("file_id", F.lit(5000).alias("dip_ms"), F.lit(480).alias("offset_ms"))
    return align.score_probes(src, lang, regions.probe_grid(dips, SHORT_PROBES), PROBE_KEYS)


@query("probe_candidates", fx.sql_with(["fx1", "fx2"], "SELECT file_id, CAST(margin_no AS INTEGER) AS margin_no, CAST(delta_no AS INTEGER) AS delta_no, delta_ms, src_frames, round_even(mean_ssim, 6) AS mean_ssim FROM sc WHERE lang_frames > 0", PROBE_ARGS))
def probe_candidates(spark, d):
    return probes(spark, d).filter("lang_frames > 0").select("file_id", "margin_no", "delta_no", "delta_ms", "src_frames", F.bround("mean_ssim", 6).alias("mean_ssim"))


@query("probe_consensus", fx.sql_with(["fx1", "fx2"], """SELECT file_id, count(*) AS points, round_even(min(ssim), 6) AS min_ssim,
  CAST(CASE WHEN count(*) >= 2 AND min(delta_ms) = max(delta_ms) AND min(ssim) >= 0.7 THEN min(delta_ms) ELSE 0 END AS BIGINT) AS delta_ms FROM (
  SELECT file_id, margin_no, coalesce(first(delta_ms ORDER BY mean_ssim DESC, delta_no) FILTER (lang_frames >= 2 AND mean_ssim > 0), 0) AS delta_ms,
   coalesce(max(mean_ssim) FILTER (lang_frames >= 2 AND mean_ssim > 0), 0.0) AS ssim FROM sc WHERE src_frames >= 2 GROUP BY ALL) GROUP BY file_id""", PROBE_ARGS))
def probe_consensus(spark, d):
    c = regions.probe_consensus(probes(spark, d), ["file_id"], SHORT_PROBES)
    return c.withColumn("min_ssim", F.bround("min_ssim", 6))


VERIFY_ARGS = [("v", """SELECT file_id, CAST(p AS INTEGER) AS point, CAST(floor(dur / 31.0::DOUBLE * p) AS BIGINT) AS src_start, CAST(floor(dur / 31.0::DOUBLE * p - 1480) AS BIGINT) AS lang_start FROM
   (SELECT file_id, count(*) * 40 AS dur FROM fx1 GROUP BY file_id), range(1, 31) r(p) WHERE dur / 31.0::DOUBLE * p - 1480 >= 0"""),
               ("a", "SELECT *, ts_ms - min(ts_ms) OVER (PARTITION BY file_id, point) AS rel FROM (SELECT v.file_id, point, f.frame_idx, ts_ms, px FROM v JOIN fx1 f ON f.file_id = v.file_id AND ts_ms >= src_start AND ts_ms < src_start + 2000 QUALIFY row_number() OVER (PARTITION BY v.file_id, point, ts_ms // 500 ORDER BY ts_ms) = 1)"),
               ("b", "SELECT *, ts_ms - min(ts_ms) OVER (PARTITION BY file_id, point) AS rel FROM (SELECT v.file_id, point, f.frame_idx, ts_ms, px FROM v JOIN fx2 f ON f.file_id = v.file_id AND ts_ms >= lang_start AND ts_ms < lang_start + 2000 QUALIFY row_number() OVER (PARTITION BY v.file_id, point, ts_ms // 500 ORDER BY ts_ms) = 1)"),
               ("pt", f"""SELECT file_id, point, min((saa + sbb - 2 * sab) / 64.0::DOUBLE) AS mse FROM (SELECT file_id, point, {sums_sql('apx', 'bpx')} FROM (
                  SELECT a.file_id, a.point, a.px AS apx, b.px AS bpx, abs(a.rel - b.rel) AS dist, row_number() OVER (PARTITION BY a.file_id, a.point, a.frame_idx ORDER BY abs(a.rel - b.rel), b.rel DESC) AS k
                  FROM a JOIN b USING (file_id, point)) WHERE k = 1 AND dist <= 1000) GROUP BY ALL""")]


def verify_rows(spark, d):
    from twinline.plans import align
    src, lang = fx.frames(spark, d), fx.lang_frames(spark, d)
    dur = fr.frame_counts(src).withColumn("dur", F.col("frame_count") * 40)
    even = series.even_points(dur, ["file_id"], "dur", DEFAULTS.piecewise.verify_points).withColumn("offset_ms", F.lit(1480.0))
    return align.verify_points(src, lang, even, DEFAULTS.piecewise)


@query("verify_points", fx.sql_with(["fx1", "fx2"], "SELECT file_id, point, mse FROM pt", VERIFY_ARGS))
def verify_points(spark, d):
    return verify_rows(spark, d).select("file_id", "point", "mse")


@query("global_verify", fx.sql_with(["fx1", "fx2"], """SELECT file_id, round_even(base, 6) AS baseline_mse, count(*) AS points, count(*) FILTER (mse < greatest(base * 3, 100)) AS valid_points,
  count(*) FILTER (mse < greatest(base * 3, 100)) / count(*)::DOUBLE >= 0.8 AS verified FROM (SELECT *, avg(mse) OVER (PARTITION BY file_id) AS base FROM pt) GROUP BY file_id, base""", VERIFY_ARGS))
def global_verify(spark, d):
    g = regions.global_check(verify_rows(spark, d), ["file_id"], DEFAULTS.piecewise)
    return g.withColumn("baseline_mse", F.bround("baseline_mse", 6))
