"""Frame series: alignment, differences, cuts, fingerprints, similarity."""

from pyspark.sql import functions as F

from twinline import fixtures as fx
from twinline.functions import pixels
from twinline.operators import frames as fr
from twinline.operators import ordered, series
from twinline.params import VECTOR_FRAMES as VF
from twinline.session import settled
from twinline.suite.registry import query

SHIFT_MS = -1480


def sse_sql(a, b):
    return f"CAST(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"


def dot_sql(a, b):
    return f"CAST(list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2])) AS BIGINT)"


SSIM_SQL = """((2 * (sa / 64.0::DOUBLE) * (sb / 64.0::DOUBLE) + 6.5025::DOUBLE) * (2 * ((64 * sab - sa * sb) / 4096.0::DOUBLE) + 58.5225::DOUBLE)) /
  (((sa / 64.0::DOUBLE) * (sa / 64.0::DOUBLE) + (sb / 64.0::DOUBLE) * (sb / 64.0::DOUBLE) + 6.5025::DOUBLE) *
   ((64 * saa - sa * sa) / 4096.0::DOUBLE + (64 * sbb - sb * sb) / 4096.0::DOUBLE + 58.5225::DOUBLE))"""


def sums_sql(a, b):
    return f"""CAST(list_sum({a}) AS BIGINT) AS sa, CAST(list_sum({b}) AS BIGINT) AS sb, {dot_sql(a, a)} AS saa, {dot_sql(b, b)} AS sbb, {dot_sql(a, b)} AS sab"""


def diff_sql(view):
    return f"SELECT file_id, frame_idx, ts_ms, {sse_sql('px', 'nx')} AS sse FROM (SELECT *, lead(px) OVER (PARTITION BY file_id ORDER BY frame_idx) AS nx FROM {view}) WHERE nx IS NOT NULL"


def cut_sql(diffs):
    return f"""/*RECURSIVE*/SELECT file_id, min(frame_idx) + 1 AS cut FROM {diffs} WHERE sse / 64.0 > 600 GROUP BY file_id
  UNION ALL SELECT p.file_id, min(c.frame_idx) + 1 FROM {{me}} p JOIN {diffs} c ON c.file_id = p.file_id AND c.frame_idx + 1 >= p.cut + 6 AND c.sse / 64.0 > 600 GROUP BY p.file_id, p.cut"""


FRAME_ARGS = [("d1", diff_sql("fx1")), ("d2", diff_sql("fx2")),
              ("c1", cut_sql("d1").format(me="c1")), ("c2", cut_sql("d2").format(me="c2")),
              ("n1", "SELECT file_id, count(*) AS frame_count FROM fx1 GROUP BY file_id"),
              ("n2", "SELECT file_id, count(*) AS frame_count FROM fx2 GROUP BY file_id"),
              ("v1", "SELECT c1.file_id, cut FROM c1 JOIN n1 USING (file_id) WHERE cut >= 5 AND cut + 5 <= frame_count"),
              ("v2", "SELECT c2.file_id, cut FROM c2 JOIN n2 USING (file_id) WHERE cut >= 5 AND cut + 5 <= frame_count"),
              ("cp", """SELECT file_id, src_cut, lang_cut FROM (SELECT v1.file_id, v1.cut AS src_cut, v2.cut AS lang_cut, abs(v2.cut * 40 - (v1.cut * 40 - 1480)) AS dist,
                 row_number() OVER (PARTITION BY v1.file_id, v1.cut ORDER BY abs(v2.cut * 40 - (v1.cut * 40 - 1480)), v2.cut) AS k
                 FROM v1 JOIN v2 USING (file_id)) WHERE k = 1 AND dist <= 120""")]


def upto(name):
    names = [n for n, _ in FRAME_ARGS]
    return FRAME_ARGS[:names.index(name) + 1]


def valid_cuts(frames):
    return fr.with_margin(fr.scene_cuts(fr.interframe(frames), VF), fr.frame_counts(frames), VF)


def cut_pairs(spark, d, src, lang):
    a = settled(valid_cuts(src)).select("file_id", F.col("frame_idx").alias("src_cut"), (F.col("frame_idx") * 40 + SHIFT_MS).alias("target_ms"))
    b = settled(valid_cuts(lang)).select("file_id", F.col("frame_idx").alias("lang_cut"), (F.col("frame_idx") * 40).alias("ts_ms"))
    near = ordered.nearest(a, b, ["file_id"], "target_ms", "ts_ms", "earlier", 1 << 20)
    near = near.filter(F.abs(F.col("near") - F.col("target_ms")) <= 120)
    return settled(a.join(near, ["file_id", "target_ms"]).join(b.withColumnRenamed("ts_ms", "near"), ["file_id", "near"]).select("file_id", "src_cut", "lang_cut"))


@query("frame_align", fx.sql_with(["fx1", "fx2"], "SELECT a.file_id, a.frame_idx, a.ts_ms, CAST(list_sum(b.px) AS BIGINT) AS px_sum FROM fx1 a JOIN fx2 b USING (file_id, frame_idx)"))
def frame_align(spark, d):
    stamps = fx.frames(spark, d).select("file_id", "frame_idx", "ts_ms")
    pictures = fx.lang_frames(spark, d).select("file_id", "frame_idx", "px")
    return stamps.join(pictures, ["file_id", "frame_idx"]).select(
        "file_id", "frame_idx", "ts_ms", F.aggregate("px", F.lit(0).cast("long"), lambda a, x: a + x).alias("px_sum"))


@query("segment_slice", fx.sql_with(["fx1"], "SELECT file_id, frame_idx, ts_ms FROM fx1 WHERE ts_ms >= 4000 AND ts_ms < 16000"))
def segment_slice(spark, d):
    f = fx.frames(spark, d).select("file_id", "frame_idx", "ts_ms")
    seg = f.select("file_id").distinct().select("file_id", F.lit(4000).alias("start"), F.lit(12000).alias("dur"))
    return fr.slice_segments(f, seg, "start", "dur").select("file_id", "frame_idx", "ts_ms")


@query("stored_slice", fx.sql_with(["fx1"], """SELECT file_id, w AS window_no, count(*) AS frames, CAST(sum(list_sum(px)) AS BIGINT) AS px_sum FROM fx1, range(3) r(w)
WHERE ts_ms >= w * 9000 + 500 AND ts_ms < w * 9000 + 500 + 4000 + w * 1000 GROUP BY ALL"""))
def stored_slice(spark, d):
    """Windows of frames that were written bucketed by file and time: their pixels don't move."""
    stored = fr.store_frames(fx.frames(spark, d))
    no = F.explode(F.sequence(F.lit(0), F.lit(2)))
    seg = stored.select("file_id").distinct().select("file_id", no.alias("window_no")).select(
        "file_id", F.col("window_no").cast("long").alias("window_no"), (F.col("window_no") * 9000 + 500).alias("start"), (F.col("window_no") * 1000 + 4000).alias("dur"))
    sliced = fr.slice_segments(stored, seg, "start", "dur")
    each = F.aggregate("px", F.lit(0).cast("long"), lambda a, x: a + x)
    return sliced.groupBy("file_id", "window_no").agg(F.count(F.lit(1)).alias("frames"), F.sum(each).alias("px_sum"))


@query("crop_43", fx.sql_with(["fx1"], """SELECT file_id, frame_idx, array_to_string(list_concat(list_concat(px[6:10], px[22:26]), list_concat(px[38:42], px[54:58])), ',') AS cropped FROM fx1"""))
def crop_43(spark, d):
    return fx.frames(spark, d).select("file_id", "frame_idx", F.array_join(pixels.crop_43(F.col("px"), 16, 4).cast("array<string>"), ",").alias("cropped"))


@query("interframe_mse", fx.sql_with(["fx1"], "SELECT file_id, frame_idx, sse, sse / 64.0::DOUBLE AS mse FROM d1", upto("d1")))
def interframe_mse(spark, d):
    return fr.interframe(fx.frames(spark, d)).select("file_id", "frame_idx", "sse", "mse")


@query("scene_cuts", fx.sql_with(["fx1"], "SELECT file_id, cut FROM c1", [FRAME_ARGS[0], FRAME_ARGS[2]]))
def scene_cuts(spark, d):
    return fr.scene_cuts(fr.interframe(fx.frames(spark, d)), VF).select("file_id", F.col("frame_idx").alias("cut"))


@query("cut_margin", fx.sql_with(["fx1"], "SELECT file_id, cut FROM v1", [FRAME_ARGS[0], FRAME_ARGS[2], FRAME_ARGS[4], FRAME_ARGS[6]]))
def cut_margin(spark, d):
    return valid_cuts(fx.frames(spark, d)).select("file_id", F.col("frame_idx").alias("cut"))


@query("fingerprint", fx.sql_with(["fx1"], """SELECT v1.file_id, cut, string_agg(sse, ',' ORDER BY frame_idx) AS steps FROM v1 JOIN d1 ON d1.file_id = v1.file_id AND frame_idx BETWEEN cut - 5 AND cut + 3
GROUP BY v1.file_id, cut HAVING count(*) = 9""", [FRAME_ARGS[0], FRAME_ARGS[2], FRAME_ARGS[4], FRAME_ARGS[6]]))
def fingerprint(spark, d):
    f = fx.frames(spark, d)
    fp = fr.fingerprints(valid_cuts(f).withColumnRenamed("frame_idx", "cut"), fr.interframe(f), VF, ["file_id"], "cut", "fp")
    return fp.select("file_id", "cut", F.array_join(F.transform("fp", lambda x: (x * 64).cast("long").cast("string")), ",").alias("steps"))


FP_SQL = """SELECT {v}.file_id, cut, frame_idx - cut AS k, sse / 64.0::DOUBLE AS mse FROM {v} JOIN {d} ON {d}.file_id = {v}.file_id AND frame_idx BETWEEN cut - 5 AND cut + 3"""


@query("fingerprint_corr", fx.sql_with(["fx1", "fx2"], """SELECT cp.file_id, src_cut, lang_cut, round_even(coalesce(corr(a.mse, b.mse), 0.0), 6) AS correlation FROM cp
JOIN f1 a ON a.file_id = cp.file_id AND a.cut = src_cut JOIN f2 b ON b.file_id = cp.file_id AND b.cut = lang_cut AND a.k = b.k GROUP BY ALL HAVING count(*) = 9""",
                                   FRAME_ARGS + [("f1", FP_SQL.format(v="v1", d="d1")), ("f2", FP_SQL.format(v="v2", d="d2"))]))
def fingerprint_corr(spark, d):
    src, lang = fx.frames(spark, d), fx.lang_frames(spark, d)
    p = cut_pairs(spark, d, src, lang)
    a = fr.fingerprints(p.select("file_id", "src_cut").distinct(), fr.interframe(src), VF, ["file_id"], "src_cut", "fp_a")
    b = fr.fingerprints(p.select("file_id", "lang_cut").distinct(), fr.interframe(lang), VF, ["file_id"], "lang_cut", "fp_b")
    return p.join(a, ["file_id", "src_cut"]).join(b, ["file_id", "lang_cut"]).select(
        "file_id", "src_cut", "lang_cut", F.bround(pixels.correlation(F.col("fp_a"), F.col("fp_b")), 6).alias("correlation"))


PAIRED_SQL = f"SELECT a.file_id, a.frame_idx AS src_idx, b.frame_idx AS lang_idx, {sums_sql('a.px', 'b.px')} FROM fx1 a JOIN fx2 b ON a.file_id = b.file_id AND b.frame_idx = a.frame_idx - 37"


def aligned(spark, d):
    src, lang = fx.frames(spark, d), fx.lang_frames(spark, d)
    m = src.filter("frame_idx >= 37").select("file_id", F.col("frame_idx").alias("src_idx"), (F.col("frame_idx") - 37).alias("lang_idx"))
    return fr.matched_pixels(m, src, lang)


@query("frame_mse", fx.sql_with(["fx1", "fx2"], "SELECT file_id, src_idx, saa + sbb - 2 * sab AS sse, (saa + sbb - 2 * sab) / 64.0::DOUBLE AS mse FROM p", [("p", PAIRED_SQL)]))
def frame_mse(spark, d):
    return aligned(spark, d).select("file_id", "src_idx", pixels.squared_error_of(F.col("s")).alias("sse"), pixels.mse_of(F.col("s")).alias("mse"))


@query("frame_ssim", fx.sql_with(["fx1", "fx2"], f"SELECT file_id, src_idx, round_even({SSIM_SQL}, 6) AS ssim FROM p", [("p", PAIRED_SQL)]))
def frame_ssim(spark, d):
    return aligned(spark, d).select("file_id", "src_idx", F.bround(pixels.ssim_of(F.col("s")), 6).alias("ssim"))


@query("frame_ssim_binary", fx.sql_with(["fx1", "fx2"], f"SELECT file_id, src_idx, round_even({SSIM_SQL}, 6) AS ssim FROM p", [("p", PAIRED_SQL)]))
def frame_ssim_binary(spark, d):
    pack = lambda f, n: f.select("file_id", F.col("frame_idx").alias(n), pixels.to_binary(F.col("px")).alias(f"_{n}"))
    a = pack(fx.frames(spark, d), "src_idx")
    b = pack(fx.lang_frames(spark, d), "lang_idx").withColumn("src_idx", F.col("lang_idx") + 37)
    s = a.join(b, ["file_id", "src_idx"]).withColumn("s", pixels.binary_sums("_src_idx", "_lang_idx"))
    return s.select("file_id", "src_idx", F.bround(pixels.ssim_of(F.col("s")), 6).alias("ssim"))


SEQ_SQL = f"""SELECT file_id, src_cut, lang_cut, count(*) AS frames, avg({SSIM_SQL}) AS ssim, CAST(sum(saa + sbb - 2 * sab) AS BIGINT) AS sse FROM (
  SELECT cp.file_id, src_cut, lang_cut, {sums_sql('a.px', 'b.px')} FROM cp JOIN range(10) k(k) ON true
  JOIN fx1 a ON a.file_id = cp.file_id AND a.frame_idx = src_cut - 5 + k.k JOIN fx2 b ON b.file_id = cp.file_id AND b.frame_idx = lang_cut - 5 + k.k) GROUP BY ALL"""


@query("cut_verify", fx.sql_with(["fx1", "fx2"], f"SELECT file_id, src_cut, lang_cut, frames, round_even(ssim, 6) AS ssim FROM ({SEQ_SQL}) WHERE frames = 10 AND ssim BETWEEN 0.55 AND 0.999", FRAME_ARGS))
def cut_verify(spark, d):
    src, lang = fx.frames(spark, d), fx.lang_frames(spark, d)
    seq = fr.cut_sequences(cut_pairs(spark, d, src, lang), src, lang, VF, ["file_id"])
    return seq.filter(fr.in_band(VF)).select("file_id", "src_cut", "lang_cut", "frames", F.bround("ssim", 6).alias("ssim"))


@query("sequence_mse", fx.sql_with(["fx1", "fx2"], f"SELECT file_id, src_cut, lang_cut, sse, CASE WHEN frames = 10 THEN round_even(sse / 640.0::DOUBLE, 7) END AS mse FROM ({SEQ_SQL})", FRAME_ARGS))
def sequence_mse(spark, d):
    src, lang = fx.frames(spark, d), fx.lang_frames(spark, d)
    seq = fr.cut_sequences(cut_pairs(spark, d, src, lang), src, lang, VF, ["file_id"])
    return seq.select("file_id", "src_cut", "lang_cut", "sse", F.bround("mse", 7).alias("mse"))


SEG_SQL = """SELECT file_id, CAST(p AS INTEGER) AS point, {src} AS src_start, {lang} AS lang_start FROM
 (SELECT file_id, count(*) * 40 AS dur FROM fx1 GROUP BY file_id), range(9) r(p)"""
POINT_SQL = "dur * (p + 1) * 10 // 100"


def windows(spark, d, src_len, lang_len):
    dur = fr.frame_counts(fx.frames(spark, d)).withColumn("dur", F.col("frame_count") * 40)
    p = series.checkpoints(dur, ["file_id"], "dur")
    return p.select("file_id", "point", F.greatest(F.lit(0), F.col("point_ms") - src_len // 2).alias("src_start"), F.lit(src_len).alias("src_dur"),
                    F.greatest(F.lit(0), F.col("point_ms") + SHIFT_MS - lang_len // 2).alias("lang_start"), F.lit(lang_len).alias("lang_dur"))


WIN_SQL = """SELECT w.file_id, point, '{n}' AS side, {len} AS width, min(f.frame_idx) AS first_frame, count(*) AS frames FROM w{k} w JOIN {v} f ON f.file_id = w.file_id
  AND f.ts_ms >= w.{n}_start AND f.ts_ms < w.{n}_start + {len} GROUP BY ALL"""
W1 = SEG_SQL.format(src=f"greatest(0, {POINT_SQL} - 5000)", lang=f"greatest(0, {POINT_SQL} - 1480 - 7500)")
W2 = SEG_SQL.format(src=f"greatest(0, {POINT_SQL} - 10000)", lang=f"greatest(0, {POINT_SQL} - 1480 - 15000)")


@query("checkpoint_windows", fx.sql_with(["fx1", "fx2"], " UNION ALL ".join(
    WIN_SQL.format(n=n, len=length, k=k, v=v) for k, n, length, v in [(1, "src", 10000, "fx1"), (1, "lang", 15000, "fx2"), (2, "src", 20000, "fx1"), (2, "lang", 30000, "fx2")]),
    [("w1", W1), ("w2", W2)]))
def checkpoint_windows(spark, d):
    src, lang = (f(spark, d).select("file_id", "frame_idx", "ts_ms") for f in (fx.frames, fx.lang_frames))
    def count(w, rows, n):
        hit = fr.slice_segments(rows, w.select("file_id", "point", f"{n}_start", f"{n}_dur"), f"{n}_start", f"{n}_dur")
        return hit.groupBy("file_id", "point", F.lit(n).alias("side"), F.col(f"{n}_dur").alias("width")).agg(
            F.min("frame_idx").alias("first_frame"), F.count(F.lit(1)).alias("frames"))
    first, again = windows(spark, d, VF.verify_source_sec * 1000, VF.verify_lang_sec * 1000), windows(spark, d, VF.retry_source_sec * 1000, VF.retry_lang_sec * 1000)
    return count(first, src, "src").unionByName(count(first, lang, "lang")).unionByName(count(again, src, "src")).unionByName(count(again, lang, "lang"))


PROBE_SQL = SEG_SQL.format(src=POINT_SQL, lang=f"{POINT_SQL} - 1500")
TSM_ARGS = [("w", f"SELECT * FROM ({PROBE_SQL}) WHERE lang_start >= 0"),
            ("a", "SELECT w.file_id, point, f.frame_idx, f.ts_ms - min(f.ts_ms) OVER (PARTITION BY w.file_id, point) AS rel, px FROM w JOIN fx1 f ON f.file_id = w.file_id AND ts_ms >= src_start AND ts_ms < src_start + 3000"),
            ("b", "SELECT w.file_id, point, f.frame_idx, f.ts_ms - min(f.ts_ms) OVER (PARTITION BY w.file_id, point) AS rel, px FROM w JOIN fx2 f ON f.file_id = w.file_id AND ts_ms >= lang_start AND ts_ms < lang_start + 3000"),
            ("m", f"""SELECT file_id, point, {sums_sql('apx', 'bpx')} FROM (SELECT a.file_id, a.point, a.px AS apx, b.px AS bpx, row_number() OVER (PARTITION BY a.file_id, a.point, a.frame_idx ORDER BY abs(a.rel - b.rel), b.rel DESC) AS k, abs(a.rel - b.rel) AS dist
               FROM a JOIN b ON a.file_id = b.file_id AND a.point = b.point) WHERE k = 1 AND dist <= 500""")]


@query("ts_matched_ssim", fx.sql_with(["fx1", "fx2"], f"""SELECT w.file_id, w.point, count(m.sa) AS matched, round_even(coalesce(avg({SSIM_SQL}), 0.0), 6) AS mean_ssim
FROM w LEFT JOIN m ON m.file_id = w.file_id AND m.point = w.point GROUP BY ALL""", TSM_ARGS))
def ts_matched_ssim(spark, d):
    src, lang = fx.frames(spark, d), fx.lang_frames(spark, d)
    dur = fr.frame_counts(src).withColumn("dur", F.col("frame_count") * 40)
    seg = series.checkpoints(dur, ["file_id"], "dur").select(
        "file_id", "point", F.col("point_ms").alias("src_start"), (F.col("point_ms") - 1500).alias("lang_start"), F.lit(3000).alias("dur_ms")).filter("lang_start >= 0")
    keys = ["file_id", "point"]
    scored = fr.scored_matches(fr.timed_matches(src, lang, seg, keys, 500.0), src, lang, keys)
    return fr.mean_similarity(seg, scored, keys).select("file_id", "point", "matched", F.bround("mean_ssim", 6).alias("mean_ssim"))
