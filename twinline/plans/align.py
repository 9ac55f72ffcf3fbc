"""Alignment jobs over all pairs at once: constant, speed-scaled and piecewise offsets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from twinline.functions import pixels
from twinline.operators import frames as fr
from twinline.operators import offsets, ordered, regions, series
from twinline.params import DEFAULTS, ConstantOffsetSettings, FrameSettings, PiecewiseSettings
from twinline.plans import jobs
from twinline.session import settled

US = 1000
NEAR_SPAN_US = 60_000_000


def verified_delays(src_cuts: DataFrame, lang_cuts: DataFrame, src: DataFrame, lang: DataFrame, src_time: DataFrame,
                    lang_time: DataFrame, settings: FrameSettings, need: int) -> DataFrame:
    """Delay (us) of every source cut whose nearest expected language cut looks the same.

    ``src_cuts``: file_id, seg, cut, ts_ms, expected_ms (where the cut should be
    on the language side, up to three frames) and frame_ms. Similarity of the frames around both cuts decides; where
    it verifies fewer than ``need`` cuts of a segment, the fingerprints of the
    frame steps do. The fallback is computed for those segments only.
    """
    keys = ["file_id", "seg"]
    a = src_cuts.withColumn("target_us", F.bround(F.col("expected_ms") * US, 0).cast("long"))
    b = lang_cuts.withColumn("lang_us", F.bround(F.col("ts_ms") * US, 0).cast("long"))
    near = ordered.nearest(a, b, keys, "target_us", "lang_us", "earlier", NEAR_SPAN_US)
    pairs = settled(a.join(near, keys + ["target_us"]).filter(F.abs(F.col("near") - F.col("target_us")) <= F.col("frame_ms") * (3 * US)).join(b.select(*keys, F.col("lang_us").alias("near"), F.col("cut").alias("lang_cut")), keys + ["near"])
                    .select(*keys, F.col("cut").alias("src_cut"), "lang_cut",
                            (F.col("near") - F.bround(F.col("ts_ms") * US, 0).cast("long")).alias("delay_us"), "ts_ms"))
    seq = fr.cut_sequences(pairs.select(*keys, "src_cut", "lang_cut"), src, lang, settings, keys).filter(fr.in_band(settings))
    good = settled(pairs.join(seq.select(*keys, "src_cut", "ssim"), keys + ["src_cut"]).select(
        *keys, "src_cut", "delay_us", "ts_ms", F.lit("ssim").alias("method"), F.col("ssim").alias("score")))
    enough = good.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= need).select(*keys)
    rest = pairs.join(enough, keys, "left_anti")
    fa = fr.fingerprints(rest.select(*keys, "src_cut"), src_time, settings, keys, "src_cut", "_a")
    fb = fr.fingerprints(rest.select(*keys, "lang_cut").distinct(), lang_time, settings, keys, "lang_cut", "_b")
    corr = (rest.join(fa, keys + ["src_cut"]).join(fb, keys + ["lang_cut"])
            .withColumn("score", pixels.correlation(F.col("_a"), F.col("_b"))).filter(F.col("score") >= settings.fingerprint_correlation)
            .select(*keys, "src_cut", "delay_us", "ts_ms", F.lit("corr").alias("method"), "score"))
    return good.join(enough, keys, "left_semi").unionByName(corr)


def _point_results(delays: DataFrame, corrected: Column, points: DataFrame) -> DataFrame:
    """Offset (upper median, rounded) and best score of every checkpoint; offset is null without a match."""
    keys = ["file_id", "seg"]
    d = delays.withColumn("_us", corrected)
    med = ordered.upper_median(ordered.histogram(d, keys, "_us"), keys, "_us", "_med", 1 << 20)
    best = series.checkpoint_scores(d, keys)
    return (points.join(med, keys, "left").join(best, keys, "left")
            .select(*[c for c in points.columns if c != "seg"], F.col("seg").alias("point"), F.bround(F.col("_med") / US, 0).cast("long").alias("offset"), "score", "method"))


def duration_gate(pairs: DataFrame, search: ConstantOffsetSettings = DEFAULTS.constant) -> DataFrame:
    """Pairs with the reason that keeps them from an offset search, empty for those that are long enough and have a rate."""
    reason = (F.when(F.col("duration_ms").isNull() | (F.col("duration_ms") < search.min_duration_ms), "too short")
              .when(F.col("fps").isNull() | (F.col("fps") <= 0), "no rate").otherwise(""))
    return pairs.withColumn("gate", reason)


def constant_offset(src: DataFrame, lang: DataFrame, pairs: DataFrame, settings: FrameSettings = DEFAULTS.frames,
                    search: ConstantOffsetSettings = DEFAULTS.constant, cluster_frames: int = 1) -> DataFrame:
    """Offset of every file pair from scene cuts, verified at checkpoints.

    ``pairs``: file_id, duration_ms, fps and inverse_ratio, each pair with its own rates.
    With an inverse ratio other than 1 the language side runs at another speed: the
    drift is taken out of every difference and checkpoints must also agree with the
    expected drift. Returns file_id, initial_delay_ms, offset_ms (mean of the largest
    agreeing group, null when too few agree), valid_points, summary.
    """
    need = settings.min_scene_cuts
    rates = ["frame_ms", "frame_us", "inverse_ratio"]
    usable = settled(duration_gate(pairs, search).filter("gate = ''").select(
        "file_id", "duration_ms", (1000.0 / F.col("fps")).alias("frame_ms"), F.bround(F.lit(1e6) / F.col("fps"), 0).cast("long").alias("frame_us"), "inverse_ratio"))
    rate = usable.select("file_id", *rates)
    drift = F.col("inverse_ratio") - 1.0

    def cuts(time, seg, side):
        return settled(fr.segment_cuts(time, seg, f"{side}_start", f"{side}_dur", settings))

    def windows(seg):
        """Pixels inside the windows of both sides, and the frame steps there."""
        near = [fr.in_windows(frames, seg, f"{side}_start", f"{side}_dur") for frames, side in ((src, "src"), (lang, "lang"))]
        return near, [settled(fr.cut_timeline(n)) for n in near]

    first = usable.select("file_id", F.lit(0).alias("seg"), F.lit(search.source_start_sec * 1000).alias("src_start"),
                          F.lit(search.source_duration_sec * 1000).alias("src_dur"), F.lit(0).alias("lang_start"),
                          F.lit(search.lang_duration_sec * 1000).alias("lang_dur"))
    near, times = windows(first)
    a, b = cuts(times[0], first, "src"), cuts(times[1], first, "lang")
    rich = [c.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= need).select("file_id") for c in (a, b)]
    a = a.join(rich[0], "file_id", "left_semi").join(rich[1], "file_id", "left_semi").join(rate, "file_id")
    us = F.bround(F.col("ts_ms") * US, 0).cast("long").alias("us")
    hist = offsets.candidates(a.select("file_id", us, "inverse_ratio"), b.select("file_id", us), "file_id", "us", F.col("inverse_ratio"))
    # the rates follow from the file, so they ride along as keys
    winner = offsets.densest_cluster(hist.join(rate, "file_id"), ["file_id", "frame_us"], F.col("frame_us") * cluster_frames)
    expected = a.join(winner.drop("frame_us"), "file_id").withColumn("expected_ms", F.col("ts_ms") * F.col("inverse_ratio") + F.col("offset") / US)
    delays = verified_delays(expected, b, *near, *times, settings, need).join(rate, "file_id") \
        .withColumn("delay_us", F.col("delay_us") - F.bround(F.col("ts_ms") * (drift * US), 0).cast("long"))
    initial = settled(offsets.consistency(delays, ["file_id", "frame_us"], "delay_us", F.col("frame_us"), need)
                      .select("file_id", F.bround(F.col("median") / US, 0).cast("long").alias("initial_delay_ms")))

    marks = settled(series.checkpoints(usable.join(initial, "file_id"), ["file_id", *rates, "initial_delay_ms"], "duration_ms", settings.num_check_points)
                    .withColumn("expected_offset", series.expected_offset(F.col("initial_delay_ms"), F.col("point_ms"), F.col("inverse_ratio")))
                    .withColumnRenamed("point", "seg"))

    def check(points: DataFrame, src_sec: int, lang_sec: int) -> DataFrame:
        seg = points.select("file_id", "seg", F.greatest(F.lit(0), F.col("point_ms") - src_sec * 500).alias("src_start"), F.lit(src_sec * 1000).alias("src_dur"),
                            F.greatest(F.lit(0), F.col("point_ms") + F.col("expected_offset") - lang_sec * 500).alias("lang_start"), F.lit(lang_sec * 1000).alias("lang_dur"))
        near, times = windows(seg)
        sc, lc = cuts(times[0], seg, "src"), cuts(times[1], seg, "lang")
        want = sc.join(points, ["file_id", "seg"]).withColumn("expected_ms", F.col("ts_ms") + F.col("expected_offset"))
        found = verified_delays(want.select(*sc.columns, "frame_ms", "expected_ms"), lc, *near, *times, settings, 1) \
            .join(points.select("file_id", "seg", "point_ms", "inverse_ratio"), ["file_id", "seg"])
        corrected = F.col("delay_us") - F.bround((F.col("ts_ms") - F.col("point_ms")) * (drift * US), 0).cast("long")
        r = _point_results(found, corrected, points.select("file_id", "seg", "expected_offset", "frame_ms", "inverse_ratio"))
        agrees = (F.col("inverse_ratio") == 1.0) | (F.abs(F.col("offset") - F.col("expected_offset")) <= F.col("frame_ms"))
        return r.withColumn("valid", F.coalesce(F.col("offset").isNotNull() & agrees, F.lit(False))).select("file_id", "point", "offset", "score", "method", "valid")

    one = settled(check(marks, settings.verify_source_sec, settings.verify_lang_sec))
    failed = settled(marks.join(one.filter("not valid").select("file_id", F.col("point").alias("seg")), ["file_id", "seg"], "left_semi"))
    # without a failed point the second check has no rows; its jobs are not started then
    two = one.filter("false") if failed.isEmpty() else check(failed, settings.retry_source_sec, settings.retry_lang_sec)
    points = settled(series.with_retry(one, two, ["file_id"]))
    tolerance = F.greatest(F.lit(1), F.bround(F.col("frame_us") / US, 0).cast("long")) * search.grouping_tolerance_frames
    agreed = offsets.consensus(points.filter("valid").join(rate, "file_id"), ["file_id", "frame_us"], "offset", F.col("point"), tolerance, search.min_valid_points)
    return (initial.join(series.validity(points, ["file_id"], settings.min_valid_points), "file_id", "left")
            .join(agreed.select("file_id", F.col("offset").alias("offset_ms")), "file_id", "left")
            .join(series.detail_summary(points, ["file_id"]), "file_id", "left")
            .select("file_id", "initial_delay_ms", "offset_ms", "valid_points", "verified", "summary"))


def frame_sync_job(src: DataFrame, lang: DataFrame, pairs: DataFrame, settings: FrameSettings) -> DataFrame:
    """Constant offset of ``pairs(file_id, duration_ms, src_video_ns)``; the sign turns because a late language track must be moved earlier.

    Pairs without a frame duration have no rate to work with and no row.
    """
    rated = pairs.withColumn("fps", F.try_divide(F.lit(1e9), F.col("src_video_ns"))).withColumn("inverse_ratio", F.lit(1.0))
    r = constant_offset(src, lang, rated, settings)
    return r.select("file_id", (-F.col("offset_ms")).alias("sync_ms"), "initial_delay_ms", "valid_points", "summary")


def speed_job(src: DataFrame, lang: DataFrame, pairs: DataFrame, settings: FrameSettings) -> DataFrame:
    """Offset under a speed difference: stretch factor, delay on the stretched clock, verdict.

    ``pairs``: file_id, duration_ms and the frame and container durations of both sides
    (src_video_ns, lang_video_ns, src_container_ns, lang_container_ns), each pair with
    its own. Only pairs whose speeds differ, soft telecine aside, have a row.
    """
    s, l = F.col("src_video_ns"), F.col("lang_video_ns")
    odd = settled(jobs.with_speed_mismatch(pairs).filter("mismatch").select(
        "file_id", "duration_ms", F.col("src_fps").alias("fps"), (l / s).alias("inverse_ratio"), (s / l).alias("ratio"),
        F.concat_ws("/", s.cast("string"), l.cast("string")).alias("stretch")))
    r = constant_offset(src, lang, odd, settings, cluster_frames=3).join(odd.select("file_id", "ratio", "stretch"), "file_id")
    return r.select("file_id", "stretch", "initial_delay_ms", F.bround(-F.col("initial_delay_ms") * F.col("ratio"), 0).cast("long").alias("sync_ms"),
                    "valid_points", "verified", "summary")


def offset_regions(src: DataFrame, lang: DataFrame, settings: PiecewiseSettings = DEFAULTS.piecewise, inverse: float = 1.0,
                   min_cuts: int = DEFAULTS.frames.min_scene_cuts, drift_compensated: bool = False, span: int = regions.CHUNK_MS) -> DataFrame:
    """Regions of constant offset of every pair with enough cuts and a clear initial vote."""
    def rich(c):
        return c.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_cuts).select("pair_id")
    rich_pairs = settled(rich(src).join(rich(lang), "pair_id", "left_semi"))
    src = settled(src.select("pair_id", "t_ms").join(rich_pairs, "pair_id", "left_semi"))
    lang = settled(lang.select("pair_id", "t_ms").join(rich_pairs, "pair_id", "left_semi"))
    initial = settled(offsets.initial_offset(offsets.grid_votes(src, lang, settings, inverse)))
    points = regions.change_points(src, lang, initial, settings, inverse, drift_compensated, span)
    return regions.assemble(points, src.join(initial.select("pair_id"), "pair_id", "left_semi"), initial)


def score_probes(src: DataFrame, lang: DataFrame, probes: DataFrame, keys: list[str]) -> DataFrame:
    seg = probes.select(*keys, "delta_ms", "src_start", "lang_start", "dur_ms")
    scored = fr.scored_matches(fr.timed_matches(src, lang, seg, keys, 500.0), src, lang, keys)
    return fr.mean_similarity(seg, scored, keys)


def verify_points(src: DataFrame, lang: DataFrame, points: DataFrame, settings: PiecewiseSettings, inverse: float = 1.0) -> DataFrame:
    """Smallest matched error around every verify point (file_id, point, point_ms, offset_ms)."""
    lang_ms = (F.col("point_ms") - F.col("offset_ms")) * inverse
    seg = points.withColumn("_lang", lang_ms).filter("_lang >= 0").select(
        "file_id", "point", F.floor("point_ms").alias("src_start"), F.floor("_lang").alias("lang_start"), F.lit(2000).alias("dur_ms"))
    keys = ["file_id", "point"]
    m = fr.timed_matches(src, lang, seg, keys, 2000.0 / settings.coarse_fps, settings.coarse_fps)
    return fr.scored_matches(m, src, lang, keys).groupBy(*keys).agg(F.min("mse").alias("mse")).filter("mse is not null")


def edit_map(rg: DataFrame, ops: DataFrame, cuts: DataFrame, baseline: DataFrame) -> DataFrame:
    """One summary row per pair."""
    r = rg.groupBy("pair_id").agg(F.sum("match_count").alias("matched_cuts"), F.min_by("offset_ms", "start_ms").alias("_first"))
    n = ops.groupBy("pair_id").agg(F.count(F.lit(1)).alias("op_count"))
    c = cuts.groupBy("pair_id").agg(F.count_if(F.col("side") == "src").alias("source_cuts"), F.count_if(F.col("side") == "lang").alias("lang_cuts"))
    return (r.join(n, "pair_id", "left").join(c, "pair_id").join(baseline, "pair_id").select(
        "pair_id", F.coalesce("op_count", F.lit(0)).alias("op_count"), "source_cuts", "lang_cuts", "matched_cuts",
        F.bround("_first", 0).cast("long").alias("initial_delay_ms"), "baseline_mse"))


def _segment_scores(src: DataFrame, lang: DataFrame, seg: DataFrame, keys: list[str], tolerance: float, fps: float) -> DataFrame:
    return settled(fr.scored_matches(fr.timed_matches(src, lang, seg, keys, tolerance, fps), src, lang, keys))


def confirm_dips(src: DataFrame, lang: DataFrame, rg: DataFrame, settings: PiecewiseSettings, inverse: float = 1.0) -> DataFrame:
    """Hidden offset changes inside regions: dips of a dense scan, confirmed by probing.

    A dip is probed from the offset the dips before it left. All open dips of a
    region are probed at once as if none of them changed it; results count up to
    the first that does, the dips after that are probed again. So there are as
    many rounds as changes in a region, not as dips.
    """
    keys = ["file_id", "region_start"]
    seg = rg.filter(F.col("end_ms") - F.col("start_ms") >= settings.min_region_sec * 1000).select(
        F.col("pair_id").alias("file_id"), F.col("start_ms").alias("region_start"), F.floor("start_ms").alias("src_start"),
        F.greatest(F.floor((F.col("start_ms") - F.col("offset_ms")) * inverse), F.lit(0)).alias("lang_start"),
        F.ceil(F.col("end_ms") - F.col("start_ms")).alias("dur_ms"), "offset_ms")
    scored = _segment_scores(src, lang, seg.drop("offset_ms"), keys, 2000.0 / settings.dense_scan_fps, settings.dense_scan_fps)
    s = scored.filter((F.col("src_frames") >= 4) & (F.col("lang_frames") >= 4)).select(
        *keys, F.bround("src_ts", 0).cast("long").alias("pos"), F.coalesce("ssim", F.lit(0.0)).alias("ssim"))
    runs = series.low_runs(s.withColumn("tie", F.lit(0)), keys, "pos", "tie", "ssim", settings.dip_ssim, 3_600_000, 1000)
    dips = series.dip_runs(runs, settings.dense_scan_min_dip).select(*keys, F.col("run_start").alias("dip_ms"))
    pending = settled(dips.join(seg.select(*keys, "offset_ms"), keys))
    cols = keys + ["dip_ms", "margin_no", "delta_no"]
    parts = []
    while not pending.isEmpty():
        grid = regions.probe_grid(pending, settings, inverse)
        here = grid.filter("margin_no = 0 and delta_no = 0").withColumn("lang_start", (F.col("src_start") - F.col("offset_ms")) * inverse) \
            .withColumn("delta_ms", F.lit(0)).filter("lang_start >= 0")
        still = score_probes(src, lang, here, cols).filter((F.col("src_frames") >= 2) & (F.col("lang_frames") >= 2)
                                                           & (F.col("mean_ssim") >= settings.probe_min_ssim)).select(*keys, "dip_ms")
        open_grid = settled(grid.join(still, keys + ["dip_ms"], "left_anti"))
        verdict = regions.probe_consensus(score_probes(src, lang, open_grid, cols), keys + ["dip_ms"], settings)
        probed = settled(pending.join(verdict.select(*keys, "dip_ms", "delta_ms"), keys + ["dip_ms"], "left")
                         .withColumn("delta_ms", F.coalesce("delta_ms", F.lit(0).cast("long"))))
        change = probed.filter("delta_ms <> 0").groupBy(*keys).agg(F.min("dip_ms").alias("_at"), F.min_by("delta_ms", "dip_ms").alias("_by"))
        judged = probed.join(change, keys, "left")
        parts.append(judged.filter("_at is null or dip_ms <= _at").select(F.col("file_id").alias("pair_id"), "region_start", "dip_ms", "delta_ms"))
        pending = settled(judged.filter("dip_ms > _at").select(*keys, "dip_ms", (F.col("offset_ms") + F.col("_by")).alias("offset_ms")))
    empty = pending.select(F.col("file_id").alias("pair_id"), "region_start", "dip_ms", F.lit(0).cast("long").alias("delta_ms"))
    return reduce(DataFrame.unionByName, parts, empty)


def refine_crossovers(src: DataFrame, lang: DataFrame, trans: DataFrame, settings: PiecewiseSettings, inverse: float = 1.0) -> DataFrame:
    """Exact position of each transition: dense scan for the first dip, then a frame-by-frame confirmation."""
    keys = ["file_id", "region_start"]
    t = trans.withColumnRenamed("pair_id", "file_id").withColumn("region_start", F.col("start_ms"))
    def segment(start, dur):
        return t2.select(*keys, F.floor(start).alias("src_start"),
                         F.greatest(F.floor((start - F.col("offset_ms")) * inverse), F.lit(0)).alias("lang_start"), dur.alias("dur_ms"))
    t2 = t
    dense = _segment_scores(src, lang, segment(F.col("search_start"), F.ceil(F.col("search_end") - F.col("search_start"))), keys,
                            2000.0 / settings.dense_scan_fps, settings.dense_scan_fps)
    s = dense.filter((F.col("src_frames") >= 4) & (F.col("lang_frames") >= 4)).select(
        *keys, F.bround("src_ts", 0).cast("long").alias("pos"), F.coalesce("ssim", F.lit(0.0)).alias("ssim"), F.lit(0).alias("tie"))
    runs = series.low_runs(s, keys, "pos", "tie", "ssim", settings.dense_scan_ssim, 3_600_000, 1000)
    dip = series.first_dip(s, runs, keys, "pos", "tie", "ssim", settings.dense_scan_min_dip)
    t2 = settled(t.join(dip.select(*keys, "position"), keys, "left").withColumn("crossover_ms", F.coalesce(F.col("position").cast("double"), "crossover_ms")).drop("position"))
    half = settings.linear_scan_window_sec * 1000
    fine = _segment_scores(src, lang, segment(F.greatest(F.col("crossover_ms") - half, F.lit(0.0)), F.lit(int(2 * half))), keys, 100.0, 0.0)
    f = fine.filter((F.col("src_frames") >= 4) & (F.col("lang_frames") >= 4) & F.col("ssim").isNotNull()).select(
        *keys, F.bround("src_ts", 0).cast("long").alias("pos"), "ssim", F.lit(0).alias("tie"))
    bad = series.low_runs(f, keys, "pos", "tie", "ssim", 0.5, 3_600_000, 1000)
    sure = series.confirmed_run(t2.select(*keys, F.col("crossover_ms").alias("est")), bad, keys, "est", settings.linear_scan_confirm)
    return t2.join(sure.select(*keys, F.col("position").cast("double").alias("_x")), keys).withColumn("crossover_ms", F.col("_x")) \
        .drop("_x", "region_start").withColumnRenamed("file_id", "pair_id")


def piecewise_job(src_cuts: DataFrame, lang_cuts: DataFrame, settings: PiecewiseSettings = DEFAULTS.piecewise) -> DataFrame:
    """Regions and edit operations from cut timelines alone (no pictures to refine with)."""
    rg = settled(offset_regions(src_cuts, lang_cuts, settings))
    ops = regions.edit_operations(regions.search_range(regions.transitions(rg)), "crossover_ms")
    both = src_cuts.withColumn("side", F.lit("src")).unionByName(lang_cuts.withColumn("side", F.lit("lang")))
    base = rg.select("pair_id").distinct().withColumn("baseline_mse", F.lit(0.0))
    return edit_map(rg, ops, both, base)


def piecewise_frames_job(src: DataFrame, lang: DataFrame, durations: DataFrame, frame_settings: FrameSettings,
                         settings: PiecewiseSettings = DEFAULTS.piecewise) -> tuple[DataFrame, DataFrame]:
    """Whole piecewise analysis of frame tables: (edit map of verified pairs, their operations)."""
    def timeline(frames):
        cuts = fr.scene_cuts(settled(fr.interframe(frames)), frame_settings)
        return settled(cuts.join(frames.select("file_id", "frame_idx", "ts_ms"), ["file_id", "frame_idx"])
                       .select(F.col("file_id").cast("long").alias("pair_id"), F.col("ts_ms").cast("long").alias("t_ms")))
    a, b = timeline(src), timeline(lang)
    rg = settled(offset_regions(a, b, settings))
    dips = confirm_dips(src, lang, rg, settings)
    # neighbours are merged only for pairs in which a dip has split a region
    cut_pairs = dips.filter("delta_ms <> 0").select("pair_id").distinct()
    split = regions.split_at_dips(rg, dips)
    rg = settled(regions.merge_equal(split.join(cut_pairs, "pair_id", "left_semi")).unionByName(split.join(cut_pairs, "pair_id", "left_anti")))
    trans = regions.search_range(regions.transitions(rg))
    ops = settled(regions.edit_operations(refine_crossovers(src, lang, trans, settings), "crossover_ms"))
    points = series.even_points(durations, ["file_id"], "duration_ms", settings.verify_points).withColumn("us", F.floor(F.col("point_ms") * US))
    marks = rg.select(F.col("pair_id").alias("file_id"), F.floor(F.col("start_ms") * US).alias("start_us"), "offset_ms")
    at = ordered.last_at_or_before(points, marks, ["file_id"], "us", "start_us", ["offset_ms"], 1 << 32)
    placed = points.join(at, ["file_id", "us"]).withColumn("offset_ms", F.coalesce("offset_ms", F.lit(0.0)))
    verdict = settled(regions.global_check(verify_points(src, lang, placed, settings), ["file_id"], settings, frame_settings.mse_threshold))
    passed = verdict.filter("verified").select(F.col("file_id").cast("long").alias("pair_id"), "baseline_mse")
    both = a.withColumn("side", F.lit("src")).unionByName(b.withColumn("side", F.lit("lang")))
    return edit_map(rg, ops, both, passed), ops.join(passed.select("pair_id"), "pair_id", "left_semi")
