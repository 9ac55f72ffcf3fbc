"""Frame series: differences, scene cuts, fingerprints, segments, matched scores.

Frames are rows ``(file_id, frame_idx, ts_ms, px)``. Work is done on indexes and
times; pixels are joined last and only for the frames that are compared.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from twinline.functions import pixels
from twinline.operators import ordered
from twinline.params import FrameSettings
from twinline.session import settled, shared_folder, spread

FRAME_CHUNK = 4096
BUCKET_MS = 10_000


def interframe(frames: DataFrame) -> DataFrame:
    """Squared error of every frame and the next one, where the table holds it."""
    pairs = ordered.with_next(frames.withColumn("_i", F.col("frame_idx")), ["file_id"], "frame_idx", ["px", "_i"], FRAME_CHUNK)
    return (pairs.filter("next__i = frame_idx + 1").drop("_i", "next__i")
            .withColumn("sse", pixels.squared_error(F.col("px"), F.col("next_px")))
            .withColumn("mse", F.col("sse") / F.size("px")).drop("px", "next_px"))


def scene_cuts(diffs: DataFrame, settings: FrameSettings, keys: list[str] = ["file_id"], pos: str = "frame_idx") -> DataFrame:
    """Cuts: a large step, at least the minimum spacing after the last accepted cut."""
    steps = diffs.filter(F.col("mse") > settings.scene_cut_threshold).select(*keys, (F.col(pos) + 1).alias(pos))
    return ordered.pick_spaced(steps, keys, pos, settings.min_cut_spacing)


def with_margin(cuts: DataFrame, sizes: DataFrame, settings: FrameSettings, keys: list[str] = ["file_id"],
                pos: str = "frame_idx") -> DataFrame:
    """Cuts with half a signature on both sides; ``sizes`` has ``frame_count`` per key."""
    half = settings.cut_half_window
    return cuts.join(sizes, keys).filter((F.col(pos) >= half) & (F.col(pos) + half <= F.col("frame_count")))


def frame_counts(frames: DataFrame) -> DataFrame:
    return frames.groupBy("file_id").agg(F.count(F.lit(1)).alias("frame_count"))


def fingerprints(cuts: DataFrame, diffs: DataFrame, settings: FrameSettings, keys: list[str], cut: str, out: str) -> DataFrame:
    """Array of the frame differences around each cut; cuts without a full window drop out."""
    n = settings.cut_signature_length - 1
    spots = cuts.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) \
        .withColumn("frame_idx", F.col(cut) - settings.cut_half_window + F.col("_k"))
    hit = spots.join(diffs.select("file_id", "frame_idx", "sse", "mse"), ["file_id", "frame_idx"])
    items = F.sort_array(F.collect_list(F.struct("_k", "mse")))
    return (hit.groupBy(*keys, cut).agg(F.transform(items, lambda x: x["mse"]).alias(out))
            .filter(F.size(out) == n))


def matched_pixels(matches: DataFrame, src: DataFrame, lang: DataFrame) -> DataFrame:
    """Join pixels to rows ``(file_id, src_idx, lang_idx, ...)`` and add integer sums ``s``.

    The rows are small and may lie in one file; they are dealt out first, as pictures are compared where the rows are.
    """
    a = src.select("file_id", F.col("frame_idx").alias("src_idx"), F.col("px").alias("_a"))
    b = lang.select("file_id", F.col("frame_idx").alias("lang_idx"), F.col("px").alias("_b"))
    return (spread(matches, ["file_id", "src_idx"]).join(a, ["file_id", "src_idx"]).join(b, ["file_id", "lang_idx"])
            .withColumn("s", pixels.sums(F.col("_a"), F.col("_b"))).drop("_a", "_b"))


def cut_sequences(cut_pairs: DataFrame, src: DataFrame, lang: DataFrame, settings: FrameSettings,
                  keys: list[str]) -> DataFrame:
    """Mean similarity and mean squared error over the aligned frames around two cuts.

    An incomplete sequence has similarity 0 and no error value.
    """
    n = settings.cut_signature_length
    rows = (cut_pairs.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
            .withColumn("src_idx", F.col("src_cut") - settings.cut_half_window + F.col("_k"))
            .withColumn("lang_idx", F.col("lang_cut") - settings.cut_half_window + F.col("_k")))
    scored = matched_pixels(rows, src, lang)
    agg = scored.groupBy(*keys, "src_cut", "lang_cut").agg(
        F.count(F.lit(1)).alias("frames"), F.avg(pixels.ssim_of(F.col("s"))).alias("_ssim"),
        F.sum(pixels.squared_error_of(F.col("s"))).alias("sse"), F.sum("s.n").alias("_n"))
    full = F.col("frames") == n
    return (agg.withColumn("ssim", F.when(full, F.col("_ssim")).otherwise(0.0))
            .withColumn("mse", F.when(full, F.col("sse") / F.col("_n"))).drop("_ssim", "_n"))


def in_band(settings: FrameSettings) -> Column:
    """Similarity high enough, but not the near-identity of static or black frames."""
    return F.col("ssim").between(settings.ssim_threshold, settings.ssim_max_threshold)


def store_frames(frames: DataFrame, buckets: int | None = None) -> DataFrame:
    """Frames written once as a table bucketed and sorted by file and time bucket.

    Slices and windows of the stored table join small tables of wanted buckets to it: only
    those move, the frames are read where they lie. ``buckets`` should be the number of
    shuffle partitions of the jobs that read it (the default), or a multiple.
    """
    spark = frames.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"frames_{uuid.uuid4().hex}"
    placed = frames.withColumn("time_bucket", F.floor(F.col("ts_ms") / BUCKET_MS)).repartition(n, "file_id", "time_bucket")  # one file for each bucket
    (placed.write.format("parquet").bucketBy(n, "file_id", "time_bucket").sortBy("file_id", "time_bucket", "ts_ms")
     .option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name))
    return spark.table(name)


def _in_buckets(rows: DataFrame, ts: str = "ts_ms") -> DataFrame:
    """Rows with their time bucket, the stored one where there is one."""
    if "time_bucket" in rows.columns:
        return rows.withColumnRenamed("time_bucket", "_bucket")
    return rows.withColumn("_bucket", F.floor(F.col(ts) / BUCKET_MS))


def slice_segments(rows: DataFrame, segments: DataFrame, start: str, duration: str, ts: str = "ts_ms") -> DataFrame:
    """Rows of a series inside each segment ``[start, start + duration)`` of the same file.

    Segments are exploded into the time buckets they touch and joined on file
    and bucket, so no range join degenerates into a nested loop.
    """
    first = F.floor(F.col(start) / BUCKET_MS)
    last = F.floor((F.col(start) + F.col(duration)) / BUCKET_MS)
    touched = segments.withColumn("_bucket", F.explode(F.sequence(first, last)))
    return (_in_buckets(rows, ts).join(touched, ["file_id", "_bucket"])
            .filter((F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(start) + F.col(duration))).drop("_bucket"))


def in_windows(frames: DataFrame, segments: DataFrame, start: str, duration: str) -> DataFrame:
    """Frames of the time buckets that a segment of their file touches.

    The wanted buckets are a small table without pixels; all other frames go before
    any pixel is shuffled, and work that follows reads the written rest.
    """
    touched = F.explode(F.sequence(F.floor(F.col(start) / BUCKET_MS), F.floor((F.col(start) + F.col(duration)) / BUCKET_MS)))
    wanted = settled(segments.select("file_id", touched.alias("_bucket")).distinct())
    return settled(_in_buckets(frames).join(wanted, ["file_id", "_bucket"], "left_semi").drop("_bucket"))


def resample(rows: DataFrame, keys: list[str], ts_ms: Column, fps: float, payload: list[str], order: Column) -> DataFrame:
    """First sample of each cell of a regular grid."""
    cell = F.floor(ts_ms * F.lit(fps) / F.lit(1000.0))
    return (rows.groupBy(*keys, cell.alias("cell")).agg(F.min_by(F.struct(*payload), order).alias("_p"))
            .select(*keys, "cell", "_p.*"))


def segment_cuts(diffs: DataFrame, segments: DataFrame, start: str, duration: str, settings: FrameSettings) -> DataFrame:
    """Scene cuts found inside each segment, with margin, as file positions.

    ``diffs`` has one row per frame, with a null ``mse`` for the last one.
    """
    keys = ["file_id", "seg"]
    inside = slice_segments(diffs, segments.select(*keys, start, duration), start, duration)
    extent = inside.groupBy(*keys).agg(F.min("frame_idx").alias("_first"), F.max("frame_idx").alias("_last"),
                                       F.count(F.lit(1)).alias("frame_count"))
    local = (inside.join(extent, keys).filter(F.col("frame_idx") < F.col("_last"))
             .select(*keys, (F.col("frame_idx") - F.col("_first")).alias("pos"), "mse"))
    cuts = scene_cuts(local, settings, keys, "pos")
    ok = with_margin(cuts, extent.filter(F.col("frame_count") >= settings.cut_signature_length), settings, keys, "pos")
    return (ok.select(*keys, (F.col("pos") + F.col("_first")).alias("frame_idx"))
            .join(diffs.select("file_id", "frame_idx", "ts_ms"), ["file_id", "frame_idx"])
            .select(*keys, F.col("frame_idx").alias("cut"), "ts_ms"))


def cut_timeline(frames: DataFrame) -> DataFrame:
    """One row per frame with the step to the next frame (null on the last) and no pixels."""
    return frames.select("file_id", "frame_idx", "ts_ms").join(
        interframe(frames).select("file_id", "frame_idx", "sse", "mse"), ["file_id", "frame_idx"], "left")


def timed_matches(src: DataFrame, lang: DataFrame, segments: DataFrame, keys: list[str], tolerance_ms: float,
                  fps: float = 0.0) -> DataFrame:
    """Frames of a source and a language segment matched on time since segment start.

    ``segments``: keys (with file_id), src_start, lang_start, dur_ms. Returns
    keys, src_idx, src_ts, lang_idx for source frames with a match in
    tolerance, and null lang_idx for those without one. ``src_frames`` and
    ``lang_frames`` count the frames of either side in the segment, matched or not.
    """
    def side(frames, start, name):
        rows = slice_segments(frames.select("file_id", "frame_idx", "ts_ms"), segments.select(*keys, start, "dur_ms"), start, "dur_ms")
        if fps > 0:
            rows = resample(rows, keys, F.col("ts_ms"), fps, ["frame_idx", "ts_ms"], F.col("ts_ms"))
        w = W.partitionBy(*keys)  # a segment is bounded by its duration
        rel = F.bround((F.col("ts_ms") - F.min("ts_ms").over(w)) * 1000, 0).cast("long")
        return settled(rows.select(*keys, F.col("frame_idx").alias(f"{name}_idx"), F.col("ts_ms").alias(f"{name}_ts"),
                                   rel.alias("rel"), F.count(F.lit(1)).over(w).alias(f"{name}_frames")))
    a, b = side(src, "src_start", "src"), side(lang, "lang_start", "lang")
    near = ordered.nearest(a, b, keys, "rel", "rel", "later", 60_000_000)
    near = near.withColumn("near", F.when(F.abs(F.col("near") - F.col("rel")) <= tolerance_ms * 1000, F.col("near")))
    counts = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("lang_frames"))
    return settled(a.join(near, keys + ["rel"])
                   .join(b.select(*keys, F.col("rel").alias("near"), "lang_idx"), keys + ["near"], "left")
                   .join(counts, keys, "left").withColumn("lang_frames", F.coalesce("lang_frames", F.lit(0).cast("long")))
                   .drop("near"))


def scored_matches(matches: DataFrame, src: DataFrame, lang: DataFrame, keys: list[str]) -> DataFrame:
    """Similarity and error of matched frames; unmatched source frames keep null scores."""
    hit = matched_pixels(matches.filter("lang_idx is not null").select(*keys, "src_idx", "lang_idx"), src, lang)
    return matches.join(hit.select(*keys, "src_idx", pixels.ssim_of(F.col("s")).alias("ssim"), pixels.mse_of(F.col("s")).alias("mse")),
                        keys + ["src_idx"], "left")


def mean_similarity(segments: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """Mean similarity of the matched frames of each segment, 0 without any."""
    means = scored.groupBy(*keys).agg(F.avg("ssim").alias("_m"), F.count("ssim").alias("matched"),
                                      F.max("src_frames").alias("src_frames"), F.max("lang_frames").alias("lang_frames"))
    return (segments.join(means, keys, "left").withColumn("mean_ssim", F.coalesce("_m", F.lit(0.0)))
            .fillna(0, ["matched", "src_frames", "lang_frames"]).drop("_m"))
