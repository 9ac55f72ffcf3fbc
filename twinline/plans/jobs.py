"""Pair-level jobs: durations, plans, results and reports, over all pairs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from twinline.functions import codecs, text
from twinline.operators import report, tracks as tr
from twinline.params import DEFAULTS, SpeedSettings
from twinline.session import settled


def pair_durations(pairs: DataFrame, durations: DataFrame) -> DataFrame:
    """Frame and container durations of both files of every pair."""
    def side(name, key):
        return durations.select(F.col("file_id").alias(key), F.col("video_duration_ns").alias(f"{name}_video_ns"),
                                F.col("container_duration_ns").alias(f"{name}_container_ns"))
    return pairs.join(side("src", "src_file"), "src_file").join(side("lang", "lang_file"), "lang_file")


def with_speed_mismatch(p: DataFrame, settings: SpeedSettings = DEFAULTS.speed) -> DataFrame:
    """Speed mismatch, unless equal container durations point to soft telecine.

    Frame rates are filled whenever the frame durations differ, even when the pair is rejected.
    """
    s, l = F.col("src_video_ns"), F.col("lang_video_ns")
    differs = F.coalesce((s > 0) & (l > 0) & (F.abs(F.try_divide(s, l) - 1) >= settings.min_ratio_diff), F.lit(False))
    sc, lc = F.col("src_container_ns"), F.col("lang_container_ns")
    telecine = F.coalesce((sc > 0) & (lc > 0)
                          & (F.abs(F.try_divide(sc, lc) - 1) < settings.max_duration_diff_telecine), F.lit(False))
    return (p.withColumn("mismatch", differs & ~telecine).withColumn("soft_telecine", differs & telecine)
            .withColumn("src_fps", F.when(differs, F.lit(1e9) / s).otherwise(0.0))
            .withColumn("lang_fps", F.when(differs, F.lit(1e9) / l).otherwise(0.0)))


def with_stretch(p: DataFrame, min_diff: float = 0.001) -> DataFrame:
    s, l = F.col("src_video_ns"), F.col("lang_video_ns")
    big = F.coalesce((s > 0) & (l > 0) & (F.abs(F.try_divide(s, l) - 1) >= min_diff), F.lit(False))
    return (p.withColumn("inverse_ratio", F.when(big, l / s).otherwise(1.0))
            .withColumn("stretch", F.when(big, F.concat_ws("/", s.cast("string"), l.cast("string"))).otherwise("")))


def _imports_of(pairs: DataFrame, imports: DataFrame) -> DataFrame:
    return pairs.select("src_file", F.col("lang_file").alias("file_id")).join(imports, "file_id")


def _kept_of(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    return pairs.select("src_file", F.col("src_file").alias("file_id")).join(kept, "file_id")


def result_languages(pairs: DataFrame, tracks: DataFrame, kept_audio: DataFrame, keep_sub_langs: list[str],
                     imports: DataFrame) -> DataFrame:
    """Languages of the result: kept first, then imported in target order, each once.

    Subtitles are kept by language name, not by track.
    """
    lang = F.when(F.col("language") == "", "und").otherwise(F.col("language"))
    subs = tr.of_type(tracks, "subtitles").filter(F.lower(lang).isin([w.lower() for w in keep_sub_langs]))
    kept = _kept_of(pairs, kept_audio.unionByName(subs)).select(
        "src_file", "type", lang.alias("lang"), F.struct(F.lit(-1).alias("p"), "track_id").alias("o"))
    imp = _imports_of(pairs, imports).select(
        "src_file", "type", lang.alias("lang"), F.struct(F.col("target_pos").alias("p"), "track_id").alias("o"))
    lists = tr.distinct_in_order(kept.unionByName(imp), ["src_file", "type"], "lang", F.col("o"), "langs")
    def of(kind):
        return F.coalesce(F.any_value(F.when(F.col("type") == kind, F.col("langs")), True), F.array().cast("array<string>"))
    return lists.groupBy("src_file").agg(of("audio").alias("result_audio_langs"), of("subtitles").alias("result_sub_langs"))


def result_tracks(pairs: DataFrame, kept: DataFrame, imports: DataFrame, convert: str) -> DataFrame:
    rows = (_kept_of(pairs, kept).withColumn("side", F.lit(0)).withColumn("target_pos", F.lit(0))
            .unionByName(_imports_of(pairs, imports).withColumn("side", F.lit(1))))
    item = text.with_conversion(text.track_text(F.col("track_id"), F.col("language"), F.col("codec"), F.col("channels")),
                                F.col("codec"), F.col("name"), convert)
    return tr.text_lists(rows, ["src_file"], ["side", "target_pos", "track_id"], {"tracks": item})


def plan_job(pairs: DataFrame, tracks: DataFrame, kept_audio: DataFrame, kept_subs: DataFrame, imports: DataFrame,
             convert: str, audio_delay: Column, sub_delay: Column, has_edits: Column, rename_all: bool = True, whole: bool = False) -> DataFrame:
    """Selection, conversion and splicing of all pairs as one plan table; pairs with nothing to import have no plan.

    ``whole`` adds the tracks that are not selected: source video kept, all others dropped.
    """
    stretch = with_stretch(pair_durations(pairs.select("src_file", "lang_file"), tr.video_duration(tracks)))
    imp = _imports_of(pairs, imports).join(stretch.select("src_file", "stretch"), "src_file")
    working = with_imports(pairs, imports)
    rows = tr.plan(_kept_of(working, kept_audio), _kept_of(working, kept_subs), imp, convert, audio_delay, sub_delay,
                   F.col("stretch"), has_edits, rename_all)
    return tr.with_unselected(settled(rows), working.select("src_file", "lang_file"), tracks) if whole else rows


def with_imports(pairs: DataFrame, imports: DataFrame) -> DataFrame:
    """Pairs whose language file has a track to import."""
    return pairs.join(imports.select(F.col("file_id").alias("lang_file")), "lang_file", "left_semi")


def plan_skips(pairs: DataFrame, imports: DataFrame) -> DataFrame:
    """Pairs left out of the plan, with the reason."""
    rest = pairs.join(imports.select(F.col("file_id").alias("lang_file")), "lang_file", "left_anti")
    return rest.select("src_file", "lang_file", F.lit("No matching tracks").alias("skip_reason"))


def conversion_plan(pairs: DataFrame, source_audio: DataFrame, imported_audio: DataFrame, target: str) -> DataFrame:
    """Tracks to convert with target, layout and rate; a track chosen twice is converted once."""
    src = _kept_of(pairs, source_audio).withColumn("side", F.lit("source"))
    lang = _imports_of(pairs, imported_audio).withColumn("side", F.lit("language")).drop("target_pos").distinct()
    rows = src.unionByName(lang).filter(codecs.is_convertible(F.col("codec"), F.col("name"), target))
    kbps = codecs.rate_for(F.col("channels"), "libopus") if target == "opus" else F.lit(None).cast("int")
    layout = codecs.layout_standard(F.col("channels")) if target == "opus" else F.lit("")
    return rows.select("src_file", "side", "file_id", "track_id", F.lit(target).alias("target"), layout.alias("layout"),
                       kbps.alias("kbps"))


def record_frame(pairs: DataFrame, langs: DataFrame, results: DataFrame) -> DataFrame:
    src = langs.select(F.col("file_id").alias("src_file"), F.col("audio_langs").alias("src_audio_langs"), F.col("sub_langs").alias("src_sub_langs"))
    lng = langs.select(F.col("file_id").alias("lang_file"), F.col("audio_langs").alias("lang_audio_langs"), F.col("sub_langs").alias("lang_sub_langs"))
    return pairs.join(src, "src_file", "left").join(lng, "lang_file", "left").join(results, "src_file", "left")


def report_summary(record: DataFrame, runs: DataFrame, dry_run: bool = True) -> DataFrame:
    """Rows and text sizes of the three report tables from one scan of the records, and the counted runs."""
    listed = {"source": "src_audio_langs", "language": "lang_audio_langs", "result": "result_audio_langs"}
    sizes = report.eligible(record, dry_run).agg(F.count(F.lit(1)).alias("row_count"),
                                                 *[F.sum(F.length(text.list_text(F.col(c)))).alias(t) for t, c in listed.items()])
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("table_name"), F.col("row_count"), F.col(t).alias("text_size")) for t in listed]))
    stats = report.run_stats(runs)
    total = sum((F.col(c) for c in stats.columns[1:]), F.col(stats.columns[0]))
    return sizes.select(tables.alias("t")).select("t.*").unionByName(
        stats.select(F.lit("stats").alias("table_name"), total.alias("row_count"), F.lit(0).cast("bigint").alias("text_size")))
