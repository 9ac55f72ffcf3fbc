"""Delays, run counters and the three report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from twinline.functions import text


def with_effective_delays(records: DataFrame, audio_ms: int, subtitle_ms: int) -> DataFrame:
    return (records.withColumn("audio_delay_ms", F.col("sync_ms") + F.lit(audio_ms) + F.col("manual_audio_ms"))
            .withColumn("subtitle_delay_ms", F.col("sync_ms") + F.lit(subtitle_ms) + F.col("manual_sub_ms")))


def outcome() -> Column:
    """First matching outcome of a record; null for rows no counter takes."""
    error = F.lower("error_message")
    return (F.when(F.col("success"), "processed").when(F.col("skip_reason") == "No episode ID", "skipped")
            .when(F.col("skip_reason") == "No match", "no_match").when(F.col("skip_reason") == "No matching tracks", "no_tracks")
            .when(error.contains("sync") | error.contains("speed"), "sync_failed")
            .when(F.col("status") == "Error", "errors"))


def run_stats(records: DataFrame) -> DataFrame:
    names = ["processed", "skipped", "no_match", "no_tracks", "sync_failed", "errors"]
    return records.select(outcome().alias("o")).agg(*[F.count_if(F.col("o") == n).alias(n) for n in names])


def eligible(records: DataFrame, dry_run: bool) -> DataFrame:
    cond = F.col("success")
    return records.filter(cond | (F.col("lang_name") != "")) if dry_run else records.filter(cond)


def report_tables(records: DataFrame, dry_run: bool) -> dict[str, DataFrame]:
    """Source, language and result tables of the eligible records."""
    r = eligible(records, dry_run)
    size = F.lit("N/A") if dry_run else text.size_text(F.col("result_size"))
    def took(name):
        return F.when(F.col(name) > 0, F.concat(F.col(name).cast("string"), F.lit("ms"))).otherwise("-")
    merge = F.when(F.col("merge_ms") > 0, F.concat(F.col("merge_ms").cast("string"), F.lit("ms"))) \
        .otherwise("N/A" if dry_run else "-")
    return {
        "source": r.select("src_file", "episode_id", text.list_text(F.col("src_audio_langs")).alias("audio"),
                           text.list_text(F.col("src_sub_langs")).alias("subtitles"),
                           text.size_text(F.col("size_bytes")).alias("size")),
        "language": r.select("src_file", "episode_id", text.list_text(F.col("lang_audio_langs")).alias("audio"),
                             text.list_text(F.col("lang_sub_langs")).alias("subtitles"),
                             text.size_text(F.col("lang_size")).alias("size")),
        "result": r.select("src_file", "episode_id", text.list_text(F.col("result_audio_langs")).alias("audio"),
                           text.list_text(F.col("result_sub_langs")).alias("subtitles"), size.alias("size"),
                           text.delay_text(F.col("audio_delay_ms")).alias("delay"),
                           took("frame_sync_ms").alias("frame_sync"),
                           F.when(F.col("edit_ops").isNotNull(), F.concat(F.col("edit_ops").cast("string"), F.lit(" ops")))
                            .otherwise("-").alias("deep"),
                           took("speed_ms").alias("speed"), merge.alias("merge")),
    }
