"""Matching two file catalogues on a derived id."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from twinline.functions import text


def with_episode(catalog: DataFrame, pattern: str = text.DEFAULT_ID_PATTERN) -> DataFrame:
    return catalog.withColumn("episode_id", text.episode_id(F.col("file_name"), pattern))


def language_index(lang: DataFrame) -> DataFrame:
    """One language file per id: the last one scanned. Aggregates map-side, so a hot id is no problem."""
    last = F.max_by(F.struct("scan_pos", "file_name", "size_bytes"), "scan_pos")
    return (lang.filter("episode_id <> ''").groupBy("episode_id").agg(last.alias("_l"))
            .select("episode_id", F.col("_l.scan_pos").alias("lang_file"), F.col("_l.file_name").alias("lang_name"),
                    F.col("_l.size_bytes").alias("lang_size")))


def match(source: DataFrame, lang: DataFrame) -> DataFrame:
    """Left join source files to the language index with a status ladder.

    Files without an id never meet the shuffle key '' (which could hold most of
    the catalogue); AQE splits a hot id, since its other side is one row.
    """
    with_id, without = source.filter("episode_id <> ''"), source.filter("episode_id = ''")
    joined = with_id.join(language_index(lang), "episode_id", "left").unionByName(without, allowMissingColumns=True)
    reason = (F.when(F.col("episode_id") == "", "No episode ID").when(F.col("lang_file").isNull(), "No match").otherwise(""))
    return (joined.withColumn("skip_reason", reason)
            .withColumn("status", F.when(reason == "", "Pending").otherwise("Skipped"))
            .withColumnRenamed("scan_pos", "src_file").drop("side"))


def match_job(catalog: DataFrame, pattern: str = text.DEFAULT_ID_PATTERN, same_folder: bool = False) -> DataFrame:
    files = with_episode(catalog, pattern)
    lang = files if same_folder else files.filter("side = 'language'")
    source = files if same_folder else files.filter("side = 'source'")
    return match(source, lang)


def matched(matches: DataFrame) -> DataFrame:
    return matches.filter("status = 'Pending'")


def scan_counts(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count_if(F.col("status") == "Pending").alias("pending"),
                       F.count_if(F.col("status") == "Skipped").alias("skipped"))


def ordered_records(matches: DataFrame) -> DataFrame:
    """Records by id without regard to case; ties keep scan order."""
    return matches.orderBy(F.upper("episode_id"), "src_file")
