"""Text sources: probe documents, tool logs, header lines and run logs.

All parsers take a DataFrame with one text column, as ``spark.read.text``
gives it, so the same code reads files, tables and streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from twinline.session import settled

# fixed values: names used in run logs, in their order
SECTIONS = ["GENERAL", "CONFIG", "SPEED", "DEEP", "FRAME-SYNC", "CONV", "ENC", "MERGE", "FFMPEG", "REPORT"]
LEVELS = ["ERROR", "WARNING", "NOTICE", "SUCCESS", "PHASE", "HEADER", "INFO", "TEXT", "DEBUG"]

PROBE_SCHEMA = """container struct<properties: struct<duration: bigint, title: string>>,
 tracks array<struct<id: int, type: string, codec: string, properties: struct<language: string, language_ietf: string,
 track_name: string, default_duration: bigint, audio_channels: int, audio_bits_per_sample: int, audio_sampling_frequency: int>>>,
 _corrupt string"""


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def probe_documents(docs: DataFrame, column: str, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Typed (files, tracks, rejects) of probe documents; absent values become 0 or ''.

    Documents of a table are made and parsed once, and written for all three; those of a stream are parsed for each.
    """
    parsed = docs.select(*keys, column, F.from_json(column, PROBE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("_p"))
    if not docs.isStreaming:
        broken = F.col("_p").isNull() | F.col("_p._corrupt").isNotNull()
        parsed = settled(parsed.select(*keys, F.when(broken, F.col(column)).alias(column), "_p"))
    broken = F.col("_p").isNull() | F.col("_p._corrupt").isNotNull()
    good = parsed.filter(~broken)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    number = lambda c, t: F.coalesce(F.col(c), F.lit(0)).cast(t)
    files = good.select(*keys, number("_p.container.properties.duration", "bigint").alias("container_duration_ns"),
                        text("_p.container.properties.title").alias("title"))
    t = good.select(*keys, F.explode("_p.tracks").alias("t"))
    tracks = t.select(
        *keys, number("t.id", "bigint").alias("track_id"), text("t.type").alias("type"), text("t.codec").alias("codec"),
        text("t.properties.language").alias("language"), text("t.properties.language_ietf").alias("language_ietf"),
        text("t.properties.track_name").alias("name"), number("t.properties.default_duration", "bigint").alias("default_duration_ns"),
        number("t.properties.audio_channels", "int").alias("channels"), number("t.properties.audio_bits_per_sample", "int").alias("bits_per_sample"),
        number("t.properties.audio_sampling_frequency", "int").alias("sampling_frequency"))
    return files, tracks, parsed.filter(broken).select(*keys, column)


def cut_times(logs: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Every ``pts_time`` value of every line, in seconds."""
    found = F.regexp_extract_all(column, F.lit(r"pts_time:(-?\d+(?:\.\d+)?)"), F.lit(1))
    return logs.select(*keys, F.explode(found).alias("_t")).select(*keys, F.col("_t").cast("double").alias("t_s"))


def headers(logs: DataFrame, column: str, keys: list[str], default_fps: float = 25.0) -> DataFrame:
    """Duration and frame rate of header lines; lines without a duration are no headers."""
    pattern = r"Duration:\s*(\d{2}):(\d{2}):(\d{2})\.(\d{2})"
    part = lambda g: F.regexp_extract(column, pattern, g).cast("bigint")
    fps = F.regexp_extract(column, r"(\d+(?:\.\d+)?)\s*fps", 1).try_cast("double")
    ms = part(1) * 3600000 + part(2) * 60000 + part(3) * 1000 + part(4) * 10
    return logs.filter(F.col(column).rlike(pattern)).select(
        *keys, ms.alias("duration_ms"), F.when(fps > 0, fps).otherwise(F.lit(default_fps)).alias("fps"))


def run_log(logs: DataFrame, column: str) -> DataFrame:
    """Time, section, level and text of run-log lines; other lines drop out."""
    pattern = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) \[([A-Z-]+)\] \[([A-Z]+)\] (.*)$"
    part = lambda g: F.regexp_extract(column, pattern, g)
    return (logs.filter(F.col(column).rlike(pattern))
            .select(F.to_timestamp(part(1), "yyyy-MM-dd HH:mm:ss").alias("ts"), part(2).alias("section"), part(3).alias("level"), part(4).alias("text"))
            .filter(F.col("section").isin(SECTIONS) & F.col("level").isin(LEVELS)))


def log_counts(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("section", "level").agg(F.count(F.lit(1)).alias("lines"), F.min("ts").cast("string").alias("first_seen"))
