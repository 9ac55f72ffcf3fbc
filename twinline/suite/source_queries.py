"""Text sources: probe documents and logs."""

from pyspark.sql import functions as F

from twinline import fixtures as fx
from twinline.sources import textlogs
from twinline.suite.registry import query

PART = 1024  # tracks per probe document of a very large file


def probe_docs(spark, d):
    """Probe documents made of the track table; every 50th file is cut in half."""
    t = fx.tracks(spark, d).withColumn("part", F.floor(F.col("track_id") / PART))
    n = F.col("track_id") + 1
    ietf = F.when(n % 7 == 0, F.lit(None)).when(n % 11 == 0, "@@null").otherwise(F.col("language_ietf"))
    props = F.struct("language", ietf.alias("language_ietf"), F.col("name").alias("track_name"), F.col("default_duration_ns").alias("default_duration"),
                     F.col("channels").alias("audio_channels"), F.col("bits_per_sample").alias("audio_bits_per_sample"), F.col("sampling_frequency").alias("audio_sampling_frequency"))
    track = F.struct(F.col("track_id").alias("id"), "type", "codec", props.alias("properties"))
    docs = t.groupBy("file_id", "part").agg(F.sort_array(F.collect_list(F.struct("track_id", track.alias("t")))).alias("_t"))
    body = F.struct(F.struct(F.struct((F.size("_t") * F.lit(60000000000)).alias("duration"), F.concat(F.lit("Serie "), F.col("file_id").cast("string")).alias("title")).alias("properties")).alias("container"),
                    F.transform("_t", lambda x: x["t"]).alias("tracks"))
    doc = F.replace(F.to_json(body), F.lit('"language_ietf":"@@null"'), F.lit('"language_ietf":null'))
    return docs.select("file_id", "part", doc.alias("doc")).withColumn(
        "doc", F.when(F.col("file_id") % 50 == 0, F.substring("doc", F.lit(1), F.floor(F.length("doc") / 2).cast("int"))).otherwise(F.col("doc")))


@query("probe_tracks", fx.sql_with(["fx4"], """SELECT file_id, part, count(*) OVER (PARTITION BY file_id, part) * 60000000000 AS container_duration_ns, 'Serie ' || file_id AS title,
  track_id, type, codec, language, CASE WHEN (track_id + 1) % 7 = 0 OR (track_id + 1) % 11 = 0 THEN '' ELSE language_ietf END AS language_ietf, name, default_duration_ns, channels, bits_per_sample, sampling_frequency
FROM (SELECT *, track_id // 1024 AS part FROM fx4 WHERE file_id % 50 <> 0)"""))
def probe_tracks(spark, d):
    files, tracks, _ = textlogs.probe_documents(probe_docs(spark, d), "doc", ["file_id", "part"])
    return files.join(tracks, ["file_id", "part"])


@query("probe_rejects", fx.sql_with(["fx4"], "SELECT DISTINCT file_id, track_id // 1024 AS part FROM fx4 WHERE file_id % 50 = 0"))
def probe_rejects(spark, d):
    return textlogs.probe_documents(probe_docs(spark, d), "doc", ["file_id", "part"])[2].select("file_id", "part")


@query("cuts_from_log", fx.sql_with(["cuts"], "SELECT pair_id, side, t_ms / 1000.0::DOUBLE AS t_s FROM cuts"))
def cuts_from_log(spark, d):
    t = F.col("t_ms")
    line = F.concat(F.lit("[showinfo] n:"), t.cast("string"), F.lit(" pts_time:"), F.floor(t / 1000).cast("string"), F.lit("."),
                    F.lpad((t % 1000).cast("string"), 3, "0"), F.lit(" pos:0"))
    return textlogs.cut_times(fx.cuts(spark, d).select("pair_id", "side", line.alias("value")), "value", ["pair_id", "side"])


@query("header_info", fx.sql_with(["cuts"], """SELECT pair_id, max(t_ms) // 10 * 10 AS duration_ms, CASE pair_id % 4 WHEN 0 THEN 23.98::DOUBLE WHEN 1 THEN 30.0 ELSE 25.0 END AS fps
FROM cuts WHERE pair_id % 10 <> 9 GROUP BY pair_id"""))
def header_info(spark, d):
    m, k = F.col("t"), F.col("pair_id") % 4
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    stamp = F.concat(two(F.floor(m / 3600000)), F.lit(":"), two(F.floor(m / 60000) % 60), F.lit(":"), two(F.floor(m / 1000) % 60), F.lit("."), two(F.floor(m / 10) % 100))
    fps = F.when(k == 0, ", 23.98 fps").when(k == 1, ", 30 fps, 30 tbr").when(k == 2, ", 0 fps").otherwise("")
    line = F.when(F.col("pair_id") % 10 == 9, F.concat(F.lit("Stream #0"), fps)).otherwise(F.concat(F.lit("  Duration: "), stamp, F.lit(", start: 0.000"), fps))
    logs = fx.cuts(spark, d).groupBy("pair_id").agg(F.max("t_ms").alias("t")).select("pair_id", line.alias("value"))
    return textlogs.headers(logs, "value", ["pair_id"])


@query("log_rollup", """SELECT section, level, count(*) AS lines, strftime(min(date_trunc('second', ts)), '%Y-%m-%d %H:%M:%S') AS first_seen FROM (SELECT ts,
  ['GENERAL', 'CONFIG', 'SPEED', 'DEEP', 'FRAME-SYNC', 'CONV', 'ENC', 'MERGE', 'FFMPEG', 'REPORT'][event_id % 10 + 1] AS section,
  ['ERROR', 'WARNING', 'NOTICE', 'SUCCESS', 'PHASE', 'HEADER', 'INFO', 'TEXT', 'DEBUG'][event_id % 9 + 1] AS level FROM events) GROUP BY section, level""")
def log_rollup(spark, d):
    r = fx.records(spark, d)
    tag = lambda names, k: F.concat(F.lit("["), fx.pick(names, F.col("record_id") % k + 1), F.lit("] "))
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), tag(textlogs.SECTIONS, 10), tag(textlogs.LEVELS, 9), F.col("status"), F.lit(" "), F.col("error_message"))
    return textlogs.log_counts(textlogs.run_log(r.select(line.alias("value")), "value"))
