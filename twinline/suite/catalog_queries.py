"""Id matching and output routing."""

from pyspark.sql import functions as F

from twinline import fixtures as fx
from twinline.functions import text
from twinline.operators import catalog
from twinline.suite.registry import query

MATCH_SQL = """SELECT s.scan_pos AS src_file, s.episode_id, s.file_name, s.size_bytes, l.lang_file, l.lang_name, l.lang_size,
  CASE WHEN s.episode_id = '' THEN 'No episode ID' WHEN l.lang_file IS NULL THEN 'No match' ELSE '' END AS skip_reason,
  CASE WHEN s.episode_id = '' OR l.lang_file IS NULL THEN 'Skipped' ELSE 'Pending' END AS status
FROM eps s LEFT JOIN lang_idx l ON s.episode_id = l.episode_id AND s.episode_id <> '' WHERE s.side = 'source'"""


@query("episode_id", fx.sql_with(["eps"], "SELECT scan_pos, file_name, episode_id FROM eps"))
def episode_id(spark, d):
    return catalog.with_episode(fx.catalog(spark, d)).select("scan_pos", "file_name", "episode_id")


@query("episode_match", fx.sql_with(["eps", "lang_idx"], MATCH_SQL))
@query("job_match", fx.sql_with(["eps", "lang_idx"], MATCH_SQL))
def job_match(spark, d):
    return catalog.match_job(fx.catalog(spark, d))


@query("episode_self_match", fx.sql_with(["eps"], """
SELECT s.scan_pos AS src_file, s.episode_id, s.file_name, s.size_bytes, l.scan_pos AS lang_file, l.file_name AS lang_name,
  l.size_bytes AS lang_size, CASE WHEN s.episode_id = '' THEN 'No episode ID' ELSE '' END AS skip_reason,
  CASE WHEN s.episode_id = '' THEN 'Skipped' ELSE 'Pending' END AS status
FROM eps s LEFT JOIN (SELECT * FROM eps WHERE episode_id <> ''
  QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY scan_pos DESC) = 1) l
  ON s.episode_id = l.episode_id AND s.episode_id <> ''"""))
def episode_self_match(spark, d):
    return catalog.match_job(fx.catalog(spark, d), same_folder=True)


@query("scan_counts", fx.sql_with(["eps", "lang_idx"], f"""SELECT count(*) FILTER (status = 'Pending') AS pending,
  count(*) FILTER (status = 'Skipped') AS skipped FROM ({MATCH_SQL})"""))
def scan_counts(spark, d):
    return catalog.scan_counts(job_match(spark, d))


@query("ordered_records", fx.sql_with(["eps", "lang_idx"], f"""SELECT src_file, episode_id, status FROM ({MATCH_SQL})
ORDER BY upper(episode_id), src_file"""))
def ordered_records(spark, d):
    return catalog.ordered_records(job_match(spark, d)).select("src_file", "episode_id", "status")


@query("output_path", fx.sql_with(["fx5"], """SELECT scan_pos, '/in/shows/' || file_name AS overwritten,
  '/out/' || file_name AS routed FROM fx5 WHERE side = 'source'"""))
def output_path(spark, d):
    path = F.concat(F.lit("/in/shows/"), F.col("file_name"))
    return fx.catalog(spark, d).filter("side = 'source'").select(
        "scan_pos", text.output_path(path, "/in/shows", "/out", True).alias("overwritten"),
        text.output_path(path, "/in/shows", "/out", False).alias("routed"))


@query("csv_list", """SELECT p_partkey, ' ' || p_type || ', ,' || p_name || ',.' || p_brand AS raw,
  p_type || '|' || p_name || '|.' || p_brand AS items, p_type || '|' || p_name || '|' || p_brand AS extensions FROM part""")
def csv_list(spark, d):
    raw = F.concat(F.lit(" "), F.col("p_type"), F.lit(", ,"), F.col("p_name"), F.lit(",."), F.col("p_brand"))
    return fx.table(spark, d, "part").select(
        "p_partkey", raw.alias("raw"), F.array_join(text.csv_list(raw), "|").alias("items"),
        F.array_join(text.csv_list(raw, strip_dot=True), "|").alias("extensions"))


@query("fmt_size", fx.sql_with(["fx5"], """SELECT scan_pos, size_bytes, v.shift,
  CASE WHEN b >= 1073741824 THEN regexp_replace(CAST(CAST(round_even(b / 1073741824.0, 2) AS DECIMAL(20,2)) AS VARCHAR), '\\.?0+$', '') || ' GB'
       WHEN b >= 1048576 THEN regexp_replace(CAST(CAST(round_even(b / 1048576.0, 1) AS DECIMAL(20,2)) AS VARCHAR), '\\.?0+$', '') || ' MB'
       WHEN b >= 1024 THEN regexp_replace(CAST(CAST(round_even(b / 1024.0, 1) AS DECIMAL(20,2)) AS VARCHAR), '\\.?0+$', '') || ' KB'
       ELSE b || ' B' END AS size_text
FROM (SELECT scan_pos, size_bytes, v AS shift, CAST(size_bytes AS BIGINT) >> CAST(v AS BIGINT) AS b FROM fx5, (VALUES (0), (8), (18), (28)) t(v)) v"""))
def fmt_size(spark, d):
    shifts = F.explode(F.array(*[F.lit(n) for n in (0, 8, 18, 28)]))
    return fx.catalog(spark, d).select("scan_pos", "size_bytes", shifts.alias("shift")).withColumn(
        "size_text", text.size_text(F.expr("shiftright(size_bytes, shift)")))


@query("fmt_delay", fx.sql_with(["fx7"], """SELECT record_id, sync_ms,
  CASE WHEN t > 0 THEN '+' || t || 'ms' WHEN t < 0 THEN t || 'ms' ELSE '0ms' END AS delay_text,
  CASE WHEN t > 0 THEN '+' || t || 'ms' WHEN t < 0 THEN t || 'ms' ELSE '0ms' END ||
    CASE WHEN manual_ms <> 0 THEN ' (sync:' || sync_ms || ' man:' || manual_ms || ')' ELSE '' END AS delay_text_full
FROM (SELECT *, sync_ms + manual_ms AS t FROM (SELECT *, (record_id % 3) * 40 AS manual_ms FROM fx7))"""))
def fmt_delay(spark, d):
    r = fx.records(spark, d).withColumn("manual_ms", (F.col("record_id") % 3) * 40)
    total = F.col("sync_ms") + F.col("manual_ms")
    return r.select("record_id", "sync_ms", text.delay_text(total).alias("delay_text"),
                    text.delay_text_full(total, F.col("sync_ms"), F.col("manual_ms")).alias("delay_text_full"))


@query("effective_delay", fx.sql_with(["fx7"], """SELECT record_id,
  sync_ms + 120 + (record_id % 3) * 40 AS audio_delay_ms, sync_ms - 80 + (record_id % 2) * 10 AS subtitle_delay_ms FROM fx7"""))
def effective_delay(spark, d):
    from twinline.operators import report
    r = fx.records(spark, d).withColumn("manual_audio_ms", (F.col("record_id") % 3) * 40) \
        .withColumn("manual_sub_ms", (F.col("record_id") % 2) * 10)
    return report.with_effective_delays(r, 120, -80).select("record_id", "audio_delay_ms", "subtitle_delay_ms")
