"""Input views derived from the driver tables, in Spark and as SQL text.

The SQL text is what the checker runs; the Spark functions produce the same
rows with the partition-safe operators of the library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from twinline.operators import ordered
from twinline.session import spread

VIEWS: dict[str, tuple[list[str], str]] = {
    "fx1_frames": ([], """
  SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY vec_id, explode_n) - 1 AS frame_idx,
         embedding
  FROM (SELECT label AS file_id, vec_id, unnest(range(8 + vec_id % 5)) AS explode_n, embedding FROM embeddings)"""),
    "fx1": (["fx1_frames"], """
  SELECT file_id, frame_idx, frame_idx * 40 AS ts_ms,
    list_transform(embedding, lambda x, i: CAST(greatest(0, least(255, floor(CAST(x AS DOUBLE) * 255 + 128)
      + (frame_idx + i) % 3)) AS INTEGER)) AS px FROM fx1_frames"""),
    "fx2": (["fx1"], """
  SELECT file_id, frame_idx - 37 AS frame_idx, (frame_idx - 37) * 40 AS ts_ms,
    list_transform(px, lambda v, i: CAST(greatest(0, least(255, v + (i * 7 + frame_idx * 3) % 21 - 10)) AS INTEGER)) AS px
  FROM fx1 WHERE frame_idx >= 37"""),
    "fx3": ([], """
  SELECT pair_id, 'src' AS side, t AS t_ms FROM (
    SELECT user_id AS pair_id, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 600000) AS BIGINT) AS t FROM events)
  UNION ALL
  SELECT pair_id, 'lang', t - CASE WHEN t < 2880000 THEN (pair_id % 11 - 5) * 1000
                                   ELSE (pair_id % 11 - 5) * 1000 + (pair_id % 3 - 1) * 4000 END
  FROM (SELECT user_id AS pair_id, event_id, event_type,
          CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 600000) AS BIGINT) AS t FROM events)
  WHERE NOT (event_type = 'error' AND pair_id % 2 = 0 AND event_id % 3 = 0)"""),
    "cuts": (["fx3"], "SELECT * FROM fx3 WHERE t_ms >= 0"),
    "fx4": ([], """
  SELECT l_orderkey AS file_id,
   row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS track_id,
   CASE l_returnflag WHEN 'A' THEN 'audio' WHEN 'R' THEN 'subtitles' ELSE 'video' END AS type,
   CASE p_type WHEN 'ECONOMY' THEN 'AC-3' WHEN 'LARGE' THEN 'DTS' WHEN 'MEDIUM' THEN 'TrueHD' WHEN 'PROMO' THEN 'DTS-HD Master Audio' WHEN 'SMALL' THEN 'E-AC-3' ELSE 'FLAC' END AS codec,
   CASE WHEN s_nationkey % 7 = 6 THEN '' ELSE ['eng','ita','jpn','fra','ger','spa'][s_nationkey % 7 + 1] END AS language,
   CASE WHEN s_nationkey % 3 = 0 THEN ['en-US','it-IT','ja-JP','fr-FR','de-DE','es-ES',''][s_nationkey % 7 + 1] ELSE '' END AS language_ietf,
   CASE WHEN p_size % 10 = 0 THEN 'Atmos ' || p_name ELSE p_name END AS name,
   CAST(CASE WHEN l_returnflag = 'N' THEN [41708333, 40000000, 33366667, 0][l_linenumber % 4 + 1] ELSE 0 END AS BIGINT) AS default_duration_ns,
   CASE WHEN l_returnflag = 'A' THEN [1, 2, 6, 8, 3][p_size % 5 + 1] ELSE 0 END AS channels,
   CASE WHEN l_returnflag = 'A' THEN [0, 16, 24][p_size % 3 + 1] ELSE 0 END AS bits_per_sample,
   CASE WHEN l_returnflag = 'A' THEN [0, 44100, 48000][l_linenumber % 3 + 1] ELSE 0 END AS sampling_frequency
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"""),
    "fx5": ([], """
  SELECT o_orderkey AS scan_pos, CASE WHEN o_orderstatus = 'F' THEN 'source' ELSE 'language' END AS side,
   CASE WHEN o_orderpriority LIKE '5%' THEN 'Extra.' || o_orderkey || '.mkv'
        ELSE 'Serie.' || CASE WHEN o_orderkey % 2 = 0 THEN 's' ELSE 'S' END || lpad(CAST(o_custkey % 40 AS VARCHAR), 2, '0') || 'E' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || '.mkv' END AS file_name,
   CAST(round_even(o_totalprice * 10000, 0) AS BIGINT) AS size_bytes FROM orders"""),
    "fx6": ([], """
  SELECT conv_id AS pair_id, turn AS cue_id, turn * 5000 AS start_ms, turn * 5000 + least(8000, length(text) * 10) AS end_ms, text FROM conversations"""),
    "fx7": ([], """
  SELECT event_id AS record_id, user_id AS episode_id, ts, event_type = 'purchase' AS success,
   CASE WHEN event_type = 'view' AND event_id % 3 = 0 THEN 'No episode ID' WHEN event_type = 'view' AND event_id % 3 = 1 THEN 'No match' WHEN event_type = 'view' THEN 'No matching tracks' WHEN event_type = 'signup' AND event_id % 4 = 0 THEN 'Skipped by user' ELSE '' END AS skip_reason,
   CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'Frame sync failed' WHEN event_type = 'error' AND event_id % 3 = 1 THEN 'Speed correction failed' WHEN event_type = 'error' THEN 'Merge failed: code 2' ELSE '' END AS error_message,
   CASE event_type WHEN 'purchase' THEN 'Done' WHEN 'error' THEN 'Error' WHEN 'view' THEN 'Skipped' WHEN 'click' THEN 'Pending' ELSE CASE WHEN event_id % 4 = 0 THEN 'Skipped' ELSE 'Analyzed' END END AS status,
   CAST(floor(value * 10) AS INTEGER) - 500 AS sync_ms FROM events"""),
    "eps": (["fx5"], """
  SELECT *, CASE WHEN regexp_matches(file_name, '(?i)S(\\d+)E(\\d+)')
     THEN regexp_extract(file_name, '(?i)S(\\d+)E(\\d+)', 1) || '_' || regexp_extract(file_name, '(?i)S(\\d+)E(\\d+)', 2) ELSE '' END AS episode_id FROM fx5"""),
    "lang_idx": (["eps"], """
  SELECT episode_id, scan_pos AS lang_file, file_name AS lang_name, size_bytes AS lang_size FROM eps
  WHERE side = 'language' AND episode_id <> ''
  QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY scan_pos DESC) = 1"""),
    "pairs": (["eps", "lang_idx"], """
  SELECT s.scan_pos AS src_file, l.lang_file, s.episode_id, s.file_name, s.size_bytes, l.lang_name, l.lang_size
  FROM eps s JOIN lang_idx l USING (episode_id) WHERE s.side = 'source' AND s.episode_id <> ''"""),
}


def sql_with(views: list[str], body: str, extra: list[tuple[str, str]] = ()) -> str:
    """``WITH`` clause holding the named views and all they depend on, then ``body``."""
    ordered_names: list[str] = []

    def add(name):
        if name not in ordered_names:
            for dep in VIEWS[name][0]:
                add(dep)
            ordered_names.append(name)

    for v in views:
        add(v)
    def part(name, q):  # computed once, however often the query is wrapped or a view is named
        return f"{name} AS {'' if 'RECURSIVE' in q else 'MATERIALIZED '}(\n{q}\n)"

    parts = [part(n, VIEWS[n][1]) for n in ordered_names] + [part(n, q) for n, q in extra]
    recursive = "RECURSIVE " if any("RECURSIVE" in q for _, q in extra) else ""
    text = ",\n".join(parts).replace("/*RECURSIVE*/", "")
    return f"WITH {recursive}{text}\n{body}" if parts else body


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a driver timestamp, read as UTC."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    """FX1: every vector held for 8 to 12 frames of 40 ms with 0-2 noise."""
    vec = (table(spark, d, "embeddings")
           .select(F.col("label").alias("file_id"), "vec_id", "embedding",
                   (8 + F.col("vec_id") % 5).alias("_hold"))
           .withColumn("_chunk", ordered.chunk_index(F.col("vec_id"), 1024)))
    placed = ordered.running_total(spread(vec, ["file_id", "_chunk"]), ["file_id"], "_chunk", ["vec_id"], F.col("_hold"), "_start", exclusive=True)
    held = placed.select("file_id", "embedding",
                         F.explode(F.sequence(F.col("_start"), F.col("_start") + F.col("_hold") - 1)).alias("frame_idx"))
    px = F.transform("embedding", lambda x, i: F.greatest(F.lit(0), F.least(
        F.lit(255), (F.floor(x.cast("double") * 255 + 128) + (F.col("frame_idx") + i + 1) % 3))).cast("int"))
    return held.select("file_id", "frame_idx", (F.col("frame_idx") * 40).alias("ts_ms"), px.alias("px"))


def noisy_frames(spark: SparkSession, d: str) -> DataFrame:
    """FX1 with +-10 noise."""
    px = F.transform("px", lambda v, i: F.greatest(F.lit(0), F.least(
        F.lit(255), v + ((i + 1) * 7 + F.col("frame_idx") * 3) % 21 - 10)).cast("int"))
    return frames(spark, d).withColumn("px", px)


def lang_frames(spark: SparkSession, d: str) -> DataFrame:
    """FX2: the noisy frames with the first 37 removed."""
    # numbered in a step of its own: inside a lambda a column name would bind to a new alias of the same select
    n = F.col("frame_idx")
    return noisy_frames(spark, d).filter(n >= 37).select(
        "file_id", (n - 37).alias("frame_idx"), ((n - 37) * 40).alias("ts_ms"), "px")


def speed_lang_frames(spark: SparkSession, d: str) -> DataFrame:
    """FX10: FX2 played at 41.708 ms per frame."""
    return lang_frames(spark, d).withColumn("ts_ms", F.col("frame_idx") * F.lit(41.708))


def all_cuts(spark: SparkSession, d: str) -> DataFrame:
    """FX3: paired cut timelines with a known offset per pair."""
    e = table(spark, d, "events").select(
        F.col("user_id").alias("pair_id"), "event_id", "event_type",
        F.floor((micros(F.col("ts")) - F.lit(1704067200000000)) / 600000).alias("t_ms"))
    off1 = (F.col("pair_id") % 11 - 5) * 1000
    off = F.when(F.col("t_ms") < 2880000, off1).otherwise(off1 + (F.col("pair_id") % 3 - 1) * 4000)
    lost = (F.col("event_type") == "error") & (F.col("pair_id") % 2 == 0) & (F.col("event_id") % 3 == 0)
    # one pass over events: both sides come out of the same row
    both = F.filter(F.array(
        F.struct(F.lit("src").alias("side"), F.col("t_ms")),
        F.when(~lost, F.struct(F.lit("lang").alias("side"), (F.col("t_ms") - off).alias("t_ms")))),
        lambda x: x.isNotNull())
    return e.select("pair_id", F.explode(both).alias("c")).select("pair_id", "c.side", "c.t_ms")


def cuts(spark: SparkSession, d: str) -> DataFrame:
    """FX3 without the positions before zero, which no recording has."""
    return all_cuts(spark, d).filter("t_ms >= 0")


TRACK_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
               "l_shipdate", "l_returnflag", "l_linestatus"]


def tracks(spark: SparkSession, d: str) -> DataFrame:
    """FX4: track table; file id = order key."""
    numbered = ordered.number_rows(
        table(spark, d, "lineitem").select("l_orderkey", *TRACK_ORDER), ["l_orderkey"], TRACK_ORDER,
        [F.col("l_linenumber"), ordered.chunk_index(F.col("l_partkey"), 4096)], "_rn")
    part = table(spark, d, "part").select("p_partkey", "p_type", "p_size", "p_name")
    supp = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    t = numbered.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    nation7, audio = F.col("s_nationkey") % 7, F.col("l_returnflag") == "A"
    return t.select(
        F.col("l_orderkey").alias("file_id"), (F.col("_rn") - 1).cast("long").alias("track_id"),
        F.when(audio, "audio").when(F.col("l_returnflag") == "R", "subtitles").otherwise("video").alias("type"),
        F.when(F.col("p_type") == "ECONOMY", "AC-3").when(F.col("p_type") == "LARGE", "DTS")
         .when(F.col("p_type") == "MEDIUM", "TrueHD").when(F.col("p_type") == "PROMO", "DTS-HD Master Audio")
         .when(F.col("p_type") == "SMALL", "E-AC-3").otherwise("FLAC").alias("codec"),
        pick(["eng", "ita", "jpn", "fra", "ger", "spa", ""], nation7 + 1).alias("language"),
        F.when(F.col("s_nationkey") % 3 == 0, pick(["en-US", "it-IT", "ja-JP", "fr-FR", "de-DE", "es-ES", ""], nation7 + 1))
         .otherwise("").alias("language_ietf"),
        F.when(F.col("p_size") % 10 == 0, F.concat(F.lit("Atmos "), F.col("p_name"))).otherwise(F.col("p_name")).alias("name"),
        F.when(F.col("l_returnflag") == "N", pick([41708333, 40000000, 33366667, 0], F.col("l_linenumber") % 4 + 1))
         .otherwise(0).cast("long").alias("default_duration_ns"),
        F.when(audio, pick([1, 2, 6, 8, 3], F.col("p_size") % 5 + 1)).otherwise(0).alias("channels"),
        F.when(audio, pick([0, 16, 24], F.col("p_size") % 3 + 1)).otherwise(0).alias("bits_per_sample"),
        F.when(audio, pick([0, 44100, 48000], F.col("l_linenumber") % 3 + 1)).otherwise(0).alias("sampling_frequency"))


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """FX5: two catalogues with duplicate ids and names without an id."""
    return as_catalog(table(spark, d, "orders"))


def as_catalog(o: DataFrame) -> DataFrame:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    serie = F.concat(F.lit("Serie."), F.when(F.col("o_orderkey") % 2 == 0, "s").otherwise("S"),
                     two(F.col("o_custkey") % 40), F.lit("E"), two(F.col("o_orderkey") % 60), F.lit(".mkv"))
    return o.select(
        F.col("o_orderkey").alias("scan_pos"),
        F.when(F.col("o_orderstatus") == "F", "source").otherwise("language").alias("side"),
        F.when(F.col("o_orderpriority").startswith("5"), F.concat(F.lit("Extra."), F.col("o_orderkey").cast("string"), F.lit(".mkv")))
         .otherwise(serie).alias("file_name"),
        F.bround(F.col("o_totalprice") * 10000, 0).cast("long").alias("size_bytes"))


def cues(spark: SparkSession, d: str) -> DataFrame:
    """FX6: subtitle-like cues."""
    c = table(spark, d, "conversations")
    start = F.col("turn") * 5000
    return c.select(F.col("conv_id").alias("pair_id"), F.col("turn").alias("cue_id"), start.alias("start_ms"),
                    (start + F.least(F.lit(8000), F.length("text") * 10)).alias("end_ms"), "text")


def records(spark: SparkSession, d: str) -> DataFrame:
    """FX7: processing records and status updates."""
    return as_records(table(spark, d, "events"))


def as_records(e: DataFrame) -> DataFrame:
    kind, n = F.col("event_type"), F.col("event_id")
    view, error, signup = kind == "view", kind == "error", kind == "signup"
    return e.select(
        n.alias("record_id"), F.col("user_id").alias("episode_id"), "ts", (kind == "purchase").alias("success"),
        F.when(view & (n % 3 == 0), "No episode ID").when(view & (n % 3 == 1), "No match").when(view, "No matching tracks")
         .when(signup & (n % 4 == 0), "Skipped by user").otherwise("").alias("skip_reason"),
        F.when(error & (n % 3 == 0), "Frame sync failed").when(error & (n % 3 == 1), "Speed correction failed")
         .when(error, "Merge failed: code 2").otherwise("").alias("error_message"),
        F.when(kind == "purchase", "Done").when(error, "Error").when(view, "Skipped").when(kind == "click", "Pending")
         .when(n % 4 == 0, "Skipped").otherwise("Analyzed").alias("status"),
        (F.floor(F.col("value") * 10).cast("int") - 500).alias("sync_ms"))
