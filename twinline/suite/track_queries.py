"""Track selection, codec and language lookups, texts, plans and reports."""

import uuid

from pyspark.sql import functions as F

from twinline import fixtures as fx
from twinline.functions import codecs, languages, text
from twinline.operators import catalog, regions, report, tracks as tr
from twinline.plans import jobs
from twinline.session import settled, shared_folder
from twinline.sources import files
from twinline.suite.registry import query

AUDIO_PATTERNS = ["AC-3", "DTS"]
TARGETS = ["ita", "en"]


def quoted(values):
    return ", ".join("'" + v.lower().replace("'", "''") + "'" for v in values)


def lang_sql(w):
    return f"(lower(language) = '{w}' OR (length(language_ietf) > 0 AND starts_with(lower(language_ietf), '{w}')))"


LOSSLESS_SQL = f"lower(codec) IN ({quoted(codecs.LOSSLESS)})"
SPATIAL_SQL = "(lower(codec) = 'dts:x' OR (lower(codec) = 'truehd' AND contains(lower(name), 'atmos')))"
FLAC_SQL = f"({LOSSLESS_SQL} AND NOT {SPATIAL_SQL} AND lower(codec) <> 'flac')"
OPUS_SQL = f"({LOSSLESS_SQL} AND NOT {SPATIAL_SQL})"
SPLICE_SQL = f"NOT (lower(codec) IN ({quoted(codecs.NOT_SPLICEABLE)}) OR regexp_matches(lower(codec), 'truehd|dts-hd|dts:x|mlp|lossless'))"
DOTTED_SQL = "CASE channels WHEN 1 THEN '1.0' WHEN 2 THEN '2.0' WHEN 6 THEN '5.1' WHEN 8 THEN '7.1' ELSE CASE WHEN channels > 0 THEN channels || '.0' ELSE '' END END"
OPUS_RATE_SQL = "CASE WHEN channels <= 1 THEN 128 WHEN channels <= 2 THEN 256 WHEN channels <= 6 THEN 510 ELSE 768 END"
QUALITY_SQL = """CASE WHEN bits_per_sample > 0 AND sampling_frequency // 1000 > 0 THEN ' ' || bits_per_sample || 'bit/' || sampling_frequency // 1000 || 'kHz'
  WHEN bits_per_sample > 0 THEN ' ' || bits_per_sample || 'bit' WHEN sampling_frequency // 1000 > 0 THEN ' ' || sampling_frequency // 1000 || 'kHz' ELSE '' END"""
NAME_SQL = f"CASE WHEN codec = '' THEN '' ELSE codec || CASE WHEN ({DOTTED_SQL}) = '' THEN '' ELSE ' ' || {DOTTED_SQL} END || {QUALITY_SQL} END"
FLAC_NAME_SQL = f"'FLAC' || CASE WHEN ({DOTTED_SQL}) = '' THEN '' ELSE ' ' || {DOTTED_SQL} END || {QUALITY_SQL}"
OPUS_NAME_SQL = f"""'Opus' || CASE WHEN ({DOTTED_SQL}) = '' THEN '' ELSE ' ' || {DOTTED_SQL} END ||
  CASE WHEN sampling_frequency // 1000 > 0 THEN ' ' || sampling_frequency // 1000 || 'kHz' ELSE '' END || ' ' || {OPUS_RATE_SQL} || 'kbps'"""
COMPACT_SQL = f"""track_id || ': ' || CASE WHEN language = '' THEN 'und' ELSE language END || ' ' || codec ||
  CASE WHEN ({DOTTED_SQL}) = '' THEN '' ELSE ' ' || {DOTTED_SQL} END"""

KEEP_AUDIO = "(type = 'audio' AND (" + lang_sql("eng") + " OR " + lang_sql("ja") + ") AND lower(codec) IN ('ac-3', 'dts', 'flac', 'dts-hd master audio'))"
KEEP_SUBS = "(type = 'subtitles')"
IMPORT_SQL = "SELECT *, 0 AS target_pos FROM fx4 WHERE {p} AND " + lang_sql("ita") + " UNION ALL SELECT *, 1 FROM fx4 WHERE {p} AND " + lang_sql("en")
IMPORT_SQL = IMPORT_SQL.format(p="((type = 'audio' AND lower(codec) IN ('ac-3', 'dts')) OR type = 'subtitles')")
IMPORT_ALL_SQL = "SELECT *, 0 AS target_pos FROM fx4 WHERE {p} AND " + lang_sql("ita") + " UNION ALL SELECT *, 1 FROM fx4 WHERE {p} AND " + lang_sql("en")
IMPORT_ALL_SQL = IMPORT_ALL_SQL.format(p="(type IN ('audio', 'subtitles'))")


def keep_audio(t):
    return tr.kept(t, "audio", ["eng", "ja"], ["AC-3", "DTS", "FLAC", "DTS-HD Master Audio"])


@query("tracks_by_type", fx.sql_with(["fx4"], "SELECT file_id, track_id, type FROM fx4 WHERE lower(type) = lower('AUDIO')"))
def tracks_by_type(spark, d):
    return tr.of_type(fx.tracks(spark, d), "AUDIO").select("file_id", "track_id", "type")


@query("tracks_by_ids", fx.sql_with(["fx4"], f"""SELECT file_id, track_id, codec FROM fx4 t WHERE EXISTS (
  SELECT 1 FROM fx4 k WHERE {KEEP_AUDIO.replace('type =', 'k.type =').replace('language_ietf', 'k.language_ietf')} AND k.file_id = t.file_id AND k.track_id = t.track_id)"""))
def tracks_by_ids(spark, d):
    t = fx.tracks(spark, d)
    return tr.by_ids(t, keep_audio(t)).select("file_id", "track_id", "codec")


@query("lang_match", fx.sql_with(["fx4"], f"""SELECT file_id, track_id, {lang_sql('it')} AS m_it, {lang_sql('ita')} AS m_ita,
  {lang_sql('eng')} AS m_eng, ({lang_sql('jpn')} OR {lang_sql('fr')}) AS m_list FROM fx4"""))
def lang_match(spark, d):
    a, b = F.col("language"), F.col("language_ietf")
    return fx.tracks(spark, d).select(
        "file_id", "track_id", languages.language_matches(a, b, "it").alias("m_it"),
        languages.language_matches(a, b, "ITA").alias("m_ita"), languages.language_matches(a, b, "eng").alias("m_eng"),
        languages.language_in(a, b, ["jpn", "fr"]).alias("m_list"))


@query("codec_match", fx.sql_with(["fx4"], """SELECT file_id, track_id, codec, lower(codec) IN ('dts', 'truehd') AS matched FROM fx4"""))
def codec_match(spark, d):
    return fx.tracks(spark, d).select("file_id", "track_id", "codec",
                                      codecs.matches_any(F.col("codec"), ["dts", "TRUEHD"]).alias("matched"))


@query("import_selection", fx.sql_with(["fx4"], f"SELECT file_id, track_id, target_pos, type FROM ({IMPORT_SQL})"))
def import_selection(spark, d):
    return tr.imported(fx.tracks(spark, d), TARGETS, AUDIO_PATTERNS).select("file_id", "track_id", "target_pos", "type")


@query("union_selection", fx.sql_with(["fx4"], f"""SELECT file_id, track_id, 'audio' AS branch FROM ({IMPORT_SQL}) WHERE type = 'audio'
UNION ALL SELECT file_id, track_id, 'subtitles' FROM ({IMPORT_SQL}) WHERE type = 'subtitles'"""))
def union_selection(spark, d):
    t = fx.tracks(spark, d)
    audio = tr.imported(t, TARGETS, AUDIO_PATTERNS, subtitles=False).select("file_id", "track_id", F.lit("audio").alias("branch"))
    subs = tr.imported(t, TARGETS, AUDIO_PATTERNS, audio=False).select("file_id", "track_id", F.lit("subtitles").alias("branch"))
    return audio.unionByName(subs)


@query("keep_selection", fx.sql_with(["fx4"], f"SELECT file_id, track_id, type FROM fx4 WHERE {KEEP_AUDIO} OR {KEEP_SUBS}"))
def keep_selection(spark, d):
    t = fx.tracks(spark, d)
    return keep_audio(t).unionByName(tr.kept(t, "subtitles", [], None)).select("file_id", "track_id", "type")


@query("convertible_tracks", fx.sql_with(["fx4"], f"""SELECT file_id, track_id, {LOSSLESS_SQL} AS lossless, {SPATIAL_SQL} AS spatial,
  {FLAC_SQL} AS to_flac, {OPUS_SQL} AS to_opus FROM fx4"""))
def convertible_tracks(spark, d):
    return tr.with_conversion_flags(fx.tracks(spark, d)).select("file_id", "track_id", "lossless", "spatial", "to_flac", "to_opus")


@query("splice_eligible", fx.sql_with(["fx4"], f"SELECT file_id, track_id, {SPLICE_SQL} AS eligible FROM fx4 WHERE type = 'audio'"))
def splice_eligible(spark, d):
    return tr.of_type(fx.tracks(spark, d), "audio").select("file_id", "track_id", codecs.is_spliceable(F.col("codec")).alias("eligible"))


@query("passthrough_tracks", fx.sql_with(["fx4"], f"""SELECT file_id, track_id FROM fx4 WHERE type = 'audio' AND NOT {FLAC_SQL} AND NOT (type = 'audio' AND {SPLICE_SQL} AND {lang_sql('ita')})"""))
def passthrough_tracks(spark, d):
    audio = tr.of_type(fx.tracks(spark, d), "audio")
    converted = audio.filter(codecs.is_convertible(F.col("codec"), F.col("name"), "flac"))
    spliced = audio.filter(codecs.is_spliceable(F.col("codec")) & languages.language_matches(F.col("language"), F.col("language_ietf"), "ita"))
    return tr.passthrough(audio, converted, spliced).select("file_id", "track_id")


USER_CODEC_SQL = """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN ' ac3 ' WHEN 1 THEN 'dts hd ma' WHEN 2 THEN p_type WHEN 3 THEN 'Atmos' ELSE 'dd+' END AS user_codec FROM part"""
ALIAS_SQL = ("SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{a}', '{a.replace(' ', '').replace('-', '').replace(':', '')}', '{'|'.join(p)}')" for i, (a, p) in enumerate(codecs.ALIASES))
    + ") v(pos, alias, stripped, patterns)")


def user_codecs(spark, d):
    m = F.col("p_partkey") % 5
    return fx.table(spark, d, "part").select("p_partkey", F.when(m == 0, " ac3 ").when(m == 1, "dts hd ma").when(m == 2, F.col("p_type"))
                                             .when(m == 3, "Atmos").otherwise("dd+").alias("user_codec"))


@query("codec_alias", fx.sql_with([], f"""SELECT p_partkey, user_codec, coalesce(
   (SELECT patterns FROM al WHERE alias = upper(trim(user_codec))),
   (SELECT arg_min(patterns, pos) FROM al WHERE stripped = regexp_replace(upper(trim(user_codec)), '[\\s\\-:]', '', 'g'))) AS patterns FROM uc""",
                              [("al", ALIAS_SQL), ("uc", USER_CODEC_SQL)]))
def codec_alias(spark, d):
    return codecs.resolve_aliases(user_codecs(spark, d), "user_codec").select(
        "p_partkey", "user_codec", F.array_join("patterns", "|").alias("patterns"))


@query("codec_pattern_set", fx.sql_with([], f"""SELECT p_brand, string_agg(pattern, '|' ORDER BY first_key, pos) AS patterns FROM (
  SELECT p_brand, pattern, arg_min(p_partkey, p_partkey * 10 + pos) AS first_key, arg_min(pos, p_partkey * 10 + pos) AS pos FROM (
    SELECT p_brand, p_partkey, unnest(string_split(patterns, '|')) AS pattern, generate_subscripts(string_split(patterns, '|'), 1) AS pos
    FROM (SELECT p.p_brand, p_partkey, coalesce(
     (SELECT patterns FROM al WHERE alias = upper(trim(user_codec))),
     (SELECT arg_min(patterns, pos) FROM al WHERE stripped = regexp_replace(upper(trim(user_codec)), '[\\s\\-:]', '', 'g'))) AS patterns FROM uc JOIN part p USING (p_partkey))
    WHERE patterns IS NOT NULL) GROUP BY p_brand, pattern) GROUP BY p_brand""",
                                    [("al", ALIAS_SQL), ("uc", USER_CODEC_SQL)]))
def codec_pattern_set(spark, d):
    users = user_codecs(spark, d).join(fx.table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")
    rows = codecs.resolve_aliases(users, "user_codec").select("p_brand", "p_partkey", F.posexplode("patterns").alias("pos", "pattern"))
    return tr.distinct_in_order(rows, ["p_brand"], "pattern", F.struct("p_partkey", "pos"), "patterns").select(
        "p_brand", F.array_join("patterns", "|").alias("patterns"))


CODES_SQL = "SELECT unnest([" + quoted(sorted(set(languages.COMMON_NAMES.values()))) + "]) AS code"
NAMES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{c}')" for n, c in languages.COMMON_NAMES.items()) + ") v(name, code)"


@query("lang_invalid", fx.sql_with([], """SELECT doc_id, lang, EXISTS (SELECT 1 FROM codes WHERE code = lower(trim(lang))) AS valid FROM documents""",
                               [("codes", CODES_SQL)]))
def lang_invalid(spark, d):
    return languages.with_validity(fx.table(spark, d, "documents").select("doc_id", "lang"), "lang").select("doc_id", "lang", "valid")


@query("lang_suggest", fx.sql_with([], """SELECT word, code, tier, rank FROM (
  SELECT word, code, min(tier) AS tier, row_number() OVER (PARTITION BY word ORDER BY min(tier), code) AS rank FROM (
    SELECT word, n.code, 1 AS tier FROM w JOIN names n ON n.name = word
    UNION ALL SELECT word, code, 2 FROM w, codes WHERE starts_with(code, left(word, 2))
    UNION ALL SELECT word, code, 3 FROM w, codes WHERE contains(code, word) OR contains(word, code)) GROUP BY word, code) WHERE rank <= 3""",
                               [("codes", CODES_SQL), ("names", NAMES_SQL),
                                ("w", "SELECT DISTINCT lower(trim(word)) AS word FROM (SELECT lang AS word FROM documents UNION ALL SELECT unnest(string_split(text, ' ')) FROM documents)")]))
def lang_suggest(spark, d):
    docs = fx.table(spark, d, "documents")
    words = docs.select(F.col("lang").alias("word")).unionByName(docs.select(F.explode(F.split("text", " ")).alias("word")))
    return languages.suggestions(words, "word", 3).select("word", "code", "tier", F.col("rank").cast("bigint").alias("rank"))


@query("file_langs", fx.sql_with(["fx4"], """SELECT file_id, coalesce(string_agg(lang, ',' ORDER BY o) FILTER (type = 'audio'), '-') AS audio,
  coalesce(string_agg(lang, ',' ORDER BY o) FILTER (type = 'subtitles'), '-') AS subtitles FROM (
  SELECT file_id, type, CASE WHEN language = '' THEN 'und' ELSE language END AS lang, min(track_id) AS o FROM fx4
  WHERE type IN ('audio', 'subtitles') GROUP BY ALL) GROUP BY file_id"""))
@query("fmt_langs", fx.sql_with(["fx4"], """SELECT file_id, coalesce(string_agg(lang, ',' ORDER BY o) FILTER (type = 'audio'), '-') AS audio,
  coalesce(string_agg(lang, ',' ORDER BY o) FILTER (type = 'subtitles'), '-') AS subtitles FROM (
  SELECT file_id, type, CASE WHEN language = '' THEN 'und' ELSE language END AS lang, min(track_id) AS o FROM fx4
  WHERE type IN ('audio', 'subtitles') GROUP BY ALL) GROUP BY file_id"""))
def file_langs(spark, d):
    return tr.file_languages(fx.tracks(spark, d)).select(
        "file_id", text.list_text(F.col("audio_langs")).alias("audio"), text.list_text(F.col("sub_langs")).alias("subtitles"))


VIDEO_SQL = """SELECT file_id, coalesce(arg_min(default_duration_ns, track_id) FILTER (type = 'video' AND default_duration_ns > 0), 0) AS video_duration_ns,
  count(*) * 60000000000 AS container_duration_ns FROM fx4 GROUP BY file_id"""


@query("video_duration", fx.sql_with(["fx4"], VIDEO_SQL))
def video_duration(spark, d):
    return tr.video_duration(fx.tracks(spark, d))


PAIR_DUR_SQL = """SELECT p.src_file, p.lang_file, s.video_duration_ns AS sd, l.video_duration_ns AS ld,
  s.container_duration_ns AS sc, l.container_duration_ns AS lc FROM pairs p JOIN vd s ON s.file_id = p.src_file JOIN vd l ON l.file_id = p.lang_file"""


def pair_durations(spark, d):
    pairs = catalog.matched(catalog.match_job(fx.catalog(spark, d))).select("src_file", "lang_file", "episode_id")
    return jobs.pair_durations(pairs, tr.video_duration(fx.tracks(spark, d)))


@query("speed_mismatch", fx.sql_with(["pairs", "fx4"], """SELECT src_file, lang_file,
  pos AND diff >= 0.001 AND NOT tele AS mismatch, pos AND diff >= 0.001 AND tele AS soft_telecine,
  CASE WHEN pos AND diff >= 0.001 THEN round_even(1e9 / sd, 6) ELSE 0.0 END AS src_fps,
  CASE WHEN pos AND diff >= 0.001 THEN round_even(1e9 / ld, 6) ELSE 0.0 END AS lang_fps
FROM (SELECT *, sd > 0 AND ld > 0 AS pos, CASE WHEN ld > 0 THEN abs(CAST(sd AS DOUBLE) / ld - 1) END AS diff,
  sc > 0 AND lc > 0 AND abs(CAST(sc AS DOUBLE) / lc - 1) < 0.005 AS tele FROM pd)""",
                                 [("vd", VIDEO_SQL), ("pd", PAIR_DUR_SQL)]))
def speed_mismatch(spark, d):
    return jobs.with_speed_mismatch(pair_durations(spark, d)).select(
        "src_file", "lang_file", "mismatch", "soft_telecine", F.bround("src_fps", 6).alias("src_fps"), F.bround("lang_fps", 6).alias("lang_fps"))


STRETCH_SQL = """SELECT src_file, lang_file, CASE WHEN big THEN round_even(CAST(ld AS DOUBLE) / sd, 9) ELSE 1.0 END AS inverse_ratio,
  CASE WHEN big THEN sd || '/' || ld ELSE '' END AS stretch FROM (SELECT *, coalesce(sd > 0 AND ld > 0 AND abs(CAST(sd AS DOUBLE) / ld - 1) >= 0.001, false) AS big FROM pd)"""


@query("stretch_factor", fx.sql_with(["pairs", "fx4"], STRETCH_SQL, [("vd", VIDEO_SQL), ("pd", PAIR_DUR_SQL)]))
def stretch_factor(spark, d):
    return jobs.with_stretch(pair_durations(spark, d)).select("src_file", "lang_file", F.bround("inverse_ratio", 9).alias("inverse_ratio"), "stretch")


@query("stretch_ratio", fx.sql_with(["pairs", "fx4"], """SELECT src_file, raw,
  CASE WHEN len(string_split(raw, '/')) = 2 AND TRY_CAST(string_split(raw, '/')[2] AS DOUBLE) > 0 AND TRY_CAST(string_split(raw, '/')[1] AS DOUBLE) > 0
    THEN round_even(TRY_CAST(string_split(raw, '/')[1] AS DOUBLE) / TRY_CAST(string_split(raw, '/')[2] AS DOUBLE), 9) END AS ratio
FROM (SELECT src_file, sd || CASE src_file % 4 WHEN 0 THEN '/x' WHEN 1 THEN '' ELSE '/' || ld END AS raw FROM pd)""",
                                [("vd", VIDEO_SQL), ("pd", PAIR_DUR_SQL)]))
def stretch_ratio(spark, d):
    m = F.col("src_file") % 4
    raw = F.concat(F.col("src_video_ns").cast("string"), F.when(m == 0, "/x").when(m == 1, "")
                   .otherwise(F.concat(F.lit("/"), F.col("lang_video_ns").cast("string"))))
    return pair_durations(spark, d).select("src_file", raw.alias("raw")).withColumn("ratio", F.bround(text.stretch_ratio(F.col("raw")), 9))


@query("fps_cols", fx.sql_with(["fx4"], """SELECT file_id, round_even(1e9 / video_duration_ns, 6) AS fps,
  CAST(greatest(1, round_even(video_duration_ns / 1000000.0, 0)) AS INTEGER) AS interval_ms FROM vd WHERE video_duration_ns > 0""", [("vd", VIDEO_SQL)]))
def fps_cols(spark, d):
    v = tr.video_duration(fx.tracks(spark, d)).filter("video_duration_ns > 0").withColumn("_fps", F.lit(1e9) / F.col("video_duration_ns"))
    return v.select("file_id", F.bround("_fps", 6).alias("fps"), text.frame_interval_ms(F.col("_fps")).alias("interval_ms"))


@query("channel_layouts", fx.sql_with(["fx4"], f"""SELECT file_id, track_id, channels, {DOTTED_SQL} AS dotted,
  CASE WHEN channels <= 1 THEN 'mono' WHEN channels <= 2 THEN 'stereo' WHEN channels <= 6 THEN '5.1' ELSE '7.1' END AS named,
  CASE channels WHEN 3 THEN '2.1' WHEN 4 THEN 'quad' WHEN 6 THEN '5.1' WHEN 8 THEN '7.1' ELSE '' END AS standard FROM fx4"""))
def channel_layouts(spark, d):
    ch = F.col("channels")
    return fx.tracks(spark, d).select("file_id", "track_id", "channels", codecs.layout_dotted(ch).alias("dotted"),
                                      codecs.layout_named(ch).alias("named"), codecs.layout_standard(ch).alias("standard"))


FAMILY_SQL = """CASE WHEN contains(c, 'ac-3') OR contains(c, 'ac3') THEN 'ac3' WHEN contains(c, 'aac') THEN 'aac' WHEN contains(c, 'flac') THEN 'flac'
  WHEN contains(c, 'dts') THEN 'dca' WHEN contains(c, 'mp3') OR contains(c, 'a_mpeg/l3') THEN 'libmp3lame' WHEN contains(c, 'opus') THEN 'libopus'
  WHEN contains(c, 'vorbis') THEN 'libvorbis' WHEN contains(c, 'pcm') THEN 'pcm_s16le' ELSE '' END"""


@query("encoder_family", fx.sql_with(["fx4"], f"SELECT file_id, track_id, codec, {FAMILY_SQL} AS family FROM (SELECT *, lower(codec) AS c FROM fx4 WHERE type = 'audio')"))
def encoder_family(spark, d):
    return tr.of_type(fx.tracks(spark, d), "audio").select("file_id", "track_id", "codec", codecs.encoder_family(F.col("codec")).alias("family"))


@query("bitrate_plan", fx.sql_with(["fx4"], f"""SELECT file_id, track_id, family, {OPUS_RATE_SQL} AS opus_kbps,
  CASE family WHEN 'ac3' THEN CASE WHEN channels <= 2 THEN 192 WHEN channels <= 6 THEN 640 ELSE 768 END
   WHEN 'dca' THEN CASE WHEN channels <= 2 THEN 256 WHEN channels <= 6 THEN 768 ELSE 1024 END ELSE 0 END AS reencode_kbps
  FROM (SELECT *, {FAMILY_SQL} AS family FROM (SELECT *, lower(codec) AS c FROM fx4 WHERE type = 'audio'))"""))
def bitrate_plan(spark, d):
    ch = F.col("channels")
    return (tr.of_type(fx.tracks(spark, d), "audio").withColumn("family", codecs.encoder_family(F.col("codec")))
            .select("file_id", "track_id", "family", codecs.rate_for(ch, "libopus").alias("opus_kbps"),
                    codecs.reencode_rate(F.col("family"), ch).alias("reencode_kbps")))


@query("track_name", fx.sql_with(["fx4"], f"SELECT file_id, track_id, {NAME_SQL} AS track_name FROM fx4"))
def track_name(spark, d):
    return fx.tracks(spark, d).select("file_id", "track_id", text.track_name(
        F.col("codec"), F.col("channels"), F.col("bits_per_sample"), F.col("sampling_frequency")).alias("track_name"))


@query("converted_name", fx.sql_with(["fx4"], f"SELECT file_id, track_id, {FLAC_NAME_SQL} AS flac_name, {OPUS_NAME_SQL} AS opus_name FROM fx4"))
def converted_name(spark, d):
    args = F.col("channels"), F.col("bits_per_sample"), F.col("sampling_frequency")
    return fx.tracks(spark, d).select("file_id", "track_id", text.converted_name(*args, "flac").alias("flac_name"),
                                      text.converted_name(*args, "opus").alias("opus_name"))


@query("track_text", fx.sql_with(["fx4"], f"""SELECT file_id, (place - 1) // 1024 AS part, string_agg({COMPACT_SQL}, ' | ' ORDER BY track_id) AS tracks,
  string_agg({COMPACT_SQL} || CASE WHEN {FLAC_SQL} THEN ' -> FLAC' ELSE '' END, ' | ' ORDER BY track_id) AS tracks_converted
FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY track_id) AS place FROM fx4) GROUP BY ALL"""))
def track_text(spark, d):
    return tr.track_texts(fx.tracks(spark, d), "flac")


# --- pair level: plans and reports ------------------------------------------------------------

def inputs(spark, d):
    """Pairs, and numbered tracks written once: the branches of a plan read them instead of numbering lineitem again."""
    return catalog.matched(catalog.match_job(fx.catalog(spark, d))), settled(fx.tracks(spark, d))


SRC_KEPT_SQL = f"""SELECT p.src_file, k.* FROM pairs p JOIN (SELECT * FROM fx4 WHERE {KEEP_AUDIO} OR {KEEP_SUBS}) k ON k.file_id = p.src_file"""
LANG_IMPORT_SQL = f"SELECT p.src_file, k.* FROM pairs p JOIN ({IMPORT_ALL_SQL}) k ON k.file_id = p.lang_file"
RESULT_LANG_SQL = """SELECT src_file, coalesce(string_agg(lang, ',' ORDER BY o) FILTER (type = 'audio'), '-') AS audio,
  coalesce(string_agg(lang, ',' ORDER BY o) FILTER (type = 'subtitles'), '-') AS subtitles FROM (
  SELECT src_file, type, lang, min(o) AS o FROM (
   SELECT src_file, type, CASE WHEN language = '' THEN 'und' ELSE language END AS lang, track_id AS o FROM kept
   UNION ALL SELECT src_file, type, CASE WHEN language = '' THEN 'und' ELSE language END, 1000000000000 * (target_pos + 1) + track_id FROM imp) GROUP BY ALL) GROUP BY src_file"""


@query("result_langs", fx.sql_with(["pairs", "fx4"], RESULT_LANG_SQL, [("kept", SRC_KEPT_SQL.replace(f"OR {KEEP_SUBS}", "OR (type = 'subtitles' AND lower(CASE WHEN language = '' THEN 'und' ELSE language END) IN ('eng', 'und'))")), ("imp", LANG_IMPORT_SQL)]))
def result_langs(spark, d):
    pairs, t = inputs(spark, d)
    r = jobs.result_languages(pairs, t, keep_audio(t), ["eng", "und"], tr.imported(t, TARGETS, None))
    return r.select("src_file", text.list_text(F.col("result_audio_langs")).alias("audio"), text.list_text(F.col("result_sub_langs")).alias("subtitles"))


@query("result_tracks", fx.sql_with(["pairs", "fx4"], f"""SELECT src_file, part, string_agg({COMPACT_SQL} || CASE WHEN {FLAC_SQL} THEN ' -> FLAC' ELSE '' END, ' | ' ORDER BY side, target_pos, track_id) AS tracks
FROM (SELECT *, (row_number() OVER (PARTITION BY src_file ORDER BY side, target_pos, track_id) - 1) // 1024 AS part
 FROM (SELECT *, 0 AS side, 0 AS target_pos FROM kept UNION ALL SELECT * EXCLUDE (target_pos), 1 AS side, target_pos FROM imp)) GROUP BY src_file, part""",
                                [("kept", SRC_KEPT_SQL), ("imp", LANG_IMPORT_SQL)]))
def result_tracks(spark, d):
    pairs, t = inputs(spark, d)
    kept = keep_audio(t).unionByName(tr.kept(t, "subtitles", [], None))
    return jobs.result_tracks(pairs, kept, tr.imported(t, TARGETS, None), "flac")


PLAN_SQL = f"""SELECT src_file, file_id, track_id, type, 0 AS target_pos, 'source' AS side,
  CASE WHEN type = 'audio' AND {FLAC_SQL} THEN 'convert' ELSE 'keep' END AS action, CAST(0 AS BIGINT) AS delay_ms, '' AS stretch,
  CASE WHEN type = 'audio' AND {FLAC_SQL} AND language_ietf <> '' THEN language_ietf ELSE language END AS language,
  CASE WHEN type = 'audio' AND {FLAC_SQL} THEN {FLAC_NAME_SQL} WHEN type = 'audio' THEN {NAME_SQL} ELSE '' END AS track_name FROM kept WHERE src_file IN (SELECT src_file FROM imp)
UNION ALL SELECT src_file, file_id, track_id, type, target_pos, 'language',
  CASE WHEN src_file % 2 = 0 AND (type <> 'audio' OR CASE WHEN {FLAC_SQL} THEN true ELSE {SPLICE_SQL} END) THEN 'splice'
       WHEN type = 'audio' AND {FLAC_SQL} THEN 'convert' ELSE 'import' END,
  CASE WHEN type = 'audio' THEN 120 + src_file % 100 ELSE src_file % 100 - 80 END,
  CASE WHEN src_file % 2 = 0 THEN '' ELSE stretch END,
  CASE WHEN type = 'audio' AND ({FLAC_SQL} OR (src_file % 2 = 0 AND {SPLICE_SQL})) AND language_ietf <> '' THEN language_ietf ELSE language END,
  CASE WHEN type = 'audio' AND {FLAC_SQL} THEN {FLAC_NAME_SQL}
       WHEN type = 'audio' THEN {NAME_SQL} ELSE '' END
FROM imp JOIN st USING (src_file)"""
PLAN_ARGS = [("vd", VIDEO_SQL), ("pd", PAIR_DUR_SQL), ("st", f"SELECT src_file, stretch FROM ({STRETCH_SQL})"),
             ("kept", SRC_KEPT_SQL), ("imp", LANG_IMPORT_SQL)]


@query("remux_plan", fx.sql_with(["pairs", "fx4"], PLAN_SQL, PLAN_ARGS))
def remux_plan(spark, d, rename_all=True, whole=False):
    pairs, t = inputs(spark, d)
    return jobs.plan_job(pairs, t, keep_audio(t), tr.kept(t, "subtitles", [], None), tr.imported(t, TARGETS, None), "flac",
                         F.lit(120) + F.col("src_file") % 100, F.col("src_file") % 100 - 80, F.col("src_file") % 2 == 0, rename_all, whole)


@query("remux_plan_names_kept", fx.sql_with(["pairs", "fx4"], f"""SELECT p.* REPLACE (CASE WHEN t.type = 'audio' AND t.flac THEN track_name ELSE '' END AS track_name)
FROM ({PLAN_SQL}) p JOIN (SELECT file_id, track_id, type, {FLAC_SQL} AS flac FROM fx4) t ON t.file_id = p.file_id AND t.track_id = p.track_id""", PLAN_ARGS))
def remux_plan_names_kept(spark, d):
    return remux_plan(spark, d, rename_all=False)


@query("remux_plan_whole", fx.sql_with(["pairs", "fx4"], """SELECT * FROM pl UNION ALL
SELECT src_file, t.file_id, t.track_id, type, 0, side, CASE WHEN side = 'source' AND type = 'video' THEN 'keep' ELSE 'drop' END, 0, '', language, '' FROM (
  SELECT src_file, 'source' AS side, src_file AS file_id FROM pairs UNION ALL SELECT src_file, 'language', lang_file FROM pairs) f JOIN fx4 t ON t.file_id = f.file_id
WHERE src_file IN (SELECT src_file FROM imp) AND NOT EXISTS (SELECT 1 FROM pl WHERE pl.src_file = f.src_file AND pl.side = f.side AND pl.track_id = t.track_id)""",
                                       [*PLAN_ARGS, ("pl", PLAN_SQL)]))
def remux_plan_whole(spark, d):
    return remux_plan(spark, d, whole=True)


@query("plan_skips", fx.sql_with(["pairs", "fx4"], """SELECT src_file, lang_file, 'No matching tracks' AS skip_reason FROM pairs
WHERE NOT EXISTS (SELECT 1 FROM imp WHERE imp.src_file = pairs.src_file)""", [("imp", LANG_IMPORT_SQL)]))
def plan_skips(spark, d):
    pairs, t = inputs(spark, d)
    return jobs.plan_skips(pairs, tr.imported(t, TARGETS, None))


@query("job_plan", fx.sql_with(["pairs", "fx4"], f"""SELECT side, action, type, count(*) AS n, count(DISTINCT src_file) AS files,
  CAST(sum(CASE WHEN stretch = '' THEN 0 ELSE 1 END) AS BIGINT) AS stretched FROM ({PLAN_SQL}) GROUP BY ALL""", PLAN_ARGS))
def job_plan(spark, d):
    return remux_plan(spark, d).groupBy("side", "action", "type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("src_file").alias("files"),
        F.sum(F.when(F.col("stretch") == "", 0).otherwise(1)).alias("stretched"))


@query("job_convert_plan", fx.sql_with(["pairs", "fx4"], f"""SELECT src_file, side, file_id, track_id, 'opus' AS target,
  CASE channels WHEN 3 THEN '2.1' WHEN 4 THEN 'quad' WHEN 6 THEN '5.1' WHEN 8 THEN '7.1' ELSE '' END AS layout, {OPUS_RATE_SQL} AS kbps FROM (
  SELECT DISTINCT src_file, side, file_id, track_id, channels, codec, name FROM (
    SELECT p.src_file, 'source' AS side, t.* FROM pairs p JOIN fx4 t ON t.file_id = p.src_file WHERE type = 'audio'
    UNION ALL SELECT src_file, 'language', * EXCLUDE (src_file, target_pos) FROM imp WHERE type = 'audio')) WHERE {OPUS_SQL}""",
                                   [("imp", LANG_IMPORT_SQL)]))
def job_convert_plan(spark, d):
    pairs, t = inputs(spark, d)
    return jobs.conversion_plan(pairs, tr.of_type(t, "audio"), tr.imported(t, TARGETS, None, subtitles=False), "opus")


SIZE_SQL = """CASE WHEN {b} >= 1073741824 THEN regexp_replace(CAST(CAST(round_even({b} / 1073741824.0, 2) AS DECIMAL(20,2)) AS VARCHAR), '\\.?0+$', '') || ' GB'
       WHEN {b} >= 1048576 THEN regexp_replace(CAST(CAST(round_even({b} / 1048576.0, 1) AS DECIMAL(20,2)) AS VARCHAR), '\\.?0+$', '') || ' MB'
       WHEN {b} >= 1024 THEN regexp_replace(CAST(CAST(round_even({b} / 1024.0, 1) AS DECIMAL(20,2)) AS VARCHAR), '\\.?0+$', '') || ' KB'
       ELSE {b} || ' B' END"""
LANGS_SQL = file_langs_sql = """SELECT file_id, coalesce(string_agg(lang, ',' ORDER BY o) FILTER (type = 'audio'), '-') AS audio,
  coalesce(string_agg(lang, ',' ORDER BY o) FILTER (type = 'subtitles'), '-') AS subtitles FROM (
  SELECT file_id, type, CASE WHEN language = '' THEN 'und' ELSE language END AS lang, min(track_id) AS o FROM fx4
  WHERE type IN ('audio', 'subtitles') GROUP BY ALL) GROUP BY file_id"""


def record_frame(spark, d):
    pairs, t = inputs(spark, d)
    langs = tr.file_languages(t)
    results = jobs.result_languages(pairs, t, keep_audio(t), ["eng", "und"], tr.imported(t, TARGETS, None))
    return jobs.record_frame(pairs, langs, results).withColumn("success", F.col("src_file") % 3 == 0) \
        .withColumn("result_size", F.col("size_bytes") + F.col("lang_size")) \
        .withColumn("audio_delay_ms", (F.col("src_file") % 100 - 50).cast("bigint")) \
        .withColumn("frame_sync_ms", F.col("src_file") % 7).withColumn("speed_ms", F.col("src_file") % 3) \
        .withColumn("merge_ms", F.col("src_file") % 2).withColumn("edit_ops", F.when(F.col("src_file") % 5 == 0, F.col("src_file") % 4))


@query("report_source", fx.sql_with(["pairs", "fx4"], f"""SELECT src_file, episode_id, coalesce(audio, '-') AS audio, coalesce(subtitles, '-') AS subtitles,
  {SIZE_SQL.format(b='size_bytes')} AS size FROM pairs LEFT JOIN lg ON file_id = src_file""", [("lg", LANGS_SQL)]))
def report_source(spark, d):
    return report.report_tables(record_frame(spark, d), True)["source"]


@query("report_lang", fx.sql_with(["pairs", "fx4"], f"""SELECT src_file, episode_id, coalesce(audio, '-') AS audio, coalesce(subtitles, '-') AS subtitles,
  {SIZE_SQL.format(b='lang_size')} AS size FROM pairs LEFT JOIN lg ON file_id = lang_file""", [("lg", LANGS_SQL)]))
def report_lang(spark, d):
    return report.report_tables(record_frame(spark, d), True)["language"]


RESULT_ARGS = [("kept", SRC_KEPT_SQL.replace(f"OR {KEEP_SUBS}", "OR (type = 'subtitles' AND lower(CASE WHEN language = '' THEN 'und' ELSE language END) IN ('eng', 'und'))")),
               ("imp", LANG_IMPORT_SQL), ("rl", RESULT_LANG_SQL)]
RESULT_SQL = """SELECT src_file, episode_id, coalesce(audio, '-') AS audio, coalesce(subtitles, '-') AS subtitles, {size} AS size,
  CASE WHEN src_file % 100 > 50 THEN '+' || (src_file % 100 - 50) || 'ms' WHEN src_file % 100 < 50 THEN (src_file % 100 - 50) || 'ms' ELSE '0ms' END AS delay,
  CASE WHEN src_file % 7 > 0 THEN src_file % 7 || 'ms' ELSE '-' END AS frame_sync, CASE WHEN src_file % 5 = 0 THEN src_file % 4 || ' ops' ELSE '-' END AS deep,
  CASE WHEN src_file % 3 > 0 THEN src_file % 3 || 'ms' ELSE '-' END AS speed, CASE WHEN src_file % 2 > 0 THEN src_file % 2 || 'ms' ELSE '{merge}' END AS merge
FROM pairs LEFT JOIN rl USING (src_file) WHERE {where}"""


@query("report_result", fx.sql_with(["pairs", "fx4"], RESULT_SQL.format(size="'N/A'", merge="N/A", where="true"), RESULT_ARGS))
def report_result(spark, d):
    return report.report_tables(record_frame(spark, d), True)["result"]


@query("report_result_run", fx.sql_with(["pairs", "fx4"], RESULT_SQL.format(size=SIZE_SQL.format(b="(size_bytes + lang_size)"), merge="-", where="src_file % 3 = 0"), RESULT_ARGS))
def report_result_run(spark, d):
    return report.report_tables(record_frame(spark, d), False)["result"]


STATS_SQL = """SELECT CAST(count(*) FILTER (o = 1) AS BIGINT) AS processed, count(*) FILTER (o = 2) AS skipped, count(*) FILTER (o = 3) AS no_match, count(*) FILTER (o = 4) AS no_tracks,
  count(*) FILTER (o = 5) AS sync_failed, count(*) FILTER (o = 6) AS errors FROM (
  SELECT CASE WHEN success THEN 1 WHEN skip_reason = 'No episode ID' THEN 2 WHEN skip_reason = 'No match' THEN 3 WHEN skip_reason = 'No matching tracks' THEN 4
   WHEN contains(lower(error_message), 'sync') OR contains(lower(error_message), 'speed') THEN 5 WHEN status = 'Error' THEN 6 END AS o FROM fx7)"""


@query("run_stats", fx.sql_with(["fx7"], STATS_SQL))
def run_stats(spark, d):
    return report.run_stats(fx.records(spark, d))


REPORT_SQL = """SELECT 'source' AS table_name, count(*) AS row_count, CAST(sum(length(audio)) AS BIGINT) AS text_size FROM (
  SELECT coalesce(audio, '-') AS audio FROM pairs LEFT JOIN lg ON file_id = src_file WHERE {where})
UNION ALL SELECT 'language', count(*), CAST(sum(length(audio)) AS BIGINT) FROM (SELECT coalesce(audio, '-') AS audio FROM pairs LEFT JOIN lg ON file_id = lang_file WHERE {where})
UNION ALL SELECT 'result', count(*), CAST(sum(length(audio)) AS BIGINT) FROM (SELECT coalesce(audio, '-') AS audio FROM pairs LEFT JOIN rl USING (src_file) WHERE {where})
UNION ALL SELECT 'stats', processed + skipped + no_match + no_tracks + sync_failed + errors, 0 FROM st"""
REPORT_ARGS = [*RESULT_ARGS, ("lg", LANGS_SQL), ("st", STATS_SQL)]


@query("job_report", fx.sql_with(["pairs", "fx4", "fx7"], REPORT_SQL.format(where="true"), REPORT_ARGS))
def job_report(spark, d):
    return jobs.report_summary(record_frame(spark, d), fx.records(spark, d))


@query("job_report_run", fx.sql_with(["pairs", "fx4", "fx7"], REPORT_SQL.format(where="src_file % 3 = 0"), REPORT_ARGS))
def job_report_run(spark, d):
    return jobs.report_summary(record_frame(spark, d), fx.records(spark, d), False)


@query("report_sink", fx.sql_with(["pairs", "fx4"], f"""SELECT 'source' AS table_name, src_file, episode_id, audio, subtitles, size, CAST(NULL AS VARCHAR) AS delay FROM (SELECT src_file, episode_id, coalesce(audio, '-') AS audio, coalesce(subtitles, '-') AS subtitles,
    {SIZE_SQL.format(b='size_bytes')} AS size FROM pairs LEFT JOIN lg ON file_id = src_file WHERE src_file % 3 = 0)
UNION ALL SELECT 'language', src_file, episode_id, coalesce(audio, '-'), coalesce(subtitles, '-'), {SIZE_SQL.format(b='lang_size')}, NULL FROM pairs LEFT JOIN lg ON file_id = lang_file WHERE src_file % 3 = 0
UNION ALL SELECT 'result', src_file, episode_id, audio, subtitles, size, delay FROM ({RESULT_SQL.format(size=SIZE_SQL.format(b="(size_bytes + lang_size)"), merge="-", where="src_file % 3 = 0")})""", [*RESULT_ARGS, ("lg", LANGS_SQL)]))
def report_sink(spark, d):
    """The report of a run written twice beside that of a dry run, and read back."""
    frame, out = settled(record_frame(spark, d)), f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    files.write_report(report.report_tables(frame, True), out, "dry")
    for _ in range(2):
        files.write_report(report.report_tables(frame, False), out, "real")
    return files.read_report(spark, out, "real").select(F.col("table").alias("table_name"), "src_file", "episode_id", "audio", "subtitles", "size", "delay")
