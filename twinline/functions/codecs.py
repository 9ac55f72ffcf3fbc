"""Codec lookups, predicates and rate tables as Column expressions.

The tables below are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LOSSLESS = ["DTS-HD Master Audio", "DTS-HD High Resolution", "TrueHD", "PCM", "ALAC", "MLP", "FLAC"]

ALIASES = [
    ("AC3", ["AC-3"]), ("AC-3", ["AC-3"]), ("DD", ["AC-3"]),
    ("EAC3", ["E-AC-3"]), ("E-AC-3", ["E-AC-3"]), ("DD+", ["E-AC-3"]), ("DDP", ["E-AC-3"]),
    ("TRUEHD", ["TrueHD"]), ("ATMOS", ["TrueHD", "E-AC-3"]), ("MLP", ["MLP"]),
    ("DTS", ["DTS"]), ("DTS-HD", ["DTS-HD Master Audio", "DTS-HD High Resolution"]),
    ("DTS-HD MA", ["DTS-HD Master Audio"]), ("DTS-HDMA", ["DTS-HD Master Audio"]),
    ("DTS-HD HR", ["DTS-HD High Resolution"]), ("DTS-HDHR", ["DTS-HD High Resolution"]),
    ("DTS-ES", ["DTS-ES"]), ("DTS:X", ["DTS:X"]), ("DTSX", ["DTS:X"]),
    ("FLAC", ["FLAC"]), ("PCM", ["PCM"]), ("LPCM", ["PCM"]), ("WAV", ["PCM"]), ("ALAC", ["ALAC"]),
    ("AAC", ["AAC"]), ("HE-AAC", ["AAC"]), ("MP3", ["MPEG Audio", "MP3"]),
    ("MP2", ["MP2", "MPEG Audio Layer 2"]), ("OPUS", ["Opus"]), ("VORBIS", ["Vorbis"]),
]

NOT_SPLICEABLE = ["TrueHD", "DTS-HD Master Audio", "DTS-HD High Resolution", "DTS:X", "MLP",
                  "A_TRUEHD", "A_DTS/LOSSLESS", "A_MLP"]
NOT_SPLICEABLE_PARTS = ["truehd", "dts-hd", "dts:x", "mlp", "lossless"]

# encoder family: text parts tested in this order
FAMILIES = [("ac3", ["ac-3", "ac3"]), ("aac", ["aac"]), ("flac", ["flac"]), ("dca", ["dts"]),
            ("libmp3lame", ["mp3", "a_mpeg/l3"]), ("libopus", ["opus"]), ("libvorbis", ["vorbis"]),
            ("pcm_s16le", ["pcm"])]

# (largest channel count, kbit/s) steps and the rate beyond the last step
RATES = {
    "ac3": ([(2, 192), (6, 640)], 768),
    "aac": ([(2, 128), (6, 384)], 512),
    "dca": ([(2, 256), (6, 768)], 1024),
    "libmp3lame": ([(2, 192)], 320),
    "libopus": ([(1, 128), (2, 256), (6, 510)], 768),
    "libvorbis": ([(2, 192), (6, 448)], 640),
}


def same_text(col: Column, values: list[str]) -> Column:
    return F.lower(col).isin([v.lower() for v in values])


def is_lossless(codec: Column) -> Column:
    return same_text(codec, LOSSLESS)


def is_spatial(codec: Column, name: Column) -> Column:
    return (F.lower(codec) == "dts:x") | ((F.lower(codec) == "truehd") & F.lower(name).contains("atmos"))


def is_convertible(codec: Column, name: Column, target: str) -> Column:
    ok = is_lossless(codec) & ~is_spatial(codec, name)
    return ok & (F.lower(codec) != "flac") if target.lower() == "flac" else ok


def is_spliceable(codec: Column) -> Column:
    low = F.lower(codec)
    bad = same_text(codec, NOT_SPLICEABLE)
    for part in NOT_SPLICEABLE_PARTS:
        bad = bad | low.contains(part)
    return ~bad


def encoder_family(codec: Column) -> Column:
    low, out = F.lower(codec), None
    for family, parts in FAMILIES:
        hit = low.contains(parts[0])
        for p in parts[1:]:
            hit = hit | low.contains(p)
        out = F.when(hit, family) if out is None else out.when(hit, family)
    return out.otherwise("")


def rate_for(channels: Column, family: str) -> Column:
    steps, beyond = RATES[family]
    out = None
    for top, rate in steps:
        out = F.when(channels <= top, rate) if out is None else out.when(channels <= top, rate)
    return out.otherwise(beyond)


def reencode_rate(codec_family: Column, channels: Column) -> Column:
    """kbit/s of the re-encode, 0 for families without a rate."""
    out = None
    for family in RATES:
        cond, val = codec_family == family, rate_for(channels, family)
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out.otherwise(0)


def layout_dotted(ch: Column) -> Column:
    return (F.when(ch == 1, "1.0").when(ch == 2, "2.0").when(ch == 6, "5.1").when(ch == 8, "7.1")
            .when(ch > 0, F.concat(ch.cast("string"), F.lit(".0"))).otherwise(""))


def layout_named(ch: Column) -> Column:
    return F.when(ch <= 1, "mono").when(ch <= 2, "stereo").when(ch <= 6, "5.1").otherwise("7.1")


def layout_standard(ch: Column) -> Column:
    return F.when(ch == 3, "2.1").when(ch == 4, "quad").when(ch == 6, "5.1").when(ch == 8, "7.1").otherwise("")


def alias_table(spark: SparkSession) -> DataFrame:
    """One row per alias: position, exact key, stripped key, patterns."""
    rows = [(i, a, a.replace(" ", "").replace("-", "").replace(":", ""), p) for i, (a, p) in enumerate(ALIASES)]
    return spark.createDataFrame(rows, "pos int, alias string, stripped string, patterns array<string>")


def resolve_aliases(df: DataFrame, user: str) -> DataFrame:
    """Add ``patterns``: exact upper-case alias, else the first alias equal without spaces, hyphens and colons.

    The alias table has 30 rows and is always broadcast.
    """
    aliases = alias_table(df.sparkSession)
    norm = F.upper(F.trim(F.col(user)))
    exact = aliases.select(F.col("alias").alias("_key"), F.col("patterns").alias("_exact"))
    loose = (aliases.groupBy(F.col("stripped").alias("_loose_key"))
             .agg(F.min_by("patterns", "pos").alias("_loose")))
    return (df.withColumn("_key", norm).withColumn("_loose_key", F.regexp_replace(norm, r"[\s\-:]", ""))
            .join(F.broadcast(exact), "_key", "left").join(F.broadcast(loose), "_loose_key", "left")
            .withColumn("patterns", F.coalesce("_exact", "_loose"))
            .drop("_key", "_loose_key", "_exact", "_loose"))


def matches_any(codec: Column, patterns: list[str]) -> Column:
    return same_text(codec, patterns)
