"""Language codes: validity, matching and suggestions.

The common names below are fixed values. The list of valid codes (ISO 639-2) is
a parameter: any one-column table, see ``read_codes``;
without one, the codes of the common names are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from twinline.session import settled

COMMON_NAMES = {
    "italian": "ita", "italiano": "ita", "english": "eng", "inglese": "eng", "japanese": "jpn", "giapponese": "jpn",
    "german": "ger", "tedesco": "ger", "deutsch": "deu", "french": "fra", "francese": "fra", "spanish": "spa",
    "spagnolo": "spa", "portuguese": "por", "portoghese": "por", "russian": "rus", "russo": "rus", "chinese": "chi",
    "cinese": "chi", "korean": "kor", "coreano": "kor", "arabic": "ara", "arabo": "ara", "dutch": "dut",
    "olandese": "dut", "polish": "pol", "polacco": "pol", "turkish": "tur", "turco": "tur", "greek": "gre",
    "greco": "gre", "hebrew": "heb", "ebraico": "heb", "hindi": "hin", "thai": "tha", "tailandese": "tha",
    "vietnamese": "vie", "vietnamita": "vie", "swedish": "swe", "svedese": "swe", "norwegian": "nor",
    "norvegese": "nor", "danish": "dan", "danese": "dan", "finnish": "fin", "finlandese": "fin", "hungarian": "hun",
    "ungherese": "hun", "czech": "cze", "ceco": "cze", "romanian": "ron", "rumeno": "ron", "bulgarian": "bul",
    "bulgaro": "bul", "croatian": "hrv", "croato": "hrv", "serbian": "srp", "serbo": "srp", "ukrainian": "ukr",
    "ucraino": "ukr", "indonesian": "ind", "indonesiano": "ind", "malay": "may", "malese": "may", "latin": "lat",
    "latino": "lat", "undefined": "und", "unknown": "und",
}


def language_matches(language: Column, ietf: Column, wanted: str) -> Column:
    """Same code, or an IETF tag that starts with the wanted text; case is ignored."""
    w = wanted.lower()
    return (F.lower(language) == w) | ((F.length(ietf) > 0) & F.lower(ietf).startswith(w))


def language_in(language: Column, ietf: Column, wanted: list[str]) -> Column:
    out = F.lit(False)
    for w in wanted:
        out = out | language_matches(language, ietf, w)
    return out


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Code list from a text file with one code per line."""
    code = F.lower(F.trim("value"))
    return spark.read.text(path).select(code.alias("code")).filter(F.length("code") == 3).distinct()


def common_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in sorted(set(COMMON_NAMES.values()))], "code string")


def name_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(COMMON_NAMES.items()), "name string, code string")


def with_validity(df: DataFrame, lang: str, codes: DataFrame | None = None) -> DataFrame:
    """Add ``valid``: the trimmed, lower-case code is in the list."""
    known = (common_codes(df.sparkSession) if codes is None else codes).distinct() \
        .select(F.col("code").alias("_code"), F.lit(True).alias("_known"))
    return (df.withColumn("_code", F.lower(F.trim(F.col(lang)))).join(known, "_code", "left")
            .withColumn("valid", F.coalesce("_known", F.lit(False))).drop("_code", "_known"))


def suggestions(words: DataFrame, word: str, k: int, codes: DataFrame | None = None) -> DataFrame:
    """First k distinct codes per distinct word: common name, same two-letter start, containment.

    Every rule is an equi-join against the fixed code list: prefix on the first
    two characters, "word is part of a code" on the pieces of the codes, and
    "code is part of the word" on the three-letter pieces of the word.
    """
    spark = words.sparkSession
    w = settled(words.select(F.lower(F.trim(F.col(word))).alias("word"))
                .filter(F.col("word").isNotNull()).distinct())  # read by each of the four rules
    codes = (common_codes(spark) if codes is None else codes).distinct()
    named = name_table(spark).select(F.col("name").alias("word"), "code")
    t1 = w.join(named, "word").select("word", "code", F.lit(1).alias("tier"))

    starts = codes.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)),
                                                lambda n: F.substring("code", F.lit(1), n))).alias("_key"), "code")
    t2 = (w.withColumn("_key", F.substring("word", 1, 2)).join(starts, "_key")
          .select("word", "code", F.lit(2).alias("tier")))

    spots = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(n).alias("n")) for s in (1, 2, 3) for n in range(0, 5 - s)])
    pieces = codes.select(F.explode(F.transform(spots, lambda p: F.substring("code", p["s"], p["n"]))).alias("word"),
                          "code").distinct()
    t3 = w.join(pieces, "word").select("word", "code", F.lit(3).alias("tier"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("word") - 2, F.lit(1))),
                                         lambda i: F.substring("word", i, F.lit(3))))
    t4 = (w.withColumn("code", F.explode(grams)).join(codes, "code")
          .select("word", "code", F.lit(3).alias("tier")))

    best = (t1.unionByName(t2).unionByName(t3).unionByName(t4)
            .groupBy("word", "code").agg(F.min("tier").alias("tier")))
    rank = F.row_number().over(W.partitionBy("word").orderBy("tier", "code"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)
