"""Ids, lists and report texts as Column expressions."""

from __future__ import annotations

import re
from functools import cache

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession, functions as F

from twinline.functions import codecs

DEFAULT_ID_PATTERN = r"S(\d+)E(\d+)"


@cache
def group_count(pattern: str) -> int:
    """Capture groups of a pattern, named ones too, as the engine that will run it counts them; a bad pattern raises ``re.error``.

    Each question is a query over a literal that the planner folds, so nothing runs on executors.
    """
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()

    def asked(group: int) -> bool:
        try:
            spark.range(1).select(F.regexp_extract(F.lit(""), f"(?:{pattern})|", group)).first()
            return True
        except PySparkException as e:
            if "REGEX_GROUP_INDEX" in str(e):
                return False
            raise re.error(f"bad id pattern: {str(e).splitlines()[0]}", pattern) from None

    asked(0)
    groups = 0
    while asked(groups + 1):
        groups += 1
    return groups


def episode_id(name: Column, pattern: str = DEFAULT_ID_PATTERN) -> Column:
    """Capture groups joined by ``_``; whole match without groups; '' without a match.

    The pattern is user input; a bad one is rejected here, by the engine that runs it.
    """
    groups = group_count(pattern)
    ci = f"(?i){pattern}"
    if groups == 0:
        return F.regexp_extract(name, ci, 0)
    parts = [F.regexp_extract(name, ci, g) for g in range(1, groups + 1)]
    return F.when(name.rlike(ci), F.concat_ws("_", *parts)).otherwise("")


def csv_list(text: Column, strip_dot: bool = False) -> Column:
    items = F.transform(F.split(text, ","), lambda x: F.trim(x))
    if strip_dot:
        items = F.transform(items, lambda x: F.ltrim(x, F.lit(".")))
    return F.filter(items, lambda x: x != "")


def plain_number(x: Column) -> Column:
    """Shortest decimal text: no trailing zeros, no trailing point."""
    return F.regexp_replace(x.cast("decimal(20,2)").cast("string"), r"\.?0+$", "")


def size_text(n: Column) -> Column:
    def part(unit, digits, name):
        return F.concat(plain_number(F.bround(n / F.lit(float(unit)), digits)), F.lit(f" {name}"))
    return (F.when(n >= 1073741824, part(1073741824, 2, "GB")).when(n >= 1048576, part(1048576, 1, "MB"))
            .when(n >= 1024, part(1024, 1, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" B"))))


def delay_text(ms: Column) -> Column:
    return (F.when(ms > 0, F.concat(F.lit("+"), ms.cast("string"), F.lit("ms")))
            .when(ms < 0, F.concat(ms.cast("string"), F.lit("ms"))).otherwise("0ms"))


def delay_text_full(total: Column, sync: Column, manual: Column) -> Column:
    note = F.concat(F.lit(" (sync:"), sync.cast("string"), F.lit(" man:"), manual.cast("string"), F.lit(")"))
    return F.concat(delay_text(total), F.when(manual != 0, note).otherwise(""))


def list_text(items: Column) -> Column:
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.array_join(items, ",")).otherwise("-")


def quality_text(bits: Column, rate: Column) -> Column:
    khz = F.floor(rate / 1000)
    bit, k = F.concat(bits.cast("string"), F.lit("bit")), F.concat(khz.cast("string"), F.lit("kHz"))
    return (F.when((bits > 0) & (khz > 0), F.concat(bit, F.lit("/"), k)).when(bits > 0, bit)
            .when(khz > 0, k))


def _or_null(x: Column) -> Column:
    return F.when(x != "", x)


def track_name(codec: Column, channels: Column, bits: Column, rate: Column) -> Column:
    name = F.concat_ws(" ", codec, _or_null(codecs.layout_dotted(channels)), quality_text(bits, rate))
    return F.when(codec == "", "").otherwise(name)


def converted_name(channels: Column, bits: Column, rate: Column, target: str) -> Column:
    layout = _or_null(codecs.layout_dotted(channels))
    if target == "flac":
        return F.concat_ws(" ", F.lit("FLAC"), layout, quality_text(bits, rate))
    khz = F.floor(rate / 1000)
    return F.concat_ws(" ", F.lit("Opus"), layout, F.when(khz > 0, F.concat(khz.cast("string"), F.lit("kHz"))),
                       F.concat(codecs.rate_for(channels, "libopus").cast("string"), F.lit("kbps")))


def track_text(track_id: Column, language: Column, codec: Column, channels: Column) -> Column:
    lang = F.when(language == "", "und").otherwise(language)
    return F.concat_ws(" ", F.concat(track_id.cast("string"), F.lit(":")), lang, codec,
                       _or_null(codecs.layout_dotted(channels)))


def with_conversion(text: Column, codec: Column, name: Column, target: str) -> Column:
    mark = F.when(codecs.is_convertible(codec, name, target), f" -> {target.upper()}").otherwise("")
    return F.concat(text, mark)


def stretch_ratio(text: Column) -> Column:
    """``num/den`` as a number; null when it is not two numbers with a positive denominator."""
    parts = F.split(text, "/")
    num, den = F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")
    ratio = F.when((F.size(parts) == 2) & (den > 0), num / den)
    return F.when(ratio > 0, ratio)


def frame_interval_ms(fps: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(F.lit(1000.0) / fps, 0).cast("int"))


def output_path(path: Column, root: str, dest: str, overwrite: bool) -> Column:
    if overwrite:
        return path
    return F.concat(F.lit(dest.rstrip("/") + "/"), F.ltrim(F.substring(path, F.lit(len(root) + 1), F.length(path)), F.lit("/\\")))
