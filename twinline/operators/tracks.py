"""Selecting, describing and planning tracks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from twinline.functions import codecs, languages, text
from twinline.operators import ordered

TEXT_PART = 1024  # tracks per text row, by position


def of_type(tracks: DataFrame, kind: str) -> DataFrame:
    return tracks.filter(F.lower("type") == kind.lower())


def by_ids(tracks: DataFrame, ids: DataFrame) -> DataFrame:
    return tracks.join(ids.select("file_id", "track_id"), ["file_id", "track_id"], "left_semi")


def passthrough(tracks: DataFrame, *processed: DataFrame) -> DataFrame:
    """Tracks that are in none of the processed sets."""
    done = reduce(DataFrame.unionByName, [p.select("file_id", "track_id") for p in processed])
    return tracks.join(done, ["file_id", "track_id"], "left_anti")


def kept(tracks: DataFrame, kind: str, langs: list[str], patterns: list[str] | None) -> DataFrame:
    """Source tracks to keep; an empty language list or no codec list means no constraint."""
    out = of_type(tracks, kind)
    if langs:
        out = out.filter(languages.language_in(F.col("language"), F.col("language_ietf"), langs))
    if patterns is not None:
        out = out.filter(codecs.matches_any(F.col("codec"), patterns))
    return out


def imported(tracks: DataFrame, targets: list[str], patterns: list[str] | None, audio: bool = True,
             subtitles: bool = True) -> DataFrame:
    """Tracks to import per target language; one that fits two targets comes twice.

    All targets are tested in the same scan: a track is exploded into the
    positions it matches, no row is generated for a target it does not match.
    """
    kind = F.lower("type")
    wanted = F.lit(False)
    if audio:
        fits = kind == "audio"
        wanted = wanted | (fits & codecs.matches_any(F.col("codec"), patterns) if patterns is not None else fits)
    if subtitles:
        wanted = wanted | (kind == "subtitles")
    hits = F.array_compact(F.array(*[
        F.when(languages.language_matches(F.col("language"), F.col("language_ietf"), t), F.lit(i))
        for i, t in enumerate(targets)]))
    return tracks.filter(wanted).withColumn("target_pos", F.explode(hits))


def with_conversion_flags(tracks: DataFrame) -> DataFrame:
    codec, name = F.col("codec"), F.col("name")
    return (tracks.withColumn("lossless", codecs.is_lossless(codec)).withColumn("spatial", codecs.is_spatial(codec, name))
            .withColumn("to_flac", codecs.is_convertible(codec, name, "flac"))
            .withColumn("to_opus", codecs.is_convertible(codec, name, "opus")))


def _lang(language: Column) -> Column:
    return F.when(language == "", "und").otherwise(language)


def distinct_in_order(rows: DataFrame, keys: list[str], value: str, order: Column, out: str) -> DataFrame:
    """Distinct values per key by first appearance.

    Values are first reduced to one row each with their first position, so the
    final list is as long as the number of different values, not of rows.
    """
    first = rows.groupBy(*keys, value).agg(F.min(order).alias("_o"))
    items = F.sort_array(F.collect_list(F.struct("_o", F.col(value).alias("_v"))))
    return first.groupBy(*keys).agg(F.transform(items, lambda x: x["_v"]).alias(out))


def file_languages(tracks: DataFrame) -> DataFrame:
    """Ordered distinct audio and subtitle languages per file, 'und' for unset."""
    rows = tracks.select("file_id", "track_id", F.lower("type").alias("kind"), _lang(F.col("language")).alias("lang")) \
        .filter(F.col("kind").isin("audio", "subtitles"))
    lists = distinct_in_order(rows, ["file_id", "kind"], "lang", F.col("track_id"), "langs")
    def of(kind):
        return F.coalesce(F.any_value(F.when(F.col("kind") == kind, F.col("langs")), True), F.array().cast("array<string>"))
    return lists.groupBy("file_id").agg(of("audio").alias("audio_langs"), of("subtitles").alias("sub_langs"))


def video_duration(tracks: DataFrame) -> DataFrame:
    """First positive video frame duration of each file, else 0."""
    good = (F.lower("type") == "video") & (F.col("default_duration_ns") > 0)
    return tracks.groupBy("file_id").agg(F.coalesce(
        F.min_by("default_duration_ns", F.when(good, F.col("track_id"))), F.lit(0)).alias("video_duration_ns"),
        (F.count(F.lit(1)) * F.lit(60000000000)).alias("container_duration_ns"))


def text_lists(rows: DataFrame, keys: list[str], order: list[str], items: dict[str, Column]) -> DataFrame:
    """Joined texts of every key, in rows of ``TEXT_PART`` tracks by their position in ``order``.

    ``part`` counts the rows of a key, so the texts of its parts follow each other in
    order; a key with up to ``TEXT_PART`` tracks has one row, whatever their ids. The
    last column of ``order`` is a number that grows with it.
    """
    chunk = [*[F.col(c) for c in order[:-1]], ordered.chunk_index(F.col(order[-1]), 4096)]
    placed = ordered.number_rows(rows, keys, order, chunk, "_at").withColumn("part", F.floor((F.col("_at") - 1) / TEXT_PART))
    for name, item in items.items():
        placed = placed.withColumn(name, item)

    def joined(c):
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", c))), lambda x: x[c]), " | ").alias(c)
    return placed.groupBy(*keys, "part").agg(*[joined(c) for c in items])


def track_texts(tracks: DataFrame, convert: str) -> DataFrame:
    compact = text.track_text(F.col("track_id"), F.col("language"), F.col("codec"), F.col("channels"))
    return text_lists(tracks, ["file_id"], ["track_id"], {
        "tracks": compact, "tracks_converted": text.with_conversion(compact, F.col("codec"), F.col("name"), convert)})


def plan(kept_audio: DataFrame, kept_subs: DataFrame, imports: DataFrame, convert: str, delay_audio: Column,
         delay_sub: Column, stretch: Column, has_edits: Column, rename_all: bool = True) -> DataFrame:
    """One row per selected track with its action.

    Converted and spliced tracks leave the pass-through set; a splice already
    contains the stretch, so it is cleared for all imports of a spliced pair.
    Converted tracks are always named anew, other audio tracks only with ``rename_all``.
    """
    codec, name = F.col("codec"), F.col("name")
    audio = F.lower("type") == "audio"
    to_convert = audio & codecs.is_convertible(codec, name, convert) if convert else F.lit(False)
    spliced_codec = F.when(to_convert, F.lit(convert)).otherwise(codec) if convert else codec
    tag = F.when(F.col("language_ietf") != "", F.col("language_ietf")).otherwise(F.col("language"))
    spec = F.col("channels"), F.col("bits_per_sample"), F.col("sampling_frequency")
    track_name = (F.when(audio & to_convert, text.converted_name(*spec, convert))
                  .when(audio & F.lit(rename_all), text.track_name(codec, *spec)).otherwise("").alias("track_name"))
    can_splice = has_edits & (~audio | codecs.is_spliceable(spliced_codec))
    src = kept_audio.unionByName(kept_subs).select(
        "src_file", "file_id", "track_id", "type", F.lit(0).alias("target_pos"), F.lit("source").alias("side"),
        F.when(to_convert, "convert").otherwise("keep").alias("action"), F.lit(0).cast("bigint").alias("delay_ms"),
        F.lit("").alias("stretch"), F.when(to_convert, tag).otherwise(F.col("language")).alias("language"),
        track_name)
    lang = imports.select(
        "src_file", "file_id", "track_id", "type", "target_pos", F.lit("language").alias("side"),
        F.when(can_splice, "splice").when(to_convert, "convert").otherwise("import").alias("action"),
        F.when(audio, delay_audio).otherwise(delay_sub).cast("bigint").alias("delay_ms"),
        F.when(has_edits, "").otherwise(stretch).alias("stretch"),
        F.when(audio & (to_convert | can_splice), tag).otherwise(F.col("language")).alias("language"),
        track_name)
    return src.unionByName(lang)


def with_unselected(plan_rows: DataFrame, pairs: DataFrame, tracks: DataFrame) -> DataFrame:
    """``plan`` and a row for every other track of its pairs' files: source video is kept as it is, all else is dropped.

    The language file brings no video. One pass over the tracks finds both sides, and one anti
    join takes out what the plan has already.
    """
    files = F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("src_file").alias("file_id")),
                              F.struct(F.lit("language").alias("side"), F.col("lang_file").alias("file_id")))).alias("f")
    rows = pairs.select("src_file", files).select("src_file", "f.*").join(tracks, "file_id")
    rest = rows.join(plan_rows.select("src_file", "side", "track_id").distinct(), ["src_file", "side", "track_id"], "left_anti")
    action = F.when((F.col("side") == "source") & (F.lower("type") == "video"), "keep").otherwise("drop")
    return plan_rows.unionByName(rest.select(
        "src_file", "file_id", "track_id", "type", F.lit(0).alias("target_pos"), "side", action.alias("action"), F.lit(0).cast("bigint").alias("delay_ms"),
        F.lit("").alias("stretch"), "language", F.lit("").alias("track_name")))
