"""Documented examples of ids, names, lookups and suggestions."""

import re

import pytest
from pyspark.sql import functions as F

from twinline.functions import codecs, languages, pixels, text
from twinline.params import DEFAULTS, FrameSettings, PiecewiseSettings
from twinline.sources import textlogs


@pytest.mark.parametrize("name, pattern, want", [
    ("Serie.S01E05.mkv", r"S(\d+)E(\d+)", "01_05"),
    ("Serie.s01e05.mkv", r"S(\d+)E(\d+)", "01_05"),
    ("Serie.S01.E05.mkv", r"S(\d+)\.E(\d+)", "01_05"),
    ("Serie.1x05.mkv", r"(\d+)x(\d+)", "1_05"),
    ("Anime - 05.mkv", r"- (\d+)", "05"),
    ("Anime - 005.mkv", r"- (\d{3})", "005"),
    ("Show.2024.01.15.mkv", r"(\d{4})\.(\d{2})\.(\d{2})", "2024_01_15"),
    ("Show.mkv", r"S(\d+)E(\d+)", ""),
    ("Show.S2.mkv", r"S\d", "S2"),
    ("Serie.S01E05.mkv", r"S(?<s>\d+)E(?<e>\d+)", "01_05"),
    ("Serie.S01E05.mkv", r"(?:S|s)(\d+)|x", "01"),
])
def test_episode_ids(spark, name, pattern, want):
    assert spark.range(1).select(text.episode_id(F.lit(name), pattern)).first()[0] == want


def test_bad_pattern_is_rejected_early():
    import re
    with pytest.raises(re.error):
        text.episode_id(None, "S(")


def test_track_names(spark):
    row = spark.range(1).select(
        text.track_name(F.lit("DTS"), F.lit(6), F.lit(24), F.lit(48000)),
        text.converted_name(F.lit(6), F.lit(24), F.lit(48000), "flac"),
        text.converted_name(F.lit(6), F.lit(24), F.lit(48000), "opus"),
        text.track_name(F.lit("AC-3"), F.lit(0), F.lit(0), F.lit(0)),
        text.track_text(F.lit(3), F.lit(""), F.lit("DTS"), F.lit(2))).first()
    assert list(row) == ["DTS 5.1 24bit/48kHz", "FLAC 5.1 24bit/48kHz", "Opus 5.1 48kHz 510kbps", "AC-3", "3: und DTS 2.0"]


def test_codec_aliases(spark):
    want = {"ac3": "AC-3", "dd+": "E-AC-3", "dts": "DTS", "dts-hdma": "DTS-HD Master Audio", "dts hd ma": "DTS-HD Master Audio",
            "DTSHD": "DTS-HD Master Audio|DTS-HD High Resolution", "atmos": "TrueHD|E-AC-3", "mp3": "MPEG Audio|MP3", "nope": None}
    df = spark.createDataFrame([(k,) for k in want], "c string")
    got = {r["c"]: r["p"] for r in codecs.resolve_aliases(df, "c").select("c", F.array_join("patterns", "|").alias("p")).collect()}
    assert got == want


def test_exact_codec_match(spark):
    row = spark.range(1).select(codecs.matches_any(F.lit("dts"), ["DTS"]), codecs.matches_any(F.lit("DTS-HD Master Audio"), ["DTS"]),
                                codecs.encoder_family(F.lit("E-AC-3")), codecs.is_spatial(F.lit("TrueHD"), F.lit("Dolby ATMOS"))).first()
    assert list(row) == [True, False, "ac3", True]


def test_language_suggestion(spark):
    words = spark.createDataFrame([("Italian ",), ("zz",), ("ital",)], "w string")
    rows = languages.suggestions(words, "w", 3).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        by.setdefault(r["word"], []).append(r["code"])
    assert by["italian"][0] == "ita"
    assert by["ital"][0] == "ita"
    assert "zz" not in by


def test_code_list_is_a_parameter(spark, tmp_path):
    (tmp_path / "codes.txt").write_text("aaa\nITA\n\nxx\n")
    codes = languages.read_codes(spark, str(tmp_path / "codes.txt"))
    got = languages.with_validity(spark.createDataFrame([("ita",), (" AAA",), ("eng",)], "l string"), "l", codes)
    assert {r["l"]: r["valid"] for r in got.collect()} == {"ita": True, " AAA": True, "eng": False}


def test_language_prefix_is_literal(spark):
    row = spark.range(1).select(languages.language_matches(F.lit(""), F.lit("it-IT"), "ita"), languages.language_matches(F.lit(""), F.lit("it-IT"), "it"),
                                languages.language_matches(F.lit("ITA"), F.lit(""), "ita")).first()
    assert list(row) == [False, True, True]


def test_sizes_delays_and_ratios(spark):
    row = spark.range(1).select(text.size_text(F.lit(1073741824 * 3 // 2)), text.size_text(F.lit(2048)), text.size_text(F.lit(5)), text.delay_text(F.lit(-3)),
                                text.delay_text(F.lit(0)), text.stretch_ratio(F.lit("25/24")), text.stretch_ratio(F.lit("25/x")), text.stretch_ratio(F.lit("25"))).first()
    assert list(row)[:5] == ["1.5 GB", "2 KB", "5 B", "-3ms", "0ms"]
    assert row[5] == pytest.approx(25 / 24) and row[6] is None and row[7] is None


def test_settings_are_clamped():
    s = FrameSettings(frame_width=10, ssim_threshold=3.0).clamped()
    assert (s.frame_width, s.ssim_threshold) == (64, 1.0)
    assert PiecewiseSettings(probe_deltas_ms=()).clamped().probe_deltas_ms == DEFAULTS.piecewise.probe_deltas_ms
    assert DEFAULTS.clamped() == DEFAULTS


def test_binary_and_array_frames_agree(spark):
    df = spark.createDataFrame([([0, 255, 7, 9], [1, 250, 7, 0])], "a array<int>, b array<int>")
    row = df.select(pixels.sums(F.col("a"), F.col("b")).alias("s"), pixels.binary_sums(pixels.to_binary(F.col("a")), pixels.to_binary(F.col("b"))).alias("t"),
                    pixels.squared_error(F.col("a"), F.col("b")).alias("e")).first()
    assert row["s"] == row["t"] and row["e"] == 1 + 25 + 0 + 81


@pytest.mark.parametrize("pattern", ["S(", r"S(?P<s>\d+)", "[a-", "*"])
def test_bad_id_pattern(spark, pattern):
    """A pattern that the engine cannot run is refused before any job, named groups of another dialect too."""
    with pytest.raises(re.error, match="bad id pattern"):
        text.episode_id(F.col("x"), pattern)


def test_probe_documents_are_parsed_once(spark):
    """Files, tracks and rejects of a table of documents come from one pass over it; broken and null documents are rejects."""
    whole = '{"container": {"properties": {"duration": 7, "title": "t"}}, "tracks": [{"id": 0, "type": "audio"}, {"id": 1, "properties": {"language": "eng"}}]}'
    made = [(1, whole, "x"), (1, whole, "x"), (2, whole[:60], "x"), (3, None, "x"), (None, '{"tracks": []}', "x"), (4, "{}", "x")]
    files, tracks, rejects = textlogs.probe_documents(spark.createDataFrame(made, "k int, body string, other string"), "body", ["k"])
    for out in (files, tracks, rejects):
        assert "from_json" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, files.collect())) == sorted(["Row(k=1, container_duration_ns=7, title='t')"] * 2 + [f"Row(k={k}, container_duration_ns=0, title='')" for k in (4, None)])
    assert sorted((r.k, r.track_id, r.type, r.language) for r in tracks.collect()) == [(1, 0, "audio", "")] * 2 + [(1, 1, "", "eng")] * 2
    assert sorted(tuple(r) for r in rejects.collect()) == [(2, whole[:60]), (3, None)]
