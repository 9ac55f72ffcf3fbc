"""Which method decides the offset of a pair: speed, then piecewise, then constant offset."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def analyse(records: DataFrame, speed: bool, piecewise: bool, constant: bool, audio_ms: int, subtitle_ms: int) -> DataFrame:
    """Combine the method results of every record.

    Needs: status, mismatch, src_fps, lang_fps, has_durations, speed_sync_ms,
    piecewise_sync_ms, constant_sync_ms (null = failed), manual_audio_ms and
    manual_sub_ms. Only pending or failed records are analysed again. Piecewise
    and constant offset exclude each other.
    """
    assert not (piecewise and constant)
    todo = F.col("status").isin("Pending", "Error")
    spd, pcs, con = F.col("speed_sync_ms"), F.col("piecewise_sync_ms"), F.col("constant_sync_ms")
    mismatch = F.col("mismatch") if speed else F.lit(False)
    # a frame rate difference that was put down to soft telecine leaves the rates filled in
    suspected = (F.col("src_fps") > 0) & (F.col("lang_fps") > 0) & ~F.col("mismatch") if speed else F.lit(False)
    by_constant = F.when(con.isNotNull(), "constant") \
        .when(suspected & F.col("has_durations") & spd.isNotNull(), "speed_fallback") \
        .when(suspected & F.col("has_durations"), "failed_both").otherwise("failed_constant")
    if constant:
        rest = by_constant
    elif piecewise:
        rest = F.when(pcs.isNotNull(), "piecewise").otherwise("none")
    else:
        rest = F.lit("none")
    method = F.when(~todo, F.lit(None)).when(mismatch & spd.isNotNull(), "speed").when(mismatch, "failed_speed").otherwise(rest)
    out = records.withColumn("method", method)
    m = F.col("method")
    failed = m.startswith("failed")
    sync = F.when(m.isin("speed", "speed_fallback"), spd).when(m == "piecewise", pcs).when(m == "constant", con).otherwise(0)
    return (out.withColumn("new_status", F.when(m.isNull(), F.col("status")).when(failed, "Error").otherwise("Analyzed"))
            .withColumn("error", F.when(m == "failed_speed", "Speed correction failed").when(m == "failed_both", "Frame sync and speed correction failed")
                        .when(m == "failed_constant", "Frame sync failed").otherwise(""))
            .withColumn("sync_offset_ms", F.when(m.isNotNull() & ~failed, sync).cast("bigint"))
            .withColumn("audio_delay_ms", F.col("sync_offset_ms") + audio_ms + F.col("manual_audio_ms"))
            .withColumn("subtitle_delay_ms", F.col("sync_offset_ms") + subtitle_ms + F.col("manual_sub_ms")))
