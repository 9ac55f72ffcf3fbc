"""Score series: dips, confirmed runs, checkpoints and their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from twinline.operators import ordered

DAY_US, SECOND_US = 86_400_000_000, 1_000_000


def low_runs(series: DataFrame, keys: list[str], pos: str, tie: str, score: str, threshold: float | Column,
             span: int = DAY_US, fine: int = SECOND_US) -> DataFrame:
    """All runs of consecutive samples below the threshold, a number or a column that follows from the keys."""
    chunked = ordered.with_chunk(series, keys, pos, span, fine)
    return ordered.run_groups(chunked, keys, "chunk", [pos, tie], F.col(score) < threshold, pos)


def dip_runs(runs: DataFrame, min_length: int) -> DataFrame:
    return runs.filter(F.col("run_length") >= min_length)


def first_dip(series: DataFrame, runs: DataFrame, keys: list[str], pos: str, tie: str, score: str, min_length: int) -> DataFrame:
    """Start of the first long enough run, else the first smallest sample."""
    first = dip_runs(runs, min_length).groupBy(*keys).agg(F.min("run_start").alias("_dip"))
    lowest = series.groupBy(*keys).agg(F.min_by(pos, F.struct(score, pos, tie)).alias("_lowest"))
    return (lowest.join(first, keys, "left")
            .select(*keys, F.coalesce("_dip", "_lowest").alias("position"), F.col("_dip").isNotNull().alias("is_dip")))


def confirmed_run(estimates: DataFrame, runs: DataFrame, keys: list[str], estimate: str, min_length: int) -> DataFrame:
    """First run of the confirming length, else the estimate."""
    first = dip_runs(runs, min_length).groupBy(*keys).agg(F.min("run_start").alias("_run"))
    return (estimates.join(first, keys, "left")
            .select(*keys, F.coalesce("_run", estimate).alias("position"), F.col("_run").isNotNull().alias("confirmed")))


def checkpoints(durations: DataFrame, keys: list[str], duration: str, points: int = 9) -> DataFrame:
    """Positions at 10 %, 20 %, ... of the duration, by integer division."""
    return durations.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select(
        *keys, "point", F.expr(f"({duration} * (point + 1) * 10) div 100").alias("point_ms"))


def even_points(durations: DataFrame, keys: list[str], duration: str, points: int = 30) -> DataFrame:
    """Evenly spaced positions strictly inside the duration."""
    return durations.withColumn("point", F.explode(F.sequence(F.lit(1), F.lit(points)))).select(
        *keys, "point", (F.col(duration) / F.lit(float(points + 1)) * F.col("point")).alias("point_ms"))


def checkpoint_scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Best score per checkpoint: similarity where there is one, else correlation."""
    best = rows.groupBy(*keys).agg(F.max(F.when(F.col("method") == "ssim", F.col("score"))).alias("_s"),
                                   F.max(F.when(F.col("method") == "corr", F.col("score"))).alias("_c"))
    return best.select(*keys, F.when(F.col("_s").isNotNull(), "ssim").otherwise("corr").alias("method"),
                       F.coalesce("_s", "_c").alias("score"))


def validity(points: DataFrame, keys: list[str], need: int) -> DataFrame:
    return points.groupBy(*keys).agg(F.count_if("valid").alias("valid_points"), F.count(F.lit(1)).alias("points")) \
        .withColumn("verified", F.col("valid_points") >= need)


def with_retry(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Replace failed points by their second result, only where some but not all failed.

    A valid first result always stays. ``second`` may hold rows for points that need none.
    """
    state = first.groupBy(*keys).agg(F.count_if(~F.col("valid")).alias("_failed"), F.count(F.lit(1)).alias("_all"))
    again = first.join(state, keys).withColumn("retried", ~F.col("valid") & (F.col("_failed") > 0) & (F.col("_failed") < F.col("_all")))
    other = second.select(*keys, "point", *[F.col(c).alias(f"_2_{c}") for c in ("offset", "score", "method", "valid")])
    out = again.join(other, keys + ["point"], "left")
    pick = lambda c: F.when(F.col("retried"), F.col(f"_2_{c}")).otherwise(F.col(c)).alias(c)
    return out.select(*keys, "point", pick("offset"), pick("score"), pick("method"),
                      F.coalesce(F.when(F.col("retried"), F.col("_2_valid")).otherwise(F.col("valid")), F.lit(False)).alias("valid"), "retried")


def detail_summary(points: DataFrame, keys: list[str]) -> DataFrame:
    """Text of all checkpoints of a pair (at most one per checkpoint number)."""
    pct = F.concat(((F.col("point") + 1) * 10).cast("string"), F.lit("%="))
    score = F.when(F.col("method") == "corr", F.format_string("ms(corr:%.2f)", "score")).otherwise(F.format_string("ms(SSIM:%.3f)", "score"))
    item = F.when(F.col("valid"), F.concat(pct, F.col("offset").cast("string"), score)).otherwise(F.concat(pct, F.lit("FAIL")))
    items = F.sort_array(F.collect_list(F.struct("point", item.alias("t"))))
    return points.groupBy(*keys).agg(F.array_join(F.transform(items, lambda x: x["t"]), ", ").alias("summary"))


def expected_offset(delay: Column, ts: Column, inverse_ratio: Column | float) -> Column:
    """Delay plus the drift at ``ts``, rounded half to even."""
    return delay + F.bround(ts * (inverse_ratio - 1.0), 0).cast("bigint")


def drift_normalised(raw: Column, cut: Column, centre: Column, inverse_ratio: Column | float) -> Column:
    return raw - (cut - centre) * (inverse_ratio - 1.0)
