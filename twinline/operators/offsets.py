"""Constant offsets between two cut timelines: candidates, clusters, votes, medians, consensus."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from twinline.operators import ordered
from twinline.params import PiecewiseSettings
from twinline.session import settled, spread

#: Pairs that are formed at a time, and the longest timeline that is transformed at once.
BLOCK, LONGEST = 2_000_000, 1 << 23


def correlate(sp: np.ndarray, sn: np.ndarray, lp: np.ndarray, ln: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences ``lp - sp`` that occur, and the sum of ``ln * sn`` over the pairs of each, exactly.

    Few positions are paired one by one. Many become two timelines whose cross-correlation
    is a product of Fourier transforms; the work then follows the length of the block, not
    the number of pairs. Weights are cut into digits small enough that rounding the transform is exact.
    """
    none = np.zeros(0, np.int64)
    if not len(sp) or not len(lp):
        return none, none
    width = int(max(np.ptp(sp), np.ptp(lp))) + 1
    size = 1 << (2 * width - 1).bit_length()
    if len(sp) * len(lp) <= 4 * size * size.bit_length() or size > LONGEST:
        total: pd.Series | None = None
        step = max(1, BLOCK // len(lp))
        for i in range(0, len(sp), step):
            diff = np.subtract.outer(lp, sp[i:i + step]).ravel()
            part = pd.Series(np.multiply.outer(ln, sn[i:i + step]).ravel()).groupby(diff).sum()
            total = part if total is None else total.add(part, fill_value=0)
        return total.index.to_numpy(np.int64), total.to_numpy().astype(np.int64)
    # a coefficient's error is some 1e-15 of the product of both norms; it must stay well below a half
    most = max(int(sn.max()), int(ln.max()))
    bits = 1
    while bits < most.bit_length() and float(1 << (2 * bits + 2)) * np.sqrt(float(len(sp)) * len(lp)) < 1e13:
        bits += 1

    def transforms(at: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        out = []
        for digit in range(0, most.bit_length(), bits):
            line = np.zeros(size)
            np.add.at(line, at, ((n >> digit) & ((1 << bits) - 1)).astype(float))
            out.append(np.fft.rfft(line))
        return out

    s, l = transforms(sp - sp.min(), sn), transforms(lp - lp.min(), ln)
    total = np.zeros(size, np.int64)
    for i, a in enumerate(s):
        for j, b in enumerate(l):
            total += np.rint(np.fft.irfft(a.conj() * b, size)).astype(np.int64) << (bits * (i + j))
    at = np.flatnonzero(total)
    return np.where(at < width, at, at - size) + (lp.min() - sp.min()), total[at]


def candidates(src: DataFrame, lang: DataFrame, key: str, pos: str, inverse_ratio: Column | float = 1.0,
               block: int = 1 << 25, fine: int = 1 << 20, crowded: int = 1 << 16) -> DataFrame:
    """How often each offset (lang - src, less the drift) occurs per pair.

    Both sides must already be cut to the search windows: a pair then has at
    most as many different positions as the windows have ticks, whatever its
    row count. The cross-correlation of the two sides is summed
    into a histogram (``correlate``); the single differences are never rows. Blocks of ``block`` ticks of
    either side meet in groups of their own, so a pair is spread over many tasks; of keys
    that have more than ``crowded`` positions in a block, blocks of ``fine`` ticks.
    ``inverse_ratio`` may be a column of ``src``.
    """
    if isinstance(inverse_ratio, Column) or inverse_ratio != 1.0:
        src = src.withColumn(pos, F.bround(F.col(pos) * inverse_ratio, 0).cast("long"))
    hists = [settled(ordered.histogram(df, [key], pos)) for df in (src, lang)]
    filled = hists[0].unionByName(hists[1]).groupBy(key, F.floor(F.col(pos) / block)).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > crowded)
    hot = filled.select(key, F.lit(fine).alias("_w")).distinct()

    def blocks(hist, side, name):
        return hist.join(hot, key, "left").withColumn("side", F.lit(side)).withColumn(name, F.floor(F.col(pos) / F.coalesce("_w", F.lit(block)))).drop("_w")

    s, l = blocks(hists[0], 0, "_s"), blocks(hists[1], 1, "_l")
    both = s.join(l.select(key, "_l").distinct(), key).unionByName(l.join(s.select(key, "_s").distinct(), key))

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        s, l = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        offset, n = correlate(*(x.to_numpy(np.int64) for x in (s[pos], s["n"], l[pos], l["n"])))
        return pd.DataFrame({key: pdf[key].iloc[0], "offset": offset, "n": n})

    kind, group = src.schema[key].dataType.simpleString(), [key, "_s", "_l"]
    parts = spread(both, group).groupBy(*group).applyInPandas(sums, f"{key} {kind}, offset long, n long")
    return parts.groupBy(key, "offset").agg(F.sum("n").alias("n"))


#: A window of any width is this long after scaling.
UNIT = 1_000_000_000


def _windows(hist: DataFrame, keys: list[str], value: str, width: Column | int, both_sides: bool, aggs: dict[str, Column], span: int = 1 << 16) -> DataFrame:
    """``value_window`` whose width may differ from key to key.

    Values are scaled so that every width becomes ``UNIT``. Scaling errs by less than
    two units, the next value beyond a window lies ``UNIT / width`` further, so windows
    stay exact for widths up to 10^8.
    """
    if isinstance(width, int):
        return ordered.value_window(hist, keys, value, width, width if both_sides else 0, aggs, max(span, width))
    scaled = hist.withColumn("_width", width.cast("long")).withColumn("_x", F.expr(f"(cast({value} as decimal(38,0)) * {UNIT}) div _width"))
    return ordered.value_window(scaled, keys, "_x", UNIT + 2, UNIT + 2 if both_sides else 0, aggs, 16 * UNIT).drop("_x", "_width")


def densest_cluster(hist: DataFrame, keys: list[str], width: Column | int, span: int = 1 << 16) -> DataFrame:
    """Fullest value window of each key (first on ties) and its middle element ``n / 2``; ``width`` may be a column that follows from the key."""
    seen = _windows(hist, keys, "offset", width, False, {"votes": F.sum("n")}, span)
    best = seen.groupBy(*keys).agg(F.max_by(F.struct("offset", "votes"), F.struct("votes", -F.col("offset"))).alias("_b")) \
        .select(*keys, F.col("_b.offset").alias("_top"), F.col("_b.votes").alias("votes"))
    members = hist.join(best, keys).filter((F.col("offset") <= F.col("_top")) & (F.col("offset") >= F.col("_top") - width))
    # a cluster has at most width + 1 different values
    w = W.partitionBy(*keys).orderBy("offset").rowsBetween(W.unboundedPreceding, 0)
    return (members.withColumn("_cum", F.sum("n").over(w)).filter(F.col("_cum") > F.floor(F.col("votes") / 2))
            .groupBy(*keys).agg(F.min("offset").alias("offset"), F.max("votes").alias("votes")))


#: Tolerances that one block of edges spans, at least.
EDGE_BLOCK = 64


def grid_votes(src: DataFrame, lang: DataFrame, settings: PiecewiseSettings, inverse_ratio: float = 1.0) -> DataFrame:
    """Votes of the first source cuts for every offset of a fixed grid.

    A vote needs any language cut within tolerance. Language cuts are reduced
    to the first and last cut per tolerance-wide bucket, which is all the test
    needs: an expected time hits from one tolerance before the first to one after the last.
    A source cut meets the buckets that some offset of the grid can reach, in blocks as wide
    as the grid, and only the offsets that hit become rows; the grid itself is never spelled out.
    """
    tol = settings.match_tolerance_ms
    one = W.partitionBy("pair_id")
    first = (src.select("pair_id", "t_ms").withColumn("_r", F.row_number().over(one.orderBy("t_ms"))).filter(F.col("_r") <= settings.initial_cuts)
             .withColumn("tested", F.count(F.lit(1)).over(one)))
    steps = int(settings.initial_range_sec * 2 / settings.initial_step_sec)
    step_ms, low_ms = round(settings.initial_step_sec * 1000), -settings.initial_range_sec * 1000
    inverse = inverse_ratio if abs(inverse_ratio - 1.0) > 0.0001 else 1.0

    def expected(offset):
        x = F.col("t_ms") - offset
        return x if inverse == 1.0 else F.bround(x * inverse, 0).cast("long")

    # a source cut reaches two or three blocks
    wide = max(EDGE_BLOCK, -(-int(steps * step_ms * inverse) // tol) + 2)
    block = lambda x: F.floor(x / (tol * wide))
    probes = first.withColumn("_block", F.explode(F.sequence(block(expected(F.lit(low_ms + steps * step_ms)) - tol), block(expected(F.lit(low_ms)) + tol))))
    b = F.floor(F.col("t_ms") / tol)
    edges = (lang.groupBy("pair_id", b.alias("_b")).agg(F.min("t_ms").alias("_lo"), F.max("t_ms").alias("_hi"))
             .select("pair_id", F.floor(F.col("_b") / wide).alias("_block"), "_lo", "_hi"))
    # offsets that may hit, one more on either side; the test itself is on whole milliseconds
    def step_of(x):
        return (F.col("t_ms") - x / inverse - low_ms) / step_ms
    s0 = F.greatest(F.floor(step_of(F.col("_hi") + tol + 1)), F.lit(0))
    s1 = F.least(F.ceil(step_of(F.col("_lo") - tol - 1)), F.lit(steps))
    near = F.when(s0 <= s1, F.sequence(s0, s1))
    offset = F.col("_s") * step_ms + low_ms
    x = expected(offset)
    hits = (probes.join(edges, ["pair_id", "_block"]).withColumn("_s", F.explode(near))
            .filter((x >= F.col("_lo") - tol) & (x <= F.col("_hi") + tol))
            .select("pair_id", offset.cast("int").alias("offset_ms"), "_r", "tested").distinct())
    return hits.groupBy("pair_id", "offset_ms").agg(F.count(F.lit(1)).alias("votes"), F.max("tested").alias("tested"))


def initial_offset(votes: DataFrame, min_share: float = 0.3) -> DataFrame:
    """Most voted offset (first on ties), unless too few of the tested cuts agree."""
    best = F.max_by(F.struct("offset_ms", "votes", "tested"), F.struct("votes", -F.col("offset_ms")))
    return (votes.groupBy("pair_id").agg(best.alias("_b")).select("pair_id", "_b.*")
            .filter(F.col("votes") >= F.col("tested") * min_share))


def consistency(delays: DataFrame, keys: list[str], value: str, tolerance: Column | int, need: int) -> DataFrame:
    """Upper median per key and how many delays lie within tolerance of it."""
    hist = ordered.histogram(delays, keys, value)
    med = ordered.upper_median(hist, keys, value, "median")
    near = F.abs(F.col(value) - F.col("median")) <= tolerance
    out = hist.join(med, keys).groupBy(*keys).agg(
        F.any_value("median").alias("median"), F.any_value("total").alias("total"),
        F.sum(F.when(near, F.col("n")).otherwise(0)).alias("consistent"))
    return out.filter((F.col("total") >= need) & (F.col("consistent") >= need))


def consensus(points: DataFrame, keys: list[str], value: str, order: Column, tolerance: Column | int, need: int) -> DataFrame:
    """Largest group of values near one of them; first such value on ties.

    Members are near the centre, not near each other. The result is the mean of
    the group, cut toward zero.
    """
    hist = ordered.histogram(points, keys, value, extra=[F.min(order).alias("_first")])
    near = _windows(hist, keys, value, tolerance, True, {"members": F.sum("n"), "_sum": F.sum(F.col("n") * F.col(value))})
    best = F.min_by(F.struct("members", "_sum"), F.struct(-F.col("members"), F.col("_first")))
    return (near.groupBy(*keys).agg(best.alias("_b"), F.sum("n").alias("total"))
            .select(*keys, F.col("_b.members").alias("members"), "total",
                    F.expr("_b._sum div _b.members").alias("offset"))
            .filter(F.col("members") >= need))
