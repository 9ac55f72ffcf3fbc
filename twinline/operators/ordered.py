"""Order-sensitive building blocks that never put a whole key into one task.

Every function cuts a key's ordered rows into chunks, works inside
``(key, chunk)`` and passes a one-row-per-chunk summary across chunks. A key
that holds a third of all rows is spread over as many tasks as it has chunks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from twinline.operators import carry
from twinline.session import settled

HOT_ROWS = 2_000_000


def chunk_index(pos: Column, span: int) -> Column:
    return F.floor(pos / F.lit(span))


def with_chunk(df: DataFrame, keys: list[str], pos: str, span: int, fine: int,
               hot_rows: int = HOT_ROWS, name: str = "chunk") -> DataFrame:
    """Add a chunk column; chunks above ``hot_rows`` rows are cut again into ``fine`` ones.

    The limit changes how rows are laid out, never which rows come out.
    """
    coarse = chunk_index(F.col(pos), span)
    hot = (df.groupBy(*keys, coarse.alias("_coarse")).agg(F.count(F.lit(1)).alias("_n"))
           .filter(F.col("_n") > hot_rows)
           .select(*keys, "_coarse", F.lit(True).alias("_hot")))
    return (df.withColumn("_coarse", coarse)
            .join(hot, keys + ["_coarse"], "left")
            .withColumn(name, F.struct(
                F.col("_coarse").alias("c"),
                F.when(F.col("_hot"), chunk_index(F.col(pos), fine)).otherwise(F.lit(-1)).alias("f")))
            .drop("_coarse", "_hot"))


def running_totals(df: DataFrame, keys: list[str], chunk: str, order: list, values: dict[str, Column],
                   exclusive: bool = False) -> DataFrame:
    """Running sums ``{name: value}`` per key in ``order``, inclusive of the row unless ``exclusive``."""
    rows = W.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    before = (df.groupBy(*keys, chunk).agg(*[F.sum(v).alias(f"_s_{n}") for n, v in values.items()])
              .select(*keys, chunk, *[F.coalesce(F.sum(f"_s_{n}").over(ahead), F.lit(0)).alias(f"_b_{n}") for n in values]))
    local = df.withColumns({f"_l_{n}": F.sum(v).over(rows) - (v if exclusive else F.lit(0)) for n, v in values.items()})
    return (local.join(before, keys + [chunk]).withColumns({n: F.col(f"_b_{n}") + F.col(f"_l_{n}") for n in values})
            .drop(*[f"{p}{n}" for n in values for p in ("_l_", "_b_")]))


def running_total(df: DataFrame, keys: list[str], chunk: str, order: list, value: Column, out: str,
                  exclusive: bool = False) -> DataFrame:
    return running_totals(df, keys, chunk, order, {out: value}, exclusive)


def number_rows(df: DataFrame, keys: list[str], order: list, chunk: list[Column], out: str) -> DataFrame:
    """``row_number`` per key, chunk by chunk.

    ``chunk`` lists expressions that grow with ``order``.
    """
    rows = df.withColumn("_chunk", F.struct(*[c.alias(f"c{i}") for i, c in enumerate(chunk)]))
    return running_total(rows, keys, "_chunk", order, F.lit(1), out).drop("_chunk").withColumn(out, F.col(out).cast("int"))


def nearest(targets: DataFrame, points: DataFrame, keys: list[str], target: str, point: str,
            tie: str, span: int, fine: int | None = None) -> DataFrame:
    """Nearest point to every distinct target of the same key.

    Both sides are reduced to distinct integer positions first, so a chunk never
    holds more than twice ``span`` rows; with ``fine``, chunks that get hot
    are cut again. Returns keys, target and ``near`` (null when the key has no
    point). ``tie`` is "earlier" or "later".
    """
    t = targets.select(*keys, F.col(target).cast("long").alias("_pos")).distinct() \
        .select(*keys, "_pos", F.lit(1).alias("_kind"))
    p = points.select(*keys, F.col(point).cast("long").alias("_pos")).distinct() \
        .select(*keys, "_pos", F.lit(0).alias("_kind"))
    both = t.unionByName(p)
    rows = (with_chunk(both, keys, "_pos", span, fine, name="_chunk") if fine
            else both.withColumn("_chunk", chunk_index(F.col("_pos"), span)))
    pt = F.when(F.col("_kind") == 0, F.col("_pos"))
    w = W.partitionBy(*keys, "_chunk").orderBy("_pos", "_kind")
    by_chunk = W.partitionBy(*keys).orderBy("_chunk")
    edges = (rows.groupBy(*keys, "_chunk").agg(F.max(pt).alias("_hi"), F.min(pt).alias("_lo"))
             .select(*keys, "_chunk",
                     F.max("_hi").over(by_chunk.rowsBetween(W.unboundedPreceding, -1)).alias("_prev_edge"),
                     F.min("_lo").over(by_chunk.rowsBetween(1, W.unboundedFollowing)).alias("_next_edge")))
    local = rows.withColumn("_prev", F.last(pt, True).over(w.rowsBetween(W.unboundedPreceding, 0))) \
        .withColumn("_next", F.first(pt, True).over(w.rowsBetween(0, W.unboundedFollowing))) \
        .filter(F.col("_kind") == 1)
    joined = (local.join(edges, keys + ["_chunk"])
              .withColumn("_prev", F.coalesce("_prev", "_prev_edge"))
              .withColumn("_next", F.coalesce("_next", "_next_edge")))
    left, right = F.col("_pos") - F.col("_prev"), F.col("_next") - F.col("_pos")
    keep_left = (left <= right) if tie == "earlier" else (left < right)
    near = F.when(F.col("_next").isNull() | (F.col("_prev").isNotNull() & keep_left), F.col("_prev")) \
        .otherwise(F.col("_next"))
    return joined.select(*keys, F.col("_pos").alias(target), near.alias("near"))


def last_at_or_before(targets: DataFrame, marks: DataFrame, keys: list[str], target: str, mark: str,
                      values: list[str], span: int, fine: int | None = None) -> DataFrame:
    """As-of lookup: the values of the last mark at or before every distinct target."""
    payload = F.struct(F.col(mark).cast("long").alias("_m"), *[F.col(v) for v in values])
    t = targets.select(*keys, F.col(target).cast("long").alias("_pos")).distinct() \
        .select(*keys, "_pos", F.lit(1).alias("_kind"))
    m = (marks.groupBy(*keys, F.col(mark).cast("long").alias("_pos")).agg(F.max(payload).alias("_v"))
         .withColumn("_kind", F.lit(0)))
    both = t.unionByName(m, allowMissingColumns=True)
    rows = (with_chunk(both, keys, "_pos", span, fine, name="_chunk") if fine
            else both.withColumn("_chunk", chunk_index(F.col("_pos"), span)))
    w = W.partitionBy(*keys, "_chunk").orderBy("_pos", "_kind").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    edges = (rows.groupBy(*keys, "_chunk").agg(F.max("_v").alias("_hi"))
             .select(*keys, "_chunk", F.last("_hi", True).over(ahead).alias("_edge")))
    local = rows.withColumn("_v", F.last("_v", True).over(w)).filter(F.col("_kind") == 1)
    return (local.join(edges, keys + ["_chunk"])
            .withColumn("_v", F.coalesce("_v", "_edge"))
            .select(*keys, F.col("_pos").alias(target), *[F.col(f"_v.{v}").alias(v) for v in values]))


def histogram(df: DataFrame, keys: list[str], value: str, weight: Column | None = None,
              extra: list[Column] = ()) -> DataFrame:
    """One row per distinct value and key: the map-side combine every rank operator starts from."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.groupBy(*keys, F.col(value).cast("long").alias(value)).agg(n.alias("n"), *extra)


def pick_ranks(hist: DataFrame, keys: list[str], value: str, low: Column, high: Column,
               span: int) -> DataFrame:
    """Values at two 1-based ranks of every key, from a histogram.

    ``low`` / ``high`` are expressions over ``total``. Only the one or two bins
    that contain the ranks are looked at in detail.
    """
    binned = hist.withColumn("_bin", chunk_index(F.col(value), span))
    bins = binned.groupBy(*keys, "_bin").agg(F.sum("n").alias("_bn"))
    by_bin = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    placed = (bins.withColumn("_start", F.coalesce(F.sum("_bn").over(by_bin), F.lit(0)))
              .withColumn("total", F.sum("_bn").over(W.partitionBy(*keys)))
              .withColumn("_lo", low).withColumn("_hi", high)
              .filter(((F.col("_lo") > F.col("_start")) & (F.col("_lo") <= F.col("_start") + F.col("_bn")))
                      | ((F.col("_hi") > F.col("_start")) & (F.col("_hi") <= F.col("_start") + F.col("_bn"))))
              .drop("_bn"))
    inside = W.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    ranked = (binned.join(placed, keys + ["_bin"])
              .withColumn("_end", F.col("_start") + F.sum("n").over(inside))
              .withColumn("_begin", F.col("_end") - F.col("n")))
    def at(rank):
        return F.max(F.when((F.col(rank) > F.col("_begin")) & (F.col(rank) <= F.col("_end")), F.col(value)))
    return ranked.groupBy(*keys).agg(at("_lo").alias("low_value"), at("_hi").alias("high_value"),
                                     F.max("total").alias("total"))


def upper_median(hist: DataFrame, keys: list[str], value: str, out: str, span: int = 4096) -> DataFrame:
    """Element ``n / 2`` (0-based) of the sorted values."""
    rank = F.floor(F.col("total") / 2) + 1
    return pick_ranks(hist, keys, value, rank, rank, span).select(*keys, F.col("low_value").alias(out), "total")


def true_median(hist: DataFrame, keys: list[str], value: str, out: str, span: int = 4096) -> DataFrame:
    """Mean of the middle two values (or the middle one)."""
    low = F.floor((F.col("total") + 1) / 2)
    high = F.floor(F.col("total") / 2) + 1
    return pick_ranks(hist, keys, value, low, high, span).select(
        *keys, ((F.col("low_value") + F.col("high_value")) / 2.0).alias(out), "total")


def value_window(hist: DataFrame, keys: list[str], value: str, below: int, above: int,
                 aggs: dict[str, Column], span: int) -> DataFrame:
    """Aggregate the histogram rows within ``[v - below, v + above]`` of every value v.

    Rows near a chunk edge are copied into the neighbouring chunk, so windows
    stay inside ``(key, chunk)``. Needs ``span >= max(below, above)``.
    """
    assert span >= max(below, above)
    v, c = F.col(value), chunk_index(F.col(value), span)
    homes = F.filter(F.array(
        c,
        F.when(v >= (c + 1) * span - below, c + 1),
        F.when(v < c * span + above, c - 1)), lambda x: x.isNotNull())
    spread = hist.withColumn("_home", c).withColumn("_chunk", F.explode(homes))
    w = W.partitionBy(*keys, "_chunk").orderBy(value).rangeBetween(-below, above)
    for name, agg in aggs.items():
        spread = spread.withColumn(name, agg.over(w))
    return spread.filter(F.col("_home") == F.col("_chunk")).drop("_home", "_chunk")


def with_next(df: DataFrame, keys: list[str], pos: str, payload: list[str], span: int) -> DataFrame:
    """Attach the payload of the next row (``pos + 1``) of a densely numbered series.

    The first row of each chunk is copied to the chunk before it, so the
    payload is shuffled once and no window spans a whole key.
    """
    c = chunk_index(F.col(pos), span)
    homes = F.when(F.col(pos) % span == 0, F.array(c, c - 1)).otherwise(F.array(c))
    w = W.partitionBy(*keys, "_chunk").orderBy(pos)
    out = df.withColumn("_home", c).withColumn("_chunk", F.explode(homes))
    for name in payload:
        out = out.withColumn(f"next_{name}", F.lead(name).over(w))
    return out.filter(F.col("_home") == F.col("_chunk")).drop("_home", "_chunk")


#: Pauses: an array "entry pause -> exit pause"; a missing chunk lasts longer than any pause.
PAUSES = carry.Algebra(np.asarray, lambda f, g: g[f], lambda f, s: int(f[s]), np.zeros_like, lambda s: 0)


def pick_spaced(events: DataFrame, keys: list[str], pos: str, spacing: int | str, span: int = 16384, fan: int = carry.FAN, whole: int = 4096) -> DataFrame:
    """Greedy pick: take an event when it is at least ``spacing`` after the last taken one.

    ``spacing`` is a number below ``span``, or the name of a key that holds such numbers.

    A chunk can be entered in only ``spacing`` ways (how long the pause from
    the chunk before still lasts), so each chunk of a long series is first
    reduced to a table "entry pause -> exit pause". Composing the tables in a tree
    (``carry``) gives the true entry pause of every chunk, after which all chunks
    pick in parallel. Series of one chunk, or of up to ``whole`` different positions in
    any number of chunks, skip that step: their positions are one bounded list.
    """
    assert isinstance(spacing, str) or spacing < span
    spacing = F.col(spacing).cast("int") if isinstance(spacing, str) else F.lit(spacing)
    chunks = (events.select(*keys, chunk_index(F.col(pos), span).alias("_chunk"), F.col(pos).alias("_p"))
              .groupBy(*keys, "_chunk")
              .agg(F.sort_array(F.collect_set((F.col("_p") - F.col("_chunk") * span).cast("int"))).alias("_rel")))
    extent = chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_chunks"), F.sum(F.size("_rel")).alias("_n"))
    few = (F.col("_chunks") == 1) | (F.col("_n") <= whole)
    single = extent.filter(few).select(*keys)
    several = extent.filter(~few).select(*keys)

    def leave(arr, entry):
        return F.greatest(F.lit(0), F.aggregate(
            arr, entry, lambda a, x: F.when(x >= a, x + spacing).otherwise(a)) - F.lit(span))

    tables = settled(chunks.join(several, keys, "left_semi")
                     .select(*keys, "_chunk", F.transform(F.sequence(F.lit(0), spacing - 1), lambda e: leave(F.col("_rel"), e)).alias("fn"),
                             F.lit(carry.dump(0)).alias("start")))
    entries = carry.entry_states(tables, keys, "_chunk", PAUSES, "int", int, fan).withColumnRenamed("state", "_entry")
    entered = chunks.join(entries, keys + ["_chunk"])

    def picked(positions, entry, kind):
        start = F.struct(entry.alias("ok"), F.array().cast(f"array<{kind}>").alias("got"))
        return F.aggregate(positions, start, lambda a, x: F.when(x >= a["ok"], F.struct(
            (x + spacing).cast(kind).alias("ok"), F.concat(a["got"], F.array(x)).alias("got"))).otherwise(a))["got"]

    # a short series is one list of positions, whatever time it spans
    lists = (chunks.join(single, keys, "left_semi").select(*keys, F.struct("_chunk", F.transform("_rel", lambda x: F.col("_chunk") * span + x).alias("_at")).alias("_c"))
             .groupBy(*keys).agg(F.flatten(F.transform(F.sort_array(F.collect_list("_c")), lambda c: c["_at"])).alias("_all")))
    short = lists.select(*keys, F.explode(picked(F.col("_all"), F.get("_all", F.lit(0)), "bigint")).alias(pos))
    long = entered.select(*keys, "_chunk", F.explode(picked(F.col("_rel"), F.col("_entry"), "int")).alias("_x")).select(
        *keys, (F.col("_chunk") * span + F.col("_x")).alias(pos))
    return short.unionByName(long)


def with_neighbour(df: DataFrame, keys: list[str], pos: str, cols: list[str], span: int, prefix: str,
                   following: bool = False) -> DataFrame:
    """Columns of the previous (or following) row per key; ``pos`` is unique per key."""
    rows = df.withColumn("_chunk", chunk_index(F.col(pos), span))
    payload = F.struct(*cols)
    by_pos, by_chunk = W.partitionBy(*keys, "_chunk").orderBy(pos), W.partitionBy(*keys).orderBy("_chunk")
    edge = F.min_by(payload, pos) if following else F.max_by(payload, pos)
    edges = rows.groupBy(*keys, "_chunk").agg(edge.alias("_e"))
    edges = edges.select(*keys, "_chunk", (F.lead("_e") if following else F.lag("_e")).over(by_chunk).alias("_edge"))
    local = (F.lead(payload) if following else F.lag(payload)).over(by_pos)
    out = rows.withColumn("_n", local).join(edges, keys + ["_chunk"]).withColumn("_n", F.coalesce("_n", "_edge"))
    for c in cols:
        out = out.withColumn(f"{prefix}{c}", F.col(f"_n.{c}"))
    return out.drop("_chunk", "_n", "_edge")


def run_groups(df: DataFrame, keys: list[str], chunk: str, order: list, low: Column, pos: str) -> DataFrame:
    """Maximal runs of consecutive low rows: one row per run with length and first position."""
    flagged = df.withColumn("_low", low)
    broken = running_total(flagged, keys, chunk, order, F.when(F.col("_low"), 0).otherwise(1), "_run")
    return (broken.filter("_low").groupBy(*keys, "_run")
            .agg(F.count(F.lit(1)).alias("run_length"), F.min(pos).alias("run_start")))
