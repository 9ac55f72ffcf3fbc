"""One plan over many settings: a frame of parameters whose columns are keys like any other.

A stage is repeated only for the settings that change it. Settings that agree in the
values a stage reads share its rows (``distinct_on``), and its result is joined back to all of
them (``back``). So a grid of 4 spacings and 100 later limits picks 4 times, not 400.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F

from twinline.operators import ordered, series

#: Most settings of a sweep: the frame is written into the plan.
MOST = 100_000


def grid(**values: list) -> list[dict]:
    """Every combination of the given values."""
    return [dict(zip(values, c)) for c in itertools.product(*values.values())]


class Sweep:
    """A numbered list of settings, each a value for the same names."""

    def __init__(self, settings: list[dict]):
        if not settings or len(settings) > MOST:
            raise ValueError(f"a sweep takes 1 to {MOST} settings")
        self.names = list(settings[0])
        if any(list(s) != self.names for s in settings):
            raise ValueError("every setting names the same parameters")
        self.settings = settings

    def distinct_on(self, names: list[str]) -> list[tuple]:
        return list(dict.fromkeys(tuple(s[n] for n in names) for s in self.settings))

    def over(self, rows: DataFrame, names: list[str]) -> DataFrame:
        """``rows`` once for every distinct combination of the parameters ``names``, as columns; no join."""
        clash = set(names) & set(rows.columns)
        if clash:
            raise ValueError(f"columns in the way of parameters: {sorted(clash)}")
        choices = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, c)]) for c in self.distinct_on(names)]
        return rows.select("*", F.explode(F.array(*choices)).alias("_p")).select(*rows.columns, "_p.*")

    def back(self, results: DataFrame, names: list[str], keep: Column | None = None) -> DataFrame:
        """``results`` by ``names`` for every setting that has these values, with its number and all its parameters; then ``keep`` applies."""
        rest = [n for n in self.names if n not in names]
        by: dict[tuple, list] = {}
        for i, s in enumerate(self.settings):
            by.setdefault(tuple(s[n] for n in names), []).append((i, *[s[n] for n in rest]))
        fields = ["setting", *rest]
        pairs = [F.struct(F.struct(*[F.lit(v).alias(n) for n, v in zip(names, c)]).alias("k"),
                          F.array(*[F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, m)]) for m in members]).alias("m")) for c, members in by.items()]
        mine = F.filter(F.array(*pairs), lambda x: x["k"] == F.struct(*[F.col(n) for n in names]))[0]["m"]
        out = results.select("*", F.explode(mine).alias("_m")).select(*results.columns, "_m.*")
        return out if keep is None else out.filter(keep)


def sweep_picks(events: DataFrame, keys: list[str], pos: str, score: str, settings: list[dict]) -> DataFrame:
    """Spaced picks of events above ``floor`` at ``spacing``, for every setting: how many, the first and the last by key.

    A key without a pick has no row of that setting. ``limit``, if settings name it,
    keeps the keys of at least so many picks, after one pick for all limits.
    """
    sweep = Sweep(settings)
    tried = sweep.over(events, ["floor", "spacing"]).filter(F.col(score) > F.col("floor"))
    by = ["floor", "spacing", *keys]
    picks = ordered.pick_spaced(tried.select(*by, pos), by, pos, "spacing")
    counts = picks.groupBy(*by).agg(F.count(F.lit(1)).alias("picks"), F.min(pos).alias("first"), F.max(pos).alias("last"))
    return sweep.back(counts, ["floor", "spacing"], F.col("picks") >= F.col("limit") if "limit" in sweep.names else None)


def sweep_dips(events: DataFrame, keys: list[str], pos: str, tie: str, score: str, settings: list[dict]) -> DataFrame:
    """Runs below ``threshold`` of at least ``min_dip`` samples, for every setting: how many, the longest and the first by key.

    Runs are found once for each threshold, whatever lengths are asked of them.
    """
    sweep = Sweep(settings)
    by = ["threshold", *keys]
    runs = series.low_runs(sweep.over(events, ["threshold"]), by, pos, tie, score, F.col("threshold"))
    lengths = runs.groupBy(*by, "run_length").agg(F.count(F.lit(1)).alias("n"), F.min("run_start").alias("start"))
    each = sweep.back(lengths, ["threshold"], F.col("run_length") >= F.col("min_dip"))
    return each.groupBy("setting", *sweep.names, *keys).agg(F.sum("n").alias("dips"), F.max("run_length").alias("longest"), F.min("start").alias("first_dip"))
