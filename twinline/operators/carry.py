"""State carried through the ordered chunks of a key, by composing chunk functions in a tree.

A chunk of an ordered series is a function from the state that enters it to the state
that leaves it. Functions of neighbouring chunks are composed, ``fan`` at a time, into
functions of larger stretches until few are left in a key. States then go down the tree
again, each level in parallel. No task ever sees more than ``fan`` functions of a key,
and the number of jobs is the height of the tree, whatever the states do.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from twinline.session import settled, spread

FAN = 1024


def _same(x):
    return x


@dataclass(frozen=True)
class Algebra:
    """How functions of a kind are read from a row's ``fn``, and states from its ``start``; how functions are composed and applied.

    ``then(f, g)`` is the function of f's stretch followed by g's. Where chunk numbers are
    missing between two chunks, ``gap`` changes the function, and ``gap_state`` the state, of what stands before.
    """

    read: Callable
    then: Callable
    apply: Callable
    gap: Callable = _same
    gap_state: Callable = _same
    enter: Callable = pickle.loads


def dump(x) -> bytes:
    return pickle.dumps(x, protocol=5)


load = pickle.loads


def _composed(keys: list[str], read: Callable, algebra: Algebra) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        whole, last = None, None
        for first, end, fn in zip(pdf["_first"], pdf["_last"], pdf["_fn"]):
            f = read(fn)
            if whole is None:
                whole = f
            else:
                whole = algebra.then(whole if first == last + 1 else algebra.gap(whole), f)
            last = end
        head = pdf.iloc[0]
        return pd.DataFrame([[*[head[k] for k in keys], head["_up"], head["_first"], last, dump(whole), head["_start"]]], columns=[*keys, "_n", "_first", "_last", "_fn", "_start"])

    return run


def _entered(keys: list[str], read: Callable, enter: Callable, algebra: Algebra, show: Callable) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        state, last, states = enter(pdf["_start"].iloc[0]), None, []
        for first, end, fn in zip(pdf["_first"], pdf["_last"], pdf["_fn"]):
            if last is not None and first != last + 1:
                state = algebra.gap_state(state)
            states.append(show(state))
            state, last = algebra.apply(read(fn), state), end
        return pdf[[*keys, "_n", "_first"]].assign(_state=states)

    return run


def entry_states(functions: DataFrame, keys: list[str], at: str, algebra: Algebra, kind: str = "binary", show: Callable = dump, fan: int = FAN) -> DataFrame:
    """``functions(keys, at, fn, start)`` -> ``(keys, at, state)``: the state that enters every chunk, as ``show`` gives it in the type ``kind``.

    ``at`` numbers a key's chunks upwards, with gaps or without; ``start`` is the state that
    enters the first chunk, as ``algebra.enter`` takes it, the same in all rows of a key. ``fn`` is
    what ``algebra.read`` takes. Keys that are null are keys like any other.
    """
    lo, hi = functions.agg(F.min(at), F.max(at)).first()
    named = [functions.schema[k] for k in keys]
    rows = functions.select(*keys, (F.col(at) - F.lit(lo)).cast("long").alias("_n"), F.col(at).cast("long").alias("_first"), F.col(at).cast("long").alias("_last"),
                            F.col("fn").alias("_fn"), F.col("start").alias("_start"))
    levels, read, top = [rows], algebra.read, 0 if lo is None else hi - lo
    up = T.StructType([*named, *[T.StructField(c, T.LongType()) for c in ("_n", "_first", "_last")], T.StructField("_fn", T.BinaryType()), T.StructField("_start", functions.schema["start"].dataType)])
    at_fields = [T.StructField("_n", T.LongType()), T.StructField("_first", T.LongType())]
    while top >= fan:
        grouped = spread(levels[-1].withColumn("_up", F.floor(F.col("_n") / fan)), [*keys, "_up"]).groupBy(*keys, "_up")
        levels.append(settled(grouped.applyInPandas(_composed(keys, read, algebra), up)))
        read, top = load, top // fan
    states = None
    for level in reversed(range(len(levels))):
        read, enter, rows = (algebra.read if level == 0 else load), (algebra.enter if states is None else load), levels[level]
        if states is not None:  # every group starts from the state that enters it
            above = states.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_n").alias("_up"), F.col("_state").alias("_start"))
            rows = rows.drop("_start").withColumn("_up", F.floor(F.col("_n") / fan))
            same = [rows[k].eqNullSafe(above[f"_k{i}"]) for i, k in enumerate(keys)]
            on = rows["_up"] == above["_up"]
            for s in same:
                on = on & s
            rows = rows.join(above, on).select(*[rows[c] for c in rows.columns], above["_start"])
            group = [*keys, "_up"]
        else:
            group = list(keys)
        told = T.StructField("_state", T.BinaryType() if level else T._parse_datatype_string(kind))
        states = spread(rows, group).groupBy(*group).applyInPandas(_entered(keys, read, enter, algebra, dump if level else show), T.StructType([*named, *at_fields, told]))
        states = settled(states) if level else states
    return states.select(*keys, F.col("_first").alias(at), F.col("_state").alias("state"))
