"""Frame comparison from exact integer sums.

Frames go through Arrow batches, as arrays of integers or as BINARY. Both give
the same integer sums, so the scores agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

C1, C2 = 6.5025, 58.5225  # fixed values: (0.01 * 255)^2 and (0.03 * 255)^2


SUMS = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "a", "b", "aa", "bb", "ab")])



def _pair_sums(a, b) -> list:
    """Sums of two arrays, as SQL has them: null where an array or an element is null, or a partner is missing."""
    x, y = (None if v is None or any(e is None or e != e for e in v) else np.asarray(v, dtype=np.int64) for v in (a, b))
    both = x is not None and y is not None and len(x) == len(y)
    return [None if a is None else len(a), *[None if v is None else int(v.sum()) for v in (x, y)],
            *[None if v is None else int(v @ v) for v in (x, y)], int(x @ y) if both else None]


@F.pandas_udf(SUMS)
def sums(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Struct of n, sum a, sum b, sum aa, sum bb, sum ab as long, of two columns of integer arrays."""
    plain = all(isinstance(v, np.ndarray) and v.dtype.kind == "i" for s in (a, b) for v in s)
    if plain and len({len(v) for s in (a, b) for v in s}) == 1:
        x, y = (np.stack(s.to_list()).astype(np.int64) for s in (a, b))
        cols = [np.full(len(x), x.shape[1]), x.sum(1), y.sum(1), (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)]
        return pd.DataFrame(dict(zip(SUMS.names, cols)))
    return pd.DataFrame([_pair_sums(p, q) for p, q in zip(a, b)], columns=SUMS.names, dtype=object)


@F.pandas_udf(SUMS)
def binary_sums(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    out = np.empty((len(a), 6), dtype=np.int64)
    for i, (p, q) in enumerate(zip(a, b)):
        x, y = np.frombuffer(p, np.uint8).astype(np.int64), np.frombuffer(q, np.uint8).astype(np.int64)
        out[i] = len(x), x.sum(), y.sum(), x @ x, y @ y, x @ y
    return pd.DataFrame(out, columns=SUMS.names)


def squared_error(a: Column, b: Column) -> Column:
    return squared_error_of(sums(a, b))


def squared_error_of(s: Column) -> Column:
    return s["aa"] + s["bb"] - 2 * s["ab"]


def mse_of(s: Column) -> Column:
    return squared_error_of(s) / s["n"]


def ssim_of(s: Column) -> Column:
    """Structural similarity with the whole frame as one window.

    Variances come from integers (n * sum - sum * sum), so nothing cancels.
    """
    n = s["n"].cast("double")
    ma, mb = s["a"] / n, s["b"] / n
    va = (s["n"] * s["aa"] - s["a"] * s["a"]) / (n * n)
    vb = (s["n"] * s["bb"] - s["b"] * s["b"]) / (n * n)
    cov = (s["n"] * s["ab"] - s["a"] * s["b"]) / (n * n)
    return ((2 * ma * mb + C1) * (2 * cov + C2)) / ((ma * ma + mb * mb + C1) * (va + vb + C2))


def to_binary(px: Column) -> Column:
    return F.unhex(F.array_join(F.transform(px, lambda x: F.lpad(F.hex(x), 2, "0")), ""))


def crop_43(px: Column, width: int, height: int) -> Column:
    """Centred 4:3 cut of a row-major frame."""
    cw = height * 4 // 3
    x0 = (width - cw) // 2
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(height - 1)),
                                 lambda r: F.slice(px, r * width + x0 + 1, F.lit(cw))))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two equally long arrays, 0 when one is flat.

    Frame steps are whole numbers over a fixed size, so the sums are exact.
    """
    n = F.size(a)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)
    mul = lambda x, y: add(F.zip_with(x, y, lambda p, q: p * q))
    num = n * mul(a, b) - add(a) * add(b)
    den = F.sqrt((n * mul(a, a) - add(a) * add(a)) * (n * mul(b, b) - add(b) * add(b)))
    return F.when(den > 0, num / den).otherwise(0.0)
