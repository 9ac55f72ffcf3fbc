"""Text quality by a regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinline.llm.common import as_bytes, id_crc, map_batches, settled

FEATURES = ["chars", "words", "word_length", "upper", "digits", "symbols", "marks", "spaces", "other", "distinct", "commonest",
            "repeated_lines", "line_length", "odd_ends", "entropy"]
SCHEMA = "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)

#: Byte classes: upper case, digits, sentence marks, other ASCII symbols, white space, beyond ASCII.
_CLASS = np.zeros(256, np.int64)
_CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 6
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 3
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and _CLASS[c] == 0]] = 4
_CLASS[[9, 10, 11, 12, 13, 32]] = 5
_END = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:'\")?") | frozenset(range(128, 256))


def statistics(text: bytes | None) -> list[float]:
    """Transformed statistics of a whole text; those of an empty text are finite too."""
    text = text or b""
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n, kinds = len(text), np.bincount(_CLASS, hist, 7)
    share = lambda a, b: float(np.log((a + 0.5) / (b - a + 0.5)))
    words = text.split()
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = text.split(b"\n")
    p = hist[hist > 0] / max(n, 1)
    odd = sum(c for w, c in counts.items() if w[-1] not in _END)
    return [float(np.log1p(n)), float(np.log1p(len(words))), float(np.log1p(n / max(len(words), 1))),
            *(share(kinds[k], n) for k in (1, 2, 4, 3, 5, 6)), share(len(counts), len(words)), share(max(counts.values(), default=0), len(words)),
            share(len(lines) - len(set(lines)), len(lines)), float(np.log1p(n / len(lines))), share(odd, len(words)), float(-(p * np.log(p)).sum())]


def features(docs: DataFrame) -> DataFrame:
    """``(doc_id, ...FEATURES)`` of each row of ``docs(doc_id, text, ...)``."""
    def rows(batch: pa.RecordBatch) -> dict:
        x = np.array([statistics(t) for t in as_bytes(batch["text"])]).reshape(-1, len(FEATURES))
        return {"doc_id": batch["doc_id"], **{f: x[:, i] for i, f in enumerate(FEATURES)}}

    return map_batches(docs.select("doc_id", "text"), rows, SCHEMA)


@dataclass
class Discriminant:
    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]  # inverse of the Cholesky factor of each class covariance
    logs: list[float]          # log prior minus half the log determinant

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        dens = []
        for m, f, c in zip(self.means, self.factors, self.logs):
            d = (z - m) @ f.T
            dens.append(c - 0.5 * (d * d).sum(1))
        return dens[1] - dens[0]


def fit(rows: DataFrame, shrink: float = 0.1, ridge: float = 0.05) -> Discriminant | None:
    """Discriminant of ``rows(quality, ...FEATURES)`` from sums over all rows; None unless both classes occur.

    Each class covariance is drawn by ``shrink`` towards the pooled one, and both by
    ``ridge`` towards the unit matrix (of standardised statistics). Only the two rows
    of sums reach the driver.
    """
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = rows.groupBy("quality").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(f) for f in FEATURES]).alias("s"),
        F.array(*[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i, j in pairs]).alias("q")).collect()
    by = {r.quality: r for r in sums}
    if set(by) != {0, 1}:
        return None
    n = np.array([by[k].n for k in (0, 1)], float)
    means = np.array([by[k].s for k in (0, 1)]) / n[:, None]
    second = np.zeros((2, d, d))
    for k in (0, 1):
        for (i, j), v in zip(pairs, by[k].q):
            second[k, i, j] = second[k, j, i] = v / n[k]
    centre = (n[:, None] * means).sum(0) / n.sum()
    scale = np.sqrt(np.maximum(((n[:, None, None] * second).sum(0) / n.sum()).diagonal() - centre**2, 1e-6))
    cov = [(second[k] - np.outer(means[k], means[k])) / np.outer(scale, scale) for k in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    out = Discriminant(centre, scale, [], [], [])
    for k in (0, 1):
        c = (1 - ridge) * ((1 - shrink) * cov[k] + shrink * pooled) + ridge * np.eye(d)
        low = np.linalg.cholesky(c)
        out.means.append((means[k] - centre) / scale)
        out.factors.append(np.linalg.inv(low))
        out.logs.append(float(np.log(n[k] / n.sum()) - np.log(low.diagonal()).sum()))
    return out


def quality(docs: DataFrame, labels: DataFrame, shrink: float = 0.1) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs(doc_id, text, ...)``.

    Learns from labelled rows whose crc32 of the id modulo 3 is not 1. A null text is
    scored as an empty one; a row with a null id is scored, never learned from and not
    held out. Labels other than 0 and 1 are ignored; an id labelled twice counts twice.
    Without both classes every score is 0.5. Extra columns are ignored; an empty table
    gives an empty result.
    """
    stats = settled(features(docs))
    marks = labels.where(F.col("quality").isin(0, 1)).select("doc_id", "quality")
    model = fit(stats.where(id_crc("doc_id") % 3 != 1).join(marks, "doc_id"), shrink)

    @F.arrow_udf("double")
    def score(*cols: pa.Array) -> pa.Array:
        odds = model.log_odds(np.column_stack([c.to_numpy(zero_copy_only=False) for c in cols]))
        return pa.array(1 / (1 + np.exp(-np.clip(odds, -700, 700))))

    rows = stats.select("doc_id", F.coalesce(id_crc("doc_id") % 3 == 1, F.lit(False)).alias("held_out"),
                        (score(*FEATURES) if model else F.lit(0.5)).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
