"""Centroid clustering over dictionaries of subvectors.

Vectors of small integers are cut into blocks of a few dimensions. A segment of vectors
keeps, for each block, its distinct subvectors and a code for each vector: a lossless
dictionary encoding, written once. In a round the squared distances of every distinct
subvector to all centroids are computed once in its segment, and a vector's distances
are sums of table entries by its codes. The sums for new centroids start from counts of
(centroid, code), so no vector is put together again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinline.llm.common import settled

#: Vectors that share dictionaries, dimensions of a block, and the least component, by magnitude, whose squared distances leave a long.
SEGMENT, WIDTH, LARGEST = 1 << 14, 2, 1 << 27
_ENCODED = "ids array<long>, codes binary, sizes array<long>, entries binary"


def sound(column: str, size: int | None = None):
    """Whether a vector has neither null nor non-finite components, and ``size`` of them."""
    vec = F.col(column).cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(column).isNotNull() & fine & (F.lit(True) if size is None else F.size(column) == size)


def distinct_rows(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a matrix of integers, and each row's number among them."""
    code = np.zeros(len(block), np.int64)
    for column in block.T:
        value, mine = np.unique(column, return_inverse=True)
        _, first, code = np.unique(code * len(value) + mine, return_index=True, return_inverse=True)
    return block[first], code


def encode(ids: list, x: np.ndarray, width: int) -> pa.RecordBatch:
    """One segment: ids, the codes of each block, and the dictionaries one after the other."""
    tables, codes = zip(*[distinct_rows(x[:, at : at + width]) for at in range(0, x.shape[1], width)])
    return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([np.stack(codes).astype("<u2").tobytes()]), pa.array([[len(t) for t in tables]], pa.list_(pa.int64())),
                                       pa.array([b"".join(t.astype("<i4").tobytes() for t in tables)])], names=["ids", "codes", "sizes", "entries"])


def encoded(vectors: DataFrame, dim: int, scale: int, width: int = WIDTH, segment: int = SEGMENT) -> DataFrame:
    """``vectors(vec_id, vec)`` of ``dim`` sound components -> dictionary-encoded segments of floor(scale * component)."""
    assert segment <= 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], []
        for batch in batches:
            x = np.floor(scale * batch["vec"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            if (np.abs(x) >= LARGEST).any():
                raise ValueError(f"a component of {LARGEST / scale:.0f} or more: squared distances would leave a long")
            ids += batch["vec_id"].to_pylist()
            held.append(x.astype(np.int64))
            while len(ids) >= segment:
                x = np.concatenate(held)
                yield encode(ids[:segment], x[:segment], width)
                ids, held = ids[segment:], [x[segment:]]
        if ids:
            yield encode(ids, np.concatenate(held), width)

    return vectors.mapInArrow(run, _ENCODED)


class Segment:
    """A segment read back."""

    def __init__(self, batch: pa.RecordBatch, row: int, width: int):
        self.ids = batch["ids"][row].values
        sizes = batch["sizes"][row].as_py()
        flat = np.frombuffer(batch["entries"][row].as_py(), "<i4").astype(np.int64)
        self.codes = np.frombuffer(batch["codes"][row].as_py(), "<u2").reshape(len(sizes), -1)
        left = len(flat) - sum(sizes[:-1]) * width
        widths = [width] * (len(sizes) - 1) + [left // sizes[-1]]  # the last block may be narrower
        ends = np.cumsum([0] + [n * w for n, w in zip(sizes, widths)])
        self.tables = [flat[x:y].reshape(-1, w) for x, y, w in zip(ends[:-1], ends[1:], widths)]

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid (the smaller number of equals) and squared distance of each vector."""
        total, at = np.zeros((self.codes.shape[1], len(centroids)), np.int64), 0
        for table, codes in zip(self.tables, self.codes):
            part = table[:, None, :] - centroids[None, :, at : at + table.shape[1]]
            total += (part * part).sum(2)[codes]  # each distinct subvector's distances, then by code
            at += table.shape[1]
        best = total.argmin(1)
        return best, total[np.arange(len(total)), best]

    def sums(self, best: np.ndarray, k: int) -> np.ndarray:
        """The sum of the vectors of each cluster, from counts of (cluster, code)."""
        return np.concatenate([np.bincount(best * len(t) + c, minlength=k * len(t)).reshape(k, -1) @ t for t, c in zip(self.tables, self.codes)], 1)


def moved(segments: DataFrame, centroids: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Centroids after one round: the floor of the mean of the vectors next to each; those without vectors stay."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                part = Segment(batch, row, width)
                best, _ = part.assign(centroids)
                count += np.bincount(best, minlength=k)
                total += part.sums(best, k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(count), pa.array(list(total), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = segments.mapInArrow(run, "cluster long, n long, sums array<long>").where("n > 0")
    sums = (parts.select("cluster", "n", F.posexplode("sums").alias("at", "value")).groupBy("cluster", "at")
            .agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect())  # k x dim rows
    out = centroids.copy()
    for r in sums:
        out[r.cluster, r.at] = int(r.value) // int(r.n)
    return out


def cluster(vectors: DataFrame, dim: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, width: int = WIDTH, segment: int = SEGMENT) -> DataFrame:
    """``vectors(vec_id, embedding, ...)`` -> ``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)``, one row per kept vector.

    Kept are vectors of exactly ``dim`` components, none null or non-finite; each
    component x counts as floor(``scale`` * x). Centroids start as the ``k`` vectors of
    the smallest SHA-256 of ``1:<vec_id>`` (fewer, if fewer are kept); of repeated ids the
    smaller vector comes first, null ids come last. ``rounds`` times every centroid moves
    to the floor of the mean of the vectors nearest to it (of equals: the centroid of the
    smaller number), then vectors are assigned once more. Repeated rows count as often as they
    occur; components whose squared distances would leave a long raise an error; extra
    columns are ignored; an empty table, or one without a kept vector, gives an empty result.
    """
    spark = vectors.sparkSession
    kept = vectors.where(sound("embedding", dim)).select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    name = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(F.asc_nulls_last(name), "vec").limit(k).collect()
    parts = settled(encoded(kept, dim, scale, width, segment))
    centroids = np.floor(scale * np.array([r.vec for r in first], np.float64).reshape(-1, dim)).astype(np.int64)
    for _ in range(rounds if len(first) else 0):
        centroids = moved(parts, centroids, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part = Segment(batch, row, width)
                best, distance = part.assign(centroids)
                yield pa.RecordBatch.from_arrays([part.ids, pa.array(best.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    rows = settled(parts.mapInArrow(run, "vec_id long, cluster int, distance long"))
    sums = {r.cluster: int(r.inertia) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}  # at most k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = spark.createDataFrame([(j, sums[j], sum(sums.values()), digests[j]) for j in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
