"""Embedding near-duplicates through an inverted multi-index.

Two independent codebooks for the halves of a unit vector span a grid of cells, and
every vector lives in the cell of its two nearest codewords. As a query it visits the
cells in the order of the sum of both distances (multi-sequence traversal), as many as
a target recall needs; the vectors found there are verified by exact cosine.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinline.llm.common import parts, settled
from twinline.llm.components import components

#: Most vectors of a length that the codebooks and the number of visits are fitted on, and lengths that have codebooks of their own.
SAMPLE, LENGTHS = 4096, 16
#: Residents, and visitors, of a cell that one task compares at a time.
BLOCK = 1024


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1), 0)


def codebook(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means codewords of the rows of ``x``."""
    rng = np.random.default_rng(seed)
    words = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        own = _nearest(x, words).argmin(1)
        for j in range(len(words)):
            if (own == j).any():
                words[j] = x[own == j].mean(0)
    return words


class Grid:
    def __init__(self, first: np.ndarray, second: np.ndarray, visits: int = 1):
        self.first, self.second, self.visits = first, second, visits

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = x.shape[1] // 2
        return _nearest(x[:, :h], self.first), _nearest(x[:, h:], self.second)

    def cell(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def traverse(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The ``visits`` nearest cells of each row: the least sums of both halves' sorted distances, taken from a heap."""
        a, b = self.distances(x)
        ia, ib = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        a, b = np.take_along_axis(a, ia, 1), np.take_along_axis(b, ib, 1)
        visits = min(visits, self.cells)
        out = np.empty((len(x), visits), np.int64)
        wide = len(self.second)
        for r in range(len(x)):
            ra, rb, seen, heap = a[r].tolist(), b[r].tolist(), {(0, 0)}, [(a[r, 0] + b[r, 0], 0, 0)]
            for v in range(visits):
                _, i, j = heapq.heappop(heap)
                out[r, v] = ia[r, i] * wide + ib[r, j]
                for i2, j2 in ((i + 1, j), (i, j + 1)):
                    if i2 < len(ra) and j2 < len(rb) and (i2, j2) not in seen:
                        seen.add((i2, j2))
                        heapq.heappush(heap, (ra[i2] + rb[j2], i2, j2))
        return out


def fit(x: np.ndarray, words: int, least: float, recall: float, seed: int = 5) -> Grid:
    """Codebooks of the sample, and the visits that find a vector at cosine ``least`` with probability ``recall`` or more.

    Links at the limit are the hardest, so each sampled vector is paired with a random
    one at exactly that cosine; a pair counts as found if either visits the other's cell.
    """
    h = x.shape[1] // 2
    grid = Grid(codebook(x[:, :h], words, seed), codebook(x[:, h:], words, seed + 1))
    rng = np.random.default_rng(seed + 2)
    q = x[:512]
    noise = rng.normal(size=q.shape)
    noise -= (noise * q).sum(1, keepdims=True) * q
    size = np.linalg.norm(noise, axis=1, keepdims=True)
    y = least * q + math.sqrt(1 - least * least) * noise / np.where(size == 0, 1, size)
    order_q, order_y = grid.traverse(q, grid.cells), grid.traverse(y, grid.cells)
    rank = np.minimum((order_q == grid.cell(y)[:, None]).argmax(1), (order_y == grid.cell(q)[:, None]).argmax(1))
    grid.visits = int(np.quantile(rank, recall, method="higher")) + 1
    return grid


def unit(vectors: pa.Array, dim: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_VISIT = "dim long, cell long, own long, resident boolean, rep long, many long, vec array<double>, visits array<long>"


def one_cell(dim: int) -> Grid:
    """A grid that finds everything: vectors of a rare length are compared with all of theirs, in blocks."""
    return Grid(np.zeros((1, dim // 2)), np.zeros((1, dim - dim // 2)))


def _visit_rows(grids: dict[int, Grid]):
    """(rep, many, dim, vec) -> a resident's row in its own cell, with the cells it visits, and a visitor's row in each of these."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                part = whole.slice(at, 1024)
                dims = part["dim"].to_numpy()
                for dim in np.unique(dims).tolist():
                    batch = part.take(pa.array(np.flatnonzero(dims == dim)))
                    x, grid = unit(batch["vec"], dim), grids.get(dim) or one_cell(dim)
                    own, found = grid.cell(x), grid.traverse(x, grid.visits)
                    cells = [np.union1d(f, [o]) for f, o in zip(found, own)]
                    size = np.array([len(c) for c in cells])
                    row = np.r_[np.arange(len(own)), np.repeat(np.arange(len(own)), size)]
                    take, flat = pa.array(row), np.concatenate([np.zeros(0, np.int64), *cells])
                    ends = np.r_[0, np.cumsum(size), np.full(len(row) - len(own), size.sum())]
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([batch["dim"].take(take), pa.array(np.r_[own, flat]), pa.array(own[row]), pa.array(np.arange(len(row)) < len(own)), batch["rep"].take(take),
                                                      batch["many"].take(take), batch["vec"].take(take), lists], names=["dim", "cell", "own", "resident", "rep", "many", "vec", "visits"])

    return run


def _labels(hit: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest name reachable from each row and column of a table of links that all have one."""
    top = np.iinfo(np.int64).max
    while True:
        low = np.minimum(rows, np.where(hit, cols[None], top).min(1))
        side = np.minimum(cols, np.where(hit, low[:, None], top).min(0))
        if (low == rows).all() and (side == cols).all():
            return rows, cols
        rows, cols = low, side


def _compare(least: float):
    """One block of a cell -> (rep, links, other): links counted for visitors and residents, and spanning links of both."""
    def run(table: pa.Table) -> pa.Table:
        resident = table["resident"].to_numpy()
        rep, many, own = (table[c].to_numpy() for c in ("rep", "many", "own"))
        r, v = np.flatnonzero(resident), np.flatnonzero(~resident)
        x = unit(table["vec"].combine_chunks(), table["dim"][0].as_py())
        hit = (x[v] @ x[r].T >= least) & (rep[v][:, None] != rep[r][None])
        if not hit.any():
            return pa.table({"rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
        v, r, hit = v[hit.any(1)], r[hit.any(0)], hit[hit.any(1)][:, hit.any(0)]
        # a resident that visits the visitor's own cell counts the link there
        lists = table["visits"].combine_chunks().take(pa.array(r)).to_pylist()
        back = np.array([np.isin(own[v], c) for c in lists], bool).reshape(len(r), len(v)).T
        links = np.r_[hit @ many[r], ((hit & ~back) * many[v][:, None]).sum(0)]
        low, side = _labels(hit, rep[v], rep[r])
        return pa.table({"rep": pa.array(np.r_[rep[v], rep[r]]), "links": pa.array(links.astype(np.int64)), "other": pa.array(np.r_[low, side])})

    return run


def near_vectors(vectors: DataFrame, least: float = 0.9, codewords: int = 16, recall: float = 0.97, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """``vectors(vec_id, embedding, ...)`` -> ``(vec_id, n_links, component_id, kept)``, one row per row.

    Null and zero vectors and those with null or non-finite components link with
    nothing; vectors of different lengths don't meet. Equal vectors are
    compared once and counted as often as they occur, repeated rows too. The ``LENGTHS``
    commonest lengths have codebooks, fitted on at most ``sample`` distinct vectors chosen by hash; every
    row is indexed. Vectors of any other length, or of one with fewer than 16 vectors for each
    codeword, share one cell, in which all are compared.
    A cell of many vectors is compared in blocks, and links are counted, never listed.
    ``component_id`` is the smallest id of a component. Extra columns are ignored; an
    empty table gives an empty result.
    """
    spark = vectors.sparkSession
    vec = F.col("embedding").cast("array<double>")
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = settled(vectors.select("vec_id", F.when(sound, F.transform(vec, lambda x: x + F.lit(0.0))).alias("vec")).withColumn("rep", F.when(F.col("vec").isNotNull(), F.xxhash64("vec"))))
    single = settled(rows.where(F.col("rep").isNotNull()).groupBy("rep").agg(F.count(F.lit(1)).alias("many"), F.min("vec_id").alias("low"), F.first("vec").alias("vec"))
                     .withColumn("dim", F.size("vec").cast("long")))
    common = single.where("dim > 1").groupBy("dim").count().where(F.col("count") >= 16 * codewords).orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()
    grids = {}
    for dim, n in common:
        share = int(min(1.0, 1.2 * sample / n) * (1 << 30))
        part = single.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("rep", F.lit("sample")), F.lit(1 << 30)) < F.lit(share))).select("rep", "vec").limit(sample).collect()
        x = np.array([r.vec for r in sorted(part, key=lambda r: r.rep)] or [single.where(F.col("dim") == dim).first().vec])
        x = x / np.abs(x).max(1, keepdims=True)
        grids[dim] = fit(x / np.linalg.norm(x, axis=1, keepdims=True), codewords, least, recall)
    visits = settled(single.select("rep", "many", "dim", "vec").repartition(parts(spark), "rep").mapInArrow(_visit_rows(grids), _VISIT))
    held = lambda res: F.ceil(F.count_if(F.col("resident") == res) / block)
    blocks = settled(visits.groupBy("dim", "cell").agg(held(True).alias("nr"), held(False).alias("nv")).where("nr > 0"))
    dealt = visits.join(blocks, ["dim", "cell"]).withColumn("mine", F.pmod(F.xxhash64("rep"), F.when(F.col("resident"), F.col("nr")).otherwise(F.col("nv"))))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.when(F.col("resident"), F.col("nv")).otherwise(F.col("nr")), F.lit(1)) - 1)))
    rb, vb = (F.when(F.col("resident") == res, F.col("mine")).otherwise(F.col("other")) for res in (True, False))
    dealt = dealt.select("dim", "cell", rb.alias("rb"), vb.alias("vb"), "own", "resident", "rep", "many", "vec", F.when(F.col("resident"), F.col("visits")).alias("visits"))
    found = settled(dealt.groupBy("dim", "cell", "rb", "vb").applyInArrow(_compare(least), "rep long, links long, other long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = settled(components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))).withColumnRenamed("node", "rep")
    named = single.select("rep", "many", "low").join(links, "rep", "left").join(linked, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(lows, "component").select("rep", "component_id", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"))
    return (rows.select("vec_id", "rep").join(named, "rep", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
