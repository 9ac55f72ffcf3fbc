"""Exact top-k by inner product through M-trees of metric pages.

Vectors are dealt to shards by their nearest pivots, and each shard is an M-tree written
as rows, one a page: routing vectors with covering radii, the distances of entries to
their page's own routing vector, and child pages; leaves hold vectors. The metric is the
Euclidean distance; with it, and with norms, an inner product is bounded from above for
a whole subtree. A search takes pages from a heap, the highest bound first, and ends when
no bound reaches its k-th score. Distances to a parent that are already known bound an
entry's product by the triangle inequality, and only entries that pass are computed.

A query first searches the shard that holds its own vector. Its k-th score there prunes
whole regions, then shards, by the same bounds; what is left is searched from that score.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinline.llm.common import settled
from twinline.llm.subvectors import sound

#: Most pivots, vectors of a shard, entries of an inner page and of a leaf, and queries that a task takes through one shard at a time.
PIVOTS, SHARD, PAGE, LEAF, BLOCK = 64, 8192, 32, 512, 2048
#: Lengths that have pivots of their own, and copies of a shard's routing entry that queries are spread over.
LENGTHS, SALT = 16, 16

_PAGES = ("shard long, page long, leaf boolean, dim long, points binary, norms binary, radii binary, tops binary, gaps binary, child binary, ids array<array<long>>, "
          "one long, own array<long>, radius double, top long")
_FOUND = "rep long, vec_id long, score long"


def _flat(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``x`` to ``y``."""
    return np.sqrt(((x - y).astype(np.float64) ** 2).sum(-1))


def _groups(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows next to each other, at most ``size`` in a group: nearest of evenly taken pivots, split again where too many."""
    todo, done = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        pivots = x[rows[np.linspace(0, len(rows) - 1, min(PAGE, -(-len(rows) // size) + 1)).astype(int)]].astype(np.float64)
        y = x[rows].astype(np.float64)
        own = ((pivots * pivots).sum(1) - 2 * y @ pivots.T).argmin(1)
        split = [rows[own == j] for j in range(len(pivots)) if (own == j).any()]
        todo += split if len(split) > 1 else [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
    return done


def build(x: np.ndarray, leaf_size: int = LEAF, size: int = PAGE) -> list[dict]:
    """Pages of the M-tree over the rows of ``x`` (integers), leaves first, the root last.

    A page: ``leaf``, its routing vector ``own``, entries' ``points``, squared ``norms`` of
    the points, covering ``radii``, ``tops`` (largest squared norm below), ``gaps`` (distance
    to ``own``) and ``child`` (rows of ``x``, or numbers of pages).
    """
    pages: list[dict] = []
    points, radii, child = x, np.zeros(len(x)), np.arange(len(x))
    tops, leaf = (x * x).sum(1), True
    while True:
        first = len(pages)
        for rows in _groups(points, leaf_size if leaf else size):
            mine = points[rows]
            own = mine[_far(mine, mine.mean(0)).argmin()]
            gaps = _far(mine, own)
            pages.append({"leaf": leaf, "own": own, "points": mine, "norms": (mine * mine).sum(1), "radii": radii[rows], "tops": tops[rows], "gaps": gaps, "child": child[rows],
                          "radius": float((gaps + radii[rows]).max()), "top": int(tops[rows].max())})
        made = pages[first:]
        if len(made) == 1:
            return pages
        points, radii = np.stack([p["own"] for p in made]), np.array([p["radius"] for p in made])
        child, tops, leaf = np.arange(first, len(pages)), np.array([p["top"] for p in made]), False


def bound(norm: int, product, near, radius, top):
    """The most that a product with a point within ``radius`` of a routing vector can be, that has this ``product`` and distance ``near``.

    By the angle: product + |q| radius. By the metric: |q|^2 + |p|^2 - 2 qp is the squared
    distance, which is near - radius at least. A little is added for rounding.
    """
    by_metric = (norm + top - np.maximum(near - radius, 0) ** 2) / 2
    out = by_metric if product is None else np.minimum(by_metric, product + np.sqrt(float(norm)) * radius)
    return out + 1e-9 * (norm + top) + 1e-6


class Tree:
    """An M-tree that counts the products it computes."""

    def __init__(self, pages: list[dict]):
        self.pages, self.computed = pages, 0
        # sums of products below 2^52 are exact in doubles, which multiply faster
        self.small = max(p["top"] for p in pages[-1:]) < 1 << 52
        self.fast = [p["points"].astype(np.float64) for p in pages] if self.small else []

    def search(self, q: np.ndarray, k: int, ids: list, least: int | None = None) -> list[tuple[int, int | None]]:
        """The ``k`` best (score, id) of at least ``least``, ties to the smaller id, null ids last; ``ids`` lists those of each row."""
        norm, root, quick = int(q @ q), self.pages[-1], q.astype(np.float64)
        exact = self.small and norm < 1 << 52
        best: list[tuple] = []  # a heap of the best rows, the worst on top
        order = lambda s, i: (s, i is not None, -(i or 0))
        limit = -np.inf if least is None else least
        heap = [(-np.inf, len(self.pages) - 1, float(_far(q[None], root["own"])[0]), int(q @ root["own"]))]
        self.computed += 1
        while heap:
            high, number, near, product = heapq.heappop(heap)
            if -high < limit:
                break
            page = self.pages[number]
            # entries by the stored distance to the page's routing vector, without computing anything of theirs
            may = np.minimum(bound(norm, None, np.abs(near - page["gaps"]), page["radii"], page["tops"]), product + np.sqrt(float(norm)) * (page["gaps"] + page["radii"]) + 1e-6 + 1e-9 * abs(product))
            some = np.flatnonzero(may >= limit)
            points = self.fast[number] if exact else page["points"]
            scores = (points if len(some) == len(points) else points[some]) @ (quick if exact else q)
            self.computed += len(some)
            if page["leaf"]:
                if len(scores) > k:  # no row below the k-th score of this page alone is among the best
                    limit = max(limit, np.partition(scores, len(scores) - k)[len(scores) - k])
                for at in np.flatnonzero(scores >= limit).tolist():
                    score = int(scores[at])
                    for i in ids[page["child"][some[at]]]:
                        if len(best) < k:
                            heapq.heappush(best, (order(score, i), i))
                        elif order(score, i) > best[0][0]:
                            heapq.heapreplace(best, (order(score, i), i))
                if len(best) == k:
                    limit = max(limit, best[0][0][0])
            else:
                away = np.sqrt(np.maximum(norm + page["norms"][some] - 2 * scores, 0))
                highs = bound(norm, scores, away, page["radii"][some], page["tops"][some])
                for at in np.flatnonzero(highs >= limit).tolist():
                    heapq.heappush(heap, (-highs[at], int(page["child"][some[at]]), float(away[at]), int(scores[at])))
        return [(o[0], i) for o, i in sorted(best, key=lambda b: b[0], reverse=True)]


_ARRAYS = {"points": np.int64, "norms": np.int64, "radii": np.float64, "tops": np.int64, "gaps": np.float64, "child": np.int64}


def _page_rows(table: pa.Table) -> pa.Table:
    """One shard's vectors -> its pages, each with its own vector before its entries; the root's covering ball stands in columns, too."""
    shard, dim, one = (table[c][0].as_py() for c in ("shard", "dim", "one"))
    x = _flat(table["vec"], dim) if dim else np.zeros((table.num_rows, 0), np.int64)
    ids = table["ids"].to_pylist()
    pages = build(x)
    cells = {k: [p[k].astype(t).tobytes() for p in pages] for k, t in _ARRAYS.items()}
    cells["points"] = [p["own"].astype(np.int64).tobytes() + c for p, c in zip(pages, cells["points"])]
    n, root, no = len(pages), pages[-1], [None] * (len(pages) - 1)
    return pa.table({"shard": [shard] * n, "page": list(range(n)), "leaf": [p["leaf"] for p in pages], "dim": [dim] * n, **cells,
                     "ids": pa.array([[ids[c] for c in p["child"]] if p["leaf"] else [] for p in pages], pa.list_(pa.list_(pa.int64()))), "one": [one] * n,
                     "own": pa.array([*no, root["own"].tolist()], pa.list_(pa.int64())), "radius": pa.array([*no, root["radius"]], pa.float64()), "top": pa.array([*no, root["top"]], pa.int64())})


def _read_pages(table: pa.Table) -> tuple[Tree, list]:
    pages, ids = [], {}
    for r in sorted(table.to_pylist(), key=lambda r: r["page"]):
        page = {"leaf": r["leaf"], **{k: np.frombuffer(r[k], t) for k, t in _ARRAYS.items()}}
        points = page["points"].reshape(-1, r["dim"]) if r["dim"] else np.zeros((len(page["child"]) + 1, 0), np.int64)
        page["own"], page["points"], page["top"] = points[0], points[1:], int(page["tops"].max())
        pages.append(page)
        ids |= dict(zip(page["child"].tolist(), r["ids"]))
    return Tree(pages), ids


def _searched(k: int):
    def run(pages: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"rep": [], "vec_id": [], "score": []}
        if pages.num_rows and queries.num_rows:
            tree, ids = _read_pages(pages)
            for rep, vec, least in zip(*[queries[c].to_pylist() for c in ("rep", "vec", "least")]):
                for score, i in tree.search(np.array(vec, np.int64), k, ids, least):
                    out["rep"].append(rep), out["vec_id"].append(i), out["score"].append(score)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


def _squares(column: str):
    return F.aggregate(column, F.lit(0).cast("long"), lambda s, x: s + x * x)


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """Sound rows as ``(vec_id, vec, dim)`` with floor(scale * component); components whose products may leave a long raise an error."""
    most = F.sqrt(F.lit(2.0**60) / F.greatest(F.size("embedding"), F.lit(1)))
    large = F.raise_error(F.lit("a component too large for exact products")).cast("double")
    vec = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(F.when(F.abs(x * scale) < most - 1, x * scale).otherwise(large)))
    return vectors.where(sound("embedding")).select("vec_id", vec.cast("array<long>").alias("vec"), F.size("embedding").cast("long").alias("dim"))


def _cells(pivots: dict[int, np.ndarray]):
    """(..., vec, dim) -> with the two nearest pivots of the vector's length; 0 where the length has none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                one, two, dims = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), batch["dim"].to_numpy()
                for dim, y in pivots.items():
                    mine = np.flatnonzero(dims == dim)
                    x = _flat(batch["vec"].take(pa.array(mine)), dim).astype(np.float64)
                    order = ((y * y).sum(1) - 2 * x @ y.T).argsort(1, kind="stable")
                    one[mine], two[mine] = order[:, 0], order[:, 1]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(one), pa.array(two)], names=[*batch.schema.names, "one", "two"])

    return run


def _open(pairs: DataFrame) -> DataFrame:
    """Of queries ``(vec, norm, least)`` beside balls ``(own, radius, top)`` those whose bound reaches ``least``; the balls' columns go."""
    dot = F.aggregate(F.zip_with("vec", "own", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
    pairs = pairs.withColumn("dot", dot).withColumn("size", F.sqrt("norm"))
    near = F.sqrt(F.greatest(F.col("norm") + _squares("own") - 2 * F.col("dot"), F.lit(0)))
    by_metric = (F.col("norm") + F.col("top") - F.pow(F.greatest(near - F.col("radius"), F.lit(0.0)), 2)) / 2
    most = F.least(by_metric, F.col("dot") + F.col("size") * F.col("radius")) + 1e-9 * (F.col("norm") + F.col("top")) + 1e-6
    return pairs.where(F.col("least").isNull() | (most >= F.col("least"))).drop("dot", "size", "own", "radius", "top")


def _regions(shards: DataFrame) -> DataFrame:
    """The covering ball of each region's shards, around the routing vector of one of them."""
    keys = ["dim", "one"]
    centre = shards.groupBy(*keys).agg(F.min_by("own", "shard").alias("middle"), F.max("top").alias("most"))
    apart = F.aggregate(F.zip_with("own", "middle", lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, x: s + x)
    return (shards.join(centre, keys).groupBy(*keys).agg(F.first("middle").alias("own"), F.max(F.sqrt(apart) + F.col("radius")).alias("radius"), F.first("most").alias("top")))


def _through(pages: DataFrame, asked: DataFrame, k: int, block: int) -> DataFrame:
    """``asked(rep, vec, shard, least)`` searched in the pages of their shards, some ``block`` queries to a task."""
    cuts = settled(asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / block).alias("cuts")))
    mine = asked.join(cuts, "shard").select(F.col("shard").alias("s"), F.pmod(F.xxhash64("rep"), "cuts").alias("b"), "rep", "vec", "least")
    held = pages.join(cuts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))).drop("cuts", "own", "radius", "top", "one")
    return held.groupBy("shard", "part").cogroup(mine.groupBy("s", "b")).applyInArrow(_searched(k), _FOUND)


def build_index(vectors: DataFrame, keep: int, scale: int, pivots: int = PIVOTS, shard: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The written index: ``rows(vec_id, vec, dim)``, distinct vectors ``(shard, dim, one, rep, vec, ids)`` with their ``keep`` smallest ids, and pages."""
    rows = settled(integers(vectors, scale))
    first = Window.partitionBy("vec").orderBy(F.asc_nulls_last("vec_id"))
    single = (rows.withColumn("at", F.row_number().over(first)).where(F.col("at") <= keep).groupBy("vec", "dim")
              .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "vec_id"))), lambda s: s["vec_id"]).alias("ids")))
    single = settled(single.select("vec", "dim", F.monotonically_increasing_id().alias("rep"), "ids"))
    common = single.where("dim > 0").groupBy("dim").count().where(F.col("count") > shard).orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()
    wanted = {r.dim: min(pivots, 4 * -(-r["count"] // shard)) for r in common}  # some four regions to a shard's rows
    chosen = {dim: single.where(F.col("dim") == dim).orderBy(F.xxhash64("vec"), "vec").select("vec").limit(n).collect() for dim, n in wanted.items()}
    chosen = {dim: np.array([r.vec for r in part], np.float64) for dim, part in chosen.items()}
    celled = settled(single.mapInArrow(_cells(chosen), "vec array<long>, dim long, rep long, ids array<long>, one long, two long"))

    # a region is what is nearest to one pivot; a shard is a region, a cell of one that is too large, or a part of a cell that still is
    sizes = celled.groupBy("dim", "one", "two").agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy("dim", "one")) <= shard
    sizes = settled(sizes.select("dim", "one", "two", F.when(whole, 1).otherwise(F.ceil(F.col("n") / shard)).alias("cuts"), F.when(whole, -1).otherwise(F.col("two")).alias("cell")))
    name = F.xxhash64("dim", "one", "cell", F.pmod(F.xxhash64("vec"), "cuts"))
    dealt = settled(celled.join(sizes, ["dim", "one", "two"]).select(name.alias("shard"), "dim", "one", "rep", "vec", "ids"))
    return rows, dealt, settled(dealt.select("shard", "dim", "one", "vec", "ids").groupBy("shard").applyInArrow(_page_rows, _PAGES))


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, pivots: int = PIVOTS, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``vectors(vec_id, embedding, ...)`` -> ``(query_id, rank, vec_id, score)``, exact.

    Queries are the rows whose ``vec_id`` is divisible by ``every``, candidates all rows
    but the query's own; the score is the inner product of floor(``scale`` * component).
    Each query has its ``k`` highest scores (all, if there are fewer), ties to the smaller
    ``vec_id``, null ids last. Vectors that are null or hold null or non-finite
    components take no part; vectors of different lengths don't meet; zero vectors take
    part. Repeated rows are candidates of each other, and queries as often as they occur.
    Components whose products may leave a long raise an error. At most ``pivots`` vectors of each
    of the commonest lengths, chosen by hash, shape the shards, not the result. Extra
    columns are ignored; an empty table gives an empty result.
    """
    # equal vectors once, with their k + 1 smallest ids: a query can get no more of them, its own row aside
    rows, dealt, pages = build_index(vectors, k + 1, scale, pivots, shard)
    shards = settled(pages.where("own is not null").select("shard", "dim", "one", "own", "radius", "top"))
    # regions of lengths with pivots: at most LENGTHS * pivots rows; other lengths have one region, which is not bounded apart
    regions = settled(_regions(shards.join(shards.where("one > 0").select("dim").distinct(), "dim", "left_semi")))

    wanted = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    asked = settled(dealt.join(wanted.select("vec").distinct(), "vec", "left_semi").select("rep", "vec", "dim", F.col("shard").alias("home"), _squares("vec").alias("norm")))
    near = settled(_through(pages, asked.select("rep", "vec", F.col("home").alias("shard"), F.lit(None).cast("long").alias("least")), k + 1, block))
    last = near.withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score")))).where(F.col("at") == k + 1).select("rep", F.col("score").alias("least"))
    asked = settled(asked.join(last, "rep", "left"))
    split = F.broadcast(regions.select("dim").distinct())
    inside = _open(asked.join(F.broadcast(regions), "dim")).unionByName(asked.join(split, "dim", "left_anti").withColumn("one", F.lit(0).cast("long")))
    salted = shards.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    open_ = inside.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALT)).cast("int")).join(salted, ["dim", "one", "salt"])
    open_ = settled(_open(open_.where("shard != home")).select("rep", "vec", "shard", "least"))
    found = near.unionByName(_through(pages, open_, k + 1, block))
    by = [F.desc("score"), F.asc_nulls_last("vec_id")]
    found = settled(found.withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy(*by))).where(F.col("at") <= k + 1).select("rep", "vec_id", "score"))

    # one of the rows that equal the query's own goes, then k stay
    query = wanted.join(asked.select("vec", "rep", "norm"), "vec").select(F.col("vec_id").alias("query_id"), "rep", "norm")
    query = settled(query.withColumn("number", F.monotonically_increasing_id()))
    own = F.coalesce((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("norm")), F.lit(False))
    both = query.join(found, "rep").withColumn("own", own)
    both = both.withColumn("nth", F.row_number().over(Window.partitionBy("number", "own").orderBy(*by))).where("not own or nth > 1")
    rank = F.row_number().over(Window.partitionBy("number").orderBy(*by))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
