"""Near copies by SimHash and min-hash candidates, verified by the exact Jaccard of word shingles.

The Gray index of ``simhash`` is complete up to two differing bits only, while texts at
a similarity of 0.8 differ in some ten of 64 bits. No pigeonhole reaches that far:
with 17 differing bits one of 18 blocks agrees, of 3 or 4 bits each. So the components
of the Gray index are one kind of bucket, and bands of min-hashes over the same shingle
hashes are the others: two texts of similarity s share none of the bands with
probability (1 - s^ROWS)^BANDS, which is 7e-6 at 0.8. A pair links only if the exact
similarity of both texts reaches the limit; pairs that the parities of their shingle
hashes already rule out are not made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinline.llm import simhash
from twinline.llm.common import as_bytes, give_back, map_batches, parts, settled, small_batches
from twinline.llm.components import components

#: Words of a shingle, and the least similarity of near copies.
WORDS, LEAST = 5, 0.8
#: Bands of min-hashes, and min-hashes of a band.
BANDS, ROWS = 30, 5
#: Words of 64 bits of the parities.
PARITY = 16

_RNG = np.random.default_rng(11)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_MIX = _RNG.integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band, from the distinct shingle hashes; texts without a shingle share all keys."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024, None] * _FACTORS + _TERMS).min(0), out=least)
    mixed = least.reshape(BANDS, ROWS)
    mixed = ((mixed ^ (mixed >> np.uint64(29))) * _MIX).sum(1, dtype=np.uint64)
    return mixed ^ (mixed >> np.uint64(32)) ^ _TERMS[:BANDS]


def parities(hashes: np.ndarray) -> np.ndarray:
    """The parity of the number of hashes in each of 64 * PARITY classes, as longs."""
    odd = np.bincount((hashes % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def may_reach(size: Column, odd: Column, other_size: Column, other_odd: Column, least: float) -> Column:
    """Whether two texts may have the similarity ``least``, by their sizes and parities; never false for two that have it.

    A class whose parities differ holds a hash of one text only, so the sets differ in as many hashes at least.
    """
    differ = sum((F.bit_count(odd[k].bitwiseXOR(other_odd[k])) for k in range(PARITY)), F.lit(0)).cast("long")
    both = size + other_size
    fits = F.least(size, other_size) >= F.lit(least) * F.greatest(size, other_size)
    return fits & F.when(both == 0, True).otherwise((both - differ) / (both + differ) >= F.lit(least))


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def sketches(docs: DataFrame, words: int = WORDS, seed: int = 42) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, node, text, bits, size, bands, odd)``: text hash, fingerprint, number of shingles, band keys and parities."""
    def lists(of: list[np.ndarray], n: int) -> pa.Array:
        return pa.ListArray.from_arrays(np.arange(len(of) + 1, dtype=np.int32) * n, np.concatenate([np.zeros(0, np.int64), *of]))

    def rows(batch: pa.RecordBatch) -> dict:
        bits, sizes, bands, odd = [], [], [], []
        for t in as_bytes(batch["text"]):
            h = simhash.shingle_hashes(t, words, seed)
            bits.append(simhash.majority(h))
            h = np.unique(h)
            sizes.append(len(h))
            bands.append(band_keys(h).view(np.int64))
            odd.append(parities(h))
        return {"doc_id": batch["doc_id"], "node": batch["node"], "text": batch["text"], "bits": np.array(bits, np.uint64).view(np.int64), "size": np.array(sizes, np.int64),
                "bands": lists(bands, BANDS), "odd": lists(odd, PARITY)}

    return map_batches(docs.select("doc_id", simhash.text_hash().alias("node"), "text"), rows, "doc_id long, node long, text string, bits long, size long, bands array<long>, odd array<long>")


def _verify(words: int, least: float):
    """Rows (a, b, left, right) -> the links (a, b) whose texts are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, set())
        for batch in batches:
            hit = []
            for a, x, y in zip(batch["a"].to_pylist(), as_bytes(batch["left"]), as_bytes(batch["right"])):
                if held[0] != a:
                    held = (a, set(simhash.shingles(x, words)))
                hit.append(jaccard(held[1], set(simhash.shingles(y, words))) >= least)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))
        give_back()

    return run


def copy_links(sketch: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """Links ``(a, b)`` of text hashes that connect all texts with a candidate pair of similarity ``least`` or more.

    ``sketch`` is a written table of ``sketches`` with a number ``row`` for each row. One row
    stands for each text, chosen by number before any text moves; texts move only for candidates.
    In each bucket all texts are compared with one of them first; only buckets that this
    leaves in several components are compared pair by pair, across components. Sizes and
    parities come before the texts, so a large group of texts that are alike, but below
    ``least``, makes few pairs.
    """
    spark = sketch.sparkSession
    texts = settled(sketch.groupBy("node").agg(F.min("row").alias("row"), F.first("bits").alias("bits"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("odd").alias("odd")))
    rows = texts.select("node", F.explode("bands").alias("bucket"))
    shared = settled(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low")).where("n > 1").select("bucket", "low"))
    members = settled(rows.join(shared, "bucket"))
    near = components(simhash.fingerprint_links(texts.select("bits").distinct())).withColumnRenamed("node", "bits")
    groups = texts.select("node", "bits").join(near, "bits", "left").select("node", F.coalesce("component", "bits").alias("bucket"))
    lows = settled(groups.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low")).where("n > 1").select("bucket", "low"))
    stars = members.select("node", "low").unionByName(groups.join(lows, "bucket").select("node", "low"))
    marks = texts.select("node", "size", "odd")

    def verified(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        chosen = texts.select("node", "row").join(ends, "node").select("row", F.col("node").alias("of"))
        held = settled(sketch.select("row", "text").join(chosen, "row").select(F.col("of").alias("node"), "text"))
        both = (pairs.join(held.select(F.col("node").alias("b"), F.col("text").alias("right")), "b")
                .join(held.select(F.col("node").alias("a"), F.col("text").alias("left")), "a").select("a", "b", "left", "right"))
        # spread anew: a text that many others are compared with would leave its pairs in one task
        with small_batches(spark):
            return settled(both.repartition(parts(spark)).mapInArrow(_verify(words, least), "a long, b long"))

    pairs = settled(stars.select(F.col("low").alias("a"), F.col("node").alias("b")).where("a <> b").distinct())
    first = settled(pairs.join(marks.toDF("a", "size", "odd"), "a").join(marks.toDF("b", "b_size", "b_odd"), "b")
                    .where(may_reach(F.col("size"), F.col("odd"), F.col("b_size"), F.col("b_odd"), least)).select("a", "b"))
    links = verified(first)
    linked = settled(components(links))
    now = members.join(linked, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    split = now.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    now = settled(now.join(split, "bucket").join(marks, "node").select("bucket", "node", "size", "component", "odd"))
    other = now.toDF("bucket", "b", "b_size", "b_component", "b_odd")
    cross = (now.withColumnRenamed("node", "a").join(other, "bucket").where((F.col("a") < F.col("b")) & (F.col("component") != F.col("b_component"))
                                                                            & may_reach(F.col("size"), F.col("odd"), F.col("b_size"), F.col("b_odd"), least))
             .select("a", "b").distinct())
    return links.unionByName(verified(settled(cross.join(first, ["a", "b"], "left_anti"))))


def near_copy_groups(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, node, component)``, one row per row: text hash and component of texts.

    Words are lower-cased in A-Z and split at ASCII white space; a text of fewer than
    ``words`` words is one shingle. Null, empty and blank texts are copies of each other.
    """
    with small_batches(docs.sparkSession):
        sketch = settled(sketches(docs.select("doc_id", "text"), words).withColumn("row", F.monotonically_increasing_id()))
    linked = components(copy_links(sketch, words, least))
    return sketch.select("doc_id", "node").join(linked, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("component"))


def drop_near_copies(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest (doc_id, hash of the text); null ids come first.

    Rows that share an id, or have none, all stay if their texts are in different
    components. Of rows alike in id and text one stays, chosen by the hash of the other columns.
    """
    lows = near_copy_groups(docs, words, least).groupBy("component").agg(F.min(F.struct("doc_id", F.col("node").alias("_text"))).alias("low"))
    return simhash.representatives(docs, settled(lows.select("low.*")))
