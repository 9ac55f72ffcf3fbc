"""SimHash near-duplicates through a hierarchical index of Gray-ordered fingerprints.

The 64 bits are four blocks of 16. Two fingerprints that differ in at most two bits
agree in at least two blocks, so each fingerprint enters six upper nodes, one for
each pair of blocks, keyed by the masked bits. Inside a node the fingerprints are
sorted by the Gray rank of the remaining 32 bits; runs that share the third block
are children, and a child whose block already differs too much is skipped as a
whole. What is left of the allowance applies to the last block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinline.llm.common import as_bytes, map_batches, parts, settled
from twinline.llm.components import components

#: Pairs of 16-bit blocks that a node shares, then the two it leaves free.
NODES = [(a, b, *[c for c in range(4) if c not in (a, b)]) for a in range(4) for b in range(a + 1, 4)]
#: Nodes of more fingerprints than this are split into their children before any task reads them.
NODE_ROWS = 4096


def shingles(text: bytes | None, words: int = 3) -> list[bytes]:
    """The word shingles of a text in their order; a shorter text is one shingle, one without words has none."""
    w = (text or b"").lower().split()
    n = min(words, len(w))
    return w if n < 2 else [b" ".join(s) for s in zip(*(w[i:] for i in range(n)))]


def shingle_hashes(text: bytes | None, words: int = 3, seed: int = 42) -> np.ndarray:
    found = shingles(text, words)
    return np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in found), np.uint64, len(found))


def majority(h: np.ndarray) -> int:
    """Majority bits of the hashes; 0 without any."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of the word shingles; 0 without words."""
    return majority(shingle_hashes(text, words, seed))


def text_hash() -> Column:
    return F.xxhash64("text", F.col("text").isNull())


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, bits long)``, one row per row."""
    def rows(batch: pa.RecordBatch) -> dict:
        bits = np.array([fingerprint(t, words, seed) for t in as_bytes(batch["text"])], np.uint64)
        return {"doc_id": batch["doc_id"], "bits": bits.view(np.int64)}

    return map_batches(docs.select("doc_id", "text"), rows, "doc_id long, bits long")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each 32-bit code word in the reflected Gray sequence."""
    out = values.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16):
        out ^= out >> np.uint64(shift)
    return out


def _block(bits: np.ndarray, k: int) -> np.ndarray:
    return (bits >> np.uint64(16 * k)) & np.uint64(0xFFFF)


class _Sets:
    """Union-find over positions; the smallest position is the root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, i: int, others: np.ndarray) -> None:
        roots = {self.root(i), *(self.root(j) for j in np.unique(self.parent[others]).tolist())}
        low = min(roots)
        for r in roots:
            self.parent[r] = low


def node_links(bits: np.ndarray, third: int, fourth: int, allowed: int, visitors: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links among the fingerprints of one node, found by descending its children.

    ``visitors`` marks rows that come from a sibling child: they are compared with
    the residents only (the links among them belong to their own child).
    """
    free = (_block(bits, third) << np.uint64(16)) | _block(bits, fourth)
    order = np.argsort(gray_rank(free), kind="stable")
    bits, free = bits[order], free[order]
    resident = np.ones(len(bits), bool) if visitors is None else ~visitors[order]
    top = free >> np.uint64(16)
    starts = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
    ends, tops = np.r_[starts[1:], len(bits)], top[starts]
    last = free & np.uint64(0xFFFF)
    sets = _Sets(len(bits))
    for k in range(len(starts)):
        spent = np.bitwise_count(tops ^ tops[k])
        near = np.flatnonzero(spent <= allowed)  # all other children are pruned as a whole
        if visitors is None:
            near = near[near >= k]
        members = np.concatenate([np.arange(starts[j], ends[j]) for j in near])
        left = np.repeat(allowed - spent[near].astype(np.int64), ends[near] - starts[near])
        keep = resident[members]
        members, left = members[keep], left[keep]
        for i in range(starts[k], ends[k]):
            found = members[np.bitwise_count(last[members] ^ last[i]) <= left]
            if len(found) > 1 or len(found) == 1 and found[0] != i:
                sets.join(i, found)
    return [(int(bits[i]), int(bits[r])) for i in range(len(bits)) if (r := sets.root(i)) != i]


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _node_task(allowed: int):
    """Rows (node, key, child, bits, visitor), sorted by the first three: one node or child at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def close():
            node, _, child = key
            bits = np.concatenate([h[0] for h in held])
            away = np.concatenate([h[1] for h in held])
            if len(bits) < 2:
                return []
            return node_links(bits, *NODES[node][2:], allowed, away if child >= 0 else None)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch[c].to_numpy(zero_copy_only=False) for c in ("node", "key", "child")]
            bits, away = batch["bits"].to_numpy().view(np.uint64), batch["visitor"].to_numpy(zero_copy_only=False)
            new = np.zeros(batch.num_rows, bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            links = []
            for lo, hi in zip(cuts, cuts[1:]):
                this = tuple(int(c[lo]) for c in cols)
                if this != key:
                    if held:
                        links += close()
                    held, key = [], this
                held.append((bits[lo:hi], away[lo:hi]))
            yield pa.RecordBatch.from_arrays([pa.array(_signed([a for a, _ in links])), pa.array(_signed([b for _, b in links]))], names=["a", "b"])
        if held:
            links = close()
            yield pa.RecordBatch.from_arrays([pa.array(_signed([a for a, _ in links])), pa.array(_signed([b for _, b in links]))], names=["a", "b"])

    return run


def fingerprint_links(distinct: DataFrame, allowed: int = 2, node_rows: int = NODE_ROWS) -> DataFrame:
    """``distinct(bits)`` -> spanning links ``(a, b)`` of all pairs at ``allowed`` or fewer differing bits (at most two)."""
    if not 0 <= allowed <= 2:
        raise ValueError("four blocks cover at most two differing bits")
    spark = distinct.sparkSession
    mask = [((0xFFFF << 16 * a) | (0xFFFF << 16 * b)) for a, b, *_ in NODES]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in mask]
    rows = (distinct.select("bits", F.explode(F.array(*[F.struct(F.lit(i).alias("node"), F.col("bits").bitwiseAND(F.lit(m)).alias("key"))
                                                        for i, m in enumerate(signed)])).alias("n"))
            .select("n.node", "n.key", "bits"))
    sizes = rows.groupBy("node", "key").count().where("count > 1")
    rows = settled(rows.join(sizes, ["node", "key"]))
    small = rows.where(F.col("count") <= node_rows).select("node", "key", F.lit(-1).alias("child"), "bits", F.lit(False).alias("visitor"))
    big = rows.where(F.col("count") > node_rows)
    third = F.element_at(F.array(*[F.lit(16 * n[2]) for n in NODES]), F.col("node") + 1)
    child = F.expr("cast(shiftrightunsigned(bits, s) & 65535 as int)")
    near = [0] + [1 << i for i in range(16) if allowed > 0] + [(1 << i) | (1 << j) for i in range(16) for j in range(i) if allowed > 1]
    held = (big.withColumn("s", third).withColumn("c", child)
            .select("node", "key", "bits", "c", F.explode(F.array(*[F.lit(x) for x in near])).alias("d"))
            .select("node", "key", F.col("c").bitwiseXOR(F.col("d")).alias("child"), "bits", (F.col("d") != 0).alias("visitor")))
    n = parts(spark)
    rows = small.unionByName(held).repartition(n, "node", "key", "child").sortWithinPartitions("node", "key", "child")
    return rows.mapInArrow(_node_task(allowed), "a long, b long")


def simhash_groups(docs: DataFrame, words: int = 3, seed: int = 42, allowed: int = 2, node_rows: int = NODE_ROWS) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, fingerprint, component_id)``, one row per row.

    Texts are lower-cased in A-Z and split at ASCII white space. A null, empty or
    blank text has fingerprint zero and is linked like any other. Rows with the same
    fingerprint, repeated rows included, share a component; ``component_id`` is the
    smallest id of the component (null only where all its ids are null). Extra
    columns are ignored; an empty table gives an empty result.
    """
    prints = settled(fingerprints(docs, words, seed))
    distinct = settled(prints.groupBy("bits").agg(F.min("doc_id").alias("low")))
    linked = settled(components(fingerprint_links(distinct.select("bits"), allowed, node_rows)).withColumnRenamed("node", "bits"))
    named = distinct.join(linked, "bits", "left").withColumn("component", F.coalesce("component", "bits"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = named.join(lows, "component").select("bits", "component_id")
    return (prints.join(classes, "bits")
            .select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"))


def representatives(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, hash of the text) is in ``kept(doc_id, _text)``, once each."""
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_kept"))
    others = F.xxhash64(F.to_json(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), others.alias("_others"), F.col("doc_id").alias("_doc"),
                       text_hash().alias("_text"))
    same = rows.join(kept, (F.col("_text") == F.col("_kept")) & F.col("_doc").eqNullSafe(F.col("_id")), "left_semi")
    return same.groupBy("_doc", "_text").agg(F.min_by("_row", "_others").alias("_row")).select("_row.*")
