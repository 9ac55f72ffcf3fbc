"""Line deduplication by pairwise alignment of overlapping documents.

A document overlaps another if they share a rare line, or a run of adjacent lines
that is long enough to be deleted. For every such line and run the earliest document
that holds it is its source; a later document is aligned with the sources of its lines
and runs by patience diff, and common blocks are deleted from it. So each shared line or
run gives one pair for each later document, never all pairs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinline.llm.common import give_back, map_batches, parts, settled, small_batches
from twinline.llm.suffixes import _ranges

#: A line is rare if at most this share of all documents hold it.
RARE_SHARE = 0.5
#: A common block is deleted if its lines have this many characters in total.
BLOCK_CHARS = 80


def _anchors(a: list[int], b: list[int], alo: int, ahi: int, blo: int, bhi: int) -> list[tuple[int, int]]:
    """Longest increasing run of lines that occur once in either range."""
    def once(seq, lo, hi):
        seen: dict[int, int] = {}
        for i in range(lo, hi):
            seen[seq[i]] = -1 if seq[i] in seen else i
        return seen

    left, right = once(a, alo, ahi), once(b, blo, bhi)
    pairs = sorted((i, right[k]) for k, i in left.items() if i >= 0 and right.get(k, -1) >= 0)
    piles: list[int] = []
    tops: list[tuple] = []
    for i, j in pairs:
        at = bisect_left(piles, j)
        node = (i, j, tops[at - 1] if at else None)
        piles[at:at + 1], tops[at:at + 1] = [j], [node]
    out, node = [], tops[-1] if tops else None
    while node:
        out.append(node[:2])
        node = node[2]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of aligned positions, increasing in both sequences."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            found.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            found.append((ahi, bhi))
        if alo < ahi and blo < bhi:
            i0, j0 = alo, blo
            anchors = _anchors(a, b, alo, ahi, blo, bhi)
            for i, j in anchors:
                found.append((i, j))
                todo.append((i0, i, j0, j))
                i0, j0 = i + 1, j + 1
            if anchors:
                todo.append((i0, ahi, j0, bhi))
    return sorted(found)


def common_blocks(a: list[int], b: list[int], sizes: list[int], least: int) -> list[int]:
    """Positions in ``b`` of the aligned blocks whose lines sum up to ``least`` characters."""
    out, block, last = [], [], None
    for i, j in [*patience(a, b), (-1, -1)]:
        if last is not None and (i, j) != (last[0] + 1, last[1] + 1):
            if sum(sizes[k] for k in block) >= least:
                out += block
            block = []
        block.append(j)
        last = (i, j)
    return out


def _align(least: int):
    """Rows (doc, lines, sizes, source_lines) -> (doc, positions to delete)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [common_blocks(a, b, s, least) for a, b, s in zip(batch["source_lines"].to_pylist(), batch["lines"].to_pylist(), batch["sizes"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(cut, pa.list_(pa.int32()))], names=["doc", "cut"])
        give_back()

    return run


def run_ends(sizes: np.ndarray, blank: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """End of the shortest run from each line that has ``least`` characters and a line that isn't blank; -1 where the document ends before.

    ``ends`` holds the end of each line's document.
    """
    n = len(sizes)
    total = np.cumsum(sizes)
    last = np.searchsorted(total, total - sizes + least)
    last = np.maximum(last, np.arange(n))
    seen = np.minimum.accumulate(np.where(blank, n, np.arange(n))[::-1])[::-1]
    last = np.maximum(last, seen)
    return np.where(last < ends, last + 1, -1)


def _line_keys(rows: DataFrame, least: int) -> DataFrame:
    """``rows(place, lines, sizes, blank)`` -> ``(place, key, run)``: the distinct lines that aren't blank, and runs of ``least`` characters, of each row."""
    def keys(batch: pa.RecordBatch) -> dict:
        lists = batch["lines"]
        n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        line = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        sizes, blank = (batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("sizes", "blank"))
        owner = np.repeat(np.arange(len(n)), n)
        to = run_ends(sizes.astype(np.int64), blank, np.cumsum(n)[owner], least) if len(line) else np.zeros(0, np.int64)
        start = np.flatnonzero(to >= 0)
        whole, single = _ranges(line, start, to[start]), np.flatnonzero(~blank)
        held = np.rec.fromarrays([np.r_[owner[single], owner[start]], np.r_[line[single], whole], np.arange(len(single) + len(start)) >= len(single)], names="o,k,r")
        order = np.lexsort((held.r, held.k, held.o))
        held = held[order]
        new = np.ones(len(held), bool)
        new[1:] = (held.o[1:] != held.o[:-1]) | (held.k[1:] != held.k[:-1]) | (held.r[1:] != held.r[:-1])
        held = held[new]
        return {"place": batch["place"].take(pa.array(held.o)), "key": held.k.view(np.int64), "run": held.r}

    return map_batches(rows.select("place", "lines", "sizes", "blank"), keys, "place struct<doc_id:long,doc:long>, key long, run boolean")


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with ``doc``: a key of (doc_id, text); rows alike in both are one document."""
    return docs.withColumn("doc", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull()))


def line_cuts(docs: DataFrame, rare_share: float = RARE_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc, cut)``: the line positions to delete from each later document, where there are any."""
    n_docs = docs.count()
    # one row for each document, repeated rows once; earlier documents have the lower (doc_id, doc)
    lines = F.split("text", "\n")
    rows = settled(_keyed(docs.where(F.col("text").isNotNull())).select(
        "doc", F.struct("doc_id", "doc").alias("place"), F.transform(lines, lambda x: F.xxhash64(x)).alias("lines"),
        F.transform(lines, lambda x: F.length(x)).alias("sizes"),
        F.transform(lines, lambda x: F.trim(x) == "").alias("blank")).dropDuplicates(["doc"]))
    with small_batches(docs.sparkSession):
        keys = settled(_line_keys(rows, block_chars))
    # written before the join, which can then split a hot line over tasks
    sources = settled(keys.groupBy("key", "run").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("source"))
                      .where((F.col("n") > 1) & (F.col("run") | (F.col("n") <= int(rare_share * n_docs)))).select("key", "run", "source"))
    pairs = (keys.join(sources, ["key", "run"]).where("place > source")
             .select(F.col("place.doc").alias("doc"), F.col("source.doc").alias("source")).distinct())
    later = pairs.join(rows.select("doc", "lines", "sizes"), "doc")
    both = later.join(rows.select(F.col("doc").alias("source"), F.col("lines").alias("source_lines")), "source")
    # spread anew: a source that many documents share would leave its pairs in one task; a row holds the lines of two documents
    both = both.select("doc", "lines", "sizes", "source_lines").repartition(parts(docs.sparkSession))
    with small_batches(docs.sparkSession, 64):
        found = settled(both.mapInArrow(_align(block_chars), "doc long, cut array<int>"))
    return found.where(F.size("cut") > 0).groupBy("doc").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cut")))).alias("cut"))


def dedup_lines(docs: DataFrame, rare_share: float = RARE_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with the aligned common blocks deleted from the later documents, and ``removed``: the number of deleted lines.

    Earlier is the smaller (doc_id, hash of the text); null ids come first. Rows alike
    in id and text are one document and are cut alike. A line is rare if at most
    ``rare_share`` of the documents hold it; blank lines are never looked
    up but may lie within a block. A run is the shortest from each line that has
    ``block_chars`` characters, so each common block holds one, and it
    names a source however many documents hold it. A null text stays null, an empty one empty; a
    document whose every line is deleted becomes empty. Columns beside ``text`` are
    passed on; an empty table gives an empty result.
    """
    names = docs.columns
    cuts = line_cuts(docs.select("doc_id", "text"), rare_share, block_chars)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "doc_id", "text")
    rows = _keyed(rows).join(cuts, "doc", "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("cut", i)), "\n")
    text = F.when(F.col("cut").isNull(), F.col("text")).otherwise(kept)
    rows = rows.withColumn("row", F.col("row").withField("text", text)) if "text" in names else rows
    return rows.select("row.*", F.coalesce(F.size("cut"), F.lit(0)).alias("removed")) if "removed" not in names else rows.select("row.*")
