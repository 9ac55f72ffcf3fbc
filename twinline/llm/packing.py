"""Packing of documents into sequences by lexical retrieval.

A document's tokens are cut into whole sequences and a tail. Tails are laid out in
shards by their documents' most telling term. Each shard has a BM25 inverted index over
the terms (token ids) of its documents; a seed's window is filled with the unused
documents that the index ranks highest, the first that no longer fits being cut.
Document frequencies and the mean length come from all documents.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinline.llm.common import map_batches, parts, settled

#: Documents in a shard of the index; constants of BM25.
SHARD, K1, B = 512, 1.2, 0.75
_TOKENS = "doc_id long, n long, crcs array<long>, tail binary, terms binary, counts binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_encoders: dict[tuple, object] = {}


def encoder(path: str, pattern: str, special: str, special_id: int):
    """The vocabulary of a rank file, with one special token that is known inside texts, too."""
    key = (path, pattern)
    if key not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[key] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={special: special_id})
    return _encoders[key]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenise(docs: DataFrame, path: str, pattern: str, window: int, special: str = "<|endoftext|>", special_id: int = 50256, end_id: int = 0) -> DataFrame:
    """``(doc_id, n, crcs, tail, terms, counts)``: ids of the whole text and ``end_id``; checksums of its whole windows, the ids after them, its distinct ids and their counts."""
    def rows(batch: pa.RecordBatch) -> dict:
        coder = encoder(path, pattern, special, special_id)
        n, crcs, tails, terms, counts = [], [], [], [], []
        for text in batch["text"].to_pylist():
            ids = np.append(coder.encode_to_numpy(text or "", allowed_special={special}, disallowed_special=()), np.uint32(end_id)).astype(np.uint32)
            full = len(ids) // window * window
            n.append(len(ids))
            crcs.append([crc(ids[at : at + window]) for at in range(0, full, window)])
            tails.append(ids[full:].astype("<u2" if special_id < 65536 else "<u4").tobytes())
            held, times = np.unique(ids[:-1], return_counts=True)
            terms.append(held.astype("<u2" if special_id < 65536 else "<u4").tobytes())
            counts.append(np.minimum(times, 65535).astype("<u2").tobytes())
        return {"doc_id": batch["doc_id"], "n": n, "crcs": crcs, "tail": tails, "terms": terms, "counts": counts}

    return map_batches(docs.select("doc_id", "text"), rows, _TOKENS, 512)


def frequencies(tokens: DataFrame, size: int, width: str) -> tuple[np.ndarray, int, float]:
    """Number of documents with each id, number of documents, their mean length; from all rows, at most ``size`` numbers."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            raw = b"".join(batch["terms"].to_pylist())
            total += np.bincount(np.frombuffer(raw, width), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    df = np.zeros(size, np.int64)
    for r in tokens.select("terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        df[r.term] = r.n
    n, mean = tokens.agg(F.count(F.lit(1)), F.avg("n")).first()
    return df, n, float(mean or 1.0)


class Shard:
    """Inverted index over the documents of one shard, with what is left of each tail."""

    def __init__(self, docs: list[dict], idf: np.ndarray, mean: float):
        self.docs = docs
        sizes = np.array([len(d["terms"]) for d in docs])
        term = np.concatenate([d["terms"] for d in docs])
        owner = np.repeat(np.arange(len(docs)), sizes)
        tf = np.concatenate([d["counts"] for d in docs]).astype(np.float32)
        norm = np.array([K1 * (1 - B + B * d["n"] / mean) for d in docs], np.float32)[owner]
        weight = idf[term] * tf * (K1 + 1) / (tf + norm)
        order = np.argsort(term, kind="stable")
        self.held, self.first = np.unique(term[order], return_index=True)
        self.last = np.r_[self.first[1:], len(term)]
        self.owner, self.weight = owner[order], weight[order]

    def ranked(self, terms: np.ndarray) -> np.ndarray:
        """Documents by falling score for a query of terms; ties by place."""
        at = np.searchsorted(self.held, terms)
        at = at[(at < len(self.held)) & (self.held[np.minimum(at, len(self.held) - 1)] == terms)] if len(self.held) else at[:0]
        size = self.last[at] - self.first[at]
        spot = np.repeat(self.first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.argsort(-np.bincount(self.owner[spot], self.weight[spot], len(self.docs)), kind="stable")


def fill(docs: list[dict], window: int, idf: np.ndarray, mean: float) -> tuple[list[list[tuple[dict, int, int]]], list[dict]]:
    """Whole windows as lists of (document, start in its tail, length), and documents whose tails are left over."""
    index = Shard(docs, idf, mean)
    left = [len(d["tail"]) - d["used"] for d in docs]
    total, windows, seed = sum(left), [], 0
    while total >= window:
        while not left[seed]:
            seed += 1
        gap, pieces = window, []

        def take(i, size):
            d = docs[i]
            pieces.append((d, d["used"], size))
            d["used"] += size
            left[i] -= size

        gap -= min(gap, left[seed])
        take(seed, left[seed])
        if gap:
            ranked = [i for i in index.ranked(docs[seed]["terms"]).tolist() if left[i]]
            for i in ranked:
                if left[i] <= gap:
                    gap -= left[i]
                    take(i, left[i])
                    if not gap:
                        break
            for i in ranked:  # the best of what did not fit is cut
                if not gap:
                    break
                if left[i]:
                    size = min(gap, left[i])
                    gap -= size
                    take(i, size)
        windows.append(pieces)
        total -= window
    return windows, [d for d, n in zip(docs, left) if n]


def _pack(window: int, idf: np.ndarray, mean: float, width: str, shard: int):
    """Documents in shard order -> pieces; a partition's last tokens go to sequences of powers of two."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        number = 0
        out: list[list] = [[] for _ in range(7)]

        def emit(d, start, length, check, offset):
            for x, v in zip(out, (d["doc_id"], start, length, check, d["n"], base + number, offset)):
                x.append(v)

        def flush():
            kinds = [pa.int64()] * 7
            batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            for x in out:
                x.clear()
            return batch

        def lay(sequence):
            nonlocal number
            offset = 0
            for d, at, size in sequence:
                emit(d, d["n"] - len(d["tail"]) + at, size, crc(d["tail"][at : at + size]), offset)
                offset += size
            number += 1

        pool: list[dict] = []
        for batch in batches:
            for doc_id, n, crcs, tail, terms, counts in zip(*(batch[c].to_pylist() for c in ("doc_id", "n", "crcs", "tail", "terms", "counts"))):
                d = {"doc_id": doc_id, "n": n, "tail": np.frombuffer(tail, width), "terms": np.frombuffer(terms, width).astype(np.int64),
                     "counts": np.frombuffer(counts, "<u2"), "used": 0}
                for k, check in enumerate(crcs):
                    emit(d, k * window, window, check, 0)
                    number += 1
                if len(d["tail"]):
                    pool.append(d)
                if len(pool) >= shard:
                    windows, pool = fill(pool, window, idf, mean)
                    for w in windows:
                        lay(w)
            yield flush()
        if pool:
            windows, pool = fill(pool, window, idf, mean)
            for w in windows:
                lay(w)
        rest = sum(len(d["tail"]) - d["used"] for d in pool)
        for bit in range(window.bit_length() - 1, -1, -1):
            if rest >> bit & 1:
                gap, sequence = 1 << bit, []
                while gap:
                    d = pool[0]
                    size = min(gap, len(d["tail"]) - d["used"])
                    sequence.append((d, d["used"], size))
                    d["used"] += size
                    gap -= size
                    if d["used"] == len(d["tail"]):
                        pool.pop(0)
                lay(sequence)
        yield flush()

    return run


def pack(docs: DataFrame, path: str, pattern: str, window: int = 1024, special_id: int = 50256, shard: int = SHARD) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` of all rows of ``docs(doc_id, text, ...)``.

    Every sequence is full, except for those of a power of two that end a partition, so
    nothing is padded. A null text counts as empty and has the end id alone. Repeated
    rows are packed each for itself; extra columns are ignored; an empty table gives an
    empty result. ``window`` must be a power of two.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    width = "<u2" if special_id < 65536 else "<u4"
    tokens = settled(tokenise(docs, path, pattern, window, special_id=special_id))
    df, n, mean = frequencies(tokens, special_id + 1, width)
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)

    @F.arrow_udf("long")
    def telling(terms: pa.Array, counts: pa.Array) -> pa.Array:
        out = []
        for t, c in zip(terms.to_pylist(), counts.to_pylist()):
            t = np.frombuffer(t, width)
            w = idf[t] * np.log1p(np.frombuffer(c, "<u2")) * (df[t] > 1)  # a term of one document draws no neighbours
            out.append(int(t[w.argmax()]) if len(t) else -1)
        return pa.array(out, pa.int64())

    spread = F.xxhash64("doc_id", "n", "tail")
    rows = tokens.withColumn("key", telling("terms", "counts")).withColumn("spread", spread)
    rows = rows.repartitionByRange(parts(docs.sparkSession), "key", "spread").sortWithinPartitions("key", "spread")
    return rows.select("doc_id", "n", "crcs", "tail", "terms", "counts").mapInArrow(_pack(window, idf, mean, width, shard), _PIECES)
