"""Alignment of two tokenizers over the same bytes, by divide and conquer at shared cuts.

A byte offset at which a token of both sides ends is a cut. An interval of both token
sequences looks for a cut near its middle: the end of the middle token of A is bisected
in the ends of B, then its neighbours to both sides, until one is shared. The interval
is divided there and both halves go on alike; an interval without a cut inside is a
group. All intervals of a slice of documents are divided together, level by level.

Links are counted for the whole corpus without a row for each document and pair. The
documents of a segment share one dictionary of the id pairs that they link; only the
dictionaries are counted, joined with the counts and sent back to their segments.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinline.llm.common import settled

#: Characters of text that are aligned at a time, and those whose documents share a dictionary of pairs.
SLICE, SEGMENT = 2 << 20, 8 << 20
#: Occurrence pairs of a group that are listed one by one; larger groups are counted by their distinct ids.
LISTED = 1024

_SEGMENTS = ("segment long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, "
             "sizes array<long>, codes binary, times binary, pairs array<long>, docs array<long>")
_ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and the decimal text of every id with each separator that may follow it."""

    def __init__(self, ranks: str, pattern: str, pieces: str):
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.a = tiktoken.Encoding("aligned", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.n_a, self.n_b = max(table.values()) + 1, self.b.get_piece_size()
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.n_b) for p in [self.b.id_to_piece(i)]]
        self.len_a, self.len_b = np.zeros(self.n_a, np.int64), np.array([len(t) for t in self.bytes_b], np.int64)
        for t, i in table.items():
            self.len_a[i] = len(t)
        wide = len(str(max(self.n_a, self.n_b))) + 1
        signs = [f"{i}{sep}".encode().ljust(wide, b"\0") for n, seps in ((self.n_a, ",|"), (self.n_b, ",;")) for sep in seps for i in range(n)]
        self.signs = np.frombuffer(b"".join(signs), np.uint8).reshape(-1, wide)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides; none if one side does not stand for the bytes of a space and the text."""
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        raw = b" " + text.encode()
        a = self.a.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)
        b = self.b.encode_as_numpy(text).astype(np.int64)
        whole = self.len_a[a].sum() == len(raw) and b"".join(map(self.bytes_b.__getitem__, b.tolist())) == raw
        return (a, b) if whole else (none, none)


_loaded: dict[tuple, Tokenizers] = {}


def tokenizers(*paths: str) -> Tokenizers:
    if paths not in _loaded:
        _loaded[paths] = Tokenizers(*paths)
    return _loaded[paths]


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the tokens of A and of B that a cut follows.

    ``ends_a`` and ``ends_b`` are the rising byte ends of many documents laid one after
    the other; ``first_a`` and ``first_b`` are the numbers of tokens before each document
    and, last, of all. Every document ends at a cut.
    """
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    some = first_a[1:] > first_a[:-1]
    lo_a, hi_a, lo_b, hi_b = (x[some] for x in (first_a[:-1], first_a[1:], first_b[:-1], first_b[1:]))
    cut_a[hi_a - 1] = cut_b[hi_b - 1] = True
    while True:
        more = (hi_a - lo_a > 1) & (hi_b - lo_b > 1)  # else there is no room for a cut inside
        lo_a, hi_a, lo_b, hi_b = lo_a[more], hi_a[more], lo_b[more], hi_b[more]
        if not len(lo_a):
            return cut_a, cut_b
        middle = (lo_a + hi_a - 2) // 2
        at_a, at_b = np.full(len(middle), -1), np.full(len(middle), -1)
        open_, step = np.arange(len(middle)), 0
        while len(open_):
            for probe in (middle[open_] + step,) if step == 0 else (middle[open_] + step, middle[open_] - step):
                inside = (at_a[open_] < 0) & (probe >= lo_a[open_]) & (probe < hi_a[open_] - 1)
                mine, probe = open_[inside], probe[inside]
                found = np.searchsorted(ends_b, ends_a[probe])
                hit = ends_b[found] == ends_a[probe]
                at_a[mine[hit]], at_b[mine[hit]] = probe[hit], found[hit]
            step += 1
            open_ = open_[(at_a[open_] < 0) & ((middle[open_] + step < hi_a[open_] - 1) | (middle[open_] - step >= lo_a[open_]))]
        has = at_a >= 0
        lo_a, hi_a, lo_b, hi_b, at_a, at_b = (x[has] for x in (lo_a, hi_a, lo_b, hi_b, at_a, at_b))
        cut_a[at_a] = cut_b[at_b] = True
        lo_a, hi_a = np.stack([lo_a, at_a + 1], 1).ravel(), np.stack([at_a + 1, hi_a], 1).ravel()
        lo_b, hi_b = np.stack([lo_b, at_b + 1], 1).ravel(), np.stack([at_b + 1, hi_b], 1).ravel()


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), then the same for the next."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def align(coded: list[tuple[np.ndarray, np.ndarray]], tok: Tokenizers) -> dict:
    """Groups and links of documents: counts and digest of each, and (document, pair, occurrences) of each distinct pair, by document."""
    size_a, size_b = (np.array([len(x[k]) for x in coded], np.int64) for k in (0, 1))
    first_a, first_b = np.r_[0, np.cumsum(size_a)], np.r_[0, np.cumsum(size_b)]
    none = np.zeros(0, np.int64)
    a, b = (np.concatenate([none, *[x[k] for x in coded]]) for k in (0, 1))
    cut_a, cut_b = shared_cuts(np.cumsum(tok.len_a[a]), np.cumsum(tok.len_b[b]), first_a, first_b)
    last_a, last_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
    start_a, start_b = np.r_[0, last_a[:-1] + 1][: len(last_a)], np.r_[0, last_b[:-1] + 1][: len(last_b)]
    many_a, many_b = last_a - start_a + 1, last_b - start_b + 1
    doc = np.searchsorted(first_a, start_a, "right") - 1
    n_groups = np.bincount(doc, minlength=len(coded))
    n_links = np.zeros(len(coded), np.int64)
    np.add.at(n_links, doc, many_a * many_b)

    # every token's text, those of A before those of B in each group
    group_a, group_b = np.repeat(np.arange(len(many_a)), many_a), np.repeat(np.arange(len(many_b)), many_b)
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + start_b[group_a]] = a + tok.n_a * cut_a
    order[np.arange(len(b)) + last_a[group_b] + 1] = 2 * tok.n_a + b + tok.n_b * cut_b
    signs = tok.signs[order]
    used = signs != 0
    ends = np.r_[0, np.cumsum(used.sum(1))][first_a + first_b]
    text = signs[used].tobytes()
    groups = [hashlib.sha256(text[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]

    listed = many_a * many_b <= LISTED
    mine = listed[group_a]
    width = many_b[group_a[mine]]
    pair = np.repeat(a[mine], width) * tok.n_b + b[_spread(start_b[group_a[mine]], width)]
    keys, times = np.unique(np.repeat(doc[group_a[mine]], width) * (tok.n_a * tok.n_b) + pair, return_counts=True)
    for g in np.flatnonzero(~listed).tolist():
        (x, nx), (y, ny) = (np.unique(s[lo : hi + 1], return_counts=True) for s, lo, hi in ((a, start_a[g], last_a[g]), (b, start_b[g], last_b[g])))
        keys = np.r_[keys, doc[g] * (tok.n_a * tok.n_b) + (x[:, None] * tok.n_b + y).ravel()]
        times = np.r_[times, (nx[:, None] * ny).ravel()]
    if not listed.all():
        keys, where = np.unique(keys, return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, where, times)
        times = total
    return {"n_a": size_a, "n_b": size_b, "n_groups": n_groups, "n_links": n_links, "groups": groups,
            "doc": keys // (tok.n_a * tok.n_b), "pair": keys % (tok.n_a * tok.n_b), "times": times}


def _shrunk(x: np.ndarray) -> bytes:
    """32-bit numbers as compressed planes of bytes."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _grown(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _segment(name: int, ids: list, slices: list[dict]) -> pa.RecordBatch:
    """The row of one segment: its documents, its dictionary of pairs, and each document's codes into it as rising steps."""
    joined = {k: np.concatenate([s[k] for s in slices]) for k in ("n_a", "n_b", "n_groups", "n_links", "pair", "times")}
    before = np.cumsum([0] + [len(s["groups"]) for s in slices])
    doc = np.concatenate([s["doc"] + k for s, k in zip(slices, before)])
    pairs, codes, docs = np.unique(joined["pair"], return_inverse=True, return_counts=True)
    steps = np.diff(codes, prepend=0)
    starts = np.r_[True, doc[1:] != doc[:-1]][: len(doc)]
    steps[starts] = codes[starts]
    cells = [name, ids, *[joined[k] for k in ("n_a", "n_b", "n_groups", "n_links")], [g for s in slices for g in s["groups"]],
             np.bincount(doc, minlength=before[-1]), _shrunk(steps), _shrunk(joined["times"]), pairs, docs]
    kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names=[c.split()[0] for c in _SEGMENTS.split(", ")])


def segments(docs: DataFrame, ranks: str, pattern: str, pieces: str, slice_chars: int = SLICE, segment_chars: int = SEGMENT) -> DataFrame:
    """``docs(doc_id, text)`` aligned: one row for the documents of about ``segment_chars`` of text, a longer document having its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(ranks, pattern, pieces)
        name, ids, slices, held, coded, fresh = TaskContext.get().partitionId() << 32, [], [], 0, [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                text = text.as_py()
                ids.append(doc_id)
                coded.append(tok.encode(text))
                fresh += len(text or "") + 1
                if fresh >= slice_chars:
                    slices.append(align(coded, tok))
                    held, coded, fresh = held + fresh, [], 0
                if held >= segment_chars:
                    yield _segment(name, ids, slices)
                    name, ids, slices, held = name + 1, [], [], 0
        if ids:
            yield _segment(name, ids, slices + [align(coded, tok)] if coded else slices)

    return docs.select("doc_id", "text").mapInArrow(run, _SEGMENTS)


def _scored(_, mine: pa.Table, counts: pa.Table) -> pa.Table:
    """One segment and the corpus-wide counts of its dictionary -> its documents' rows."""
    row = {k: v[0] for k, v in mine.to_pydict().items() if k not in ("doc_ids", "groups")}
    order = counts["pair"].to_numpy().argsort()
    n, best = counts["n"].to_numpy()[order], counts["best"].to_numpy(zero_copy_only=False)[order]
    sizes = np.array(row["sizes"], np.int64)
    ends = np.r_[0, np.cumsum(sizes)]
    codes = np.cumsum(_grown(row["codes"]).astype(np.int64))
    some = sizes > 0
    codes -= np.repeat(np.r_[0, codes][ends[:-1]], sizes)
    times = _grown(row["times"]).astype(np.int64)
    sums = {k: np.zeros(len(sizes), np.int64) for k in ("n_best", "count_sum")}
    if some.any():
        for k, v in (("n_best", times * best[codes]), ("count_sum", times * n[codes])):
            sums[k][some] = np.add.reduceat(v, ends[:-1][some])
    flat = lambda c: mine[c].combine_chunks().flatten()
    return pa.table({"doc_id": flat("doc_ids"), **{k: flat(k) for k in ("n_a", "n_b", "n_groups", "n_links")}, **sums, "groups_sha256": flat("groups")})


def pair_counts(parts_: DataFrame, n_b: int) -> DataFrame:
    """``(pair, n, best)``: the documents that hold a pair linked, and whether no pair of the same id of A has more."""
    counts = settled(parts_.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("n")))
    side = F.floor(F.col("pair") / F.lit(n_b)).alias("a")
    most = counts.groupBy(side).agg(F.max("n").alias("most"))
    return counts.select("pair", "n", side).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align_tokens(docs: DataFrame, ranks: str, pattern: str, pieces: str, slice_chars: int = SLICE, segment_chars: int = SEGMENT) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, one row per row.

    A is the byte-level vocabulary of the rank file ``ranks`` with ``pattern``, B the
    sentencepiece model ``pieces``; both read a space and the text, special tokens'
    strings being plain text. Null and empty texts, and those of which either side's
    tokens stand for other bytes (B replaces some characters), have no tokens: zeros and
    an empty digest. Every row counts as a document, repeated rows too; null ids stay
    null; extra columns are ignored; an empty table gives an empty result.
    """
    aligned = settled(segments(docs, ranks, pattern, pieces, slice_chars, segment_chars))
    counts = settled(pair_counts(aligned, tokenizers(ranks, pattern, pieces).n_b))
    back = aligned.select("segment", F.explode("pairs").alias("pair")).join(counts, "pair").select(F.col("segment").alias("part"), "pair", "n", "best")
    kept = aligned.drop("pairs", "docs")
    return kept.groupBy("segment").cogroup(back.groupBy("part")).applyInArrow(_scored, _ROWS)
