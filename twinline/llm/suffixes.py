"""Repeated passages through hash-grouped suffixes at minimisers.

Only suffixes that start at a minimiser are kept: in every run of ``SPAN`` word
positions the one whose ``PREFIX``-word hash is smallest. Any two equal passages of
``PREFIX + SPAN - 1`` words keep the same suffix. There is no ordered suffix array:
suffixes are grouped by the hash of their prefix instead of sorted, members of a group
from different documents are compared by the hash of the whole context in which they are
the minimiser, and where contexts differ, each passage of the context is looked up by
its hash in place of extending a match to the left and right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinline.llm.common import as_bytes, settled

#: A passage has this many words; suffixes are compared by their first PREFIX words.
PASSAGE, PREFIX = 50, 16
SPAN = PASSAGE - PREFIX + 1

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    held = _POWERS.get(int(base))
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 14), base, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if n <= 1 << 20:  # longer ones are not kept
            _POWERS[int(base)] = held
    return held[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each range of 64-bit values, equal for equal ranges."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(_BASE, n), out=sums[1:])
    back = _powers(_INVERSE, n + 1)
    return _mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte and hash of each word (anything but ASCII white space)."""
    raw = np.frombuffer(text, np.uint8)
    gap = np.r_[True, _SPACE[raw], True]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    return starts, ends, _ranges(raw.astype(np.uint64) + np.uint64(1), starts, ends)


def _least(values: np.ndarray, n: int, op) -> np.ndarray:
    """``op`` over each run of ``n`` values, by doubling."""
    done = 1
    while done < n:
        step = min(done, n - done)
        values = op(values[:-step], values[step:])
        done += step
    return values


def contexts(hashes: np.ndarray, passage: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of passages that have the same minimiser: (suffix hash, hash of the run's words, first passage, last passage)."""
    none = np.zeros(0, np.int64)
    if len(hashes) < passage:
        return none.view(np.uint64), none.view(np.uint64), none, none
    at = np.arange(len(hashes) - prefix + 1)
    grams = _ranges(hashes, at, at + prefix)
    span = passage - prefix + 1
    least = _least(grams, span, np.minimum)  # smallest suffix hash of the passage that starts at each word
    starts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    ends = np.r_[starts[1:], len(least)]
    whole = _ranges(hashes, starts, ends - 1 + passage)
    return least[starts], whole, starts, ends - 1


_SUFFIX = "doc_id long, doc long, suffix long, run long"
_FOUND = "doc_id long, doc long, at long, to long, first_byte long, end_byte long, passage long, looked_up boolean"


def _suffix_rows(passage: int, prefix: int):
    """(doc_id, doc, text) -> distinct suffixes of each text with the context hash of their run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, keys, runs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for i, text in enumerate(as_bytes(batch["text"])):
                suffix, whole, _, _ = contexts(words(text or b"")[2], passage, prefix)
                if len(suffix):
                    first = np.unique(whole, return_index=True)[1]
                    owner.append(np.full(len(first), i))
                    keys.append(suffix[first])
                    runs.append(whole[first])
            at = pa.array(np.concatenate(owner))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(at), batch["doc"].take(at), pa.array(np.concatenate(keys).view(np.int64)),
                                              pa.array(np.concatenate(runs).view(np.int64))], names=["doc_id", "doc", "suffix", "run"])

    return run


def _passage_rows(passage: int, prefix: int):
    """(doc_id, doc, text, known, todo) -> the runs ``known`` as they are, and every single passage of the runs ``todo``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(6)]
            looked = [np.zeros(0, bool)]
            for i, (text, known, todo) in enumerate(zip(as_bytes(batch["text"]), batch["known"].to_pylist(), batch["todo"].to_pylist())):
                starts, ends, hashes = words(text or b"")
                _, whole, first, last = contexts(hashes, passage, prefix)
                whole = whole.view(np.int64)
                hit = np.isin(whole, np.array(known or [], np.int64))
                single = np.flatnonzero(np.isin(whole, np.array(todo or [], np.int64)))
                at = np.concatenate([first[hit], *(np.arange(first[k], last[k] + 1) for k in single)])
                to = np.concatenate([last[hit], at[hit.sum():]])
                key = np.zeros(len(at), np.int64)
                key[hit.sum():] = _ranges(hashes, at[hit.sum():], at[hit.sum():] + passage).view(np.int64)
                for x, v in zip(out, (np.full(len(at), i), at, to, starts[at], ends[to + passage - 1], key)):
                    x.append(v)
                looked.append(np.arange(len(at)) >= hit.sum())
            owner, *cols = (np.concatenate(x) for x in out)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(owner)), batch["doc"].take(pa.array(owner)), *map(pa.array, cols), pa.array(np.concatenate(looked))],
                                             names=["doc_id", "doc", "at", "to", "first_byte", "end_byte", "passage", "looked_up"])

    return run


_SPANS = "array<struct<first_word:long,n_words:long,first_byte:long,end_byte:long>>"


def _maximal(found: list[dict], passage: int) -> list[dict]:
    """The runs of one document joined into maximal spans."""
    out: list[dict] = []
    for f in sorted(found, key=lambda f: (f["at"], f["to"])):
        end = f["to"] + passage
        if out and f["at"] <= out[-1]["end"]:
            if end > out[-1]["end"]:
                out[-1] |= {"end": end, "end_byte": f["end_byte"]}
        else:
            out.append({"first_word": f["at"], "end": end, "first_byte": f["first_byte"], "end_byte": f["end_byte"]})
    return [{"first_word": s["first_word"], "n_words": s["end"] - s["first_word"], "first_byte": s["first_byte"], "end_byte": s["end_byte"]} for s in out]


def _without(text: bytes, cut: list[dict]) -> bytes:
    out, at = [], 0
    for s in cut:
        out.append(text[at : s["first_byte"]])
        at = s["end_byte"]
    return b"".join([*out, text[at:]]).strip(b" \t\n\r\x0b\x0c")


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with ``doc``: a key of (doc_id, text); rows alike in both are one document."""
    return docs.withColumn("doc", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull()))


def repeats(docs: DataFrame, passage: int = PASSAGE, prefix: int = PREFIX) -> DataFrame:
    """``docs(doc_id, doc, text)`` -> ``(doc_id, doc, spans)``: the maximal spans that earlier documents hold, where there are any.

    No list or pair of the documents of a passage is built: each suffix, run and
    passage is reduced to its earliest document before it is joined back.
    """
    if not 0 < prefix < passage:
        raise ValueError("the prefix must be shorter than the passage")
    docs = docs.select("doc_id", "doc", "text")
    place = F.struct("doc_id", "doc")
    rows = settled(docs.mapInArrow(_suffix_rows(passage, prefix), _SUFFIX))
    # reduced tables are written before a join, which can then split a hot suffix or passage over tasks
    shared = settled(rows.groupBy("suffix").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("suffix"))
    kept = settled(rows.join(shared, "suffix").select("suffix", "run", place.alias("place")))
    classes = kept.groupBy("suffix", "run").agg(F.min("place").alias("first"))
    several = classes.groupBy("suffix").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("suffix", F.lit(True).alias("several"))
    classes = settled(classes.join(several, "suffix", "left"))
    later = F.col("place") > F.col("first")
    # a run that an earlier document holds as a whole repeats; of the others only the first of each kind needs looking up
    plan = (kept.join(classes, ["suffix", "run"]).where(later | F.col("several")).groupBy(F.col("place.doc").alias("doc"))
            .agg(F.collect_set(F.when(later, F.col("run"))).alias("known"), F.collect_set(F.when(~later, F.col("run"))).alias("todo")))
    found = settled(docs.join(plan, "doc").select("doc_id", "doc", "text", "known", "todo").mapInArrow(_passage_rows(passage, prefix), _FOUND))
    spot = ["doc_id", "doc", "at", "to", "first_byte", "end_byte"]
    loose = found.where("looked_up").select(*spot, "passage", place.alias("place"))
    firsts = settled(loose.groupBy("passage").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last").select("passage", "first"))
    looked = loose.join(firsts, "passage").where("place > first").select(*spot)

    @F.arrow_udf(_SPANS)
    def joined(runs: pa.Array) -> pa.Array:
        return pa.array([_maximal(f, passage) for f in runs.to_pylist()],
                        pa.list_(pa.struct([(n, pa.int64()) for n in ("first_word", "n_words", "first_byte", "end_byte")])))

    every = found.where("NOT looked_up").select(*spot).unionByName(looked)
    runs = every.groupBy("doc_id", "doc").agg(F.collect_set(F.struct(*spot[2:])).alias("runs"))
    return runs.select("doc_id", "doc", joined("runs").alias("spans"))


def repeated_spans(docs: DataFrame, passage: int = PASSAGE, prefix: int = PREFIX) -> DataFrame:
    """``(doc_id, first_word, n_words, first_byte, end_byte)``: one row for each maximal span that repeats earlier documents.

    Earlier is the smaller (doc_id, hash of id and text); null ids come first. Rows
    alike in id and text are one document. A passage has ``passage`` words or more
    between ASCII white space, and must stand in another, earlier document; what a text
    repeats only within itself stays. A null or empty text, and one of fewer words, has
    no spans. Extra columns are ignored; an empty table gives an empty result.
    """
    return repeats(_keyed(docs.select("doc_id", "text")), passage, prefix).select("doc_id", F.inline("spans"))


def dedup_passages(docs: DataFrame, passage: int = PASSAGE, prefix: int = PREFIX) -> DataFrame:
    """``docs`` with every span that repeats an earlier document cut from its text; see ``repeated_spans`` for the cases.

    Columns beside ``text`` are passed on; a text of nothing but repeats becomes empty.
    """
    found = repeats(_keyed(docs.select("doc_id", "text")), passage, prefix).select("doc", "spans")
    rows = _keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")).join(found, "doc", "left")

    @F.arrow_udf("string")
    def rest(text: pa.Array, cut: pa.Array) -> pa.Array:
        return pa.array([_without(t, c) if c else t for t, c in zip(as_bytes(text), cut.to_pylist())], pa.binary()).cast(pa.string())

    return rows.select(F.col("row").withField("text", rest("text", "spans")).alias("row")).select("row.*")
