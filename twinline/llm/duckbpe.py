"""Byte-level BPE by recursive queries of an in-process DuckDB, one for each Python worker.

The words of a batch that are not known yet become rows (word, position, token). Each row
also carries the position and the token that follow it. A recursive query joins these pairs
to the merge table and contracts each word's leftmost pair of least rank until no pair
is left; an ordered aggregation then lists the ids and puts together the bytes they stand for.

A pair is contracted to its right: the row on the left goes, the one on the right becomes the
token of both and keeps what follows it, and the row before them is told of both. So
a round takes hash joins only, no sort. If no token made of the new one ranks lower than
it, every place of the pair in the word is contracted in the same round, as the leftmost would
be round after round. A word that is a token itself starts, and ends, as one row.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from twinline.llm.common import map_batches

#: Words kept with their ids by one worker in either of two generations: those used since the last turn, and before. Bytes of new words that one query takes, and texts that are split at a time.
HELD, QUERY_BYTES, TEXTS = 600_000, 4 << 20, 2048

# Positions count through all words of a query, so one number tells a row. ``pair`` is the id that a row's token and
# the next make, twice, and one more where a lower rank may come of it: the least is the least rank. The places taken:
# all of the pair or the first; of a pair that repeats one token, every second place of a run of them.
_TAKEN = """
  SELECT p, q, pair >> 1 AS id FROM live WHERE pair = b >> 32 AND CASE WHEN pair & 1 = 1 THEN p = b & 4294967295 ELSE t <> r END
  UNION ALL
  SELECT p, q, pair >> 1 FROM (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY p) % 2 = 1 AS odd FROM (
    SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY w ORDER BY p) AS run FROM (
      SELECT *, coalesce(pair = b >> 32, false) AS hit FROM live SEMI JOIN (SELECT w FROM live WHERE pair = b >> 32 AND pair & 1 = 0 AND t = r) same ON same.w = live.w))
    WHERE hit) WHERE odd"""
_CONTRACTED = f"""
WITH RECURSIVE step(w, p, t, q, r, pair, n) AS (
  SELECT w, p, t, q, start.r, pair, 0 FROM start LEFT JOIN merges ON merges.l = t AND merges.r = start.r
  UNION ALL
  (WITH best AS MATERIALIZED (SELECT w, min(pair::BIGINT << 32 | p) AS b FROM step WHERE pair IS NOT NULL GROUP BY w),
        live AS MATERIALIZED (SELECT s.*, b FROM step s JOIN best ON best.w = s.w),
        taken AS MATERIALIZED ({_TAKEN}),
        moved AS MATERIALIZED (SELECT s.w, s.p, coalesce(mine.id, s.t) AS t, coalesce(after.q, s.q) AS q, coalesce(after.id, s.r) AS r, s.pair, s.n + 1 AS n,
                                      mine.id IS NOT NULL OR after.id IS NOT NULL AS fresh
                               FROM live s LEFT JOIN taken mine ON mine.q = s.p LEFT JOIN taken after ON after.p = s.q WHERE NOT EXISTS (SELECT 1 FROM taken gone WHERE gone.p = s.p))
   SELECT w, p, t, q, r, pair, n FROM moved WHERE NOT fresh
   UNION ALL SELECT w, p, t, q, m.r, merges.pair, n FROM moved m LEFT JOIN merges ON merges.l = m.t AND merges.r = m.r WHERE fresh))
SELECT step.w, list(t ORDER BY p) AS ids, string_agg(v.chars, '' ORDER BY p) AS chars
FROM step JOIN (SELECT w, max(n) AS n FROM step GROUP BY w) last ON last.w = step.w AND last.n = step.n JOIN vocabulary v ON v.id = t GROUP BY step.w ORDER BY step.w"""
#: A word that is in the vocabulary is one row; any other has a row for each byte.
_START = """
CREATE OR REPLACE TEMP TABLE start AS
WITH whole AS MATERIALIZED (SELECT given.w, given.p, v.id FROM given JOIN vocabulary v ON v.chars = given.chars)
SELECT w, p, id AS t, NULL::INTEGER AS q, NULL::INTEGER AS r FROM whole
UNION ALL
SELECT b.w, b.p, b.t, CASE WHEN b.r IS NOT NULL THEN b.p + 1 END, b.r FROM given_bytes b ANTI JOIN whole ON whole.w = b.w"""


def merge_table(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(left id, right id, id of both together) for every way to cut a token in two tokens."""
    return [(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]


class Codec:
    """Encodes and decodes words by DuckDB queries; keeps those it has seen."""

    def __init__(self, path: str, memory: str = "400MB"):
        import duckdb

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        merges = merge_table(self.ranks)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": memory})
        early = {x for left, right, i in merges for x in (left, right) if x > i}  # a pair with one of these may rank lower than it
        ids = [m[2] for m in merges]
        self._give("merges", {"l": pa.array([m[0] for m in merges], pa.int32()), "r": pa.array([m[1] for m in merges], pa.int32()),
                              "pair": pa.array([2 * i + (i in early) for i in ids], pa.int32())})
        self._give("vocabulary", {"id": pa.array(list(self.ranks.values()), pa.int32()), "chars": pa.array([t.decode("latin-1") for t in self.ranks])})
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.before: dict[str, tuple[bytes, bytes]] = {}

    def _give(self, name: str, columns: dict) -> None:
        self.db.register("handed", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM handed")
        self.db.unregister("handed")

    def _contract(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        sizes = np.array([len(w) for w in raw])
        last, names = np.cumsum(sizes), np.arange(len(raw), dtype=np.int32)
        token = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        ends = np.zeros(len(token), bool)
        ends[last - 1] = True
        self._give("given", {"w": pa.array(names), "p": pa.array((last - sizes).astype(np.int32)), "chars": pa.array([w.decode("latin-1") for w in raw])})
        self._give("given_bytes", {"w": pa.array(np.repeat(names, sizes)), "p": pa.array(np.arange(len(token), dtype=np.int32)), "t": pa.array(token),
                                   "r": pa.array(np.r_[token[1:], token[:1]], mask=ends)})
        self.db.execute(_START)
        table = self.db.sql(_CONTRACTED).to_arrow_table()
        lists = table["ids"].combine_chunks()
        flat = lists.flatten().to_numpy().astype("<u4").tobytes()
        begin = 0
        for w, end, text in zip(words, (np.cumsum(lists.value_lengths().to_numpy()) * 4).tolist(), table["chars"].to_pylist()):
            self.known[w] = (flat[begin:end], text.encode("latin-1"))
            begin = end

    def learn(self, words: list[str]) -> None:
        """Encode and decode distinct, non-empty words that are not known yet."""
        some, size = [], 0
        for w in words:
            some.append(w)
            size += len(w)
            if size >= QUERY_BYTES:
                self._contract(some)
                some, size = [], 0
        if some:
            self._contract(some)

    def code(self, texts: list[list[str]]) -> list[tuple[bytes, bytes]]:
        """Ids (little-endian, 32 bits each) and decoded bytes of texts given as lists of words."""
        if len(self.known) > HELD:
            self.before, self.known = self.known, {}
        known, before, new = self.known, self.before, []
        for w in {w for words in texts for w in words}.difference(known):
            if w in before:
                known[w] = before[w]
            else:
                new.append(w)
        self.learn(new)
        return [(b"".join([known[w][0] for w in words]), b"".join([known[w][1] for w in words])) for words in texts]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_tokens, ids binary, decoded binary)``, one row per row.

    Each match of ``pattern`` in a text is encoded separately by the rank file at
    ``path``. A null or empty text has no ids. Repeated rows give repeated rows; extra
    columns are ignored; an empty table gives an empty result.
    """
    def rows(batch: pa.RecordBatch) -> dict:
        import regex

        split = regex.compile(pattern)
        coded = codec(path).code([split.findall(t or "") for t in batch["text"].to_pylist()])
        return {"doc_id": batch["doc_id"], "n_tokens": [len(i) // 4 for i, _ in coded], "ids": [i for i, _ in coded], "decoded": [d for _, d in coded]}

    return map_batches(docs.select("doc_id", "text"), rows, "doc_id long, n_tokens long, ids binary, decoded binary", TEXTS)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encode_decode`` with the SHA-256 of ids and decoded bytes in place of both (see there for the cases)."""
    def rows(batch: pa.RecordBatch) -> dict:
        import regex

        split = regex.compile(pattern)
        coded = codec(path).code([split.findall(t or "") for t in batch["text"].to_pylist()])
        return {"doc_id": batch["doc_id"], "n_tokens": [len(i) // 4 for i, _ in coded], "ids_sha256": [hashlib.sha256(i).hexdigest() for i, _ in coded],
                "decoded_sha256": [hashlib.sha256(d).hexdigest() for _, d in coded]}

    return map_batches(docs.select("doc_id", "text"), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", TEXTS)
