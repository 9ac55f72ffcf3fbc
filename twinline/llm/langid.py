"""Language identification by a byte convolutional network.

Filters of several widths slide over the bytes of a text, each filter keeps its
maximum inside every window of fixed length, and a softmax layer reads these maxima.
The network is trained with numpy on windows of labelled texts; applied, it sees
every window of a text, and a text's log-probabilities are the sums of its windows'.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinline.llm.common import as_bytes, give_back, id_crc

#: Bytes in a window, widths of the filters, filters of each width.
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 12
#: Most labelled windows of one language, and of all, that the driver trains on; every language has one at least.
PER_LANG, WINDOWS = 1500, 64 * 1500


@dataclass
class ByteNet:
    langs: list[str]
    tables: list[np.ndarray]  # for each width (width, 256, filters)
    out: np.ndarray
    bias: np.ndarray

    def maxima(self, stream: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """``stream``: bytes of whole windows plus max(WIDTHS) - 1 bytes; the maxima of each window and where they are.

        ``ends`` tells where texts end: a filter sees zeros behind the end, not the next text.
        """
        n = len(stream) - max(WIDTHS) + 1
        ahead = [stream[:n]]
        for j in range(1, max(WIDTHS)):
            bytes_ = stream[j : j + n].copy()
            bytes_[(ends[:, None] - np.arange(1, j + 1)).ravel()] = 0
            ahead.append(bytes_)
        tops, where = [], []
        for t in self.tables:
            act = t[0][ahead[0]]
            for j in range(1, len(t)):
                act += t[j][ahead[j]]
            act = act.reshape(n // WINDOW, WINDOW, -1)
            at = act.argmax(1) if self.trains else None
            tops.append(act.max(1) if at is None else np.take_along_axis(act, at[:, None], 1)[:, 0])
            where.append(at)
        return np.maximum(np.concatenate(tops, 1), 0), where

    trains = False

    def log_probs(self, stream: np.ndarray, ends: np.ndarray) -> np.ndarray:
        z = self.maxima(stream, ends)[0] @ self.out + self.bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def _padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % WINDOW)


def _stream(texts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(_padded, texts)) + bytes(max(WIDTHS) - 1), np.uint8)


def train(samples: list[tuple[str, bytes]], epochs: int = 6, seed: int = 7) -> ByteNet | None:
    """Fit the network to (language, window) pairs; None without samples.

    Every second pass cuts the windows to a random length, so that short texts are known too.
    """
    if not samples:
        return None
    rng = np.random.default_rng(seed)
    langs = sorted({k for k, _ in samples})
    y = np.array([langs.index(k) for k, _ in samples])
    net = ByteNet(langs, [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
                  rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))
    net.trains = True
    params = [*net.tables, net.out, net.bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = len(y) / (len(langs) * np.bincount(y))
    for epoch in range(epochs):
        order = rng.permutation(len(samples))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            texts = [samples[i][1][:WINDOW] for i in pick]
            if epoch % 2:
                texts = [t[: int(rng.integers(8, WINDOW + 1))] for t in texts]
            stream = _stream([t or b" " for t in texts])
            h, where = net.maxima(stream, np.arange(1, len(pick) + 1) * WINDOW)
            z = h @ net.out + net.bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p *= weight[y[pick]][:, None] / len(pick)
            back = (p @ net.out.T) * (h > 0)
            grads = []
            base = np.arange(len(pick))[:, None] * WINDOW
            for k, w in enumerate(WIDTHS):
                g = np.zeros_like(net.tables[k])
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    seen = np.where(where[k] + j < WINDOW, stream[base + where[k] + j], 0)
                    np.add.at(g[j], (seen, np.arange(FILTERS)[None]), part)
                grads.append(g)
            grads += [h.T @ p, p.sum(0)]
            step += 1
            for q, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.trains = False
    return net


def labelled_windows(docs: DataFrame, per_lang: int = PER_LANG, windows: int = WINDOWS) -> list[tuple[str, bytes]]:
    """At most ``per_lang`` labelled windows of each language, fewer where all share ``windows``, chosen by hash.

    Only rows that may be learned from; each gives the window at a hash-chosen place of its text.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (id_crc("doc_id") % 4 != 2))
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return []
    per_lang = max(1, min(per_lang, windows // len(counts)))
    wanted = max(1.5 * per_lang, per_lang + 32.0)  # enough that no language is left without a window by chance
    shares = docs.sparkSession.createDataFrame([(r.lang, min(1.0, wanted / r["count"])) for r in counts], "lang string, share double")
    mixed = F.xxhash64("doc_id", F.lit("window"))
    chosen = rows.join(F.broadcast(shares), "lang").where(F.pmod(mixed, F.lit(1_000_000)) < F.col("share") * 1_000_000)
    start = F.pmod(F.shiftright(mixed, 20), F.greatest(F.length("text") - WINDOW // 2, F.lit(1))) + 1
    some = chosen.select("lang", F.expr("text").substr(start.cast("int"), F.lit(WINDOW)).alias("w"), mixed.alias("h"))
    # bounded for each language, so that none crowds out another
    got = some.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("h", "w"))).where(F.col("at") <= per_lang).drop("at").collect()
    out: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r.h, r.w)):
        out.setdefault(r.lang, []).append(r.w.encode())
    return [(k, w) for k in sorted(out) for w in out[k]]


def tell(texts: list[bytes], net: ByteNet) -> tuple[list[str], np.ndarray]:
    """Language and its probability for each text, from all windows of the text."""
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    held: list[int] = []

    def close():
        windows = [-(-len(texts[i]) // WINDOW) for i in held]
        owner, last = np.repeat(np.arange(len(held)), windows), np.cumsum(windows)
        total = np.zeros((len(held), len(net.langs)))
        stream = _stream([texts[i] for i in held])
        for at in range(0, len(owner), 512):
            to = min(len(owner), at + 512)
            ends = last[(last > at) & (last <= to)] - at
            np.add.at(total, owner[at:to], net.log_probs(stream[at * WINDOW : to * WINDOW + max(WIDTHS) - 1], ends * WINDOW))
        p = np.exp(total - total.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for k, i in enumerate(held):
            langs[i], scores[i] = net.langs[int(p[k].argmax())], float(p[k].max())
        held.clear()

    size = 0
    for i, t in enumerate(texts):
        if t:
            held.append(i)
            size += len(t)
        if size > 1 << 19:
            close()
            size = 0
    if held:
        close()
    return langs, scores


def told(net: ByteNet | None):
    """Column ``struct(lang_pred, score)`` of the column ``text``.

    ``und`` with score 0 for a null text, one without a letter, or without a trained
    network. ``score`` is the probability of the language that is returned.
    """
    if net is None:
        return F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def udf(text: pa.Array) -> pa.Array:
        langs, scores = [], []
        for at in range(0, len(text), 1024):
            some = tell([t or b"" for t in as_bytes(text.slice(at, 1024))], net)
            langs += some[0]
            scores += some[1].tolist()
        give_back()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return udf(F.when(F.col("text").rlike(r"\p{L}"), F.col("text")))


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row of ``docs(doc_id, text, lang, ...)``.

    Learns from rows with a language whose crc32 of the id modulo 4 is not 2; a row
    with a null id is predicted, never learned from and not held out. Repeated rows
    are predicted alike; an empty table gives an empty result; extra columns are ignored.
    """
    net = train(labelled_windows(docs.select("doc_id", "text", "lang"), per_lang))
    return (docs.select("doc_id", told(net).alias("told"))
            .select("doc_id", F.coalesce(id_crc("doc_id") % 4 == 2, F.lit(False)).alias("held_out"), "told.lang_pred", "told.score"))


def keep_known(docs: DataFrame, per_lang: int = PER_LANG, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is told with a score of ``least`` or more; texts without letters go."""
    net = train(labelled_windows(docs.select("doc_id", "text", "lang"), per_lang))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), told(net).alias("told"))
    return held.where((F.col("told.lang_pred") != "und") & (F.col("told.score") >= least)).select("row.*")
