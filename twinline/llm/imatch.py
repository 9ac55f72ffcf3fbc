"""I-Match fingerprints from DataFrame functions only.

A lexicon keeps the terms whose inverse document frequency lies within a band. A
text is reduced to its distinct lexicon terms in order, and hashed once for each of
several randomised sublexicons. Their sampling rates fall in steps, so that long
texts, too, have sublexicons that an edit leaves alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinline.llm.common import settled

#: Share of all documents that hold a term: at least and at most, for terms of the band.
LEAST_SHARE, MOST_SHARE = 0.01, 0.2
#: Sublexicons as (first hex digit of the term's digest, digits used, values kept): 1/2, 1/4, 1/8, 1/16 and 1/64.
SUBLEXICONS = ([(1 + i, 1, 8) for i in range(3)] + [(4 + i, 1, 4) for i in range(3)] + [(7 + i, 1, 2) for i in range(3)]
               + [(10 + i, 1, 1) for i in range(3)] + [(13 + 2 * i, 2, 4) for i in range(4)])
#: Counters of the first pass over the terms.
COUNTERS = 1 << 18
#: A text with fewer terms of the lexicon than this is hashed over all its terms.
FEW = 4
#: Terms lie between these bytes: all of ASCII but digits and letters (fixed for the comparison SQL).
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    """Distinct terms of a text (null: none)."""
    return F.array_distinct(F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), ""))


def lexicon(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """``(term, n_docs)`` of all terms within the band, exact over all rows of ``docs``.

    A first pass counts terms by hash into a fixed number of counters; only terms
    whose counter reaches the band can be in it, and only they are counted by name.
    The band holds at most (mean distinct terms of a document) / ``least`` terms,
    whatever the number of documents.
    """
    n = docs.count()
    low, high = max(1.0, least * n), most * n
    slot = F.pmod(F.xxhash64("term"), F.lit(COUNTERS)).cast("int")
    each = docs.select(F.explode(terms(F.col("text"))).alias("term"))
    full = each.groupBy(slot.alias("slot")).count().where(F.col("count") >= low).select("slot")
    named = each.join(F.broadcast(full), slot == F.col("slot"), "left_semi")  # at most COUNTERS numbers, whatever the input
    return named.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs")).where((F.col("n_docs") >= low) & (F.col("n_docs") <= high))


def with_fingerprint(rows: DataFrame, text: str, name: str, words: list[str]) -> DataFrame:
    """``rows`` with an array of the sublexicon hashes of the column ``text``.

    A sublexicon that holds none of the text's terms gives an empty string. The steps
    are separate projections, so that each intermediate array is computed once.
    """
    others = [c for c in rows.columns if c != name]
    rows = rows.withColumn("_terms", terms(F.col(text)))
    listed = ", ".join(f"'{w}'" for w in words)  # terms hold no quotes or backslashes
    kept = F.expr(f"filter(_terms, t -> t IN ({listed}))") if words else F.array().cast("array<string>")
    rows = rows.withColumn("_kept", kept)
    chosen = F.array_sort(F.when(F.size("_kept") >= FEW, F.col("_kept")).otherwise(F.col("_terms")))
    rows = rows.withColumn("_digests", F.transform(chosen, lambda t: F.md5(t.cast("binary"))))
    held = []
    for at, digits, values in SUBLEXICONS:
        top = f"{values:0{digits}x}"
        held.append(F.concat_ws(",", F.filter("_digests", lambda d: F.substring(d, at, digits) < top)))  # noqa: B023
    rows = rows.select(*others, F.array(*held).alias("_held"))
    return rows.select(*others, F.transform("_held", lambda h: F.when(h != "", F.substring(F.md5(h.cast("binary")), 1, 16)).otherwise("")).alias(name))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the sublexicons that either text has terms of; 1 where neither has any."""
    used = F.zip_with(a, b, lambda x, y: F.when((x != "") | (y != ""), F.when(x == y, 1).otherwise(0)))
    used = F.filter(used, lambda v: v.isNotNull())
    return F.when(F.size(used) == 0, F.lit(1.0)).otherwise(F.aggregate(used, F.lit(0), lambda s, v: s + v) / F.size(used))


def with_next(docs: DataFrame, dress=lambda rows: rows, per_bucket: int = 2000, most_buckets: int = 1 << 16) -> DataFrame:
    """The rows ``dress(docs(doc_id, text))`` with ``next``: a struct of the next row's columns.

    Rows are ordered by (doc_id, text); after the last comes the first. Ids are cut into
    ranges of about ``per_bucket`` rows at quantiles, at most ``most_buckets`` of them; the window runs inside a
    range, and each range's last row takes the first row of the next range. The cuts are one literal array that
    each row bisects, so the plan is as large for any number of ranges. ``dress``
    adds columns to rows; it is applied to all rows and to the first rows of the ranges.
    """
    n = docs.count()
    count = min(max(1, -(-n // per_bucket)), most_buckets)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / count for i in range(1, count)], 10 * count).alias("c")).first().c if count > 1 else None
    bucket = _range_of(sorted(set(cuts or []))).alias("_bucket")
    heads = settled(docs.groupBy(bucket).agg(F.min(F.struct("doc_id", "text")).alias("h")).select("_bucket", "h.*"))
    rows = dress(docs)
    columns = rows.columns
    inside = rows.select("*", bucket).withColumn("_next", F.lead(F.struct(*columns)).over(Window.partitionBy("_bucket").orderBy("doc_id", "text")))
    # one number for each range: the range before it, and before the first the last
    order = Window.orderBy("_bucket")
    ends = heads.select("_bucket", F.lag("_bucket").over(order).alias("_ends"), F.max("_bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_last"))
    heads = heads.join(ends, "_bucket").withColumn("_ends", F.coalesce("_ends", "_last")).drop("_last")
    heads = dress(heads.select("doc_id", "text", "_ends")).select(F.col("_ends").alias("_bucket"), F.struct(*columns).alias("_head"))
    return inside.join(heads, "_bucket", "left").withColumn("next", F.coalesce("_next", "_head")).drop("_bucket", "_next", "_head")


def _range_of(cuts: list[int]) -> Column:
    """The number of cuts below ``doc_id``, by bisection; -1 for a null id."""
    if not cuts:
        return F.when(F.col("doc_id").isNull(), -1).otherwise(0).cast("long")
    held = F.from_json(F.lit(str(cuts)), "array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    below = lambda at, step: (at + step <= len(cuts)) & (F.get(held, at + step - 1) < F.col("doc_id"))
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(below(at, step), at + step).otherwise(at))
    return F.when(F.col("doc_id").isNull(), -1).otherwise(found).cast("long")


def imatch(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE, per_bucket: int = 2000) -> DataFrame:
    """Fingerprints of every text, of its half-edited form, and their likeness; one row per row of ``docs(doc_id, text, ...)``.

    A null text counts as empty. Rows are ordered by id, then text (null ids first);
    repeated rows are each other's next. Equal texts have equal fingerprints. Extra
    columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = sorted(r[0] for r in lexicon(docs, least, most).select("term").collect())  # bounded, see lexicon()
    rows = with_next(docs, lambda rows: with_fingerprint(rows, "text", "f", words), per_bucket)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("text").substr(F.lit(1), F.length("text") - half), F.col("next.text").substr(F.lit(1), half))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "f", F.col("next.f").alias("x"), edited.alias("edited"))
    rows = with_fingerprint(rows, "edited", "e", words)
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.array_join("f", "-").alias("fingerprint"),
                       F.array_join("e", "-").alias("edited_fingerprint"), likeness(F.col("f"), F.col("e")).alias("near_edited"),
                       likeness(F.col("f"), F.col("x")).alias("near_next"))
