"""Linking of tool calls and their results, from DataFrame functions only.

Calls and results are hash-joined by conversation and identifier, calls are ordered
after the calls that they follow, their arguments are validated against the schema of
their tool, and each call is serialised with its result as canonical JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinline.llm.common import settled

_KEY = ["conv_id", "call_id"]


def canonical(text: str | Column) -> Column:
    """Canonical JSON of a JSON text: keys sorted at every level, no white space; null where it isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def _first(rows: DataFrame, *order: str) -> DataFrame:
    """The first row of each (conv_id, call_id) by ``order``, and ``n``: the number of rows it stands for."""
    rest = [c for c in rows.columns if c not in _KEY]
    got = rows.groupBy(*_KEY).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"), F.count(F.lit(1)).alias("n"))
    return got.select(*_KEY, "r.*", "n")


def depths(calls: DataFrame) -> DataFrame:
    """``calls(conv_id, call_id, after)`` -> ``(conv_id, call_id, depth)``: calls that come before, -1 on a cycle or behind one.

    Every call follows one call at most, so pointers are doubled: the rounds grow with
    the logarithm of the longest chain, each is a join by identifier and is written to
    the shared folder, and a conversation is never gathered.
    """
    known = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("known"))
    now = calls.join(known, ["conv_id", "after"], "left").select(
        *_KEY, F.when(F.col("known"), F.col("after")).alias("next"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("depth"))
    now = settled(now)
    still = now.where("next IS NOT NULL").count()
    while still:
        ahead = now.select("conv_id", F.col("call_id").alias("next"), F.col("next").alias("further"), F.col("depth").alias("more"))
        now = settled(now.join(ahead, ["conv_id", "next"], "left").select(
            *_KEY, F.col("further").alias("next"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
        left = now.where("next IS NOT NULL").count()
        if left == still:  # only cycles and what hangs on them never come to an end
            break
        still = left
    return now.select(*_KEY, F.when(F.col("next").isNull(), F.col("depth")).otherwise(-1).alias("depth"))


def faults(arguments: Column, fields: Column, closed: Column) -> Column:
    """Sorted list of what is wrong with ``arguments`` (JSON text).

    ``fields``: array of (name, type, required); types are those of JSON Schema without
    null. ``closed`` forbids other names.
    """
    given = F.try_variant_get(F.try_parse_json(arguments), "$", "map<string,variant>")
    kind = lambda v: F.schema_of_variant(v)
    is_type = lambda v, t: (F.when(t == "string", kind(v) == "STRING").when(t == "boolean", kind(v) == "BOOLEAN")
                            .when(t == "integer", kind(v) == "BIGINT").when(t == "number", kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"))
                            .when(t == "array", kind(v).startswith("ARRAY")).when(t == "object", kind(v).startswith("OBJECT")).otherwise(F.lit(True)))
    missing = F.transform(F.filter(fields, lambda f: f["required"] & ~F.array_contains(F.map_keys(given), f["name"])), lambda f: F.concat(F.lit("missing:"), f["name"]))
    wrong = F.transform(F.filter(fields, lambda f: F.coalesce(~is_type(F.element_at(given, f["name"]), f["type"]), F.lit(False))), lambda f: F.concat(F.lit("type:"), f["name"]))
    names = F.transform(fields, lambda f: f["name"])
    extra = F.when(closed, F.transform(F.array_except(F.map_keys(given), names), lambda k: F.concat(F.lit("unknown:"), k))).otherwise(F.array().cast("array<string>"))
    return F.when(given.isNull(), F.array(F.lit("not an object"))).otherwise(F.array_sort(F.concat(missing, wrong, extra)))


def _json() -> Column:
    # keys in order, no white space; arguments that aren't JSON are kept as a text
    text = lambda c: F.regexp_extract(F.to_json(F.struct(F.coalesce(F.col(c).cast("string"), F.lit("")).alias("v"))), r'^\{"v":([\s\S]*)\}$', 1)
    null = F.lit("null")
    value = lambda c: F.when(F.col(c).isNull(), null).otherwise(text(c))
    return F.concat(F.lit('{"arguments":'), F.coalesce(canonical("arguments"), value("arguments")), F.lit(',"id":'), value("call_id"),
                    F.lit(',"name":'), value("name"), F.lit(',"result":'), value("content"), F.lit("}"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each call, and for each result without one.

    ``calls(conv_id, call_id, turn, name, arguments, after)`` with arguments as JSON text
    and ``after``: the identifier of the call it follows, or null. ``results(conv_id,
    call_id, turn, content)``. ``schemas(name, closed, fields)``, one row for each tool.

    Returns ``(conv_id, call_id, depth, turn, name, status, faults, json)``; (depth, turn,
    call_id) is a topological order within a conversation. Of calls, and of results, that
    share an identifier the first by turn, then content counts, and ``repeats`` tells
    how many were there. A call after an unknown call starts a chain. Status: ``linked``,
    ``unanswered``, ``early`` (the result's turn is before the call's), ``invalid`` (faults),
    ``unknown tool``, ``cycle`` (depth -1) or ``orphan`` (a result without a call; depth
    null). Null identifiers never match. Extra columns are ignored; empty tables give an
    empty result. ``link_log`` adds the other calls and results of an identifier.
    """
    calls = calls.select("conv_id", "call_id", "turn", "name", "arguments", "after")
    results = results.select("conv_id", "call_id", "turn", "content")
    first = _first(calls, "turn", "name", "arguments", "after")
    answer = _first(results, "turn", "content").select(*_KEY, F.col("turn").alias("result_turn"), "content", F.col("n").alias("result_n"))
    first = settled(first.where("conv_id IS NOT NULL AND call_id IS NOT NULL").unionByName(
        calls.where("conv_id IS NULL OR call_id IS NULL").withColumn("n", F.lit(1).cast("long"))))
    sound = first.where("conv_id IS NOT NULL AND call_id IS NOT NULL")
    tools = schemas.select("name", "closed", "fields", F.lit(True).alias("is_tool"))
    rows = (first.join(answer, _KEY, "full").join(depths(sound), _KEY, "left").join(tools, "name", "left"))
    is_call = F.col("n").isNotNull()
    rows = rows.withColumn("faults", F.when(is_call & F.col("is_tool"), faults(F.col("arguments"), F.col("fields"), F.col("closed"))))
    status = (F.when(~is_call, "orphan").when(F.col("is_tool").isNull(), "unknown tool").when(F.size("faults") > 0, "invalid").when(F.col("depth") < 0, "cycle")
              .when(F.col("result_n").isNull(), "unanswered").when(F.col("result_turn") < F.col("turn"), "early").otherwise("linked"))
    return rows.select("conv_id", "call_id", "depth", F.coalesce("turn", "result_turn").alias("turn"), "name", status.alias("status"),
                       F.array_join("faults", ",").alias("faults"), F.coalesce(F.col("n"), F.lit(0)).alias("repeats"), _json().alias("json"))


def _further(rows: DataFrame, *order: str) -> DataFrame:
    """The distinct rows of each (conv_id, call_id) after the first by ``order``, and ``n``: how often each is there."""
    each = settled(rows.groupBy(*_KEY, F.struct(*order).alias("r")).agg(F.count(F.lit(1)).alias("n")))
    firsts = each.groupBy(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call")).agg(F.min("r").alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("call_id").eqNullSafe(F.col("_call"))
    return each.join(firsts, same).where(~F.col("r").eqNullSafe(F.col("first"))).select(*_KEY, "r.*", "n")


def link_log(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """The rows of ``link_calls``, and one for each further distinct call and result of an identifier.

    These have status ``repeated`` (results of a null identifier: ``orphan``), no depth and
    no faults; ``repeats`` tells how often the row is there. A call's has no result, and a
    result's no name or arguments.
    """
    linked = link_calls(calls, results, schemas)
    more = _further(calls.select(*_KEY, "turn", "name", "arguments", "after").where("conv_id IS NOT NULL AND call_id IS NOT NULL"), "turn", "name", "arguments", "after")
    more = more.unionByName(_further(results.select(*_KEY, "turn", "content"), "turn", "content"), allowMissingColumns=True)
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    return linked.unionByName(more.select("conv_id", "call_id", F.lit(None).cast("long").alias("depth"), "turn", "name", F.when(known, "repeated").otherwise("orphan").alias("status"),
                                          F.lit(None).cast("string").alias("faults"), F.col("n").alias("repeats"), _json().alias("json")))
