"""Structured Streaming forms: status roll-up, latest state, live records, spaced pick, arrival matching.

Each function returns a streaming DataFrame; ``drain`` runs one through all
available input into a folder and reads it back. The stateful ones take rows in the
order of their event time (``in_order``), whatever order they arrive in.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from twinline.operators import catalog
from twinline.session import shared_folder

#: The state store that timers and lists of state need.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def source(spark: SparkSession, folder: str, table: str, files_per_trigger: int = 200) -> DataFrame:
    """A table, one file or a folder of part files, as a stream; the trigger size bounds what one micro-batch holds."""
    path = f"{folder}/{table}.parquet"
    rows = spark.read.parquet(path)
    first = rows.select(F.col("_metadata.file_name").alias("f")).first()
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_per_trigger)
    if first is not None and first.f == f"{table}.parquet":  # a single file: read it out of the folder that holds it
        return stream.option("pathGlobFilter", f"{table}.parquet").parquet(folder)
    return stream.parquet(path)


def work_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@contextmanager
def _state_store(spark: SparkSession):
    """The session's state store while a query starts; a query keeps what it started with."""
    old = spark.conf.get(ROCKS[0], None)
    spark.conf.set(*ROCKS)
    try:
        yield
    finally:
        spark.conf.set(ROCKS[0], old) if old else spark.conf.unset(ROCKS[0])


def run_once(stream: DataFrame, folder: str):
    """Take a stream through what is available now, from where the folder's checkpoint stands; the finished query."""
    with _state_store(stream.sparkSession):
        q = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state")
             .trigger(availableNow=True).start(f"{folder}/out"))
    q.awaitTermination()
    return q


def drain(stream: DataFrame) -> DataFrame:
    spark, folder = stream.sparkSession, work_folder(stream.sparkSession)
    run_once(stream, folder)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


class Clock:
    """A second input of a stream, whose only row moves the watermark past all others once the input is known to have ended."""

    def __init__(self, events: DataFrame, ts: str = "ts"):
        self.spark, self.schema, self.ts = events.sparkSession, events.schema, ts
        self.folder = f"{work_folder(self.spark)}/clock"
        self.spark.createDataFrame([], self.schema).write.parquet(self.folder)
        self.events = events.unionByName(self.spark.readStream.schema(self.schema).parquet(self.folder))

    def end(self) -> None:
        row = [F.lit("2200-01-01").cast("timestamp").alias(f.name) if f.name == self.ts else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        self.spark.range(1).select(*row).write.mode("append").parquet(self.folder)


def drain_to_the_end(events: DataFrame, build: Callable[[DataFrame], DataFrame], ts: str = "ts") -> DataFrame:
    """``build`` over a stream that ends: after its available input, the clock releases what still waits for the watermark."""
    clock, folder = Clock(events, ts), work_folder(events.sparkSession)
    stream = build(clock.events)
    run_once(stream, folder)
    clock.end()
    run_once(stream, folder)
    return events.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


#: State groups that the keys of a stream are dealt to. A checkpoint holds them by number, so they stay as they are.
GROUPS = 1024


class InOrder(StatefulProcessor):
    """Per key: rows wait in a list until the watermark has passed them, then a step takes them one by one in their order.

    The keys of a group share their state, their timers and what is told at a time: a call, a message to the state store and a
    pickle cost far more than a row, and some ten of them for each key were most of the work. A timer stands at the first
    row that waits in a group. The state is what waits, so no more than arrived within the allowed
    delay, and what the step keeps of each key. A step is ``(kept or None, row) -> (kept or None, rows out)`` over tuples of the
    columns ``names``; the first is the time in microseconds. ``idle`` is ``(kept) -> (time, rows out)``: when a key without
    further rows is given up, and what is told then.
    """

    def __init__(self, names: list[str], out: list[str], step: Callable, idle: Callable | None = None):
        self.names, self.out, self.step, self.idle = names, out, step, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.kept = handle.getListState("waiting", "rows binary"), handle.getValueState("kept", "states binary")

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-int(us) // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [(k, (int(us), *rest)) for pdf in rows for k, us, *rest in zip(*[pdf[n].tolist() for n in ("stream_key", *self.names)])]
        if fresh:
            self.waiting.appendValue((pickle.dumps(fresh),))
            self._wake(min(r[0] for _, r in fresh))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [r for packed in self.waiting.get() for r in pickle.loads(packed[0])] if self.waiting.exists() else []
        due, rest = sorted((r for r in rows if r[1][0] <= passed), key=lambda r: r[1]), [r for r in rows if r[1][0] > passed]
        held = self.kept.get()
        kept, out, wake = pickle.loads(held[0]) if held is not None else {}, [], [r[0] for _, r in rest]
        for k, r in due:
            now, told = self.step(kept.pop(k, None), r)
            if now is not None:
                kept[k] = now
            out += [(k, *o) for o in told]
        gone = False
        for k in list(kept) if self.idle is not None else []:
            end, told = self.idle(kept[k])
            if end <= passed:
                del kept[k]
                out, gone = out + [(k, *o) for o in told], True
            else:
                wake.append(end)
        if due:
            self.waiting.put([(pickle.dumps(rest),)]) if rest else self.waiting.clear()
        if wake:
            self._wake(min(wake))
        if due or gone:
            self.kept.update((pickle.dumps(kept),)) if kept else self.kept.clear()
        if out:
            yield pd.DataFrame(dict(zip(self.out, map(list, zip(*out)))))

    def close(self) -> None:
        pass


def in_order(events: DataFrame, key: str, ts: str, late: str, processor: InOrder, out: str) -> DataFrame:
    """``processor`` over each key of ``events``, whose rows may be ``late`` behind the newest; later ones are dropped.

    Returns the key and the columns ``out`` (DDL). Keys go through the operator as strings, as pandas turns whole numbers beside nulls into doubles.
    """
    rows = events.withWatermark(ts, late).withColumn("us", F.unix_micros(ts)).filter("us is not null")
    rows = rows.withColumn("stream_key", F.col(key).cast("string")).withColumn("state_group", F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int"))
    told = rows.select("state_group", "stream_key", ts, *processor.names).groupBy("state_group").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=T._parse_datatype_string(f"{processor.out[0]} string, {out}"), outputMode="append", timeMode="EventTime")
    return told.withColumn(key, F.col(key).cast(events.schema[key].dataType))


def _newest(state: DataFrame, keys: list[str]) -> DataFrame:
    """Run a stream of changing aggregates to the end of its input; the last row of every key.

    Every epoch overwrites its own folder, so a repeated epoch does no harm.
    """
    spark, folder = state.sparkSession, work_folder(state.sparkSession)

    def write(epoch_df, epoch):
        epoch_df.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    q = (state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    rest = [c for c in state.columns if c not in keys]
    kind = T.StructType([*state.schema, T.StructField("epoch", T.LongType())])
    rows = spark.read.schema(kind).parquet(f"{folder}/out")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_r")).select(*keys, "_r.*")


def status_counts(updates: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Updates per status and window, of the windows that closed ``late`` before the newest update.

    The state is one row per window and status and drops nothing, so an update counts
    in whatever order, and however many files at a time, the input arrives.
    """
    counts = (updates.groupBy(F.window("ts", window).alias("w"), "status").agg(F.count(F.lit(1)).alias("updates"), F.max("ts").alias("last"))
              .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "status", "updates", "last"))
    rows = _newest(counts, ["window_start", "window_end", "status"])
    newest = rows.agg(F.max("last")).first()[0]
    return rows.filter(F.col("window_end") <= F.lit(newest) - F.expr(f"INTERVAL {late}")).drop("last")


def latest_states(updates: DataFrame) -> DataFrame:
    """Latest status per key. The state is one row per key and does not expire: any key may change again."""
    last = F.max_by(F.struct("ts", "record_id", "status"), F.struct("ts", "record_id"))
    rows = _newest(updates.groupBy("episode_id").agg(last.alias("s")), ["episode_id"])
    return rows.select("episode_id", F.col("s.record_id").alias("record_id"), F.col("s.status").alias("status"))


def spaced_pick(events: DataFrame, key: str, pos: str, spacing: int, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Greedy pick of a stream: a position is taken when it is at least ``spacing`` after the last taken one of its key.

    ``pos`` grows with ``ts``. A position is decided when the watermark has passed it, and
    told at once; the state of a key is its last taken position and what arrived within ``late``.
    """
    def step(last, row):
        p = int(row[1])
        return (last, []) if last is not None and p - last[0] < spacing else ((p,), [(p,)])

    return in_order(events.select(key, pos, ts), key, ts, late, InOrder(["us", pos], [key, pos], step), f"{pos} long")


def record_moves(updates: DataFrame, key: str = "episode_id", ts: str = "ts", late: str = "1 hour", expire: str = "5 days") -> DataFrame:
    """Moves of records between statuses: ``(key, at, status, change)``, with -1 for the status left and +1 for the one entered.

    A record is what has one ``key``; its updates count in the order of (``ts``, ``record_id``).
    A record without an update for ``expire`` leaves its status and the state. The sum
    of the changes up to any moment is the number of live records by status then.
    """
    span = int(pd.Timedelta(expire).total_seconds() * 1_000_000)

    def step(kept, row):
        us, _, status = row
        told, old = [], kept
        if old is not None and us >= old[0] + span:  # it had been given up before this update
            told, old = [(old[0] + span, old[1], -1)], None
        if old is None or old[1] != status:
            told += [(us, old[1], -1)] if old is not None else []
            told.append((us, status, 1))
        return (us, status), told

    processor = InOrder(["us", "record_id", "status"], [key, "at", "status", "change"], step, lambda kept: (kept[0] + span, [(kept[0] + span, kept[1], -1)]))
    told = in_order(updates.select(key, ts, "record_id", "status"), key, ts, late, processor, "at long, status string, change long")
    return told.withColumn("at", F.timestamp_micros("at"))


def live_counts(moves: DataFrame) -> DataFrame:
    """Live records by status from their moves, and how often a status was entered and left."""
    entered = F.sum(F.when(F.col("change") > 0, F.col("change")).otherwise(0))
    return moves.groupBy("status").agg(F.sum("change").alias("records"), entered.alias("entered"), (entered - F.sum("change")).alias("departed"))


def arrivals(files: DataFrame, lang_index: DataFrame) -> DataFrame:
    """Newly landed source files against a static language index; a file seen twice within an hour counts once."""
    fresh = (files.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "1 hour")
             .dropDuplicatesWithinWatermark(["scan_pos"]).drop("arrived"))
    joined = catalog.with_episode(fresh).join(lang_index, "episode_id", "left")
    reason = F.when(F.col("episode_id") == "", "No episode ID").when(F.col("lang_file").isNull(), "No match").otherwise("")
    return joined.select(F.col("scan_pos").alias("src_file"), "episode_id", "lang_file", reason.alias("skip_reason"),
                         F.when(reason == "", "Pending").otherwise("Skipped").alias("status"))
