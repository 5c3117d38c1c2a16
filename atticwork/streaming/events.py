"""Live event streams.

Late rows: every stateful stream takes ``delay``. A row older than the newest event time minus
``delay`` may be dropped, and results appear once the watermark has passed them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.camera import event_summary, valid_messages, wanted_messages
from ..session import shared_dir

# A keyed processor is also unpacked by a Python process beside the driver, which does not have the files that were
# shipped to the workers: the classes of this module travel with their code and not by their names.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Later than any event; keyed processors get times as pandas nanoseconds, which end in 2262.
END_OF_TIME = "2262-01-01 00:00:00"

# Set while a query starts: state on disk, and visits merged within a task before they are shuffled.
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def event_stream(spark: SparkSession, path: str | None = None, kafka: dict[str, str] | None = None) -> DataFrame:
    """Messages as column ``data``: text files arriving in a folder, or a Kafka topic fed by a bridge.
    Empty and non-JSON payloads are dropped."""
    if kafka:
        raw = spark.readStream.format("kafka").options(**kafka).load().select(F.col("value").cast("string").alias("data"))
    else:
        raw = spark.readStream.text(path).select(F.col("value").alias("data"))
    return valid_messages(raw)


def table_stream(spark: SparkSession, directory: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet table of the folder as a stream, one file or a folder of part files; times are made zoned so that
    they can carry a watermark."""
    path = f"{directory.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # As a pattern the path may name a file as well as a folder.
    df = reader.parquet(f"{path[:-1]}[{path[-1]}]")
    for field in schema:
        if field.dataType.simpleString() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def finite(stream: DataFrame, ts: str, folder: str) -> DataFrame:
    """The stream of an input that has an end: ``close_stream`` on the same folder can later add a row without values
    and with a time after all others, which moves the watermark past every open visit or window."""
    spark = stream.sparkSession
    source = f"{folder}/closing"
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(source)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(source))


def close_stream(stream: DataFrame, ts: str, folder: str) -> None:
    spark = stream.sparkSession
    row = spark.range(1).select(
        *[(F.lit(END_OF_TIME).cast("timestamp") if f.name == ts else F.lit(None).cast(f.dataType)).alias(f.name) for f in stream.schema]
    )
    row.write.mode("append").parquet(f"{folder}/closing")


def filter_events(stream: DataFrame, labels: list[str]) -> DataFrame:
    """Summaries of messages that name a label and have video; stateless."""
    return event_summary(wanted_messages(stream, labels))


def late_policy(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    return stream.withWatermark(ts, delay)


def ingest_stream(stream: DataFrame, key: list[str], ts: str, delay: str) -> DataFrame:
    """One row per key, repeats within ``delay`` dropped; the state is bounded by the watermark."""
    return late_policy(stream, ts, delay).dropDuplicatesWithinWatermark(key)


def _session_gap(gap: str, strict: bool) -> str:
    # Sessions that touch are merged: a distance equal to the gap does not split. To make it split, the
    # gap is shortened by one microsecond, the finest step of a timestamp.
    return gap if strict else f"{gap} -1 microsecond"


def _named(key: str) -> Column:
    """A key as text that is never null: keyed pandas processors mix up the keys of a batch that has a null among them."""
    return F.when(F.col(key).isNull(), "").otherwise(F.concat(F.lit("="), F.col(key).cast("string"))).alias("key")


def _unnamed(stream: DataFrame, key: str) -> Column:
    text = F.when(F.col("key") != "", F.substr("key", F.lit(2)))
    return text.cast(stream.schema[key].dataType).alias(key)


class _Stitched(StatefulProcessor):
    """Visits of a key from pieces that were cut at the edges of time buckets.

    Open visits are (first, last, events) in microseconds. A piece that starts within the gap of a visit's end lies in the
    bucket of that moment or before it, and all pieces of a bucket have come when the watermark is past its end and
    one gap more: that is when the visit is closed. A visit knows the end of the one before.
    """

    def __init__(self, limit: int, gap: int, bucket: int, forget: int | None) -> None:
        self._limit, self._gap, self._bucket, self._forget = limit, gap, bucket, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getListState("open", "first bigint, last bigint, events bigint")
        self._ended = handle.getValueState("ended", "last bigint")

    def _merged(self, pieces: np.ndarray) -> np.ndarray:
        """Pieces no more than the limit apart become one; rows are first, last, events."""
        pieces = pieces[np.argsort(pieces[:, 0], kind="stable")]
        upto = np.maximum.accumulate(pieces[:, 1])
        starts = np.flatnonzero(np.r_[True, pieces[1:, 0] - upto[:-1] > self._limit])
        return np.stack([pieces[starts, 0], np.maximum.reduceat(pieces[:, 1], starts), np.add.reduceat(pieces[:, 2], starts)], axis=1)

    def _due(self, last: np.ndarray) -> np.ndarray:
        return ((last + self._gap) // self._bucket + 1) * self._bucket + self._gap

    def _settle(self, key, visits: np.ndarray, timers) -> Iterator[pd.DataFrame]:
        now = timers.getCurrentWatermarkInMs() * 1000
        done = self._due(visits[:, 1]) <= now
        # Visits are apart from each other and in order, so those that are due come first.
        closed, left = visits[done], visits[~done]
        if len(closed):
            before = self._ended.get()[0] if self._ended.exists() else None
            previous = pd.array([before, *closed[:-1, 1]], dtype="Int64")
            self._ended.update((int(closed[-1, 1]),))
            yield pd.DataFrame(
                {"key": [key[0]] * len(closed), "first_us": closed[:, 0], "last_us": closed[:, 1], "events": closed[:, 2], "prev_us": previous}
            )
        if len(left):
            self._open.put([tuple(map(int, v)) for v in left])
            self._handle.registerTimer(-(-int(self._due(left[:1, 1])[0]) // 1000))
        else:
            self._open.clear()
            if self._forget is not None and self._ended.exists():
                end = self._ended.get()[0] + self._forget
                if end <= now:
                    self._ended.clear()
                else:
                    self._handle.registerTimer(-(-end // 1000))

    def _held(self) -> np.ndarray:
        rows = list(self._open.get()) if self._open.exists() else []
        return np.array(rows, dtype=np.int64).reshape(-1, 3)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        visits = self._held()
        for batch in rows:
            visits = self._merged(np.concatenate([visits, batch[["first_us", "last_us", "events"]].to_numpy(dtype=np.int64)]))
        yield from self._settle(key, visits, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, self._held(), timerValues)

    def close(self) -> None:
        pass


def _micros(length: str) -> int:
    return pd.Timedelta(length).value // 1000


def visit_sessions(
    stream: DataFrame, key: str, ts: str, gap: str, delay: str, strict: bool = True, bucket: str | None = None, forget: str | None = None
) -> DataFrame:
    """Visits per key with start, last event, size and ``prev_ts``, the last event of the visit before.

    Two levels of state. Session windows run per key and time bucket (an hour or the gap, if not named), so the events
    of a busy key are spread over the tasks, and merged within each task before the shuffle. What comes out of
    a bucket are pieces of visits, few rows however many events they had; they are put together per key. The
    end of a key's last visit is remembered, with ``forget`` for so long.
    """
    wide = _micros(bucket) if bucket else max(_micros(gap), _micros("1 hour"))
    pieces = (
        late_policy(stream, ts, delay)
        .groupBy(
            F.col(key), F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(wide)).alias("_bucket"),
            F.session_window(ts, _session_gap(gap, strict)).alias("_s"),
        )
        .agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("events"))
        .select(
            _named(key), F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "events",
            F.window_time("_s").alias("closed_at"),
        )
    )
    stitched = pieces.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Stitched(_micros(gap) - (not strict), _micros(gap), wide, _micros(forget) if forget else None),
        outputStructType="key string, first_us bigint, last_us bigint, events bigint, prev_us bigint",
        outputMode="Append",
        timeMode="EventTime",
    )
    moment = lambda c, name: F.timestamp_micros(c).alias(name)
    return stitched.select(
        _unnamed(stream, key), moment("first_us", "first_ts"), moment("last_us", "last_ts"), "events", moment("prev_us", "prev_ts")
    )


def repeat_alerts(visits: DataFrame, key: str) -> DataFrame:
    """A row whenever a key comes back: from the stream of its visits (``visit_sessions`` with the gap in question), which
    know the end of the visit before. Needs no state of its own."""
    back = visits.filter("prev_ts IS NOT NULL")
    hours = (F.unix_micros("first_ts") - F.unix_micros("prev_ts")) / F.lit(3_600_000_000)
    return back.select(
        F.col(key).alias("person_id"), F.col("prev_ts").alias("last_seen"), F.col("first_ts").alias("seen_again"), hours.alias("gap_hours")
    )


def follow(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The stream of what is and will be written by ``run_available`` to its folder."""
    return spark.readStream.schema(schema).parquet(f"{folder}/data")


def calendar_counts_stream(stream: DataFrame, ts: str, keys: list[str], delay: str, width: str = "1 day", slide: str | None = None) -> DataFrame:
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    counted = late_policy(stream, ts, delay).groupBy(window.alias("_w"), *keys).agg(F.count(F.lit(1)).alias("events"))
    return counted.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, "events")


#: Keys that share a group of state: a group takes a few calls to the state store however many of its keys have rows.
#: Checkpoints hold groups by number, so this stays as it is.
PAUSE_GROUPS = 1024


class _PauseBlocks(StatefulProcessor):
    """Sentences wait until the watermark has passed their start and are then taken, key by key, in the order of start and id.

    A group holds the open blocks and the waiting sentences of all its keys, and all its keys are settled at once.
    """

    def __init__(self, pause: int, id_type: str) -> None:
        self._pause, self._id_type = pause, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", f"key string, start_us bigint, id {self._id_type}, end_us bigint")
        self._blocks = handle.getListState("blocks", "key string, start_us bigint, end_us bigint, sentences bigint, prev_end bigint")

    def _extended(self, blocks: pd.DataFrame, due: pd.DataFrame) -> pd.DataFrame:
        """The blocks of all keys with the sentences that are due, each key's in order; at most one block per key was open."""
        due = due.sort_values(["key", "start_us", "id"])
        key, start, end = due["key"].to_numpy(), due["start_us"].to_numpy(dtype=np.int64), due["end_us"].to_numpy(dtype=np.int64)
        first = np.r_[True, key[1:] != key[:-1]]
        opens = first.copy()
        opens[1:] |= start[1:] - end[:-1] >= self._pause
        cuts = np.flatnonzero(opens)
        last = np.r_[cuts[1:], len(start)] - 1
        own = pd.DataFrame(
            {"key": key[cuts], "start_us": start[cuts], "end_us": np.maximum.reduceat(end, cuts), "sentences": last - cuts + 1, "prev_end": end[last]}
        )
        # A key's first block may go on with the one that was open.
        place = pd.Index(own["key"][first[cuts]]).get_indexer(blocks["key"])
        at = np.flatnonzero(first[cuts])[place]
        goes_on = (place >= 0) & (start[cuts][at] - blocks["prev_end"].to_numpy(dtype=np.int64) < self._pause)
        held, at = blocks[goes_on], at[goes_on]
        bounds = own[["start_us", "end_us", "sentences"]].to_numpy(dtype=np.int64)
        bounds[at, 0] = held["start_us"]
        bounds[at, 1] = np.maximum(bounds[at, 1], held["end_us"].to_numpy(dtype=np.int64))
        bounds[at, 2] += held["sentences"].to_numpy(dtype=np.int64)
        own[["start_us", "end_us", "sentences"]] = bounds
        return pd.concat([blocks[~goes_on], own], ignore_index=True)

    def _settle(self, waiting: pd.DataFrame, timers) -> Iterator[pd.DataFrame]:
        now = timers.getCurrentWatermarkInMs() * 1000
        # Rows up to the watermark are late from now on, so nothing can come between these.
        due, left = waiting[waiting["start_us"] <= now], waiting[waiting["start_us"] > now]
        blocks = self._rows(self._blocks, ["key", "start_us", "end_us", "sentences", "prev_end"])
        if len(due):
            blocks = self._extended(blocks, due)
        # A key's last block stays open until its pause is over.
        open_ = ~blocks.duplicated("key", keep="last") & (blocks["prev_end"] + self._pause > now)
        closed, blocks = blocks[~open_], blocks[open_]
        if len(closed):
            yield closed[["key", "start_us", "end_us", "sentences"]].reset_index(drop=True)
        self._keep(self._blocks, blocks)
        self._keep(self._waiting, left)
        next_ = [*(blocks["prev_end"] + self._pause), *left["start_us"]]
        if next_:
            self._handle.registerTimer(-(-int(min(next_)) // 1000))

    @staticmethod
    def _rows(state, names: list[str]) -> pd.DataFrame:
        return pd.DataFrame(list(state.get()) if state.exists() else [], columns=names)

    @staticmethod
    def _keep(state, rows: pd.DataFrame) -> None:
        if len(rows):
            state.put(list(rows.astype(object).where(rows.notna(), None).itertuples(index=False, name=None)))
        elif state.exists():
            state.clear()

    def _typed(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Whole ids stay whole where some are null."""
        rows = rows[["key", "start_us", "id", "end_us"]]
        return rows.astype({"id": "Int64"}) if self._id_type in ("tinyint", "smallint", "int", "bigint") else rows

    def _held(self) -> pd.DataFrame:
        return self._typed(self._rows(self._waiting, ["key", "start_us", "id", "end_us"]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        all_ = [self._held(), *(self._typed(batch) for batch in rows)]
        yield from self._settle(pd.concat([part for part in all_ if len(part)]), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(self._held(), timerValues)

    def close(self) -> None:
        pass


def pause_blocks_stream(stream: DataFrame, key: str, ts: str, id_: str, duration: Column, min_pause: float, delay: str) -> DataFrame:
    """Blocks of speech as in ``transcripts.pause_blocks``: a new one starts when the pause after the end of the sentence
    before, in the order of start and id, reaches ``min_pause``, also where sentences overlap.

    ``duration`` and ``min_pause`` are seconds. Texts are joined to the bounds from the sentence table. A key's state are
    its open block and the sentences that the watermark has not reached; keys are dealt to PAUSE_GROUPS groups that keep theirs
    together, so the calls to the state store do not grow with the keys. A sentence without a duration ends as it starts.
    """
    own = late_policy(stream, ts, delay)
    start = F.unix_micros(F.col(ts).cast("timestamp"))
    length = F.coalesce(F.round(duration.cast("double") * 1e6).cast("bigint"), F.lit(0).cast("bigint"))
    id_type = stream.schema[id_].dataType.simpleString()
    blocks = (
        own.select(_named(key), F.col(ts).alias("at"), start.alias("start_us"), F.col(id_).alias("id"), (start + length).alias("end_us"))
        .withColumn("dealt", F.pmod(F.xxhash64("key"), F.lit(PAUSE_GROUPS)).cast("int"))
        .groupBy("dealt")
        .transformWithStateInPandas(
            statefulProcessor=_PauseBlocks(round(min_pause * 1e6), id_type),
            outputStructType="key string, start_us bigint, end_us bigint, sentences bigint",
            outputMode="Append",
            timeMode="EventTime",
        )
    )
    return blocks.select(
        _unnamed(stream, key), F.timestamp_micros("start_us").alias("block_start"), F.timestamp_micros("end_us").alias("block_end"), "sentences"
    )


def enrich(stream: DataFrame, static: DataFrame, on: str) -> DataFrame:
    """Stream rows with the columns of a static table; rows without a match stay."""
    return stream.join(static, on, "left")


def run_available(stream: DataFrame, name: str, mode: str = "append", folder: str | None = None, then=None) -> DataFrame:
    """Process what is there, into a table of the shared folder, and read it back.

    With ``folder`` the table and the checkpoint are kept there, and a later run goes on where this one ended. ``then`` is
    called after the first pass, and what it has added is processed too (see ``finite``). State goes to RocksDB,
    which keeps it on disk and is what keyed processors need, in as many partitions as the cluster has cores. The
    settings are read when the query starts and put back afterwards.
    """
    spark = stream.sparkSession
    out = folder or shared_dir(spark, name)
    wanted = {**STREAM_CONF, "spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism)}
    before = {key: spark.conf.get(key, None) for key in wanted}

    def once() -> None:
        query = (
            stream.writeStream.format("parquet").outputMode(mode)
            .option("path", f"{out}/data").option("checkpointLocation", f"{out}/state")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()

    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        once()
        if then is not None:
            then()
            once()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def run_to_the_end(stream: DataFrame, ts: str, build, name: str, folder: str | None = None, at_once: bool = False) -> DataFrame:
    """``build(stream)`` over an input that has an end, what is open at the end included.

    With ``at_once`` the closing row comes along with the input, in one run. This is for sources without a limit per
    trigger: all there is makes one batch, so no row of it is late, and the next batch closes everything.
    """
    out = folder or shared_dir(stream.sparkSession, name)
    whole = finite(stream, ts, out)
    if at_once:
        close_stream(stream, ts, out)
    return run_available(build(whole), name, folder=out, then=None if at_once else lambda: close_stream(stream, ts, out))


def split_late(stream: DataFrame, ts: str, delay: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a stream in time, and the late ones that a stateful stream with this ``delay`` would drop.

    A row is late if its time is not after the newest time of all batches before its own, less ``delay``. Rows without
    a time are in time. Each batch writes its rows once, with the mark, and its newest time under its own number; a batch
    that is repeated after a failure writes the same again. A later call with the same folder goes on.
    """
    spark = stream.sparkSession
    kinds = "newest timestamp"

    def once(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        own.createDataFrame([], kinds).write.mode("append").parquet(f"{folder}/newest/batch=-1")
        seen = own.read.schema(f"{kinds}, batch bigint").parquet(f"{folder}/newest").where(F.col("batch") < number)
        # One value per batch, and one of them is read here.
        newest = seen.agg(F.max("newest")).first()[0]
        limit = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        late = F.coalesce(F.col(ts).cast("timestamp") <= limit, F.lit(False))
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(f"{folder}/rows/batch={number}")
        schema = stream.schema.add("late", "boolean")
        own.read.schema(schema).parquet(f"{folder}/rows/batch={number}").agg(F.max(F.col(ts).cast("timestamp")).alias("newest")).write.mode(
            "overwrite"
        ).parquet(f"{folder}/newest/batch={number}")

    query = stream.writeStream.foreachBatch(once).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields]).add("batch", "long").add("late", "boolean")).parquet(f"{folder}/rows")
    return rows.where(~F.col("late")).drop("late", "batch"), rows.where("late").drop("late", "batch")
