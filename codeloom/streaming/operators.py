"""Structured Streaming forms: debounce, admission, progress changes, cooldown expiry.

Late data: every operator takes a watermark (10 minutes unless told otherwise) and emits in append mode. Stateful
processors order the rows of a micro-batch by time themselves, since a batch arrives unordered, and need the RocksDB state store.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.types import StructType

from codeloom.operators.limits import MINUTE, Gate

WATERMARK = "10 minutes"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events_stream(spark: SparkSession, path: str, schema: StructType, ts: str = "ts", max_files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream of change events with a proper timestamp."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def change_stream(spark: SparkSession, folder: str, schema: str = "path string, kind string, ts timestamp", max_files: int = 100) -> DataFrame:
    """The events that ``sources.watch`` writes, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", "*.json").json(folder)


def source_changes(events: DataFrame, path: str = "path") -> DataFrame:
    """Change events of source files outside generated folders."""
    return events.where(F.col(path).rlike(r"(?i)\.(py|js|ts|tsx|jsx|go|rs|java|rb)$") & ~F.col(path).rlike(r"(^|/)(docs|tests_generated)/"))


def debounce(events: DataFrame, key: str, ts: str = "ts", quiet: str = "3 seconds", watermark: str = WATERMARK) -> DataFrame:
    """One row per burst of changes: (key, start, end, events), emitted once the watermark has passed its quiet period."""
    return events.withWatermark(ts, watermark).groupBy(key, F.session_window(ts, quiet).alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def daily_usage(events: DataFrame, key: str, ts: str = "ts", amount: str = "n", watermark: str = WATERMARK) -> DataFrame:
    """Requests and amount per key and day (tumbling)."""
    return events.withWatermark(ts, watermark).groupBy(key, F.window(ts, "1 day").alias("w")).agg(F.count("*").alias("requests"), F.sum(amount).alias("amount")).select(key, F.col("w.start").alias("day"), "requests", "amount")


class Admission(StatefulProcessor):
    """Sequential admission under minute and day caps; the state is the last minute's admitted requests of the key."""

    def __init__(self, rpm: int, tpm: int, rpd: int):
        self.rpm, self.tpm, self.rpd = rpm, tpm, rpd

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.minute = handle.getListState("minute", "us long, n long")
        self.day = handle.getValueState("day", "day long, used int")

    def handleInputRows(self, key, rows, timer_values):
        minute = [(r[0], r[1]) for r in self.minute.get()] if self.minute.exists() else []
        day, used = self.day.get() if self.day.exists() else (None, 0)
        batch = pd.concat(list(rows)).sort_values(["us", "event_id"], kind="stable")
        out = []
        for t, n in zip(batch["us"].tolist(), batch["n"].tolist()):
            if t // 86_400_000_000 != day:
                day, used = t // 86_400_000_000, 0
            minute = [x for x in minute if x[0] > t - MINUTE]
            ok = used < self.rpd and len(minute) < self.rpm and not (minute and sum(x[1] for x in minute) + n >= self.tpm)
            if ok:
                minute.append((t, n))
                used += 1
            out.append(ok)
        if minute:
            self.minute.put(minute)
        else:
            self.minute.clear()
        self.day.update((day, used))
        yield pd.DataFrame({"key": [key[0]] * len(batch), "event_id": batch["event_id"], "admitted": out})

    def close(self) -> None:
        pass


def admission(events: DataFrame, key: str, ts: str = "ts", amount: str = "n", rpm: int = 4, tpm: int = 60, rpd: int = 1600) -> DataFrame:
    """(key, event_id, admitted) of a stream of requests."""
    src = events.select(F.col(key).alias("key"), F.col("event_id").cast("long"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(amount).cast("long").alias("n")).where("us is not null")
    kind = dict(src.dtypes)["key"]
    return src.groupBy("key").transformWithStateInPandas(Admission(rpm, tpm, rpd), f"key {kind}, event_id long, admitted boolean", "Append", "None")


class Recorded(StatefulProcessor):
    """The streaming form of ``limits.recorded_admission``: the state is the last minute's requests and reports and the day's counts of the key."""

    def __init__(self, rpm: int, tpm: int, rpd: int, tpd: int):
        self.caps = (rpm, tpm, rpd, tpd)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.requests = handle.getListState("requests", "us long")
        self.reports = handle.getListState("reports", "us long, n long")
        self.day = handle.getValueState("day", "day long, requests int, tokens long")

    def handleInputRows(self, key, rows, timer_values):
        day = self.day.get() if self.day.exists() else (None, 0, 0)
        gate = Gate(*self.caps, [r[0] for r in self.requests.get()] if self.requests.exists() else (), [(r[0], r[1]) for r in self.reports.get()] if self.reports.exists() else (), *day)
        batch = pd.concat(list(rows)).sort_values(["us", "event_id"], kind="stable")
        got = [(i, gate.take(t, k, n)) for i, t, k, n in zip(batch["event_id"].tolist(), batch["us"].tolist(), batch["kind"].tolist(), batch["n"].tolist())]
        for state, held in ((self.requests, [(t,) for t in gate.requests]), (self.reports, list(gate.reports))):
            if held:
                state.put(held)
            else:
                state.clear()
        self.day.update((gate.today, gate.day_requests, gate.day_tokens))
        got = [x for x in got if x[1] is not None]
        yield pd.DataFrame({"key": [key[0]] * len(got), "event_id": [x[0] for x in got], "admitted": [x[1] for x in got]})

    def close(self) -> None:
        pass


def recorded(events: DataFrame, key: str, ts: str = "ts", kind: str = "kind", amount: str = "n", rpm: int = 5, tpm: int = 60, rpd: int = 900, tpd: int = 9000) -> DataFrame:
    """(key, event_id, admitted) of the requests of a stream that also brings the tokens calls have used."""
    src = events.select(F.col(key).alias("key"), F.col("event_id").cast("long"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(kind).alias("kind"), F.col(amount).cast("long").alias("n")).where("us is not null and n is not null")
    return src.groupBy("key").transformWithStateInPandas(Recorded(rpm, tpm, rpd, tpd), f"key {dict(src.dtypes)['key']}, event_id long, admitted boolean", "Append", "None")


class Changes(StatefulProcessor):
    """Emit a row when a key's status differs from its last one (A, B, A gives three rows); nothing after a terminal status."""

    def __init__(self, terminal: tuple[str, ...]):
        self.terminal = terminal

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "status string")

    def handleInputRows(self, key, rows, timer_values):
        last = self.last.get()[0] if self.last.exists() else None
        batch = pd.concat(list(rows)).sort_values(["us", "event_id"], kind="stable")
        keep = []
        for s in batch["status"]:
            keep.append(last not in self.terminal and s != last)
            if keep[-1]:
                last = s
        self.last.update((last,))
        yield pd.DataFrame({"key": [key[0]] * sum(keep), "event_id": batch["event_id"][keep], "status": batch["status"][keep]})

    def close(self) -> None:
        pass


def progress(events: DataFrame, key: str, status: str, ts: str = "ts", terminal: tuple[str, ...] = ("done", "failed")) -> DataFrame:
    src = events.select(F.col(key).alias("key"), F.col("event_id").cast("long"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(status).alias("status"))
    kind = dict(src.dtypes)["key"]
    return src.groupBy("key").transformWithStateInPandas(Changes(terminal), f"key {kind}, event_id long, status string", "Append", "None")


def run_once(stream: DataFrame, checkpoint: str, name: str, mode: str = "append"):
    """Process what is there and stop; the result is the in-memory table ``name`` (for tests and small reports)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def exclusive(run, busy_path: str):
    """A ``foreachBatch`` callback that skips a batch while a run is marked as going on, and marks its own.

    The mark is created atomically on the file system of its path, so drivers that share a folder exclude each other.
    """

    def call(df: DataFrame, batch_id: int) -> None:
        jvm = df.sparkSession._jvm
        mark = jvm.org.apache.hadoop.fs.Path(busy_path)
        fs = mark.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
        try:
            if not fs.createNewFile(mark):
                return
        except Exception:  # some file systems raise where the file exists
            if fs.exists(mark):
                return
            raise
        try:
            run(df, batch_id)
        finally:
            fs.delete(mark, False)

    return call


def on_changes(analyse, keep: list[str] = ["path"], busy_path: str | None = None):
    """A ``foreachBatch`` callback: source files among a batch's events, each once, go to ``analyse`` unless a run is going on."""

    def call(df: DataFrame, batch_id: int) -> None:
        changed = source_changes(df).select(*keep).distinct()
        if not changed.isEmpty():
            analyse(changed, batch_id)

    return exclusive(call, busy_path) if busy_path else call


class Progress(StreamingQueryListener):
    """Hands each finished batch of a stream to a callback: (batch id, input rows)."""

    def __init__(self, tell):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.tell(event.progress.batchId, event.progress.numInputRows)

    def onQueryTerminated(self, event) -> None:
        pass
