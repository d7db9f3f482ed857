"""Streaming jobs over the event log and document folders; each equals its batch twin on the same rows.

Nothing that grows with the stream is kept in the driver: results and states are tables by epoch in the shared folder, and a
job that starts again from its checkpoint goes on from the last of them. An epoch that is run again after a failure
overwrites its own table, so its effect is the same.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.streaming import StatefulProcessor

EVENTS = S.StructType([
    S.StructField("event_id", S.LongType()), S.StructField("ts", S.TimestampNTZType()), S.StructField("user_id", S.LongType()),
    S.StructField("event_type", S.StringType()), S.StructField("value", S.DoubleType()), S.StructField("props", S.StringType()),
])


def table_stream(spark: SparkSession, folder: str, name: str, schema: S.StructType, files_per_trigger: int = 1) -> DataFrame:
    """Files of a folder as a stream of rows."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def event_stream(spark: SparkSession, folder: str, name: str = "*.parquet", files_per_trigger: int = 1) -> DataFrame:
    """The event log as a stream, with ``ts`` as an instant that a watermark accepts."""
    return table_stream(spark, folder, name, EVENTS, files_per_trigger).withColumn("ts", F.col("ts").cast("timestamp"))


class Epochs:
    """Tables by epoch in a folder of the shared store. An empty one stands at its start, so that it can always be read."""

    def __init__(self, spark: SparkSession, folder: str, schema: S.StructType) -> None:
        self.spark, self.folder, self.schema = spark, folder, schema
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/epoch=-1")

    def write(self, rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/epoch={epoch}")

    def _path(self):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)

    def known(self) -> list[int]:
        """Numbers of the epochs that are written, from the names in the folder."""
        path = self._path()
        names = [s.getPath().getName() for s in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)]
        return sorted(int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch="))

    def all(self) -> DataFrame:
        return self.of(self.known())

    def of(self, epochs: list[int]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/epoch={e}" for e in epochs])

    def last(self) -> DataFrame:
        return self.of(self.known()[-1:])


def activity_counts(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Events by window and type."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = events.withWatermark("ts", late) if events.isStreaming else events
    return counted.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Work sessions of each user: events no further apart than the gap."""
    counted = events.withWatermark("ts", late) if events.isStreaming else events
    return counted.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class Changed:
    """A ``foreachBatch`` sink for a keyed aggregation in update mode: each epoch writes the rows of the keys that changed in
    it, and nothing else. What holds now is the last row of each key; every ``every`` epochs these are written as a base
    that later reads begin with, so that reading stays in proportion to the state. An epoch that is run again overwrites
    its own tables."""

    def __init__(self, spark: SparkSession, folder: str, schema: S.StructType, keys: list[str], every: int = 16) -> None:
        self.keys, self.every, self.columns = keys, every, schema.names
        stamped = S.StructType([*schema.fields, S.StructField("epoch", S.LongType())])
        self.changes, self.bases = Epochs(spark, f"{folder}/changes", stamped), Epochs(spark, f"{folder}/bases", stamped)

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        self.changes.write(batch.withColumn("epoch", F.lit(epoch).cast("long")), epoch)
        if (epoch + 1) % self.every == 0:
            self.bases.write(self._at(epoch, below=epoch), epoch)

    def _at(self, epoch: int, below: int) -> DataFrame:
        base = max(e for e in self.bases.known() if e < below)
        rows = self.bases.of([base]).unionByName(self.changes.of([e for e in self.changes.known() if base < e <= epoch] or [-1]))
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rows.columns), "epoch").alias("r")).select("r.*")

    def now(self) -> DataFrame:
        return self._at(2**62, below=2**62).select(*self.columns)


class OpenSessions(StatefulProcessor):
    """Sessions of one user that may still change. Gives what a batch changed by (user, start): a session's end and events,
    or no event where it has become part of an earlier one. Once the watermark has passed a session's end, a timer takes it
    out of the state; its row stays as it was last given."""

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", S.StructType([S.StructField(n, S.LongType()) for n in ("start", "end", "n")]))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        before = {start: (end, n) for start, end, n in self.open.get()}
        spans = [(start, end, n) for start, (end, n) in before.items()]
        for part in rows:
            spans = _merged(spans + [(t, t + self.gap, 1) for t in part["at"].tolist()])
        self._keep(spans, new=not before)
        now = {start: (end, n) for start, end, n in spans}
        changed = [(key[0], start, end, n) for start, (end, n) in now.items() if before.get(start) != (end, n)]
        changed += [(key[0], start, end, 0) for start, (end, n) in before.items() if start not in now]
        yield pd.DataFrame(changed, columns=["user_id", "start", "end", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self._keep([(start, end, n) for start, end, n in self.open.get() if end > passed])
        yield pd.DataFrame([], columns=["user_id", "start", "end", "n"])

    def _keep(self, spans, new: bool = False) -> None:
        """Store ``spans`` and set the timer of the first that ends. A key that held none has no timer to look for."""
        for timer in [] if new else list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if spans:
            self.open.put(spans)
            self.handle.registerTimer(min(end for _, end, _ in spans) // 1000 + 1)
        else:
            self.open.clear()

    def close(self) -> None:
        pass


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans (start, end, n) with those that overlap or touch put together, as session windows are."""
    out: list[tuple[int, int, int]] = []
    for start, end, n in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2] + n)
        else:
            out.append((start, end, n))
    return out


def session_changes(events: DataFrame, gap_minutes: int = 30, late: str = "2 hours") -> DataFrame:
    """user_id, start, end, n of the sessions that each batch of a stream changes, for ``keyed`` by user_id and start; n is 0
    where a session has become part of an earlier one."""
    timed = events.withWatermark("ts", late).withColumn("at", F.unix_micros("ts")).select("user_id", "ts", "at")
    found = timed.groupBy("user_id").transformWithStateInPandas(OpenSessions(gap_minutes * 60_000_000), "user_id long, start long, end long, n long", "Update", "EventTime")
    return found.select("user_id", F.timestamp_micros("start").alias("start"), F.timestamp_micros("end").alias("end"), "n")


FILES = S.StructType([S.StructField("path", S.StringType()), S.StructField("modificationTime", S.TimestampType()), S.StructField("length", S.LongType()), S.StructField("content", S.BinaryType())])
ACCEPTED = "hash string, path string, kind string, length long"
REFUSED = "hash string, path string, reason string"


def inbox(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder as a stream: names of temporary files are ignored."""
    return named_files(spark.readStream.format("binaryFile").schema(FILES).load(folder))


def named_files(files: DataFrame) -> DataFrame:
    return files.where(~F.col("path").rlike(r"(?:^|/)(?:~\$|\.)[^/]*$|\.(?:tmp|part|crdownload)$"))


class FirstSeen(StatefulProcessor):
    """Of each key the row with the least path of the batch that first brings it; nothing later. The state of a key is the path
    it was accepted under, and with ``keep`` it goes when that time has passed."""

    def __init__(self, keep: int | None = None) -> None:
        self.keep = keep

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", S.StructType([S.StructField("path", S.StringType())]), self.keep)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        first = None
        for part in rows:
            least = part.loc[part["path"].idxmin()]
            first = least if first is None or least["path"] < first["path"] else first
        if not self.seen.exists():
            self.seen.update((first["path"],))
            yield pd.DataFrame([first])

    def close(self) -> None:
        pass


def first_seen(files: DataFrame) -> DataFrame:
    """What ``FirstSeen`` gives without a time to keep, as an aggregation in update mode, so that no key passes through Python: of
    each hash the least (instant of its batch, path), given in the batch of that instant only. The instant is written into
    the checkpoint before a batch runs, so a batch that is run again has the same."""
    rest = [c for c in files.columns if c != "hash"]
    first = files.withColumn("at", F.current_timestamp()).groupBy("hash").agg(F.min(F.struct("at", *rest)).alias("r"))
    return first.where(F.col("r.at") == F.current_timestamp()).select("hash", *[f"r.{c}" for c in rest])


class Inbox:
    """Complete files with content not seen before are accepted, others refused with a reason. What was seen is keyed state,
    a hash each: a batch looks up its own hashes and reads nothing else of what was accepted."""

    def __init__(self, spark: SparkSession, folder: str, keep: int | None = None) -> None:
        schema = lambda ddl: spark.createDataFrame([], ddl).schema
        self.keep, self._accepted, self._refused = keep, Epochs(spark, f"{folder}/accepted", schema(ACCEPTED)), Epochs(spark, f"{folder}/refused", schema(REFUSED))

    def run(self, files: DataFrame, checkpoint: str) -> None:
        """Work off what is there now."""
        from regista.sources.files import completeness, typed

        seen = typed(files).withColumn("reason", completeness("kind", "content"))
        complete = seen.where("reason IS NULL").select("hash", "path", "kind", "length")
        if self.keep:
            first = complete.groupBy("hash").transformWithStateInPandas(FirstSeen(self.keep), ACCEPTED, "Append", "ProcessingTime")
            run(first, self._accepted.write, f"{checkpoint}/accepted")
        else:
            run(first_seen(complete), self._accepted.write, f"{checkpoint}/accepted", "update")
        run(seen.where("reason IS NOT NULL").select("hash", "path", "reason"), self._refused.write, f"{checkpoint}/refused")

    def accepted(self) -> DataFrame:
        return self._accepted.all()

    def refused(self) -> DataFrame:
        return self._refused.all()


#: Keeps state by key on local disk, with its changes in the checkpoint: memory and writes follow what changes, not what there is.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Let a stream work off what is there now."""
    stream.sparkSession.conf.set(*ROCKS)
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into tables in ``folder`` and read its result: of all epochs, or, where each holds
    the complete result, of the last."""
    out = Epochs(stream.sparkSession, f"{folder}/rows", stream.schema)
    run(stream, out.write, f"{folder}/checkpoint", mode)
    return out.last() if mode == "complete" else out.all()


def keyed(stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """As ``drain``, for an aggregation of which each batch gives the rows that it changed: the last row of each key. With a
    watermark, keys that can't change any more leave the state; their rows stay."""
    out = Changed(stream.sparkSession, f"{folder}/rows", stream.schema, keys)
    run(stream, out, f"{folder}/checkpoint", "update")
    return out.now()
