"""Incremental ingestion with Structured Streaming: resumable, idempotent, deduplicated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def files(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", per_trigger: int = 64) -> DataFrame:
    """A growing folder as a stream; the number of files a trigger bounds its work."""
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", per_trigger).load(path)


def distinct_within(stream: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Drops repeats of ``keys`` within the watermark, so the state stays bounded."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def access_counts(stream: DataFrame, ts: str, key: str, late: str = "1 hour", every: str = "1 day") -> DataFrame:
    """(window, key, last_access, access_count): accesses by period, closed by the watermark;
    recency is a closed form of last_access."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, every), key).agg(F.max(ts).alias("last_access"), F.count("*").alias("access_count"))


def drain(stream: DataFrame, checkpoint: str, finish: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Runs all that is there once and stops. ``finish`` gets each batch and its number; a
    batch that was cut off comes again with the same number, so it must replace by it."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(finish).start().awaitTermination()


def idempotent_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Writes a batch under its own number: a repeat overwrites itself."""

    def finish(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return finish


def every_new(path: str, papers: int, then: Callable[[DataFrame], None], key: str = "paper_id") -> Callable[[DataFrame, int], None]:
    """Calls ``then`` on all papers seen each time ``papers`` more are there. Batches hold each
    paper once, as ``distinct_within`` or ``dropDuplicates`` leave them; the running number of
    papers is kept beside the sink, a row a batch, so no batch but the new one is counted. A
    batch that comes again replaces its own row."""
    write = idempotent_sink(path)

    def finish(batch: DataFrame, number: int) -> None:
        write(batch, number)
        spark, counts = batch.sparkSession, f"{path}-counts"
        schema = "number long, total long"
        first = spark.createDataFrame([(-1, 0)], schema)
        known = first if number == 0 else first.unionByName(spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(counts))
        before = known.where(F.col("number") < number).agg(F.max_by("total", "number")).first()[0]
        now = before + spark.read.parquet(f"{path}/batch={number}").select(key).distinct().count()
        spark.createDataFrame([(number, now)], schema).coalesce(1).write.mode("overwrite").parquet(f"{counts}/of={number}")
        if now // papers > before // papers:
            then(spark.read.parquet(path).drop("batch"))

    return finish


def rested(stream: DataFrame, key: str, ts: str, rest: str = "24 hours") -> DataFrame:
    """(key, last, due) of keys of which nothing came for ``rest``: an event-time timer a key,
    moved by each new row, so the state is one time a key and is cleared when the timer fires.
    Rows may come in any order within a batch. Needs the RocksDB state store."""
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    wait = int(pd.Timedelta(rest).total_seconds() * 1000)
    kind = stream.schema[key].dataType

    class Resting(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "ms long")

        def handleInputRows(self, key, rows, timerValues):
            came = [int(r["ms"].max()) for r in rows if len(r)]
            if not came:
                return iter([])
            newest = max(came)
            old = self.last.get()[0] if self.last.exists() else None
            if old is None or newest > old:
                if old is not None:
                    self.handle.deleteTimer(old + wait)
                self.last.update((newest,))
                self.handle.registerTimer(newest + wait)
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            last = self.last.get()[0]
            self.last.clear()
            yield pd.DataFrame({"key": [key[0]], "last": [last], "due": [last + wait]})

        def close(self) -> None:
            pass

    rows = stream.withWatermark(ts, "0 seconds").select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.unix_millis(ts).alias("ms"))
    out = rows.groupBy("key").transformWithStateInPandas(Resting(), T.StructType([T.StructField("key", kind), T.StructField("last", T.LongType()), T.StructField("due", T.LongType())]), "Append", "EventTime")
    return out.select(F.col("key").alias(key), F.timestamp_millis("last").alias("last"), F.timestamp_millis("due").alias("due"))


BREAKER_STATE = T.StructType([T.StructField("open_until", T.DoubleType())])


def breaker(calls: DataFrame, key: str = "endpoint", pause: float = 120.0) -> DataFrame:
    """(endpoint, call_id, allowed) of calls (endpoint, call_id, at epoch seconds, status) in
    order of time: a server error (0 or 500 and more) closes an endpoint to calls for
    ``pause`` seconds, client errors don't. For batches; see ``breaker_stream``."""
    import pandas as pd

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows, until, allowed = rows.sort_values(["at", "call_id"]), 0.0, []
        for at, status in zip(rows["at"], rows["status"]):
            free = at >= until
            allowed.append(free)
            if free and (status == 0 or status >= 500):
                until = at + pause
        return rows.assign(allowed=allowed)[[key, "call_id", "allowed"]]

    return calls.select(key, "call_id", "at", "status").groupBy(key).applyInPandas(fold, f"{key} string, call_id long, allowed boolean")


def breaker_stream(calls: DataFrame, key: str = "endpoint", pause: float = 120.0) -> DataFrame:
    """The same over a stream, an endpoint's state kept between batches."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def fold(name, frames, state):
        until = state.get[0] if state.exists else 0.0
        for rows in frames:
            rows, allowed = rows.sort_values(["at", "call_id"]), []
            for at, status in zip(rows["at"], rows["status"]):
                free = at >= until
                allowed.append(bool(free))
                if free and (status == 0 or status >= 500):
                    until = at + pause
            yield pd.DataFrame({key: name[0], "call_id": rows["call_id"], "allowed": allowed})
        state.update((until,))

    return calls.select(key, "call_id", "at", "status").groupBy(key).applyInPandasWithState(fold, T.StructType([T.StructField(key, T.StringType()), T.StructField("call_id", T.LongType()), T.StructField("allowed", T.BooleanType())]), BREAKER_STATE, "append", GroupStateTimeout.NoTimeout)
