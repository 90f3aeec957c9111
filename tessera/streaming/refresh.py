"""Refresh of resources as a stream: new definition files reconcile with what is served; a failed batch keeps it."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.catalogue import reconcile
from tessera.sources.tables import vector_or_empty

SCHEMA = "id string, revision int, body string, loaded timestamp"


class Serving:
    """What is served, kept as generations in a folder: a new one replaces the old once it is written whole, by a line in
    the folder's manifest. The newest line is found again after a restart, and no generation is written twice."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def generation(self) -> str | None:
        lines = vector_or_empty(self.spark, f"{self.root}/manifest", "generation string, at timestamp")
        last = lines.orderBy(F.desc("at"), F.desc("generation")).limit(1).collect()
        return last[0].generation if last else None

    def read(self) -> DataFrame:
        newest = self.generation()
        if newest is None:
            return self.spark.createDataFrame([], "id string, revision int, body string, system boolean")
        return self.spark.read.parquet(f"{self.root}/{newest}")

    def replace(self, df: DataFrame) -> None:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/{name}")
        line = self.spark.range(1).select(F.lit(name).alias("generation"), F.current_timestamp().alias("at"))
        line.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")


def apply(configured: DataFrame, serving: Serving) -> DataFrame:
    """Reconciles and swaps; returns the actions (id, action)."""
    old = serving.read()
    actions = reconcile(configured, old, ["id"], ["revision", "body"]).cache()
    system = old.where("system")
    new = configured.select("id", "revision", "body", F.lit(False).alias("system"))
    serving.replace(new.unionByName(system.join(new, "id", "left_anti")))
    return actions


def refresh(spark: SparkSession, folder: str, checkpoint: str, serving: Serving, report: Callable[[int, DataFrame], None], period: str | None = None) -> StreamingQuery:
    """Watches a folder of JSON definitions: each batch is the newest definition of each id in it. period None: all
    that is there, then stop."""
    stream = spark.readStream.schema(SCHEMA).json(folder)

    def batch(df: DataFrame, epoch: int) -> None:
        newest = df.groupBy("id").agg(F.max_by(F.struct("revision", "body"), F.struct("revision", "loaded")).alias("d")).select("id", "d.revision", "d.body")
        report(epoch, apply(newest, serving))

    out = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=period) if period else out.trigger(availableNow=True)).start()


class Updater:
    """Runs an update over and over: `period` seconds after one that went well, `retry` after one that failed, and at once
    when it is asked for. ready() waits for the first that went well."""

    def __init__(self, update: Callable[[], None], period: float = 300.0, retry: float = 5.0):
        self.update, self.period, self.retry = update, period, retry
        self.runs, self.updated, self.error = 0, 0.0, None
        self._wake, self._ready, self._stop = threading.Event(), threading.Event(), threading.Event()
        self._thread = threading.Thread(target=self._loop, daemon=True)

    def start(self) -> Updater:
        self._thread.start()
        return self

    def _loop(self) -> None:
        while not self._stop.is_set():
            self._wake.clear()
            begun = time.time()
            try:
                self.update()
                self.error, self.updated = None, begun
                self._ready.set()
            except Exception as e:
                # what is served stays; the next run tries again
                self.error = e
            self.runs += 1
            self._wake.wait(self.retry if self.error else self.period)

    def wake(self) -> float:
        """Asks for an update now; returns the time that updated_since() can be asked for."""
        now = time.time()
        self._wake.set()
        return now

    def ready(self, timeout: float | None = None) -> bool:
        return self._ready.wait(timeout)

    def updated_since(self, at: float) -> bool:
        """Whether an update that began after `at` went well."""
        return self.updated >= at

    def stop(self) -> None:
        self._stop.set()
        self._wake.set()
        self._thread.join()


def period_counters(events: DataFrame, period: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Number, average and most of values by event type over periods of a stream or table, tumbling or, with slide, every
    so often over the history before."""
    return events.groupBy(F.window("ts", period, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("value").cast("decimal(20,4)")).cast("double").alias("mean"), F.max("value").alias("most"))


def rolled_over(periods: DataFrame, length: int) -> DataFrame:
    """Periods (start in epoch seconds, others) with the figures of the one just before each (previous_...: null where
    there was none) and the seconds that each has left when the newest starts, which is how long it may be cached."""
    others = [c for c in periods.columns if c != "start"]
    past = periods.select((F.col("start") + length).alias("start"), *[F.col(c).alias(f"previous_{c}") for c in others])
    newest = periods.agg(F.max("start").alias("_newest"))
    left = F.greatest(F.col("start") + length - F.col("_newest"), F.lit(0))
    return periods.join(past, "start", "left").join(F.broadcast(newest), F.lit(True)).withColumn("remaining", left).drop("_newest")


def forecast_stream(events: DataFrame, serving: Serving, checkpoint: str, period: str, late: str = "0 seconds") -> StreamingQuery:
    """Rolls a live stream of events (ts, value) over: a period is closed once the watermark passes its end, and the newest
    closed one and the one before it are what is served."""
    closed = events.withWatermark("ts", late).groupBy(F.window("ts", period).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))

    def batch(df: DataFrame, _: int) -> None:
        new = df.select(F.col("w.start").cast("string").alias("id"), F.col("n").cast("int").alias("revision"), F.col("total").cast("string").alias("body"), F.lit(False).alias("system"))
        both = serving.read().unionByName(new)
        serving.replace(both.orderBy(F.desc("id")).limit(2))

    return closed.writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
