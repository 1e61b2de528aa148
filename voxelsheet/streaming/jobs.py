"""Incremental operators on Structured Streaming.

Sources are file streams; each function returns a streaming DataFrame or starts
a query whose checkpoint lies in the shared folder.
"""

from __future__ import annotations

import json
import re
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.ordering import spread
from ..operators.stamps import last_write
from ..session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def follow(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    return reader.parquet(path)


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what is there, write to the shared folder, and read it as a table."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode(mode).trigger(availableNow=True)
        .option("path", path).option("checkpointLocation", scratch_path(spark, f"{name}-checkpoint")).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def windowed_reports(log: DataFrame, every: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Metric means per event-time window, emitted once the watermark closes it.

    Sums and counts are kept as whole numbers of hundredths, so late rows and
    restarts cannot change a result's last digit.
    """
    return _reports(log.withWatermark("ts", lateness), every)


def _reports(log: DataFrame, every: str) -> DataFrame:
    grouped = log.groupBy(F.window("ts", every).alias("w"), "job", "metric")
    summed = grouped.agg(F.sum("value100").alias("sum100"), F.count("*").alias("n"))
    return summed.select(F.col("w.start").alias("start"), "job", "metric", "sum100", "n")


def open_reports(closed: DataFrame, log: DataFrame, every: str = "1 hour") -> DataFrame:
    """Windows the watermark had not closed when the stream ended, from the log's rows after the last closed one."""
    end = closed.agg(F.max("start")).scalar() + F.expr(f"interval {every}")
    return _reports(log.filter(F.coalesce(F.col("ts") >= end, F.lit(True))), every)


LOW = ("low", "p_low", "b_low")
HIGH = ("high", "p_high", "b_high")


def records(steps: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows, in order of step, that lower one of the first three values or raise one of the others; no other row can ever do so."""
    order = np.argsort(steps, kind="stable")
    steps, values = steps[order], values[order]
    best = np.hstack([np.minimum.accumulate(values[:, :3]), np.maximum.accumulate(values[:, 3:])])
    keep = np.r_[True, (best[1:] != best[:-1]).any(axis=1)]
    return steps[keep], values[keep]


class ExtremesProcessor(StatefulProcessor):
    """Keeps six extremes per key and emits a row whenever one changes.

    Frames of a micro-batch come in any order of step. Each is reduced to its own
    records as it comes, so what is held is a few rows a frame, not the batch.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", ", ".join(f"{c} double" for c in (*LOW, *HIGH)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = list(self.seen.get()) if self.seen.exists() else [float("inf")] * 3 + [float("-inf")] * 3
        steps, values = np.zeros(0, np.int64), np.zeros((0, 6))
        for frame in rows:
            own = records(frame["step"].to_numpy(np.int64), frame[[*LOW, *HIGH]].to_numpy(float))
            steps, values = records(np.r_[steps, own[0]], np.vstack([values, own[1]]))
        best = np.vstack([now, values])
        best[:, :3] = np.minimum.accumulate(best[:, :3])
        best[:, 3:] = np.maximum.accumulate(best[:, 3:])
        changed = (best[1:] != best[:-1]).any(axis=1)
        self.seen.update(tuple(float(v) for v in best[-1]))
        out = pd.DataFrame(best[1:][changed], columns=[*LOW, *HIGH])
        out.insert(0, "step", steps[changed])
        out.insert(0, "volume_id", key[0])
        yield out

    def close(self) -> None:
        pass


def running_extremes(slices: DataFrame) -> DataFrame:
    """``slices``: volume_id, step and the six values; one row per slice."""
    slices.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # The runner that starts stateful processors does not see shipped files.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return slices.groupBy("volume_id").transformWithStateInPandas(
        ExtremesProcessor(), "volume_id int, step long, " + ", ".join(f"{c} double" for c in (*LOW, *HIGH)), "Append", "None"
    )


# --- windows of a number of steps -------------------------------------------------------------


class CountWindowProcessor(StatefulProcessor):
    """Closes a window at every row marked ``flush``, that row included; what is left waits for the next micro-batch.

    Sums and counts per metric are kept, not rows. ``idle_ms`` closes what is left
    when no row has come for so long.
    """

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.report = handle.getValueState("report", "report long")
        self.waiting = handle.getListState("waiting", "metric string, total long, n long, last long")

    def _close(self, job, held: dict, report: int) -> pd.DataFrame:
        rows = [(job, report, metric, total, n, last) for metric, (total, n, last) in sorted(held.items())]
        return pd.DataFrame(rows, columns=["job", "report", "metric", "total", "n", "last_step"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        report = self.report.get()[0] if self.report.exists() else 0
        held = {metric: (total, n, last) for metric, total, n, last in (self.waiting.get() if self.waiting.exists() else ())}
        # a micro-batch brings a job's rows in any order: files per trigger bound what is put in order here
        batch = pd.concat([f[["step", "metric", "value100", "flush"]] for f in rows]).sort_values("step", kind="stable")
        window = np.r_[0, np.cumsum(batch["flush"].to_numpy())[:-1]]
        for number, part in batch.groupby(window, sort=True):
            if number:
                yield self._close(key[0], held, report)
                held, report = {}, report + 1
            for metric, own in part.groupby("metric"):
                total, n, _ = held.get(metric, (0, 0, 0))
                held[metric] = (total + int(own["value100"].sum()), n + len(own), int(own["step"].max()))
        if batch["flush"].iloc[-1]:
            yield self._close(key[0], held, report)
            held, report = {}, report + 1
        self.report.update((report,))
        self.waiting.put([(metric, *values) for metric, values in held.items()]) if held else self.waiting.clear()
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if held:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = {metric: (total, n, last) for metric, total, n, last in (self.waiting.get() if self.waiting.exists() else ())}
        if held:
            report = self.report.get()[0]
            self.report.update((report + 1,))
            self.waiting.clear()
            yield self._close(key[0], held, report)

    def close(self) -> None:
        pass


def count_windows(log: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """job, report, metric, total, n, last_step: one row per metric of every closed window.

    ``log``: job, step, metric, value100, flush; steps must not go back from one micro-batch to the next.
    """
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return log.groupBy("job").transformWithStateInPandas(
        CountWindowProcessor(idle_ms), "job int, report long, metric string, total long, n long, last_step long", "Append",
        "None" if idle_ms is None else "ProcessingTime")


def open_windows(closed: DataFrame, log: DataFrame) -> DataFrame:
    """The windows that no marked row has closed: the log's rows behind the last closed window of each job."""
    ends = closed.groupBy("job").agg(F.max("last_step").alias("end"), (F.max("report") + 1).alias("report"))
    rest = log.join(ends, "job", "left").filter(F.col("end").isNull() | (F.col("step") > F.col("end")))
    return rest.groupBy("job", F.coalesce("report", F.lit(0)).cast("bigint").alias("report"), "metric").agg(
        F.sum("value100").alias("total"), F.count("*").alias("n"), F.max("step").alias("last_step"))


# --- upserts ------------------------------------------------------------------------------------


class LiveFolders:
    """Which folders below a path make up a table, kept as numbered lists of which the last one counts.

    A list is written beside its place and then renamed, so a reader sees the old
    one or the new one. The folders of the last two lists are kept for readers under way.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.system = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        if not self.system.exists(self._path("_live")):
            return []
        names = [s.getPath().getName() for s in self.system.listStatus(self._path("_live"))]
        return sorted(int(n) for n in names if n.isdigit())

    def read(self, version: int | None = None) -> list[str]:
        known = self.versions()
        if not known:
            return []
        text = self.spark.read.text(f"{self.path}/_live/{(known[-1] if version is None else version):09}", wholetext=True).first()[0]
        return json.loads(text)

    def swap(self, version: int, folders: list[str]) -> None:
        half = self._path(f"_live/.{version:09}.{uuid.uuid4().hex}")
        out = self.system.create(half)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        if not self.system.rename(half, self._path(f"_live/{version:09}")):
            raise OSError(f"version {version} of {self.path} is there already")
        self._clean(version)

    def _clean(self, version: int) -> None:
        known = self.versions()
        kept = {f for v in known[-2:] for f in self.read(v)}
        for status in self.system.listStatus(self._path("")):
            name = status.getPath().getName()
            if re.fullmatch(r"level\d+-\d+", name) and name not in kept and int(name.split("-")[1]) < version:
                self.system.delete(status.getPath(), True)
        for v in known[:-2]:
            self.system.delete(self._path(f"_live/{v:09}"), False)


def upsert_predictions(stream: DataFrame, keys: list[str], value: str, order: list[str], path: str, fan: int = 8) -> StreamingQuery:
    """Keep the latest write of each pixel.

    Every micro-batch writes its own reduced folder. ``fan`` folders of one level are merged
    into one of the next, so after n batches at most ``fan`` folders a level and log n
    levels are live, and each row is rewritten log n times. Folders are named by the
    batch that makes them and become live only by the swap of the list: a batch that is
    repeated after a failure writes the same folders again, and one whose list is there already does nothing.

    The latest write is found by sorting, so rows are first dealt over the shuffle width, however
    few files they come in. A batch may write one pixel any number of times and deals those rows
    apart; folders hold a pixel once each, and its rows meet at once.
    """
    spark = stream.sparkSession

    def reduced(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.max(F.struct(*order, value)).alias("top")).select(*keys, "top.*")

    def merge(batch: DataFrame, batch_id: int) -> None:
        live = LiveFolders(spark, path)
        known = live.versions()
        if known and known[-1] >= batch_id:
            return
        reduced(spread(batch, *keys, *order)).write.mode("overwrite").parquet(f"{path}/level0-{batch_id}")
        folders = [*live.read(), f"level0-{batch_id}"]
        level = 0
        while len(full := [f for f in folders if f.startswith(f"level{level}-")]) >= fan:
            level += 1
            merged = f"level{level}-{batch_id}"
            reduced(spread(spark.read.parquet(*[f"{path}/{f}" for f in full]), *keys)).write.mode("overwrite").parquet(f"{path}/{merged}")
            folders = [f for f in folders if f not in full] + [merged]
        live.swap(batch_id, folders)

    writer = stream.writeStream.foreachBatch(merge).trigger(availableNow=True)
    return writer.option("checkpointLocation", f"{path}/_checkpoint").start()


def current(spark: SparkSession, path: str, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The latest write of each pixel, from the live folders."""
    folders = LiveFolders(spark, path).read()
    if not folders:
        raise ValueError(f"{path} holds no batch yet")
    return last_write(spread(spark.read.parquet(*[f"{path}/{f}" for f in folders]), *keys), keys, value, order)
