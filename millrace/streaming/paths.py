"""Recurrences along the paths of a stream: state for each path, timers for late rows, and a sink that a restart doesn't repeat."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from millrace.operators.recurrences import RULES

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Along(StatefulProcessor):
    """Keeps a path's state of the recurrence and, with late rows, what waits for the watermark."""

    def __init__(self, rule: str, options: dict[str, float], names: list[str], waits: bool):
        self.rule, self.options, self.names, self.waits = rule, options, names, waits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.recurrence = handle, RULES[self.rule](**self.options)
        self.state = handle.getValueState("state", "state binary")
        if self.waits:
            self.waiting = handle.getMapState("waiting", "at long, tie long", "v double")

    def _applied(self, key: Any, rows: list[tuple[int, int, float]]) -> pd.DataFrame:
        rows.sort(key=lambda r: r[:2])
        x = np.array([r[2] for r in rows], float)
        state = pickle.loads(self.state.get()[0]) if self.state.exists() else None
        out = self.recurrence.run(state, x)
        self.state.update((pickle.dumps(self.recurrence.after(state, self.recurrence.summary(x))),))
        path, time, order, value, name = self.names
        return pd.DataFrame({path: [key] * len(rows), time: pd.to_datetime([r[0] for r in rows], unit="us", utc=True).tz_convert(None), order: [r[1] for r in rows], value: x, name: out})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = []
        for part in rows:
            at = part[self.names[1]].astype("datetime64[us]").astype("int64")
            now += list(zip(at.tolist(), part[self.names[2]].tolist(), part[self.names[3]].astype(float).tolist()))
        if not self.waits:
            yield self._applied(key[0], now)
            return
        passed = timerValues.getCurrentWatermarkInMs()
        for at, tie, v in now:
            if at // 1000 >= passed:
                self.waiting.updateValue((at, tie), (v,))
        for ms in {at // 1000 for at, _, _ in now if at // 1000 >= passed}:
            self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs()
        due = [(at, tie, v[0]) for (at, tie), v in self.waiting.iterator() if at // 1000 <= upto]
        if due:
            for at, tie, _ in due:
                self.waiting.removeKey((at, tie))
            yield self._applied(key[0], due)

    def close(self) -> None:
        pass


def along_stream(events: DataFrame, path: str, time: str, order: str, value: str, rule: str, late: str | None = None, **options: float) -> DataFrame:
    """path, time, order, value and the rule's output (ewma, vol, held or drawdown; see recurrences) along each path of a stream, by time and then order (a number).

    late: how much later than others a row may come; rows wait in state, with a timer at their
    time, until the watermark has passed them, and come out in order; later ones are dropped.
    Without it, a batch's rows are in order among themselves and after those of batches before
    it. NULL values change nothing. State is in the checkpoint: a restart goes on from it, with
    the results of one batch run over all rows.
    """
    spark = events.sparkSession
    if spark.conf.get(PROVIDER) != ROCKS:
        raise ValueError(f"state with timers needs {PROVIDER} = {ROCKS}")
    kinds = {f.name: f.dataType for f in events.schema.fields}
    rows = events.select(path, F.col(time).cast("timestamp").alias(time), F.col(order).cast("long").alias(order), F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double")).alias(value))
    rows = rows.withWatermark(time, late) if late else rows
    schema = T.StructType([T.StructField(path, kinds[path]), T.StructField(time, T.TimestampType()), T.StructField(order, T.LongType()), T.StructField(value, T.DoubleType()), T.StructField(rule, T.DoubleType())])
    processor = _Along(rule, options, [path, time, order, value, rule], late is not None)
    return rows.groupBy(path).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime" if late else "None")


def each_batch(stream: DataFrame, call: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Calls back with every batch and its number. After a failure the last number may come again, with the same rows."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(call)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def to_folder(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes each batch under path/batch=<number>, over what a failed try of the same batch has left: each row is there once."""
    return each_batch(stream, lambda df, k: df.write.mode("overwrite").parquet(f"{path}/batch={k}"), checkpoint, available_now)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).drop("batch")
