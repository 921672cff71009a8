"""The state of runs as a stream: kept per run between batches, with a timer for runs that fall silent, and a sink of protocol lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import text as T

_FIELDS = ("first", "last", "stage", "stage_at", "code", "code_at")
_STATE = "first long, last long, stage int, stage_at long, code int, code_at long"
_OUT = "run {run}, stage int, seconds long, state string, code int"


class _Run(StatefulProcessor):
    """Keeps of each run its first and last message, the step named last and the code that ended it; times are milliseconds."""

    def __init__(self, stall: int):
        self.stall = stall

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("run", _STATE)

    def _row(self, key, s: dict, silent: bool) -> pd.DataFrame:
        state = ("done" if s["code"] == 0 else "stopped") if s["code"] is not None else "stalled" if silent else "running"
        row = {"run": [key[0]], "stage": [s["stage"]], "seconds": [s["last"] // 1000 - s["first"] // 1000], "state": [state], "code": [s["code"]]}
        return pd.DataFrame(row).astype({"stage": "Int32", "code": "Int32"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = dict(zip(_FIELDS, self.kept.get(), strict=True)) if self.kept.exists() else dict.fromkeys(_FIELDS)
        for frame in rows:
            for at, stage, code in zip(frame["ms"].tolist(), frame["stage"], frame["code"], strict=True):
                s["first"], s["last"] = min(at, s["first"] if s["first"] is not None else at), max(at, s["last"] if s["last"] is not None else at)
                for name, value in (("stage", stage), ("code", code)):
                    if not pd.isna(value) and (s[f"{name}_at"] is None or (at, int(value)) >= (s[f"{name}_at"], s[name])):
                        s[name], s[f"{name}_at"] = int(value), at
        self.kept.update(tuple(s[f] for f in _FIELDS))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(s["last"] + self.stall)
        yield self._row(key, s, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = dict(zip(_FIELDS, self.kept.get(), strict=True))
        if s["code"] is not None:
            self.kept.clear()  # it has ended, and nothing more is awaited
            return
        yield self._row(key, s, True)

    def close(self) -> None:
        pass


def states(messages: DataFrame, steps: tuple[str, ...], stall_seconds: int = 600, late: str = "10 minutes") -> DataFrame:
    """(run, stage, steps, clock, state, code) of each run of a stream of messages (run, at timestamp, label, code), whenever it changes.

    The same as `progress.overall` over all messages so far, and `stalled` for a run without a code whose last message is
    `stall_seconds` behind the watermark; a further message sets it going again.  Messages may come in any order within `late`;
    those behind the watermark are left out.  The state of an ended run is dropped when its timer expires.
    """
    number = F.array_position(F.array(*[F.lit(s) for s in steps]), F.col("label")).cast("int")
    rows = messages.withWatermark("at", late).select("run", "at", F.unix_millis("at").alias("ms"), F.when(number > 0, number).alias("stage"), F.col("code").cast("int").alias("code"))
    shape = _OUT.format(run=messages.schema["run"].dataType.simpleString())
    found = rows.groupBy("run").transformWithStateInPandas(_Run(stall_seconds * 1000), shape, "Update", "EventTime")
    return found.select("run", "stage", F.lit(len(steps)).alias("steps"), T.mmss(F.col("seconds")).alias("clock"), "state", "code")


def emit(progress: DataFrame, folder: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Writes the rows (label, i, n, note) of a stream as lines of the protocol; a batch that is run again writes the same folder again."""
    line = F.concat_ws("\t", F.lit("@@PROGRESS"), "label", F.col("i").cast("string"), F.col("n").cast("string"), F.coalesce("note", F.lit("")))

    def write(batch: DataFrame, number: int) -> None:
        batch.orderBy("label").select(line.alias("value")).write.mode("overwrite").text(f"{folder}/batch={number}")

    return progress.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
