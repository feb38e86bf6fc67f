"""Folds of a key's rows in time order whose state is small: admission and progress.

A fold is a pair (start, step): ``step(state, row)`` returns the row's outcome and changes the
state, a JSON-like dict.  In a batch, rows are dealt by key, sorted by time and walked, so a key's
rows are streamed and never gathered; in a stream, Spark keeps the state between micro-batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class Fold:
    start: Callable[[], dict]
    step: Callable[[dict, dict], dict]
    outcome: str  # the outcome's columns, as a schema string
    finish: Callable[[dict, dict], dict] | None = None  # state and the last row's outcome: that outcome once no more rows come


def rate_limit(limit: int, window_s: float) -> Fold:
    """Admits a call while fewer than ``limit`` calls *admitted* within the window; rejected calls don't count.

    Rows need ``t`` (seconds); outcomes are admitted and retry_after_s.
    """
    if limit < 1 or window_s <= 0:
        raise ValueError("limit and window must be positive")

    def step(state: dict, row: dict) -> dict:
        t = row["t"]
        live = [x for x in state["admitted"] if x > t - window_s]
        ok = len(live) < limit
        state["admitted"] = [*live, t] if ok else live
        return {"admitted": ok, "retry_after_s": 0.0 if ok else max(0.0, window_s - (t - live[0]))}

    return Fold(lambda: {"admitted": []}, step, "admitted boolean, retry_after_s double")


def coalesce_progress(step_fraction: float = 0.01, heartbeat_s: float = 5.0, early_stages: int = 16, cap: int = 512) -> Fold:
    """Which progress records of an attempt are persisted: first ones, new stages, steps and heartbeats.

    Fractions never fall.  One record of the cap is reserved for a final flush: in a batch the
    last record is persisted in any case; :func:`flushed_stream` knows it by a timer.  Rows need t
    (seconds), stage and fraction; outcomes are persisted and fraction_so_far.
    """

    def step(state: dict, row: dict) -> dict:
        said = row["fraction"]
        if said is None or said != said:
            return {"persisted": False, "fraction_so_far": state["seen"]}
        state["seen"] = fraction = max(state["seen"], min(1.0, max(0.0, said)))
        stage = (row["stage"] or "RUNNING")[:100]
        new = stage not in state["stages"] and len(state["stages"]) < early_stages
        if new:
            state["stages"].append(stage)
        due = not state["n"] or new or fraction - state["kept"] >= step_fraction or row["t"] - state["at"] >= heartbeat_s
        out = bool(due and state["n"] < cap - 1 and (stage, fraction) != (state["stage"], state["kept"]))
        if out:
            state.update(kept=fraction, stage=stage, at=row["t"], n=state["n"] + 1)
        return {"persisted": out, "fraction_so_far": fraction}

    return Fold(lambda: {"seen": 0.0, "kept": 0.0, "stage": None, "stages": [], "at": 0.0, "n": 0}, step, "persisted boolean, fraction_so_far double", lambda state, out: out | {"persisted": out["persisted"] or state["n"] > 0})


def _schema(rows: DataFrame, fold: Fold) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), fold.outcome])


def folded(rows: DataFrame, key: str, order: list[str], fold: Fold) -> DataFrame:
    """``rows`` with the fold's outcome, in a batch."""
    names = [x.split()[0] for x in fold.outcome.split(", ")]

    def made(rows: list[dict], out: list[dict], like: pa.RecordBatch) -> pa.RecordBatch:
        kinds = [pa.bool_() if "boolean" in kind else pa.float64() for kind in fold.outcome.split(", ")]
        columns = [pa.array([r[n] for r in rows], f.type) for n, f in zip(like.schema.names, like.schema, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array([r[n] for r in out], k) for n, k in zip(names, kinds, strict=True))], [*like.schema.names, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, held, like = object(), {}, None, None  # the last row waits until it is known whether its key goes on
        for batch in batches:
            rows, out, like = [], [], batch
            for row in batch.to_pylist():
                if held is not None:
                    last, said = held
                    rows.append(last), out.append(fold.finish(state, said) if fold.finish and row[key] != now else said)
                if row[key] != now:
                    now, state = row[key], fold.start()
                held = row, fold.step(state, row)
            if rows:
                yield made(rows, out, like)
        if held is not None:
            yield made([held[0]], [fold.finish(state, held[1]) if fold.finish else held[1]], like)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, _schema(rows, fold))


def folded_stream(rows: DataFrame, key: str, order: list[str], fold: Fold) -> DataFrame:
    """``rows`` of a stream with the fold's outcome; a key's state lives on in the checkpoint."""

    def run(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else fold.start()
        for frame in frames:
            frame = frame.sort_values(order, kind="stable").reset_index(drop=True)
            out = pd.DataFrame([fold.step(held, r) for r in frame.to_dict("records")])
            yield pd.concat([frame, out], axis=1)
        state.update((json.dumps(held),))

    return rows.groupBy(key).applyInPandasWithState(run, _schema(rows, fold), "state string", "append", GroupStateTimeout.NoTimeout)


#: The store that keeps timers and states which expire.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def flushed_stream(rows: DataFrame, key: str, order: list[str], fold: Fold, event_time: str, idle_s: float, forget_s: float | None = None) -> DataFrame:
    """``rows`` of a stream with the fold's outcome, in which a key's last row is flushed.

    The newest row of a key is held until another comes or, by a timer, until the watermark of
    ``event_time`` is ``idle_s`` past it: then it is the last, and ``fold.finish`` has its say.
    A key that was flushed keeps its state; one without rows for ``forget_s`` after its last row
    is forgotten by a second timer, so states don't pile up.  Rows behind the watermark are
    dropped by Spark, as in any stream.  Needs a watermark and the session's
    ``spark.sql.streaming.stateStore.providerClass`` set to :data:`STATE_STORE`.
    """
    if rows.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STATE_STORE:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STATE_STORE}")
    schema = rows.schema
    idle, forget = int(idle_s * 1000), None if forget_s is None else int(max(forget_s, idle_s) * 1000)
    processor = _Flushing(fold, key, [f.name for f in schema], order, event_time, idle, forget)
    return rows.groupBy(key).transformWithStateInPandas(processor, _schema(rows, fold), "Append", "EventTime")


class _Flushing(StatefulProcessor):
    """One key's fold: the state and the row held back, in one value; a timer for the flush and one to forget."""

    def __init__(self, fold: Fold, key: str, columns: list[str], order: list[str], event_time: str, idle: int, forget: int | None):
        self.fold, self.key, self.columns, self.order, self.event_time, self.idle, self.forget = fold, key, columns, order, event_time, idle, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("fold", "said string")

    def _frame(self, out: list[tuple[dict, dict]]) -> pd.DataFrame:
        names = [*self.columns, *(x.split()[0] for x in self.fold.outcome.split(", "))]
        frame = pd.DataFrame([{**row, **said} for row, said in out], columns=names)
        if len(frame):
            frame[self.event_time] = pd.to_datetime(frame[self.event_time])
        return frame

    def _last(self, kept: dict) -> tuple[dict, dict]:
        row, said = kept["held"]
        return row, self.fold.finish(kept["state"], said) if self.fold.finish else said

    def _timers(self, at: int | None) -> None:
        """The timers that a key is to have from now on: the later of two is for forgetting."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if at is not None:
            self.handle.registerTimer(at + self.idle)
            if self.forget is not None and self.forget > self.idle:
                self.handle.registerTimer(at + self.forget)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = json.loads(self.value.get()[0]) if self.value.exists() else {"state": self.fold.start(), "held": None, "at": None}
        out, at, now = [], kept["at"], timerValues.getCurrentWatermarkInMs()
        if at is not None and kept["held"] is not None and now >= at + self.idle:  # rows come before timers that are due with them
            out.append(self._last(kept))
            kept["held"] = None
        if at is not None and self.forget is not None and now >= at + self.forget:
            kept["state"] = self.fold.start()
        state, held = kept["state"], kept["held"]
        frame = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")  # a micro-batch of one key
        for row in frame.to_dict("records"):
            if held is not None:
                out.append(tuple(held))
            at = max(at or 0, int(pd.Timestamp(row[self.event_time]).value // 1_000_000))
            held = [{**row, self.event_time: str(row[self.event_time])}, self.fold.step(state, row)]
        self.value.update((json.dumps({"state": state, "held": held, "at": at}, default=_plain),))
        self._timers(at)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.value.exists():
            kept = json.loads(self.value.get()[0])
            if kept["held"] is not None:
                out.append(self._last(kept))
            if self.forget is not None and expiredTimerInfo.getExpiryTimeInMs() >= kept["at"] + self.forget:
                self.value.clear()
            else:
                self.value.update((json.dumps({**kept, "held": None}),))
        yield self._frame(out)

    def close(self) -> None:
        pass


def _plain(x):
    """Numbers of NumPy as JSON has them."""
    return x.item() if hasattr(x, "item") else str(x)
