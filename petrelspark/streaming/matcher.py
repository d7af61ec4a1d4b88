"""The three-event patterns on a stream of trace events, keyed by variable, with typed state.

State of a variable, for each rule and thread: the open start and the other threads' last middle events since, as rows of a list.  Its size is
bounded by rules x threads squared, however long the stream; with ``idle_ms`` the state of a variable that nothing has happened
to for so long expires.  Events of a variable have to arrive in the order of their index, a micro-batch at a time; within a batch they are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from petrelspark.operators.sequence import RULES

WITNESS = "rule int, var string, tid_i int, tid_j int, start_idx long, mid_idx long, end_idx long"
#: A row for each open start (``other`` and ``mid`` null) and for each middle event that it has seen.
HELD = "rule int, tid int, start long, other int, mid long"
#: Typed state needs this state store.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Open = dict[int, dict[int, tuple[int, dict[int, int]]]]


def _step(held: Open, idx: int, tid: int, kind: str) -> Iterator[tuple[int, int, int, int]]:
    """Take one event: ends first, then middles, then starts; (rule, other thread, start, middle) of the patterns that it ends."""
    for rule, (s, m, e) in RULES.items():
        threads = held.setdefault(rule, {})
        mine = threads.get(tid)
        if kind == e and mine:
            for other, mid in sorted(mine[1].items()):
                yield rule, other, mine[0], mid
            threads[tid] = (mine[0], {})
        if kind == m:
            for t, (_, mids) in threads.items():
                if t != tid:
                    mids[tid] = idx
        if kind == s:
            threads[tid] = (idx, {})


class Matcher(StatefulProcessor):
    """Keeps what is open for a variable, and gives the patterns that its new events end."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("held", HELD, self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held: Open = {}
        for rule, tid, start, other, mid in self.state.get():
            mids = held.setdefault(rule, {}).setdefault(tid, (start, {}))[1]
            if other is not None:
                mids[other] = mid
        # three numbers of each event are kept, as a variable's events may come in several batches in any order
        parts = [(b["idx"].to_numpy(np.int64), b["tid"].to_numpy(np.int64), (b["kind"] == "load").to_numpy()) for b in rows]
        idx, tid, load = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(idx, kind="stable")
        found = [
            (rule, key[0], t, other, start, mid, i)
            for i, t, is_load in zip(idx[order].tolist(), tid[order].tolist(), load[order].tolist(), strict=True)
            for rule, other, start, mid in _step(held, i, t, "load" if is_load else "store")
        ]
        kept = [(rule, t, start, other, mid) for rule, threads in held.items() for t, (start, mids) in threads.items() for other, mid in [(None, None), *mids.items()]]
        if kept:
            self.state.put(kept)
        if found:
            yield pd.DataFrame(found, columns=["rule", "var", "tid_i", "tid_j", "start_idx", "mid_idx", "end_idx"])

    def close(self) -> None:
        pass


def online_witnesses(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Witnesses of a streaming trace (idx, tid, var, kind), each when its end arrives.  Events with a null in any of these are left out.

    The session's state store has to be ``PROVIDER`` when the query starts (``spark.sql.streaming.stateStore.providerClass``); it is set here."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    whole = events.select("idx", "tid", "var", "kind").where("idx is not null and tid is not null and var is not null and kind in ('load', 'store')")
    return whole.groupBy("var").transformWithStateInPandas(statefulProcessor=Matcher(idle_ms), outputStructType=WITNESS, outputMode="Append", timeMode="ProcessingTime" if idle_ms else "None")
