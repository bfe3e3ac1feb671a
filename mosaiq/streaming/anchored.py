"""Sliding windows over a stream that begin at each key's first event, with keyed state."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SECOND = 1_000_000


class AnchoredCounts(StatefulProcessor):
    """Counts of codes in the windows (start, end] of a key, from the key's first event on.

    The first event isn't known until the watermark has passed it, since an earlier one may still come; until
    then events wait in the state. From then on only counts by pane and code are kept, and a pane
    goes when no later window holds it. A window is given once, when the watermark has passed its end
    and the key has an event at its end or later.
    """

    def __init__(self, by: str, time: str, code: str, width: int, shift: int):
        self.by, self.time, self.code = by, time, code
        self.pane = math.gcd(width, shift)
        self.step, self.panes = shift // self.pane, width // self.pane

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.span = handle.getValueState("span", "origin long, last long, next long, fixed boolean")
        self.waiting = handle.getListState("waiting", "t long, code string")
        self.counts = handle.getMapState("counts", "pane long, code string", "n long")

    def _count(self, origin: int, events: list[tuple[int, str]]) -> None:
        new: dict[tuple[int, str], int] = {}
        for t, code in events:
            if t > origin:
                at = (-((origin - t) // (self.pane * SECOND)) - 1, code)
                new[at] = new.get(at, 0) + 1
        for at, n in new.items():
            self.counts.updateValue(at, ((self.counts.getValue(at)[0] if self.counts.containsKey(at) else 0) + n,))

    def _ready(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        """The windows that are whole by now; asks to be called again when the watermark may have more."""
        origin, last, following, fixed = self.span.get()
        if not fixed:
            if watermark * 1000 <= origin:
                self.handle.registerTimer(origin // 1000 + 1)
                return
            self._count(origin, [tuple(x) for x in self.waiting.get()])
            self.waiting.clear()
            fixed = True
        out: list[tuple] = []
        held = None
        while (end := origin + (following * self.step + self.panes) * self.pane * SECOND) <= last and end < watermark * 1000:
            held = {tuple(k): v[0] for k, v in self.counts.iterator()} if held is None else held
            low = following * self.step
            total: dict[str, int] = {}
            for (pane, code), n in list(held.items()):
                if pane < low:
                    self.counts.removeKey((pane, code))
                    del held[pane, code]
                elif pane < low + self.panes:
                    total[code] = total.get(code, 0) + n
            out += [(key[0], following, code, n) for code, n in sorted(total.items())]
            following += 1
        self.span.update((origin, last, following, fixed))
        if end <= last:
            self.handle.registerTimer(end // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=[self.by, "window", "code", "n"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events: list[tuple[int, str]] = []
        for b in rows:
            events += zip((b[self.time].astype("datetime64[us]").astype("int64")).tolist(), b[self.code].astype(str).tolist(), strict=True)
        first, latest = min(events)[0], max(events)[0]
        origin, last, following, fixed = self.span.get() if self.span.exists() else (first, latest, 0, False)
        last = max(last, latest)
        if fixed:
            self._count(origin, events)
        else:
            origin = min(origin, first)
            self.waiting.appendList(events)
        self.span.update((origin, last, following, fixed))
        yield from self._ready(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._ready(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def anchored_counts(stream: DataFrame, time: str, by: str, code: str, width: int, shift: int, late: str) -> DataFrame:
    """``by, window, code, n``: how often each code occurs in each whole window of ``width`` seconds every ``shift``, from a key's first event on.

    ``time`` is a timestamp, and events may come ``late`` after later ones. The session needs the RocksDB
    state store (``spark.sql.streaming.stateStore.providerClass``); the output mode is append.
    """
    kind = stream.schema[by].dataType.simpleString()
    events = stream.select(by, time, code).withWatermark(time, late)
    return events.groupBy(by).transformWithStateInPandas(statefulProcessor=AnchoredCounts(by, time, code, width, shift), outputStructType=f"{by} {kind}, window long, code string, n long", outputMode="Append", timeMode="EventTime")
