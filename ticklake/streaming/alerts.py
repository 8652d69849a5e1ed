"""Alert rules on a stream of samples: a state machine per series, with event-time timers.

Each rule of a series is inactive, pending (its condition holds), firing (it has held long enough) or resolved. A
batch's samples are worked through in order of time. What a counter rule needs of the past, the growth between
the samples of its window, is kept in state, as is the start of each unbroken run. A run that becomes old enough
without a new sample fires by a timer, once the watermark has passed that moment.

Rows (alertname, severity, keys, ts, value, since, event): ``sample`` for each sample at which a rule fires, the same
rows as ``metrics.evaluate_rules`` gives for the same samples; ``pending``, ``firing`` and ``resolved`` for each
change of state, with the time of the sample or timer that made it.

Samples that are not later than the last one of their series are dropped, but for those of one batch and
millisecond, of which the largest counts. Decimals are kept as decimals, so sums over a window are exact.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import DecimalType, StructType

from ticklake.operators.metrics import ALERT_RULES, carries

INACTIVE, PENDING, FIRING = 0, 1, 2
RATE = "rate:"


Number = float | Decimal


def _breaks(value: Number | None, comparison: str, threshold: float) -> bool:
    if value is None or math.isnan(value):
        return False
    return {">": value > threshold, "<": value < threshold, "==": value == threshold}[comparison]


class Growth:
    """The growth in a window, oldest first; its sum costs the same whatever it holds.

    The older part carries sums from each entry to its end, the newer one is a running sum; so nothing is ever
    subtracted. When the older part is used up, the newer one takes its place. The first entry is the growth up to
    the first sample, which lies outside, and is left out of the sum.
    """

    def __init__(self, zero: Number, entries: Iterable[tuple[int, Number]] = ()):
        self.zero, self.entries, self.sums, self.newer = zero, deque(), [], zero
        for ts, grow in entries:
            self.add(ts, grow)

    def add(self, ts: int, grow: Number) -> None:
        self.entries.append((ts, grow))
        self.newer += grow

    def drop_until(self, ts: int) -> None:
        while self.entries and self.entries[0][0] <= ts:
            self._turn()
            self.entries.popleft()
            self.sums.pop()

    def _turn(self) -> None:
        """Sums of all entries from each to the last, that of the oldest at the end."""
        if not self.sums:
            total = self.zero
            for _, grow in reversed(self.entries):
                total += grow
                self.sums.append(total)
            self.newer = self.zero

    def after_first(self) -> Number:
        self._turn()
        older = self.sums[-2] if len(self.sums) > 1 else self.zero
        return older + self.newer


class AlertProcessor(StatefulProcessor):
    """All rules of one series of one metric."""

    def __init__(self, rules, keys: Sequence[str], marks: dict, kind: type, window_s: int, max_gap_s: float | None):
        self.rules, self.keys, self.marks, self.kind = rules, list(keys), marks, kind
        self.window_s, self.max_gap_ms = window_s, None if max_gap_s is None else max_gap_s * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts long, value string")
        self.grown = handle.getListState("grown", "ts long, grow string")
        self.runs = handle.getMapState("runs", "rule int", "state int, since long, value double, due long")

    def _mine(self, key) -> list[int]:
        """The rules that look at this series."""
        metric, labels = key[0], dict(zip(self.marks, key[1 + len(self.keys) :]))
        return [
            i
            for i, (_, _, kind, _, _, _, label) in enumerate(self.rules)
            if kind.removeprefix(RATE) == metric and (label is None or labels[label])
        ]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, Number | None] = {}
        for frame in rows:
            for ms, text in zip(frame["ms"].tolist(), frame["value"].tolist()):
                value = None if text is None else self.kind(text)
                known = new.get(ms)
                new[ms] = value if known is None else known if value is None else max(known, value)
        mine = self._mine(key)
        held = self.last.get()
        ts_before, value_before = (held[0], self._read(held[1])) if held is not None else (None, None)
        order = sorted(ms for ms in new if ts_before is None or ms > ts_before)
        if not order or not mine:
            return
        counter = any(self.rules[i][2].startswith(RATE) for i in mine)
        stored = self.grown.get() if counter else ()
        window = Growth(self.kind(0), ((ts, self._read(grow)) for ts, grow in stored))
        runs = {i: tuple(v) for (i,), v in self.runs.iterator()}
        before = dict(runs)
        out: list[tuple] = []
        for ts in order:
            value, rate = new[ts], None
            if counter and value is not None:
                step = self.kind(0) if value_before is None else value if value < value_before else value - value_before
                window.drop_until(ts - self.window_s * 1000)
                window.add(ts, step)
                if len(window.entries) > 1:
                    rate = float(window.after_first()) / self.window_s
            broken_off = self.max_gap_ms is not None and ts_before is not None and ts - ts_before > self.max_gap_ms
            for i in mine:
                reading = rate if self.rules[i][2].startswith(RATE) else value
                self._step(i, ts, reading, broken_off, runs, out)
            ts_before, value_before = ts, value_before if value is None else value
        self.last.update((ts_before, None if value_before is None else str(value_before)))
        if counter:
            self.grown.put([(ts, str(grow)) for ts, grow in window.entries])
        for i, run in runs.items():
            if before.get(i) == run:
                continue
            self.runs.updateValue((i,), run)
            if run[0] == PENDING:
                self.handle.registerTimer(run[3])
        yield self._frame(key, out)

    def _read(self, text: str | None) -> Number | None:
        return None if text is None else self.kind(text)

    def _step(self, i: int, ts: int, value: Number | None, broken_off: bool, runs: dict, out: list) -> None:
        _, _, _, comparison, threshold, minutes, _ = self.rules[i]
        state, since, _, due = runs.get(i, (INACTIVE, 0, 0.0, 0))
        if not _breaks(value, comparison, threshold):
            if state == FIRING:
                out.append((i, ts, value, since, "resolved"))
            if state != INACTIVE:
                runs[i] = (INACTIVE, 0, 0.0, 0)
            return
        if state == INACTIVE or broken_off:
            if state == FIRING:
                out.append((i, ts, value, since, "resolved"))
            since, due, state = ts, ts + minutes * 60_000, PENDING
            out.append((i, ts, value, since, "pending"))
        if ts >= due:
            if state == PENDING:
                out.append((i, ts, value, since, "firing"))
            state = FIRING
            out.append((i, ts, value, since, "sample"))
        runs[i] = (state, since, float(value), due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        out = []
        for (i,), (state, since, value, due) in list(self.runs.iterator()):
            if state == PENDING and due == at and self._reaches(at):
                out.append((i, at, value, since, "firing"))
                self.runs.updateValue((i,), (FIRING, since, value, due))
        if out:
            yield self._frame(key, out)

    def _reaches(self, at: int) -> bool:
        """Whether the last sample still speaks for this time."""
        return self.max_gap_ms is None or at - self.last.get()[0] <= self.max_gap_ms

    def _frame(self, key, out: list) -> pd.DataFrame:
        names = dict(zip(self.keys, key[1 : 1 + len(self.keys)]))
        text = lambda values: pd.Series(values, dtype=object)
        when = lambda ms: pd.to_datetime(pd.Series(ms, dtype="int64"), unit="ms", utc=True)
        return pd.DataFrame(
            {
                "alertname": text([self.rules[r[0]][0] for r in out]),
                "severity": text([self.rules[r[0]][1] for r in out]),
                **{k: pd.Series([v] * len(out), dtype=object) for k, v in names.items()},
                "ts": when([r[1] for r in out]),
                "value": [None if r[2] is None else float(r[2]) for r in out],
                "since": when([r[3] for r in out]),
                "event": text([r[4] for r in out]),
            }
        )

    def close(self) -> None:
        pass


def alerts(
    samples: DataFrame,
    keys: Sequence[str],
    rules=ALERT_RULES,
    window_s: int = 300,
    max_gap_s: float | None = None,
    delay: str = "0 seconds",
) -> DataFrame:
    """Alert rules over a stream of samples (metric, keys, ts, value), see above.

    ``delay`` is how long the watermark, which the timers follow, waits behind the newest sample.
    """
    rules = [(*r, None)[:7] for r in rules]
    labels = sorted({r[6] for r in rules if r[6]})
    marks = {label: f"_has_{i}" for i, label in enumerate(labels)}
    wanted = sorted({r[2].removeprefix(RATE) for r in rules})
    read = (
        samples.withWatermark("ts", delay)
        .where(F.col("metric").isin(wanted))
        .select(
            "metric",
            *keys,
            *[carries(samples, label).alias(c) for label, c in marks.items()],
            "ts",
            F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
            F.col("value").cast("string").alias("value"),
        )
        .where("ms is not null")
    )
    kind = Decimal if isinstance(samples.schema["value"].dataType, DecimalType) else float
    schema = StructType().add("alertname", "string").add("severity", "string")
    for k in keys:
        schema = schema.add(samples.schema[k])
    schema = schema.add("ts", "timestamp").add("value", "double").add("since", "timestamp").add("event", "string")
    return read.groupBy("metric", *keys, *marks.values()).transformWithStateInPandas(
        statefulProcessor=AlertProcessor(rules, keys, marks, kind, window_s, max_gap_s),
        outputStructType=schema,
        outputMode="Update",
        timeMode="EventTime",
    )
