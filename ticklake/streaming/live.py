"""Live rates and counters that can be reset, as keyed state (RocksDB state store).

Both write a row whenever a number changes, with how far its key had come (``seen``, which only grows), so the last
row of a number is the right one and a replayed batch writes the same rows again. ``latest`` keeps those.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType


def latest(updates: DataFrame, keys: Sequence[str], seen: str = "seen") -> DataFrame:
    """The last row of each number."""
    rest = [c for c in updates.columns if c not in (*keys, seen)]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), seen).alias("_l"))
    return last.select(*keys, "_l.*")


def _together(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """One trigger's rows of a key, counted by some columns before they are put together."""
    frames = [f.groupby(by, dropna=False).size().rename("n").reset_index() for f in rows]
    return pd.concat(frames).groupby(by, dropna=False)["n"].sum().reset_index() if frames else pd.DataFrame(columns=[*by, "n"])


def _named(key: dict, n: int) -> dict:
    """Columns of the key for n rows."""
    return {k: pd.Series([v] * n, dtype=object) for k, v in key.items()}


class RateProcessor(StatefulProcessor):
    """A ring of seconds per key: counts of the last ``seconds + late`` seconds, nothing older."""

    def __init__(self, seconds: int, late: int, keys: Sequence[str], ttl_ms: int | None):
        self.seconds, self.late, self.keys, self.ttl_ms = seconds, late, list(keys), ttl_ms

    def init(self, handle) -> None:
        self.ring = handle.getMapState("ring", "slot int", "sec long, n long", self.ttl_ms)
        self.total = handle.getValueState("total", "newest long, seen long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _together(rows, ["sec"]).dropna().sort_values("sec")
        if not len(new):
            return
        size = self.seconds + self.late
        newest, seen = self.total.get() or (None, 0)
        # Late seconds count while every window they are in can still be made from the ring.
        if newest is not None:
            new = new[new["sec"] > newest - self.late - 1]
        if not len(new):
            return
        counts = {} if newest is None else {sec: n for sec, n in self.ring.values() if sec > newest - size}
        for sec, n in zip(new["sec"].astype(int), new["n"].astype(int)):
            counts[sec] = counts.get(sec, 0) + n
        seen += int(new["n"].sum())
        first, last = int(new["sec"].min()), max(counts)
        # Windows that a changed second is in, as many as there are seconds with counts.
        order = np.array(sorted(counts))
        n = np.array([counts[s] for s in order.tolist()], dtype=np.int64)
        sums = np.concatenate([[0], np.cumsum(n)])
        low = np.searchsorted(order, order - self.seconds, side="right")
        at = np.arange(len(order))
        rate = (sums[at + 1] - sums[low]) / (at + 1 - low)
        out = order >= first
        # Only what the ring did not hold like this is written.
        changed = set(new["sec"].astype(int).tolist())
        for sec in order.tolist():
            if sec > last - size and sec in changed:
                self.ring.updateValue((sec % size,), (sec, counts[sec]))
        self.total.update((last, seen))
        names = dict(zip(self.keys, key))
        yield pd.DataFrame(
            {**_named(names, int(out.sum())), "sec": order[out], "n": n[out], "rate": rate[out], "seen": seen}
        )

    def close(self) -> None:
        pass


def sliding_rates(
    ticks: DataFrame, keys: Sequence[str], seconds: int = 60, late_s: int = 0, ttl_s: int | None = None
) -> DataFrame:
    """Mean messages per second over the last ``seconds``, divided by the non-empty ones, as ticks come in.

    Rows (keys, sec, n, rate, seen): ``latest`` of them by (keys, sec) is ``rates.sliding_rate`` of the same
    ticks, in whatever batches they come. A key has at most ``seconds + late_s`` entries of state; ticks of seconds
    more than ``late_s`` before the newest one of their key are dropped. With ``ttl_s`` the state of a key goes when
    it has been silent that long.
    """
    if seconds <= 0:
        raise ValueError("a window has at least a second")
    counted = ticks.select(*keys, F.unix_seconds(F.col("ts").cast("timestamp")).alias("sec"))
    fields = [ticks.schema[k] for k in keys]
    schema = StructType([*fields, StructField("sec", LongType()), StructField("n", LongType())])
    schema = schema.add("rate", "double").add("seen", "long")
    return counted.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=RateProcessor(seconds, late_s, keys, None if ttl_s is None else ttl_s * 1000),
        outputStructType=schema,
        outputMode="Update",
        timeMode="None" if ttl_s is None else "ProcessingTime",
    )


class CountProcessor(StatefulProcessor):
    """Counts per epoch of a key, where a reset starts a new epoch, in order of event time.

    Of the last ``late_ms`` the counts are kept by time, so a reset that comes late still parts them.
    """

    def __init__(self, late_ms: int, keys: Sequence[str]):
        self.late_ms, self.keys = late_ms, list(keys)

    def init(self, handle) -> None:
        self.epochs = handle.getMapState("epochs", "start long", "n long")
        self.recent = handle.getMapState("recent", "at long", "n long")
        self.total = handle.getValueState("total", "newest long, seen long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _together(rows, ["at", "reset"]).dropna()
        if not len(new):
            return
        newest, seen = self.total.get() or (None, 0)
        # Times of epochs are all kept: their number is that of the resets. The first has no start.
        epochs = {start: n for (start,), (n,) in self.epochs.iterator()}
        recent = {at: n for (at,), (n,) in self.recent.iterator()}
        before = dict(epochs)
        ticks = new[~new["reset"]]
        starts = sorted(new.loc[new["reset"], "at"].astype(int))
        if not epochs:
            epochs[NO_RESET] = 0
        for start in starts:
            if start in epochs:
                continue
            order = sorted(epochs)
            old = max(s for s in order if s < start)
            until = min((s for s in order if s > start), default=None)
            moved = sum(n for at, n in recent.items() if at >= start and (until is None or at < until))
            epochs[start] = moved
            epochs[old] -= moved
        order = np.array(sorted(epochs))
        for at, n in zip(ticks["at"].astype(int), ticks["n"].astype(int)):
            epochs[int(order[np.searchsorted(order, at, side="right") - 1])] += n
            recent[at] = recent.get(at, 0) + n
        newest = max([*recent, *starts, *([] if newest is None else [newest])])
        seen += int(new["n"].sum())
        for at in [a for a in recent if a < newest - self.late_ms]:
            del recent[at]
        self._store(epochs, before, recent)
        self.total.update((newest, seen))
        changed = {s: n for s, n in sorted(epochs.items()) if before.get(s) != n}
        names = dict(zip(self.keys, key))
        yield pd.DataFrame(
            {
                **_named(names, len(changed)),
                "since": pd.array([None if s == NO_RESET else s for s in changed], dtype="Int64"),
                "n": list(changed.values()),
                "seen": seen,
            }
        )

    def _store(self, epochs: dict, before: dict, recent: dict) -> None:
        for start, n in epochs.items():
            if before.get(start) != n:
                self.epochs.updateValue((start,), (n,))
        kept = {at: n for (at,), (n,) in self.recent.iterator()}
        for at in kept.keys() - recent.keys():
            self.recent.removeKey((at,))
        for at, n in recent.items():
            if kept.get(at) != n:
                self.recent.updateValue((at,), (n,))

    def close(self) -> None:
        pass


#: Start of the epoch before any reset.
NO_RESET = -(1 << 62)


def with_resets(ticks: DataFrame, resets: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Ticks and resets (keys, ts) as one stream."""
    at = F.unix_millis(F.col(ts).cast("timestamp")).alias("at")

    def part(df: DataFrame, reset: bool) -> DataFrame:
        return df.select(*keys, at, F.lit(reset).alias("reset"))

    return part(ticks, False).unionByName(part(resets, True))


def resettable_counts(events: DataFrame, keys: Sequence[str] = ("exchange",), late_s: float = 0) -> DataFrame:
    """Messages since the last reset of their key, and those of the epochs before it.

    ``events`` come from ``with_resets``. Rows (keys, since in ms, n, seen): ``latest`` of them by (keys, since) are
    the counts per epoch; an event at the time of a reset belongs to the new epoch. Late ticks count in
    their epoch, however late; a reset may come ``late_s`` seconds of event time late, as counts of that time are kept.
    """
    fields = [events.schema[k] for k in keys]
    schema = StructType(fields).add("since", "long").add("n", "long").add("seen", "long")
    return events.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=CountProcessor(int(late_s * 1000), keys),
        outputStructType=schema,
        outputMode="Update",
        timeMode="None",
    )


def since_reset(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The running count of each key: that of its last epoch."""
    last = latest(updates, [*keys, "since"])
    start: Column = F.coalesce("since", F.lit(NO_RESET))
    return last.groupBy(*keys).agg(F.max_by("n", start).alias("n"))
