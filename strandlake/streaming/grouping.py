"""The daily loop's state as a stream: exact matches counted up, and inexact ones kept for a while until enough of them form a group.

Matches are (key, match_time, exact): key is what a match copies (its parent, or its lineage). A day of a key is closed when the watermark
has passed its end, by a timer, so the result does not depend on how rows are spread over micro-batches or restarts. Inexact matches are
tried again on each day until they are enough, or too old. State is a few numbers per key and day, never the rows; a key that has a third
of all rows costs no more than others once its rows are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
OUT = "key string, day date, exact bigint, total_exact bigint, waiting bigint, grouped bigint, expired bigint"


def closed_day(days: dict[int, tuple[int, int]], day: int, total: int, window: int, least: int, least_days: int) -> tuple[dict, tuple]:
    """One day of one key: days (day: exact, inexact; those not closed or still waiting), the exact matches before it. The days that go on waiting, and
    exact, total_exact, waiting, grouped, expired.

    Inexact matches of days from `window` days before on wait; older ones expire. If at least `least` wait, of at least `least_days` days, all of
    them are a group and wait no longer.
    """
    exact, _ = days.get(day, (0, 0))
    past = {d: n for d, (_, n) in days.items() if d <= day and n}
    expired = sum(n for d, n in past.items() if d <= day - window)
    held = {d: n for d, n in past.items() if d > day - window}
    waiting = sum(held.values())
    grouped = waiting if waiting >= least and len(held) >= least_days else 0
    rest = {d: v for d, v in days.items() if d > day} | ({} if grouped else {d: (0, n) for d, n in held.items()})
    return rest, (exact, total + exact, waiting - grouped, grouped, expired)


class _Groups(StatefulProcessor):
    def __init__(self, window: int, least: int, least_days: int):
        self.window, self.least, self.least_days = window, least, least_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day int", "exact bigint, inexact bigint")
        self.total = handle.getValueState("total", "exact bigint, closed int")

    def _total(self) -> tuple[int, int]:
        return tuple(self.total.get()) if self.total.exists() else (0, -(1 << 30))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counts: dict[int, list[int]] = {}
        for part in rows:
            day = (part["match_time"].astype("int64") // {"ns": 86_400_000_000_000, "us": 86_400_000_000}[part["match_time"].dt.unit])
            for (d, exact), n in part.groupby([day, part["exact"].astype(bool)]).size().items():
                counts.setdefault(int(d), [0, 0])[0 if exact else 1] += int(n)
        for d, (exact, inexact) in counts.items():
            old = self.days.getValue((d,)) if self.days.containsKey((d,)) else (0, 0)
            self.days.updateValue((d,), (old[0] + exact, old[1] + inexact))
            self.handle.registerTimer((d + 1) * DAY_MS)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        total, closed = self._total()
        last = timerValues.getCurrentWatermarkInMs() // DAY_MS - 1  # all days up to this one are over
        if expiredTimerInfo.getExpiryTimeInMs() // DAY_MS - 1 <= closed:
            return  # closed along with an earlier one
        days = before = {k[0]: tuple(v) for k, v in self.days.iterator()}
        out = []
        while (day := self._due(days, closed)) is not None and day <= last:
            days, row = closed_day(days, day, total, self.window, self.least, self.least_days)
            total, closed = row[1], day
            out.append((key[0], pd.Timestamp(day, unit="D").date(), *row))
        for d in before.keys() - days.keys():
            self.days.removeKey((d,))
        for d, v in days.items():
            if v != before.get(d):
                self.days.updateValue((d,), v)
        self.total.update((total, closed))
        if (day := self._due(days, closed)) is not None:  # what waits expires even if the key gets no more rows
            self.handle.registerTimer((day + 1) * DAY_MS)
        if out:
            yield pd.DataFrame(out, columns=["key", "day", "exact", "total_exact", "waiting", "grouped", "expired"])

    def _due(self, days: dict, closed: int) -> int | None:
        """The next day on which something happens: it has rows of its own, or what waits longest expires."""
        return min([*(d for d in days if d > closed), *(d + self.window for d in days if d <= closed)], default=None)

    def close(self) -> None:
        pass


def daily_groups(matches: DataFrame, late: str = "2 days", window: int = 30, least: int = 10, least_days: int = 2) -> DataFrame:
    """A stream of matches (key, match_time, exact) as one row per key and closed day on which something happens.

    exact and total_exact: exact matches of that day and up to it; waiting, grouped, expired: inexact matches that wait after it, that formed a
    group on it, or that were given up. Rows of null key or time, and rows later than the watermark, are left out. The session must keep state in RocksDB
    (spark.sql.streaming.stateStore.providerClass), on the cluster's shared checkpoint folder. Output mode: append.
    """
    known = matches.where("key is not null and match_time is not null").select(F.col("key").cast("string").alias("key"), "match_time", F.coalesce("exact", F.lit(False)).alias("exact"))
    return known.withWatermark("match_time", late).groupBy("key").transformWithStateInPandas(statefulProcessor=_Groups(window, least, least_days), outputStructType=OUT, outputMode="append", timeMode="EventTime")
