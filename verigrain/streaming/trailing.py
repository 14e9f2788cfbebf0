"""Keyed state of element re-use, held as maps: what a batch costs does not depend on how many identities an element has."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

OUTPUT = "element string, identities_30d bigint, identities_90d bigint, identities_180d bigint, last_seen timestamp"
WINDOWS = (30, 90, 180)
_HOUR = 3_600_000_000
_DAY = 24 * _HOUR
KEPT = max(WINDOWS) * _DAY


class TrailingUses(StatefulProcessor):
    """Identities of one element in the 30, 90 and 180 days before its newest use.

    An identity counts in a window exactly if its last use does. ``last`` has that use for each identity, ``hours``
    the identities whose last use is in an hour, ``days`` how many there are in a day (181 entries at most are in
    reach). A batch looks up the identities that it names, moves them between hours, and counts whole days; only the
    three days in which windows begin are read hour by hour. A day that has left the longest window takes its
    identities along, and an element that nobody has used for so long is forgotten by a timer.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "identity string", "us bigint")
        self.hours = handle.getMapState("hours", "hour bigint", "identities array<string>, us array<bigint>")
        self.days = handle.getMapState("days", "day bigint", "identities bigint")
        self.newest = handle.getValueState("newest", "us bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        used: dict[str, int] = {}
        for batch in rows:
            for identity, us in batch.groupby("identity")["us"].max().items():
                used[identity] = max(int(us), used.get(identity, int(us)))
        known = self.newest.get()
        newest = max([*used.values(), *([known[0]] if known else [])])
        self._move({i: us for i, us in used.items() if us >= newest - KEPT}, fresh=not known)
        self._expire(newest - KEPT)
        self.newest.update((newest,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((newest + KEPT) // 1000)
        counts = self._counts(newest)
        yield pd.DataFrame({"element": [key[0]], **{f"identities_{d}d": [counts[d]] for d in WINDOWS}, "last_seen": [pd.Timestamp(newest, unit="us")]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.last, self.hours, self.days, self.newest):
            state.clear()
        return iter(())

    def _hour(self, hour: int) -> dict[str, int]:
        found = self.hours.getValue((hour,))
        return dict(zip(found[0], found[1], strict=True)) if found else {}

    def _move(self, used: dict[str, int], fresh: bool) -> None:
        """Without a look at the maps for a ``fresh`` element, of which they hold nothing: a look costs as much as an entry."""
        gone, come = defaultdict(set), defaultdict(dict)
        for identity, us in used.items():
            before = None if fresh else self.last.getValue((identity,))
            if before and before[0] >= us:
                continue
            if before:
                gone[before[0] // _HOUR].add(identity)
            come[us // _HOUR][identity] = us
            self.last.updateValue((identity,), (us,))
        change: dict[int, int] = defaultdict(int)
        for hour in gone.keys() | come.keys():
            old = {} if fresh else self._hour(hour)
            new = {i: us for i, us in old.items() if i not in gone[hour]} | come[hour]
            change[hour // 24] += len(new) - len(old)
            if new:
                self.hours.updateValue((hour,), (list(new), list(new.values())))
            else:
                self.hours.removeKey((hour,))
        for day, more in change.items():
            before = None if fresh else self.days.getValue((day,))
            left = more + (before[0] if before else 0)
            if left:
                self.days.updateValue((day,), (left,))
            elif before:
                self.days.removeKey((day,))

    def _expire(self, floor: int) -> None:
        for (day,) in list(self.days.keys()):
            if (day + 1) * _DAY <= floor:
                for hour in range(24 * day, 24 * day + 24):
                    for identity in self._hour(hour):
                        self.last.removeKey((identity,))
                    self.hours.removeKey((hour,))
                self.days.removeKey((day,))

    def _counts(self, newest: int) -> dict[int, int]:
        days = {k[0]: v[0] for k, v in self.days.iterator()}
        out = {}
        for d in WINDOWS:
            start = newest - d * _DAY
            day = start // _DAY
            out[d] = sum(n for k, n in days.items() if k > day)
            if day in days:
                out[d] += sum(us >= start for h in range(start // _HOUR, 24 * day + 24) for us in self._hour(h).values())
        return out
