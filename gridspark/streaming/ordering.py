"""Stateful processors that see the rows of a key in order of time, however they arrive.

Rows wait in list state. When the watermark has passed the earliest of them, an event-time timer fires and all rows
behind the watermark, of which none can arrive any more, are released in order. What waits is thus bounded by the
lateness, and a key without waiting rows keeps only what its processor remembers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def seen_by_watermark(time: str, condition: Column) -> Column:
    """A filter that stays above the watermark on ``time``.

    A filter that does not name the time is moved below it, and a watermark that sees only some rows stands still.
    """
    return F.coalesce(F.when(F.col(time).isNotNull(), condition), F.lit(False))


class InOrder(StatefulProcessor):
    """Releases rows by ``t_us`` and the columns after it; subclasses fold them into their own state.

    ``columns`` is the schema of a waiting row, beginning with ``t_us bigint``; ``remembered`` that of the subclass' state;
    ``keys`` names the columns of the key in the results, which ``fold`` gives without them.
    """

    columns = remembered = ""
    keys: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.columns)
        self.due = handle.getValueState("due", "ms bigint")
        self.state = handle.getValueState("state", self.remembered)
        self.names = [f.split()[0] for f in self.columns.split(",")]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for part in rows:
            if len(part):
                plain = part[self.names].astype(object)
                self.waiting.appendList(list(plain.where(plain.notna(), None).itertuples(index=False, name=None)))
                first = int(part["t_us"].min())
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self._set(-(-earliest // 1000))
        return iter(())

    def _set(self, ms: int) -> None:
        """One timer a key, at the earliest time that waits for the watermark."""
        if self.due.exists():
            if self.due.get()[0] <= ms:
                return
            self.handle.deleteTimer(self.due.get()[0])
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = pd.DataFrame(list(self.waiting.get()), columns=self.names)
        late = rows["t_us"] > passed
        if late.any():
            self.waiting.put(list(rows[late].astype(object).where(rows[late].notna(), None).itertuples(index=False, name=None)))
            self._set(-(-int(rows.loc[late, "t_us"].min()) // 1000))
        else:
            self.waiting.clear()
        ready = rows[~late].sort_values(self.names, kind="stable", ignore_index=True)
        out = self.fold(ready, passed)
        if len(out):
            for i, part in enumerate(key):
                out.insert(i, self.keys[i], part)
            yield out

    def fold(self, rows: pd.DataFrame, passed: int) -> pd.DataFrame:
        """Results of the released rows (maybe none), after bringing the state up to date."""
        raise NotImplementedError

    def close(self) -> None:
        pass
