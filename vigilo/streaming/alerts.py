"""Alert replay on a stream: the greedy rule of ``replay.replay_alerts`` with the watermark as its clock.

State is small whatever the fleet's size: per open instant the best candidates that can matter, and the assets that
are cooling.  An instant's alerts are settled when the watermark passes it, so candidates may come in any order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from vigilo.operators.replay import most_candidates

DAY_US = 86_400_000_000
OUT = "by string, asset_id string, i int, available_at timestamp, score double"
_row = Row("by", "asset_id", "i", "available_at", "score")
STATE = "settled long, live array<struct<at:long,asset:string>>, open array<struct<at:long,x:double,asset:string,day:int>>"


class AlertProcessor(StatefulProcessor):
    def __init__(self, daily_budget: int, cooldown_days: float):
        if daily_budget < 0 or cooldown_days < 0:
            raise ValueError("invalid replay policy")
        self.budget, self.cooling, self.most = daily_budget, cooldown_days * DAY_US, most_candidates(daily_budget, cooldown_days)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fleet", STATE)

    def _fleet(self) -> tuple[int, list, list]:
        got = self.state.get() if self.state.exists() else None
        return (got[0], [tuple(x) for x in got[1]], [tuple(x) for x in got[2]]) if got else (-1, [], [])

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        settled, live, open_ = self._fleet()
        heaps: dict[int, list] = {}
        for at, x, asset, day in [*open_, *((r.at, r.x, r.asset_id, r.i) for r in rows if r.at > settled)]:
            heaps.setdefault(at, []).append((at, x, asset, day))
        kept = []
        for at in sorted(heaps):
            best: dict[str, tuple] = {}
            for c in heaps[at]:
                if c[2] not in best or c[1] > best[c[2]][1]:
                    best[c[2]] = c
            kept += heapq.nsmallest(self.most, best.values(), key=lambda c: (-c[1], c[2]))
            self.handle.registerTimer(at // 1000)
        self.state.update((settled, live, kept))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        settled, live, open_ = self._fleet()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due = sorted((c for c in open_ if c[0] <= passed), key=lambda c: (c[0], -c[1], c[2]))
        for at, x, asset, day in due:
            live = [a for a in live if at - a[0] < self.cooling or a[0] // DAY_US == at // DAY_US]
            spent = sum(a[0] // DAY_US == at // DAY_US for a in live)
            if spent < self.budget and not any(a[1] == asset and at - a[0] < self.cooling for a in live):
                live.append((at, asset))
                yield _row(*key, asset, day, datetime.fromtimestamp(at / 1e6, UTC).replace(tzinfo=None), x)
            settled = max(settled, at)
        if due:
            self.state.update((settled, live, [c for c in open_ if c[0] > passed]))

    def close(self) -> None:
        pass


def stream_alerts(scores: DataFrame, score: str, threshold: float, daily_budget: int = 2, cooldown_days: float = 3, watermark: str = "2 days", by: str | None = None) -> DataFrame:
    """(by, asset_id, day, available_at, score): the alerts of ``replay_alerts``, whatever the order of arrival.

    ``scores`` is a stream with asset_id, day, available_at and ``score``; rows below the threshold and null scores
    never compete.  Of two rows of one asset at one time the higher score counts.  One replay runs for each ``by``, all
    of the fleet by default.  The session's time zone must be UTC, and its state store RocksDB.
    """
    group = F.col(by) if by else F.lit("fleet")
    rows = scores.where(F.col(score) >= threshold).select(
        group.alias("by"), "asset_id", F.datediff("day", F.lit("2000-01-01").cast("date")).alias("i"), F.col("available_at").cast("timestamp").alias("available_at"), F.col(score).cast("double").alias("x")
    )
    timed = rows.withColumn("at", F.unix_micros("available_at")).withWatermark("available_at", watermark)
    out = timed.groupBy("by").transformWithState(AlertProcessor(daily_budget, cooldown_days), OUT, "Append", "EventTime")
    shown = [F.col("by").alias(by)] if by else []
    return out.select(*shown, "asset_id", F.date_add(F.lit("2000-01-01").cast("date"), F.col("i")).alias("day"), "available_at", "score")
