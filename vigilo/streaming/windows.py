"""Trailing trends, load sensitivity and outage windows on a stream of asset-days.

Each asset keeps a ring of its last days.  A day is final when the watermark passes its availability: an event-time
timer then gives the day's row, so rows may come late and in any order within the watermark.  A day that nobody
reported gets its row too, until an asset has been silent for ``silent_days``; its state then ends, which changes no
later number because by then no window reaches back to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from vigilo.operators.duty import STATS
from vigilo.operators.features import day_index
from vigilo.operators.monitoring import OutagePolicy

DAY_MS = 86_400_000
#: Day 0 of ``features.day_index``, in milliseconds of the epoch.
ZERO_MS = 946_684_800_000
OUT = (
    "asset_id string, i int, reported boolean, value double, smooth double, slope double, vol double, "
    "load_sensitivity double, load_sensitivity_t double, window_mean_load double, "
    "score double, status string, observations long, span_days int, max_gap_days int"
)
_row = Row(*(c.split()[0] for c in OUT.split(", ")))
STATE = "next int, given boolean, newest int, days array<int>, held array<struct<value:double,ok:boolean,stats:array<double>>>"


def quantile(values: list[float], q: float) -> float:
    """Linear between order statistics, as the exact percentile of the batch form."""
    at = (len(values) - 1) * q
    k = int(at)
    ordered = sorted(values)
    return ordered[k] if at == k else (k + 1 - at) * ordered[k] + (at - k) * ordered[k + 1]


@dataclass(frozen=True)
class TrendPolicy:
    smooth_days: int = 3
    slope_days: int = 14
    load_days: int = 3
    min_cycles: int = 30
    min_load_sd: float = 0.08
    outage: OutagePolicy = OutagePolicy()

    @property
    def reach(self) -> int:
        """Days before a day that its row can depend on."""
        return max(self.slope_days + self.smooth_days - 2, self.load_days - 1, self.outage.max_age_days + self.outage.max_gap_days)


#: What the ring holds of a day: (value, supported, load statistics).
Ring = dict[int, tuple[float | None, bool, list[float]]]


def smoothed(ring: Ring, i: int, days: int) -> float | None:
    """The median of the last ``days`` days where today has a value and all of them have."""
    got = [ring[k][0] for k in range(i - days + 1, i + 1) if k in ring and ring[k][0] is not None]
    return quantile(got, 0.5) if i in ring and ring[i][0] is not None and len(got) >= days else None


def trend(ring: Ring, i: int, p: TrendPolicy) -> tuple[float | None, float | None, float | None]:
    """(smooth, slope, vol) of day ``i``."""
    span = range(i - p.slope_days + 1, i + 1)
    points = [(k, s) for k in span if (s := smoothed(ring, k, p.smooth_days)) is not None]
    now = smoothed(ring, i, p.smooth_days)
    slope = None
    if now is not None and len(points) >= 5:
        mx, my = sum(k for k, _ in points) / len(points), sum(s for _, s in points) / len(points)
        xx = sum((k - mx) ** 2 for k, _ in points)
        slope = sum((k - mx) * (s - my) for k, s in points) / xx if xx > 0 else None
    raw = [ring[k][0] for k in span if k in ring and ring[k][0] is not None]
    return now, slope, quantile(raw, 0.75) - quantile(raw, 0.25) if len(raw) >= 5 else None


def load(ring: Ring, i: int, p: TrendPolicy) -> tuple[float | None, float | None, float | None]:
    """(load_sensitivity, its t value, mean load): each day centred on its own means, then pooled."""
    xx = xy = yy = n = total = 0.0
    days = 0
    for k in range(i - p.load_days + 1, i + 1):
        if k not in ring or not ring[k][2][0] > 0:
            continue
        m, sl, sll, sy, sly, syy = ring[k][2]
        xx, xy, yy = xx + max(sll - sl * sl / m, 0.0), xy + sly - sl * sy / m, yy + max(syy - sy * sy / m, 0.0)
        n, total, days = n + m, total + sl, days + 1
    mean = total / n if n else None
    dof = n - days - 1
    if not xx > 0 or dof <= 0 or n < p.min_cycles or sqrt(xx / n) < p.min_load_sd:
        return None, None, mean
    b = xy / xx
    noise = sqrt(max(yy - b * xy, 0.0) / dof / xx)
    return b, b / noise if noise else None, mean


def outage(ring: Ring, i: int, p: OutagePolicy) -> tuple[float | None, str, int, int | None, int | None]:
    """(score, status, observations, span, largest gap) of the newest run of supported days without a large hole."""
    if i not in ring or not ring[i][1]:
        return None, "unsupported", 0, None, None
    if ring[i][0] is None:
        return None, "incomplete", 0, None, None
    run, beyond = [i], None
    for k in range(i - 1, i - p.max_age_days - p.max_gap_days - 1, -1):
        if k in ring and ring[k][1] and ring[k][0] is not None:
            if run[-1] - k > p.max_gap_days:
                beyond = k
                break
            run.append(k)
    inside = [k for k in run if i - k <= p.max_age_days]
    gaps = [a - b for a, b in zip(inside, inside[1:], strict=False)]
    enough = len(inside) >= p.min_observations
    cut = len(inside) == len(run) and beyond is not None and i - beyond <= p.max_age_days
    status = "supported" if enough else "gap_too_large" if cut else "too_few_observations"
    return quantile([ring[k][0] for k in inside], 0.5) if enough else None, status, len(inside), i - inside[-1], max(gaps, default=0)


def window_row(ring: Ring, i: int, p: TrendPolicy) -> tuple:
    """All columns of OUT after the asset."""
    return (i, i in ring, ring[i][0] if i in ring else None, *trend(ring, i, p), *load(ring, i, p), *outage(ring, i, p.outage))


class WindowProcessor(StatefulProcessor):
    """Holds an asset's ring, the next day to give, whether a day was given, and the newest day reported."""

    def __init__(self, policy: TrendPolicy, silent_days: int):
        if silent_days <= policy.reach:
            raise ValueError(f"an asset's state must outlive its windows: more than {policy.reach} days")
        self.policy, self.silent_days = policy, silent_days

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("ring", STATE)

    def _ring(self) -> tuple[int | None, bool, int, Ring]:
        got = self.state.get() if self.state.exists() else None
        if not got:
            return None, False, -1, {}
        upto, given, newest, days, held = got
        return upto, given, newest, {d: (h[0], h[1], list(h[2])) for d, h in zip(days, held, strict=True)}

    def _keep(self, upto: int, given: bool, newest: int, ring: Ring) -> None:
        days = sorted(k for k in ring if k >= upto - self.policy.reach)
        self.state.update((upto, given, newest, days, [ring[k] for k in days]))
        self.handle.registerTimer(ZERO_MS + (upto + 1) * DAY_MS)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        upto, given, newest, ring = self._ring()
        for r in rows:
            if given and r.i < upto:
                continue  # that day's row is out
            ring.setdefault(r.i, (r.value, bool(r.ok), [float(x or 0.0) for x in r.stats]))
            upto = r.i if upto is None else min(upto, r.i)
            newest = max(newest, r.i)
        if upto is not None:
            self._keep(upto, given, newest, ring)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        upto, given, newest, ring = self._ring()
        if upto is None:
            return
        passed = timerValues.getCurrentWatermarkInMs()
        last = newest + self.silent_days
        while upto <= last and ZERO_MS + (upto + 1) * DAY_MS <= passed:
            yield _row(key[0], *window_row(ring, upto, self.policy))
            upto, given = upto + 1, True
        if upto > last:
            self.state.clear()
        else:
            self._keep(upto, given, newest, ring)

    def close(self) -> None:
        pass


def stream_windows(days: DataFrame, value: str, watermark: str = "3 days", policy: TrendPolicy = TrendPolicy(), silent_days: int = 30) -> DataFrame:
    """(asset_id, day, reported, value, smooth, slope, vol, load_sensitivity, ..., status, ...) in append mode.

    ``days`` is a stream of asset-days with day, ``value``, data_quality_ok and context_supported, and with the load
    statistics of ``duty.load_stats`` if it has them.  A day's row comes when the watermark passes its end; rows that
    arrive after that are dropped, and of two rows for one asset and day the first to arrive counts.  The session must
    use the RocksDB state store.
    """
    ok = F.coalesce("data_quality_ok", F.lit(False)) & F.coalesce("context_supported", F.lit(False))
    stats = F.array(*(F.col(c).cast("double") if c in days.columns else F.lit(0.0) for c in STATS))
    timed = days.select(
        "asset_id",
        F.date_add("day", 1).cast("timestamp").alias("available_at"),
        day_index(F.col("day")).alias("i"),
        F.col(value).cast("double").alias("value"),
        ok.alias("ok"),
        stats.alias("stats"),
    )
    out = timed.withWatermark("available_at", watermark).groupBy("asset_id").transformWithState(WindowProcessor(policy, silent_days), OUT, "Append", "EventTime")
    return out.withColumn("day", F.date_add(F.lit("2000-01-01").cast("date"), F.col("i"))).drop("i")
