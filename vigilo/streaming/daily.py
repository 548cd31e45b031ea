"""Structured Streaming forms of the daily aggregation and the damped decision."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_daily(cycles: DataFrame, levels: list[str], watermark: str = "1 day", min_cycles: int = 5) -> DataFrame:
    """Asset-days as their watermark closes them; the same numbers as the batch form.

    Late rows within the watermark count; a day is final once no earlier row may come, and only then appears.  State
    holds an open day's values per asset.
    """
    aggs = [F.count("*").alias("n_cycles"), F.max("ts").alias("last_observed_at"), F.bool_and(F.coalesce("context_supported", F.lit(False))).alias("context_supported")]
    for c in levels:
        aggs += [F.percentile(c, F.lit(0.5)).alias(c), (F.count(c) / F.count("*")).alias(f"{c}_completeness")]
    timed = cycles.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    out = timed.groupBy("asset_id", F.window("ts", "1 day").alias("w")).agg(*aggs)
    least = F.least(*(F.col(f"{c}_completeness") for c in levels)) if len(levels) > 1 else F.col(f"{levels[0]}_completeness")
    return out.withColumn("day", F.col("w.start").cast("date")).withColumn("available_at", F.col("w.end")).withColumn("data_quality_ok", (F.col("n_cycles") >= min_cycles) & (least >= 0.9)).drop("w")


UNKNOWN = -1


def settle(held: int, milder: int, seen: int, dwell_days: int) -> tuple[int, int]:
    """The aspect in force after a day and the milder days in a row so far; ``milder`` counts those up to the day before.

    A day at least as severe as the aspect in force takes effect at once, a milder one when ``dwell_days`` have come in
    a row; an unknown day changes nothing but ends the row.
    """
    if seen == UNKNOWN:
        return held, 0
    row = milder + 1 if seen < held else 0
    return (held, row) if 0 < row < dwell_days else (seen, 0)


def stream_damped(raw: DataFrame, dwell_days: int = 3) -> DataFrame:
    """(asset_id, day, aspect) from a stream of (asset_id, day, raw_aspect): the batch rule with its state kept per asset.

    Days of one asset that arrive in a batch are taken in order; a day at or before the last one seen is not taken again.
    On an unknown day an elevated aspect still shows.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, milder, last = state.get if state.exists else (UNKNOWN, 0, 0)
        rows = pd.concat(list(batches))
        rows = rows.assign(at=[pd.Timestamp(d).toordinal() for d in rows["day"]]).sort_values("at").drop_duplicates("at")
        shown = []
        for at, seen in rows.loc[rows["at"] > last, ["at", "raw_aspect"]].itertuples(index=False):
            held, milder = settle(held, milder if at == last + 1 else 0, int(seen), dwell_days)
            shown.append(held if seen != UNKNOWN or held > 0 else UNKNOWN)
            last = at
        state.update((held, milder, int(last)))
        yield rows.iloc[len(rows) - len(shown) :].assign(asset_id=key[0], aspect=shown)[["asset_id", "day", "aspect"]]

    return raw.groupBy("asset_id").applyInPandasWithState(step, "asset_id string, day date, aspect int", "aspect int, milder int, last int", "append", GroupStateTimeout.NoTimeout)
