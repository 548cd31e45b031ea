"""Vendor tables to the contract: suggested, reviewed mappings and their application."""

from __future__ import annotations

import difflib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilo.contract import Subsystem
from vigilo.functions import text

#: Context values where a vendor table has none; such rows count as outside supported conditions.
FILL = {"ambient_temp_c": 28.0, "load_proxy": 0.5, "cycles_since_service": 0.0, "hour_of_day": 12.0}
CUTOFF = 0.72
TOKENS = {"true": True, "t": True, "yes": True, "y": True, "1": True, "false": False, "f": False, "no": False, "n": False, "0": False, "": False}


def squash(name: str) -> str:
    return "".join(c for c in name.lower() if c.isascii() and c.isalnum())


def scored_mapping(columns: list[str], wanted: list[str], aliases: dict[str, list[str]] | None = None, cutoff: float = CUTOFF) -> dict[str, tuple[str, float]]:
    """wanted -> (source column, confidence): exact names and aliases first at 1.0, then the closest, by name or alias; a source serves once."""
    free = {squash(c): c for c in columns}
    names = {w: [squash(n) for n in (w, *(aliases or {}).get(w, []))] for w in wanted}
    found: dict[str, tuple[str, float]] = {}
    for w in wanted:
        if exact := next((n for n in names[w] if n in free), None):
            found[w] = free.pop(exact), 1.0
    for w in wanted:
        if w in found:
            continue
        near = [(difflib.SequenceMatcher(None, n, k).ratio(), k) for n in names[w] for k in free]
        ratio, key = max(near, default=(0.0, ""))
        if near and ratio >= cutoff:
            found[w] = free.pop(key), round(ratio, 2)
    return found


def suggest_mapping(columns: list[str], wanted: list[str], aliases: dict[str, list[str]] | None = None, cutoff: float = CUTOFF) -> dict[str, str]:
    """The columns of ``scored_mapping``, for a person to review."""
    return {w: c for w, (c, _) in scored_mapping(columns, wanted, aliases, cutoff).items()}


@dataclass
class Mapping:
    columns: dict[str, str]
    unit_scales: dict[str, float] = field(default_factory=dict)
    timestamp_format: str | None = None
    source_timezone: str | None = None
    tokens: dict[str, bool] = field(default_factory=lambda: dict(TOKENS))
    reviewed_by: str | None = None

    def problems(self, available: list[str]) -> list[str]:
        out = [f"{v} is not a source column" for v in self.columns.values() if v not in available]
        if len(set(self.columns.values())) < len(self.columns):
            out.append("a source column is used twice")
        out += [f"scale of {k} is not a positive number" for k, v in self.unit_scales.items() if not 0 < v < float("inf")]
        if not self.reviewed_by:
            out.append("not reviewed")
        return out


def apply_mapping(raw: DataFrame, mapping: Mapping, sub: Subsystem) -> tuple[DataFrame, list[str]]:
    """(cycles, notes): rename, read times and numbers, scale, derive, fill contexts, put in contract order.

    Unreadable numbers and times are null, non-finite numbers too; unknown boolean words are refused, and so is a
    column that mixes times with and without an offset where no zone is declared.
    """
    problems = mapping.problems(raw.columns)
    if problems:
        raise ValueError("; ".join(problems))
    notes: list[str] = []
    src = {k: F.col(f"`{v}`") for k, v in mapping.columns.items()}
    numeric = [*(s.name for s in sub.signals), *FILL]
    cols = {}
    for k, c in src.items():
        if k == "ts":
            if mapping.source_timezone is None and dict(raw.dtypes)[mapping.columns[k]] == "string" and text.mixed_times(raw.select(c.alias("ts")), "ts"):
                raise ValueError("times with and without an offset: declare the zone of those without")
            cols[k] = c.cast("timestamp_ntz") if dict(raw.dtypes)[mapping.columns[k]].startswith("timestamp") else text.parse_time(c.cast("string"), mapping.timestamp_format, source_zone=mapping.source_timezone)
        elif k in numeric:
            x = c.try_cast("double") * mapping.unit_scales.get(k, 1.0)
            cols[k] = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
        elif k == "fault_confirmed":
            unknown = text.unknown_tokens(raw, mapping.columns[k], mapping.tokens)
            if unknown:
                raise ValueError(f"unknown words for fault_confirmed: {', '.join(unknown)}")
            cols[k] = F.coalesce(text.boolean(c, mapping.tokens), F.lit(False))
        else:
            cols[k] = c.cast("string")
    df = raw.select(*(v.alias(k) for k, v in cols.items()))
    empty = df.agg(*(F.count(c).alias(c) for c in df.columns)).first().asDict()
    gone = [c for c, n in empty.items() if n == 0 and c in numeric]
    df = df.drop(*gone)
    notes += [f"{c} holds no readable value" for c in gone]
    have = set(df.columns)
    if "hour_of_day" not in have and "ts" in have:
        df, notes = df.withColumn("hour_of_day", text.hour_of_day(F.col("ts"))), [*notes, "hour_of_day derived"]
    if "current_integral_as" not in have and {"mean_current_a", "cycle_duration_s"} <= have:
        df, notes = df.withColumn("current_integral_as", F.col("mean_current_a") * F.col("cycle_duration_s")), [*notes, "current_integral_as derived"]
    if "mean_current_a" not in have and {"current_integral_as", "cycle_duration_s"} <= have:
        df, notes = df.withColumn("mean_current_a", text.mean_current(F.col("current_integral_as"), F.col("cycle_duration_s"))), [*notes, "mean_current_a derived"]
    if "train_id" not in have and "asset_id" in have:
        df, notes = df.withColumn("train_id", text.first_token(F.col("asset_id"))), [*notes, "train_id derived"]
    filled = [c for c in FILL if c not in df.columns]
    df = df.withColumns({c: F.lit(FILL[c]) for c in filled}) if filled else df
    notes += [f"{c} filled" for c in filled]
    df = df.withColumn("context_supported", F.lit(not {"ambient_temp_c", "load_proxy", "hour_of_day"} & set(filled))).withColumn("subsystem", F.lit(sub.name))
    for c, kind in (("fault_confirmed", "boolean"), ("fault_mode", "string")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(False if kind == "boolean" else None).cast(kind))
    order = [c for c in sub.schema().fieldNames() if c in df.columns]
    return df.select(*order, "context_supported"), notes
