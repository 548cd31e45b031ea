"""The telemetry contract: column groups, subsystems and eager validation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDENTITY = ("ts", "asset_id", "train_id", "subsystem")
CONTEXT = ("ambient_temp_c", "load_proxy", "hour_of_day", "cycles_since_service")
LABEL = ("fault_confirmed", "fault_mode")


@dataclass(frozen=True)
class Signal:
    name: str
    #: +1 if larger is worse, -1 if smaller is.
    wear: int = 1

    @property
    def is_rate(self) -> bool:
        return self.name.endswith(("_flag", "_count"))


@dataclass(frozen=True)
class Subsystem:
    name: str
    signals: tuple[Signal, ...]
    primary: str

    @property
    def levels(self) -> list[str]:
        return [s.name for s in self.signals if not s.is_rate]

    @property
    def rates(self) -> list[str]:
        return [s.name for s in self.signals if s.is_rate]

    def schema(self) -> T.StructType:
        fields = [T.StructField("ts", T.TimestampNTZType()), *(T.StructField(c, T.StringType()) for c in IDENTITY[1:])]
        fields += [T.StructField(s.name, T.DoubleType()) for s in self.signals]
        fields += [T.StructField(c, T.DoubleType()) for c in CONTEXT]
        return T.StructType([*fields, T.StructField("fault_confirmed", T.BooleanType()), T.StructField("fault_mode", T.StringType())])


#: Fixed values of the contract: signal names and the direction of wear.
SUBSYSTEMS = {
    "door": Subsystem(
        "door",
        (
            Signal("cycle_duration_s"),
            Signal("peak_current_a"),
            Signal("mean_current_a"),
            Signal("current_integral_as"),
            Signal("travel_mm", -1),
            Signal("obstruction_flag"),
            Signal("retry_count"),
        ),
        "current_integral_as",
    ),
    "bogie": Subsystem(
        "bogie",
        (Signal("bearing_temp_rise_c"), Signal("vibration_rms_g"), Signal("vibration_kurtosis"), Signal("suspension_defl_mm"), Signal("wheel_impact_g")),
        "vibration_rms_g",
    ),
}


def subsystem(name: str) -> Subsystem:
    if name not in SUBSYSTEMS:
        raise KeyError(f"unknown subsystem {name!r}; known: {', '.join(SUBSYSTEMS)}")
    return SUBSYSTEMS[name]


@dataclass
class ValidationReport:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    rows: int = 0

    @property
    def ok(self) -> bool:
        return not self.errors

    def raise_if_bad(self) -> None:
        if self.errors:
            raise ValueError("; ".join(self.errors))


def validate(df: DataFrame, sub: Subsystem) -> ValidationReport:
    """Schema checks without a job, then value checks in one aggregation."""
    report = ValidationReport()
    kinds = {f.name: f.dataType for f in df.schema.fields}
    required = [*IDENTITY, sub.primary, *CONTEXT[1:3], "fault_confirmed"]
    report.errors += [f"missing column {c}" for c in required if c not in kinds]
    if "ts" in kinds and not isinstance(kinds["ts"], (T.TimestampNTZType, T.TimestampType)):
        report.errors.append("ts is not a timestamp")
    numeric = [c for c in [*(s.name for s in sub.signals), *CONTEXT] if c in kinds]
    report.errors += [f"{c} is not numeric" for c in numeric if not isinstance(kinds[c], (T.NumericType, T.BooleanType))]
    known = {*IDENTITY, *(s.name for s in sub.signals), *CONTEXT, *LABEL, "context_supported"}
    report.warnings += [f"extra column {c}" for c in df.columns if c not in known]
    if report.errors:
        return report
    checks = {"rows": F.count("*")}
    checks |= {f"null:{c}": F.count_if(F.col(c).isNull()) for c in numeric}
    if "load_proxy" in kinds:
        checks["load"] = F.count_if(~F.col("load_proxy").between(0, 1))
    if "hour_of_day" in kinds:
        checks["hour"] = F.count_if((F.col("hour_of_day") < 0) | (F.col("hour_of_day") >= 24))
    checks["faults"] = F.count_if(F.col("fault_confirmed"))
    got = df.agg(*(v.alias(k) for k, v in checks.items())).first().asDict()
    report.rows = got["rows"]
    if not report.rows:
        report.warnings.append("no rows")
        return report
    report.warnings += [f"{c} is mostly null" for c in numeric if got[f"null:{c}"] > 0.5 * report.rows]
    if got.get("load"):
        report.warnings.append("load_proxy outside [0, 1]")
    if got.get("hour"):
        report.warnings.append("hour_of_day outside [0, 24)")
    if not got["faults"]:
        report.warnings.append("no confirmed fault")
    return report


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"rows are not unique by {', '.join(keys)}")


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Non-finite values become null; from here on missing is null alone."""
    return df.withColumns({c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)) for c in columns})
