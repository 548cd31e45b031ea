"""Column functions of ingestion and presentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squash(name: Column) -> Column:
    """Lower case, letters and digits only: how column names are compared."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / 60.0


def mean_current(charge: Column, duration: Column) -> Column:
    """Null where the duration is zero."""
    return F.try_divide(charge, F.nullif(duration, F.lit(0)))


def first_token(asset: Column) -> Column:
    """What stands before the first dash, underscore or blank."""
    return F.split(asset, "[-_ ]")[0]


def boolean(token: Column, tokens: dict[str, bool]) -> Column:
    """Known tokens, trimmed and lower-cased; unknown ones null, to be refused by ``unknown_tokens``."""
    t = F.lower(F.trim(token.cast("string")))
    out = F.lit(None).cast("boolean")
    for k, v in tokens.items():
        out = F.when(t == k, F.lit(v)).otherwise(out)
    return out


def unknown_tokens(df: DataFrame, column: str, tokens: dict[str, bool], show: int = 10) -> list[str]:
    """Some of the tokens that ``boolean`` does not know."""
    t = F.lower(F.trim(F.col(column).cast("string")))
    return [r[0] for r in df.where(t.isNotNull() & ~t.isin(*tokens)).select(t.alias("t")).distinct().orderBy("t").limit(show).collect()]


OFFSET = r"(?:[zZ]|[+-]\d{2}:?\d{2})$"


def mixed_times(df: DataFrame, column: str) -> bool:
    """Whether a text column holds times with an offset and times without one: one aggregation of two counts."""
    s = F.trim(F.col(column).cast("string"))
    said = s.isNotNull() & (s != "")
    got = df.agg(F.count_if(said & s.rlike(OFFSET)).alias("aware"), F.count_if(said & ~s.rlike(OFFSET)).alias("local")).first()
    return got["aware"] > 0 and got["local"] > 0


def parse_time(raw: Column, fmt: str | None = None, zone: str = "Asia/Singapore", source_zone: str | None = None) -> Column:
    """Text to local time of ``zone``, without an offset; bad text gives null.

    Text with an offset is converted; text without one is taken as local, or as of ``source_zone``, where times that a
    clock change skips or repeats give null.
    """
    s = F.trim(raw)
    offset = s.rlike(OFFSET)
    instant = F.try_to_timestamp(F.regexp_replace(F.replace(s, F.lit("T"), F.lit(" ")), "[zZ]$", "+00:00"))
    aware = F.convert_timezone(F.current_timezone(), F.lit(zone), instant.cast("timestamp_ntz"))
    plain = F.to_timestamp_ntz(s, F.lit(fmt)) if fmt is None else F.try_to_timestamp(s, F.lit(fmt)).cast("timestamp_ntz")
    local = F.expr("NULL").cast("timestamp_ntz") if fmt is None else plain
    naive = F.try_to_timestamp(s).cast("timestamp_ntz") if fmt is None else local
    if source_zone is not None:
        utc = F.convert_timezone(F.lit(source_zone), F.lit("UTC"), naive)
        back = F.convert_timezone(F.lit("UTC"), F.lit(source_zone), utc)
        near = [F.convert_timezone(F.lit("UTC"), F.lit(source_zone), utc + F.expr(f"INTERVAL {h} HOUR")) == naive for h in (-1, 1)]
        fixed = F.when((back == naive) & ~near[0] & ~near[1], F.convert_timezone(F.lit("UTC"), F.lit(zone), utc))
        naive = fixed
    return F.when(offset, aware).otherwise(naive)


def hours_text(hours: Column, up: bool = False) -> Column:
    """Whole hours as text, never flattering: margins are floored, overruns ceiled."""
    h = F.ceil(hours) if up else F.floor(hours)
    return F.when(h < 48, F.format_string("%d h", h)).otherwise(F.format_string("%d d %d h", F.floor(h / 24).cast("long"), h % 24))


def why(contributions: list[str], top: int = 3) -> Column:
    """The largest contributions of a row, by size, as text."""
    pairs = F.array(*(F.struct((-F.abs(F.col(c))).alias("k"), F.lit(c.removeprefix("contribution_").removesuffix("_hx")).alias("n"), F.col(c).alias("v")) for c in contributions))
    known = F.array_sort(F.filter(pairs, lambda p: p.v.isNotNull()))
    return F.array_join(F.transform(F.slice(known, 1, top), lambda p: F.concat(p.n, F.lit(" "), F.format_string("%+.2f", p.v))), ", ")
