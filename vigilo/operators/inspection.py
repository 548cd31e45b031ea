"""Evidence for an inspection: which channels moved together, what peers show, what that supports; and display rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cross_channel(changes: DataFrame, families: dict[str, str | None], wear: dict[str, int]) -> DataFrame:
    """One row per asset: shifted, unchanged and unknown channels, independent families, coherence with wear.

    A channel derived from several transducers belongs to no family and corroborates none.  A single shift beside
    unknown channels is not isolated: those were not seen to stay put.
    """
    family, sign = F.lit(None).cast("string"), F.lit(None).cast("int")
    for c, f in families.items():
        family = F.when(F.col("channel") == c, F.lit(f)).otherwise(family)
    for c, s in wear.items():
        sign = F.when(F.col("channel") == c, F.lit(s)).otherwise(sign)
    shifted = F.col("direction").isin("increase", "decrease")
    pick = lambda test: F.array_sort(F.collect_set(F.when(test, F.col("channel"))))
    got = changes.groupBy("asset_id").agg(
        pick(shifted).alias("shifted"),
        pick(F.col("direction") == "no_detected_change").alias("unchanged"),
        pick(F.col("direction") == "unknown").alias("unknown"),
        F.array_sort(F.collect_set(F.when(shifted, family))).alias("families"),
        F.coalesce(F.bool_and(F.when(shifted, F.signum("z") == sign)), F.lit(False)).alias("wear_consistent"),
    )
    n = F.size("shifted")
    return got.withColumn("isolated", (n == 1) & (F.size("unknown") == 0)).withColumn("one_family", (n > 0) & (F.size("families") <= 1))


def explanations(cross: DataFrame, peers: DataFrame) -> DataFrame:
    """(asset_id, explanation, stance): statements in a fixed order, each supported, contradicted or unresolved by the evidence."""
    shared = peers.groupBy("asset_id").agg(F.bool_or("shared").alias("any_shared"), F.count("shared").alias("answered"))
    e = cross.join(shared, "asset_id", "left")
    moved = F.size("shifted") > 0
    stance = lambda yes, no: F.when(yes, "supported").when(no, "contradicted").otherwise("unresolved")
    rows = [
        ("mechanical change of this asset", stance(moved & F.col("wear_consistent") & (F.size("families") >= 2), ~moved & (F.size("unknown") == 0))),
        ("one sensor or signal path", stance(F.col("one_family"), F.size("families") >= 2)),
        ("common influence on comparable assets", stance(F.coalesce("any_shared", F.lit(False)), (F.coalesce("answered", F.lit(0)) > 0) & ~F.coalesce("any_shared", F.lit(False)))),
    ]
    made = F.array(*(F.struct(F.lit(k).alias("rank"), F.lit(t).alias("explanation"), s.alias("stance")) for k, (t, s) in enumerate(rows)))
    return e.select("asset_id", F.explode(made).alias("x")).select("asset_id", "x.rank", "x.explanation", "x.stance")


def evidence_records(changes: DataFrame, cross: DataFrame, peers: DataFrame, as_of: Column) -> DataFrame:
    """(asset_id, record): the nested evidence of an asset as JSON; channels are bounded by the subsystem."""
    by_channel = changes.groupBy("asset_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", F.struct("change", "z", "direction"))))).alias("changes"))
    by_peer = peers.groupBy("asset_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", F.struct("peers", "peer_median_z", "shared"))))).alias("peers"))
    said = explanations(cross, peers).groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("rank", "explanation", "stance"))).alias("explanations"))
    full = by_channel.join(by_peer, "asset_id", "left").join(cross, "asset_id", "left").join(said, "asset_id", "left")
    body = F.struct(as_of.alias("as_of"), "changes", F.struct("shifted", "unchanged", "unknown", "families", "isolated", "one_family", "wear_consistent").alias("cross_channel"), "peers", "explanations")
    return full.select("asset_id", F.to_json(body).alias("record"))


def display_rows(grid: DataFrame, decided: DataFrame) -> DataFrame:
    """Every asset on every day: absent days carry an elevated aspect on and are otherwise unknown; numbers stay blank.

    ``decided`` has (asset_id, day, aspect, rul_lower, duty).
    """
    rows = grid.join(decided, ["asset_id", "day"], "left")
    w = Window.partitionBy("asset_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("aspect", ignorenulls=True).over(w)
    carried = F.when(last > 0, last).otherwise(-1)
    return rows.withColumn("shown_aspect", F.coalesce("aspect", carried)).withColumn("duty", F.coalesce("duty", F.lit("not_assessed"))).withColumn("reported", F.col("aspect").isNotNull()).drop("aspect")


def surfaced(rows: DataFrame, look_back: int = 21) -> DataFrame:
    """(asset_id, reason): flagged on its last row, or flagged within the last ``look_back`` rows."""
    newest = Window.partitionBy("asset_id").orderBy(F.desc("day"))
    top = rows.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= look_back)
    got = top.groupBy("asset_id").agg(F.max(F.when(F.col("k") == 1, F.col("shown_aspect"))).alias("now"), F.max("shown_aspect").alias("peak"))
    return got.where("now > 0 or peak > 0").select("asset_id", F.when(F.col("now") > 0, "status").otherwise("review").alias("reason"))


def dashboard_payload(rows: DataFrame) -> DataFrame:
    """(asset_id, payload): an asset's display rows as a JSON array in order of day; one row per asset, for a static page."""
    item = F.struct(F.date_format("day", "yyyy-MM-dd").alias("day"), "shown_aspect", F.round("rul_lower", 3).alias("rul_lower"), "duty")
    return rows.groupBy("asset_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("payload"))
