import datetime as dt

from pyspark.sql import functions as F

from vigilo.operators.decisions import damp
from vigilo.plans import views
from vigilo.streaming.daily import stream_daily, stream_damped

SF = "/root/testdata/sf0.001"


def test_daily_stream_equals_batch(spark, tmp_path):
    cycles = views.cycles(spark, SF)
    cycles.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cycles.schema).parquet(str(tmp_path / "in"))
    q = stream_daily(stream, ["charge"]).writeStream.format("memory").queryName("daily_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.asset_id, r.day): (r.n_cycles, r.charge) for r in spark.table("daily_out").collect()}
    batch = {(r.asset_id, r.day): (r.n_cycles, r.charge) for r in views.daily(spark, SF).collect()}
    assert got and all(batch[k] == v for k, v in got.items()) and len(got) > 0.8 * len(batch)


def test_damped_stream_equals_batch(spark, tmp_path):
    raw = [3, -1, 0, 0, 1, 0, 0, 0, 2, 0, 0, 0]
    rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=i), r) for i, r in enumerate(raw)]
    df = spark.createDataFrame(rows, "asset_id string, day date, raw_aspect int")
    for k in range(2):
        df.where(F.dayofmonth("day") <= 6 if k == 0 else F.dayofmonth("day") > 6).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_damped(stream).writeStream.format("memory").queryName("damped_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.day: r.aspect for r in spark.table("damped_out").collect()}
    assert got == {r.day: r.aspect for r in damp(df).collect()}
