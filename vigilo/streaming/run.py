"""Running a stream over what is there, for tests, backfills and queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilo.session import shared_folder

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocks(spark: SparkSession) -> None:
    """State of ``transformWithState`` is kept in RocksDB and checkpointed with the stream."""
    spark.conf.set(STORE, ROCKS)


def run_available(build: Callable[[DataFrame], DataFrame], source: str, schema, sink: str, checkpoint: str, files_per_batch: int | None = None, spark: SparkSession | None = None) -> DataFrame:
    """All files in ``source`` that the checkpoint has not seen, through ``build``, appended to ``sink``; what the sink then holds."""
    spark = spark or SparkSession.active()
    use_rocks(spark)
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    out = build(reader.parquet(source))
    out.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


def replayed(build: Callable[[DataFrame], DataFrame], rows: DataFrame, name: str, order: str) -> DataFrame:
    """``rows`` as a stream: written to the shared folder by ``order``, read batch by batch in that order, result read back.

    Rows of one value of ``order`` come in one batch, in no order; a column with a few values, such as the week.
    """
    spark = rows.sparkSession
    root = shared_folder(spark, name)
    waves = sorted(r[0] for r in rows.select(order).distinct().collect())
    kept = rows.schema
    rows.repartition(order).write.partitionBy(order).parquet(f"{root}/all")
    parts = spark.read.schema(kept).parquet(f"{root}/all")
    for wave in waves:
        parts.where(F.col(order) == wave).coalesce(1).write.mode("append").parquet(f"{root}/in")
    return run_available(build, f"{root}/in", spark.read.parquet(f"{root}/in").schema, f"{root}/out", f"{root}/checkpoint", 1, spark)
