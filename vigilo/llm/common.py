"""Helpers shared by the corpus operators: shared storage, stable ordering, table access."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Bytes of a text whose words are listed at once.
SPAN = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach; a local one is made only on one machine, where the session names none."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(conf)
        return conf.rstrip("/")
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="vigilo-shared-")
    spark.sparkContext.setCheckpointDir(path)
    return shared_dir(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spared(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with its columns of these names renamed, by underscores at the end, so that an operator can add its own."""
    taken = {c.lower() for c in df.columns} | {n.lower() for n in names}
    moved = {}
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            new = c + "_"
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
            moved[c] = new
    return df.withColumnsRenamed(moved) if moved else df


def spans(data: bytes, size: int = SPAN) -> Iterator[list[bytes]]:
    """The words of ``data`` between the six ASCII blanks, in order, those of some ``size`` bytes at a time."""
    at = 0
    while at < len(data):
        blank = _BLANK.search(data, at + size)
        end = blank.start() if blank else len(data)
        yield data[at:end].split()
        at = end


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def running_total(df: DataFrame, block: str, order: list[str], value: str, out: str, totals: DataFrame | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before this one in (block, order).

    The total of each block is one row, so only block totals meet in one task; the rows of a block are summed where
    the block lies.  ``block`` must be an integer column that ascends with ``order`` and whose blocks are bounded.
    ``totals`` (block, __t) may be given where ``df`` is dear to compute twice.
    """
    totals = df.groupBy(block).agg(F.sum(value).alias("__t")) if totals is None else totals
    before = Window.orderBy(F.col(block).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(block, F.coalesce(F.sum("__t").over(before), F.lit(0)).cast("long").alias("__o"))
    inside = Window.partitionBy(block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(offsets, block)
        .withColumn(out, (F.col("__in") + F.col("__o")).cast("long"))
        .drop("__in", "__o")
    )
