"""Token ids in ORC: integer run-length encoded stripes, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilo.llm.common import running_total, shuffle_partitions, text_or_empty
from vigilo.llm.wordbpe import encoder

END_ID = 2
#: Texts tokenized at a time, in characters.
SLICE_CHARS = 1 << 20
ORC_OPTIONS = {
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.compress": "ZSTD",
    "orc.dictionary.key.threshold": "0",
}


def slices(texts: list[str | None], limit: int = SLICE_CHARS):
    """(start, stop) of runs of texts that hold at most ``limit`` characters, or one text."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, mode: str = "errorifexists") -> None:
    """Encode every whole text and write (doc_id, ids, row, block) as ORC in ascending doc_id order.

    One file per range of ids, so files and stripes are in order and min/max statistics prune; ``row`` is the place in the file.  Null and empty texts
    hold the end id alone; a null doc_id sorts first; repeated rows are kept; an empty table writes an empty data set.
    """
    spark = docs.sparkSession

    def encode(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        row = 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                parts = [x + end for x in enc.encode_batch(texts[a:b])]
                offsets = np.zeros(len(parts) + 1, dtype=np.int32)
                np.cumsum([len(x) // 4 for x in parts], out=offsets[1:])
                flat = pa.array(np.frombuffer(b"".join(parts), dtype="<i4"))
                place = pa.array(np.arange(row, row + b - a))
                row += b - a
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), flat), place], ["doc_id", "ids", "row"])

    (
        docs.select("doc_id", text_or_empty().alias("text"))
        .repartitionByRange(shuffle_partitions(spark), "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(encode, "doc_id long, ids array<int>, row long")
        .withColumn("block", F.spark_partition_id())
        .write.mode(mode)
        .options(**ORC_OPTIONS)
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The documents of the files; with ``doc_ids`` the filter reaches ORC, where statistics and Bloom filters skip rows."""
    df = spark.read.schema("doc_id long, ids array<int>, row long, block int").orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin(doc_ids))


def token_digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what ``read_tokens`` gives: place in the stream of all files, length, checksum."""

    def digest(batches):
        for batch in batches:
            lists = batch.column(1)
            flat = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4").tobytes()
            at = lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            n = np.diff(at).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "block", "row", "n_tokens", "ids_crc32"])

    rows = tokens.select("doc_id", "ids", "block", "row").mapInArrow(digest, "doc_id long, block int, row long, n_tokens long, ids_crc32 long")
    totals = tokens.groupBy("block").agg(F.sum(F.size("ids").cast("long")).alias("__t"))  # without a second pass through Python
    return running_total(rows, "block", ["row"], "n_tokens", "start", totals).select("doc_id", "start", "n_tokens", "ids_crc32")
