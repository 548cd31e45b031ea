"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into two halves.  Two fingerprints that differ in at most two bits differ by at most one in
the low half, and then share one of its 32 one-wildcard variants, or agree in the high half, which is indexed whole.
Variants are joined by equality.  A variant of two fingerprints is verified on all 64 bits.  The fingerprints of a
variant that more share are indexed again by the points around them, which differ from them by one bit at most: any
two at most two bits apart share such a point, and all that share one, 65 at most, are within two bits of each other.

Copies collapse first: only distinct fingerprints are indexed.  So no link is lost, no pair needs to be listed that is
none, and nothing grows with the square of a group.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilo.llm.common import materialize, shuffle_partitions
from vigilo.llm.components import connected_components

SEED = 42
#: Parts of a component's members, so that a component of a third of all rows is not joined in one task.
SALTS = 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """Bit set if over half of the shingles' XXH64 have it; no words: zero; fewer than ``width`` words: one shingle."""
    words = text.encode().lower().split() if text else []  # bytes: only A-Z and the six ASCII blanks count
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = [len(w) + 1 for w in words]
    ends = list(accumulate(sizes))
    starts = [0, *ends]
    digest, seed = xxhash.xxh64_intdigest, SEED
    h = np.fromiter((digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[width - 1 :])), dtype="<u8", count=len(words) - width + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        part = h[i : i + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long.  Null text counts as no words; rows with a null id and repeated rows are kept."""

    def apply(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(apply, "doc_id long, fp long")


def _variants(fps: DataFrame) -> DataFrame:
    """(key, fp, rep): the low half with one bit deleted, 32 ways, and the whole high half; place, bit and bits left make the key.

    Two fingerprints at most two bits apart differ in the low half by at most one bit, or by two and agree in the high.
    """
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    keys = [low.bitwiseAND(F.lit(0xFFFFFFFF & ~(1 << b))).bitwiseOR(F.lit(b << 32)) for b in range(32)]
    keys.append(high.bitwiseOR(F.lit(32 << 32)))
    place = F.shiftleft(F.col("place").cast("long"), 40)
    return fps.select("place", "fp", "rep", F.explode(F.array(*keys)).alias("k")).select("place", "fp", "rep", F.col("k").bitwiseOR(place).alias("key"))


def _around(max_bits: int) -> Column:
    """Points that any two fingerprints (fp) share only if they differ in ``max_bits`` or fewer: (wildcard, bits left)."""
    bits = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    if max_bits == 2:
        points = [F.struct(F.lit(-1).alias("at"), F.col("fp").bitwiseXOR(F.lit(m)).alias("rest")) for m in (0, *bits)]
    else:
        points = [F.struct(F.lit(i).alias("at"), F.col("fp").bitwiseAND(F.lit(~m)).alias("rest")) for i, m in enumerate(bits)]
    return F.array(*points)


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Edges (u, v) between the ``rep`` of fingerprints ``fps`` (place, fp, rep) within ``max_bits``, up to connection.

    (place, fp) is distinct, and only fingerprints of one place are linked.  Every edge joins fingerprints within
    ``max_bits``, and any two of them are joined or connected by such edges.  ``max_bits`` is 1 or 2.
    """
    if max_bits not in (1, 2):
        raise ValueError("a half with one wildcard and the points around a fingerprint cover one or two bits")
    # Each fingerprint makes 33 rows: dealt anew, so that a few small files don't make a few large tasks.
    variants = _variants(fps.repartition(shuffle_partitions(fps.sparkSession), "fp"))
    # Of a variant that two share, the exclusive or of all its fingerprints is the difference of the two.
    counted = variants.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("u"), F.max("rep").alias("v"), F.bit_xor("fp").alias("x"))
    shared = materialize(counted.where("n > 1"), "simhash-shared")
    pairs = shared.where("n = 2").where(F.bit_count("x") <= max_bits).select("u", "v")
    crowd = materialize(variants.join(shared.where("n > 2").select("key"), "key", "left_semi").select("place", "fp", "rep").distinct(), "simhash-crowd")
    stars = (
        crowd.select("place", "rep", F.explode(_around(max_bits)).alias("point"))
        .groupBy("place", "point.at", "point.rest")
        .agg(F.collect_set("rep").alias("near"))  # at most 65
        .where(F.size("near") > 1)
        .select(F.explode("near").alias("v"), F.array_min("near").alias("u"))
        .where("u <> v")
        .select("u", "v")
    )
    return pairs.unionByName(stars).distinct()


def components(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``prints`` (doc_id, fp).

    Rows are linked if their fingerprints are within ``max_bits``.  component_id is the smallest doc_id that links
    reach, the row's own included; null only where no row reached has an id.  Rows with one id keep a row each.  An
    empty table gives an empty result.
    """
    vertices = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-vertices")
    labels = materialize(connected_components(links(vertices.select(F.lit(0).alias("place"), "fp", F.col("fp").alias("rep")), max_bits)), "simhash-labels")
    named = labels.withColumnRenamed("node", "fp").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    least = named.join(vertices, "fp").groupBy("label").agg(F.min("first").alias("least"))
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    of_fp = vertices.join(named.join(salted, ["label", "salt"]).select("fp", "label", "least"), "fp", "left")
    of_fp = of_fp.select("fp", F.when(F.col("label").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))
    return prints.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def simhash_components(docs: DataFrame, width: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: fingerprint as 16 lowercase hex digits.

    Null and empty texts have the fingerprint zero, linked like any other; a null doc_id stays null and names no
    component that has an id; repeated rows are kept; other columns are ignored.
    """
    prints = materialize(fingerprints(docs, width), "simhash-prints")
    return components(prints, max_bits).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
