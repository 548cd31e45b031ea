"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

SimHash retrieves: each text has ``PRINTS`` 64-bit fingerprints of its bare words, and fingerprints of one place that
differ in two bits or fewer meet through deletion variants (``simhash.links``).  That misses copies whose changes are
many words of their own in one stretch, so MinHash bands of the shingles retrieve as well.  Every link so found is
checked on the two whole shingle sets before it counts.

Texts with equal shingle sets are one class from the start.  Each band first compares its classes with few of them
only: ``TURNS`` chosen by hash and as many of those that meet most others, as the text does that others were made from.
Then, until nothing new is found, bands whose classes lie in several components compare them across components, pair by
pair wherever these are at most ``ACROSS`` for each class of the band.  The bands that have more pairs, texts that
nearly all differ by a little more than the threshold, are compared last, in blocks: a task counts what the sets of two
blocks share by products of matrices, and only links leave it.  So every two classes of a band are compared or already
connected, while rows grow with the number of classes and not with the square of a family.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilo.llm.common import materialize, spans
from vigilo.llm.components import connected_components
from vigilo.llm.simhash import links

WIDTH = 5
JACCARD = 0.8
#: Fingerprints of a text; one pair in five at the threshold is within two bits in none of them.
PRINTS = 3
#: Bands and their minima: a pair at the threshold shares none with a chance of (1 - 0.8 ** 4) ** 24, 3.2e-6.
BANDS, ROWS = 24, 4
#: Members of a band, by hash and again by how many they meet, with which the others are compared.
TURNS = 2
#: Pairs across components that a band compares one by one at most for each of its classes; beyond, in blocks.
ACROSS = 16
#: Classes of a block, and its shingles, on average; columns of a matrix at once.
BLOCK, BLOCK_SHINGLES, WIDE = 512, 1 << 20, 1 << 11
_RNG = np.random.default_rng(20)
_ODD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASK = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
#: Marks around a word that edits move about.
MARKS = b".,;:!?"


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct XXH64 of each run of ``width`` words; fewer words: one shingle; no words: none."""
    held, words = [], []
    for part in spans(text.encode().lower() if text else b""):  # bytes: only A-Z and the six ASCII blanks count
        words += part
        if len(words) < width:
            continue
        joined = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        h = (xxhash.xxh64_intdigest(joined[a : b - 1]) for a, b in zip(starts, ends[width - 1 :]))
        held.append(np.fromiter(h, np.uint64, len(words) - width + 1))
        words = words[len(words) - width + 1 :]
    if not held:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))] if words else [], np.uint64)
    return np.unique(np.concatenate(held))


def word_prints(text: str | None, prints: int = PRINTS) -> np.ndarray:
    """``prints`` SimHash fingerprints of the words, each weighing the root of its count; no words: zeros.

    Edits touch few of a text's words and leave most bits; the root keeps frequent words from deciding alone.
    """
    counts: Counter[bytes] = Counter()
    for part in spans(text.encode().lower() if text else b""):
        counts.update(w.strip(MARKS) for w in part)
    if not counts:
        return np.zeros(prints, np.int64)
    words, weights = list(counts), np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
    held = np.zeros(prints * 64)
    for k in range(0, len(words), 1 << 12):
        part = words[k : k + (1 << 12)]
        digests = b"".join(xxhash.xxh3_128_digest(w, s) for w in part for s in range(0, prints, 2))
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(len(part), -1)[:, : prints * 8], axis=1)
        held += weights[k : k + len(part)] @ bits
    return np.packbits(2 * held > weights.sum()).view("<i8")


def bands(s: np.ndarray) -> np.ndarray:
    """One hash of each band of ``ROWS`` minima; none for an empty set."""
    if not len(s):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(s), 1 << 10):
        least = np.minimum(least, ((s[i : i + (1 << 10), None] ^ _MASK) * _ODD).min(axis=0))
    digests = (xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS))
    return np.fromiter(digests, np.uint64, BANDS).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """(__id, __row, columns): a row is named by its id, and whether there is one and the text."""
    row = F.xxhash64(F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("__id"), row.alias("__row"), *columns)


def marked(docs: DataFrame, prints: int = PRINTS) -> DataFrame:
    """(none, id, row, digest, fps, bands) for every row; digest names the set of shingles, 128 bits of it."""

    def apply(batches):
        for batch in batches:
            texts = [t.as_py() for t in batch.column(3)]
            sets = [shingles(t) for t in texts]
            made = [pa.array([_digest(s) for s in sets], pa.binary()), _lists([word_prints(t, prints) for t in texts]), _lists([bands(s) for s in sets])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], ["none", "id", "row", "digest", "fps", "bands"])

    rows = _keyed(docs, F.col("doc_id").isNull().alias("none"), "text").select("none", "__id", "__row", "text")
    return rows.mapInArrow(apply, "none boolean, id long, row long, digest binary, fps array<long>, bands array<long>")


def _sets(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(vid, s): the shingles of the rows named in ``rows`` (__id, __row, vid), each once."""

    def apply(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingles(t.as_py()).view(np.int64) for t in batch.column(1)])], ["vid", "s"])

    named = _keyed(docs, "text").join(rows, ["__id", "__row"]).dropDuplicates(["vid"])
    return named.select("vid", "text").mapInArrow(apply, "vid long, s array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose sets have a Jaccard similarity of at least ``threshold``."""
    a, b = (sets.select(F.col("vid").alias(x), F.col("s").alias(f"s{x}")) for x in "uv")
    shared = F.size(F.array_intersect("su", "sv"))
    return pairs.join(a, "u").join(b, "v").where(shared / (F.size("su") + F.size("sv") - shared) >= threshold).select("u", "v")


def retrieved(classes: DataFrame) -> DataFrame:
    """Links (u, v) between classes (vid, fps) that agree within two bits in one place, up to connection."""
    own = classes.select("vid", F.posexplode("fps").alias("place", "fp"))
    reps = materialize(own.groupBy("place", "fp").agg(F.min("vid").alias("rep"), F.count("*").alias("n")), "near-reps")
    same = own.join(reps.where("n > 1"), ["place", "fp"]).where("vid <> rep").select(F.col("rep").alias("u"), F.col("vid").alias("v"))
    return links(reps.drop("n")).unionByName(same)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _few(pairs: DataFrame) -> DataFrame:
    """Of the pairs (u, v) of each v those with its smallest and its largest u."""
    ends = pairs.where("u <> v").groupBy("v").agg(F.array(F.min("u"), F.max("u")).alias("us"))
    return ends.select(F.explode("us").alias("u"), "v")


def _pivoted(met: DataFrame) -> DataFrame:
    """Pairs of few members of each band of ``met`` (key, vid, n: classes in the band) with the others."""
    meets = met.groupBy("vid").agg(F.sum("n").alias("meets"))
    by_hash = [F.xxhash64("vid", "key", F.lit(k)) for k in range(TURNS)]
    central = [F.col("meets") * (1 + F.pmod(h, F.lit(1 << 20)) / (1 << 23)) for h in by_hash]
    pivots = met.join(meets, "vid").groupBy("key").agg(F.array_distinct(F.array(*(F.max_by("vid", x) for x in (*by_hash, *central)))).alias("us"))
    return met.select("key", "vid").join(pivots, "key").select(F.explode("us").alias("u"), F.col("vid").alias("v"))


def _placed(met: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, vid, label, crowded): the bands of ``met`` with several components by ``labels`` (vid, label); crowded have many pairs across."""
    placed = materialize(met.select("key", "vid").join(labels, "vid", "left").withColumn("label", F.coalesce("label", "vid")), "near-placed")
    parts = placed.groupBy("key", "label").agg(F.count("*").alias("n"))
    bands_of = parts.groupBy("key").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("inside"), F.count("*").alias("parts"))
    crowded = (F.col("m") * F.col("m") - F.col("inside")) / 2 > ACROSS * F.col("m")
    return placed.join(bands_of.where("parts > 1").select("key", crowded.alias("crowded")), "key")


def _across(placed: DataFrame) -> DataFrame:
    """Pairs (u, v) of one band in different components, of the bands that have few of them."""
    held = placed.where("not crowded")
    a, b = (held.select("key", F.col("vid").alias(x), F.col("label").alias(f"l{x}")) for x in "uv")
    return a.join(b, "key").where("u < v and lu <> lv").select("u", "v")


def _joined(cell: pa.Table, threshold: float) -> pa.Table:
    """(u, v): links between the one or two blocks of ``cell`` (block, vid, label, s), enough of them to connect its labels."""
    block, vid, label = (cell.column(c).to_numpy() for c in ("block", "vid", "label"))
    lists = pa.concat_arrays(cell.column("s").chunks)
    size = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(vid)), size)
    kinds, col = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    first, last = block == block.min(), block == block.max()
    one = block.min() == block.max()
    held = [np.bincount(col[side[row]], minlength=len(kinds)) for side in (first, last)]
    shared = np.minimum(*held) > one  # other columns add nothing
    keep = shared[col]
    row, col = row[keep], (np.cumsum(shared) - 1)[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    both = np.zeros((len(a), len(b)), np.float32)  # whole numbers below 2 ** 24
    for at in range(0, int(shared.sum()), WIDE):
        lo, hi = np.searchsorted(col, (at, at + WIDE))
        has = np.zeros((len(vid), WIDE), np.float32)
        has[row[lo:hi], col[lo:hi] - at] = 1
        both += has[a] @ has[b].T
    near = both / (size[a][:, None] + size[b][None, :] - both.astype(np.float64)) >= threshold
    near &= label[a][:, None] != label[b][None, :]
    root, links = {}, []

    def find(x):
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    for i, j in np.argwhere(np.triu(near) if one else near):
        i, j = a[i], b[j]
        x, y = find(label[i]), find(label[j])
        if x != y:
            root[x] = y
            links.append((vid[i], vid[j]))
    u, v = np.array(links, np.int64).reshape(-1, 2).T
    return pa.table({"u": pa.array(u), "v": pa.array(v)})


def _crowds(placed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (u, v) across components of the crowded bands, all their pairs compared block by block, up to connection."""
    named = placed.where("crowded").select("key", "vid", "label")
    weighed = named.join(sets.select("vid", F.size("s").alias("z")), "vid").groupBy("key").agg(F.count("*").alias("m"), F.sum("z").alias("z"))
    blocks = weighed.select("key", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("z") / BLOCK_SHINGLES)).alias("blocks"))
    dealt = named.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("vid"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    cells = dealt.withColumn("other", other).join(sets, "vid").select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "vid", "label", "s")
    return cells.groupBy("key", "i", "j").applyInArrow(lambda cell: _joined(cell, threshold), "u long, v long")


def _linked(found: DataFrame, met: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(vid, label) of the components of ``found`` links, completed across components until no band adds one."""
    while True:
        labels = materialize(connected_components(found).withColumnRenamed("node", "vid"), "near-labels")
        placed = materialize(_placed(met, labels), "near-bands")
        new = materialize(_verified(_ordered(_across(placed)), sets, threshold), "near-new")
        if new.isEmpty():
            break
        found = found.unionByName(new)
    new = materialize(_crowds(placed, sets, threshold), "near-crowds")
    if new.isEmpty():
        return labels
    return materialize(connected_components(found.unionByName(new)).withColumnRenamed("node", "vid"), "near-labels")


def near_dedup(docs: DataFrame, threshold: float = JACCARD, prints: int = PRINTS) -> DataFrame:
    """The rows of ``docs`` that stay: of each component of near copies the one with the smallest doc_id.

    Rows are judged one by one, so a repeated doc_id may stay with two texts that are not near; equal rows stay once.
    A row without an id stays only where none of its component has one.  Texts without words are copies of each
    other.  Rows that agree in id and text count as equal, whatever else they hold: one of them stays, any.  An empty
    table gives an empty result.  All columns of the input pass through, whatever their names.
    """
    rows = materialize(marked(docs, prints), "near-marked")
    made = (F.min(F.struct("none", "id", "row")).alias("first"), F.min("fps").alias("fps"), F.first("bands").alias("bands"))
    # Numbered once and written, so that a class keeps its number.
    classes = materialize(rows.groupBy("digest").agg(*made).withColumn("vid", F.monotonically_increasing_id()).drop("digest"), "near-classes")
    each = classes.select("vid", F.explode("bands").alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(each.join(shared, "key"), "near-met")
    pairs = materialize(_ordered(_few(retrieved(classes)).unionByName(_pivoted(met))), "near-pairs")
    some = [met.select("vid"), *(pairs.select(F.col(c).alias("vid")) for c in "uv")]
    candidates = classes.join(reduce(DataFrame.unionByName, some).distinct(), "vid", "left_semi")
    sets = materialize(_sets(docs, candidates.select(F.col("first.id").alias("__id"), F.col("first.row").alias("__row"), "vid")), "near-sets")
    labels = _linked(materialize(_verified(pairs, sets, threshold), "near-links"), met, sets, threshold)
    labelled = classes.select("vid", "first").join(labels, "vid", "left").groupBy(F.coalesce("label", "vid").alias("label")).agg(F.min("first").alias("first"))
    keep = materialize(labelled.select(F.col("first.id").alias("__id"), F.col("first.row").alias("__row")), "near-keep")
    whole = _keyed(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__all"))
    return whole.join(keep, ["__id", "__row"], "left_semi").dropDuplicates(["__id", "__row"]).select("__all.*")
