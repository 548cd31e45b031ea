"""Best-fit packing refined by swap-based local search.

Documents are encoded, cut into pieces of at most ``capacity`` ids and packed into as few sequences as possible.
Pieces are dealt at random to groups of bounded size; each group is packed by best fit, longest first, and then
improved until nothing helps: underfull bins exchange pieces one for one and two for one, or move a piece, whenever that raises the sum of
squared fills, until bins run empty.  The bins that stay underfull are packed again in fresh groups, so what a
group could not fill meets pieces of other groups, level by level.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilo.llm.common import materialize, text_or_empty
from vigilo.llm.orc_tokens import slices
from vigilo.llm.wordbpe import encoder

CAPACITY = 2048
END_ID = 0
#: Pieces packed together; a bound on the memory and time of one task's group.
GROUP_PIECES = 5_000
#: Bins below this share of the capacity are underfull: local search works on them.
UNDERFULL = 0.995


def encode_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; null text counts as empty and holds the end id alone.

    Rows with a null id and repeated rows give their pieces like any other; an empty table gives none.
    """

    def encode(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for a, b in slices(texts):
                for doc_id, data in zip(ids[a:b], enc.encode_batch(texts[a:b]), strict=True):
                    data += end
                    n = len(data) // 4
                    for piece, start in enumerate(range(0, n, capacity)):
                        part = data[4 * start : 4 * (start + capacity)]
                        rows.append((doc_id, piece, start, len(part) // 4, zlib.crc32(part)))
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes: longest first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        at = bisect_left(room, (lengths[i], -1))
        if at < len(room):
            free, b = room.pop(at)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        if free > lengths[i]:
            insort(room, (free - lengths[i], b))
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int, underfull: float = UNDERFULL) -> list[list[int]]:
    """Local search on underfull bins; the sum of squared fills only rises, so it ends.

    A fuller bin A (fill a) and an emptier bin B (fill b <= a) trade so that A gains d > 0 ids while A still fits: a
    move (B's piece to A), one for one (A's x for B's y, d = y - x), or two for one (A's x for B's y1 + y2).  Squared
    fill then rises by 2d(a - b + d) > 0.  The largest d that fits is taken.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    changed = True
    while changed:
        work = sorted((k for k in range(len(bins)) if bins[k] and fill[k] < underfull * capacity), key=lambda k: (-fill[k], k))
        changed = False
        # The emptiest bins give; each is tried against the fuller ones before it.
        for give in reversed(work):
            if not bins[give]:
                continue
            for take in work:
                if take == give or not bins[take] or not bins[give]:
                    continue
                if fill[take] < fill[give]:
                    break
                while fill[take] < capacity and bins[give]:
                    free = capacity - fill[take]
                    theirs = sorted((lengths[i], i) for i in bins[give])
                    best: tuple[int, tuple[int, ...], tuple[int, ...]] = (0, (), ())
                    at = bisect_left(theirs, (free + 1, -1))
                    if at:
                        best = (theirs[at - 1][0], (theirs[at - 1][1],), ())
                    if best[0] < free:
                        for x in bins[take]:
                            most = lengths[x] + free
                            at = bisect_left(theirs, (most + 1, -1))
                            if at and theirs[at - 1][0] - lengths[x] > best[0]:
                                best = (theirs[at - 1][0] - lengths[x], (theirs[at - 1][1],), (x,))
                            lo, hi = 0, len(theirs) - 1
                            while lo < hi:
                                both = theirs[lo][0] + theirs[hi][0]
                                if both > most:
                                    hi -= 1
                                else:
                                    if both - lengths[x] > best[0]:
                                        best = (both - lengths[x], (theirs[lo][1], theirs[hi][1]), (x,))
                                    lo += 1
                    d, come, go = best
                    if d <= 0:
                        break
                    for i in come:
                        bins[give].remove(i)
                    for i in go:
                        bins[take].remove(i)
                    bins[take].extend(come)
                    bins[give].extend(go)
                    fill[take] += d
                    fill[give] -= d
                    changed = True
    return [b for b in bins if b]


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Best fit and local search over one bounded group."""
    return improve(best_fit(lengths, capacity), lengths, capacity)


def _pack_groups(pieces: DataFrame, groups: int, level: int, capacity: int) -> DataFrame:
    """Adds sequence_id, offset and fill; sequence_id is (level, group, number)."""

    def pack(table: pa.Table) -> pa.Table:
        order = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = order.column("length").to_pylist()
        n = len(lengths)
        seq, at, fill = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        base = (level << 56) | (order.column("g")[0].as_py() << 24)
        for k, b in enumerate(pack_lengths(lengths, capacity)):
            place = 0
            for i in b:
                seq[i], at[i] = base + k, place
                place += lengths[i]
            fill[b] = place
        out = order.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return out.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(at)).append_column("fill", pa.array(fill))

    # The row's place in the written table is part of the hash, so that repeated rows don't share a group.
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id(), F.lit(level)), F.lit(groups)))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long"
    return dealt.groupBy("g").applyInArrow(pack, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces with their sequence_id and gapless offset.

    All pieces are packed in bounded groups; then, level by level, the pieces of the underfull bins of all groups in
    fresh bounded groups, until they fit one group or a level leaves as many bins as there were; its result is then
    set aside.  Repeated rows are packed like any other.  An empty table gives an empty result.  Columns besides those
    of a piece are ignored.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    least = int(UNDERFULL * capacity)
    rest = materialize(pieces.select(*columns), "pack-pieces")
    n, bins, level, done = rest.count(), None, 1, None
    while True:
        groups = max(1, -(-n // group_pieces))
        packed = materialize(_pack_groups(rest.select(*columns), groups, level, capacity), f"pack-{level}")
        firsts = packed.where("offset = 0")  # one for each bin
        if bins is not None and firsts.count() >= bins:
            packed, groups = rest, 1
        under = packed.where(F.col("fill") < least)
        left = under.count() if groups > 1 else 0
        full = packed.where(F.col("fill") >= least) if left else packed
        done = full if done is None else done.unionByName(full)
        if not left:
            return done.select(*columns, "sequence_id", "offset")
        rest, n, bins, level = under, left, firsts.where(F.col("fill") < least).count(), level + 1


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents with their places, as ``encode_pieces`` and ``pack`` give them."""
    return pack(encode_pieces(docs, tokenizer, capacity, end_id), capacity)
