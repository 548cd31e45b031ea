"""Byte-level BPE over a global distinct-word shuffle.

Texts are read in blocks (a piece of a file, or a hash of the id).  Each block lists its distinct pre-tokens once; the
lists are dealt by word, so that all mentions of a word meet in one partition, where it is encoded once.  The ids
travel back to the blocks that use the word, where the pre-tokens of every document, in order of position, take their
ids.  Lists and texts travel compressed, so what is shuffled is a fraction of the input, and no word, however
frequent, sends more than one entry per block.  Ids decode by the token-byte table, whose size the vocabulary bounds.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilo.llm.common import shuffle_partitions

#: Bytes of a file that make one block.
BLOCK_BYTES = 8 << 20
#: Characters of text that travel in one compressed row.
PACK_CHARS = 1 << 20
#: Of zstd, for what is shuffled.
LEVEL = 5

_full = regex.compile(public_tokenizers.PATTERN)
#: The same pattern for texts of ASCII and Latin letters only, where the standard library's classes agree with it.
_fast = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_odd = re.compile("[^\t-\r -~À-ɏ]")


def pretokens(text: str) -> list[str]:
    """The matches of the pattern; together they are the text."""
    return _full.findall(text) if _odd.search(text) else _fast.findall(text)


class Ranks:
    """A rank file: encodes pre-tokens, and holds the bytes of each id."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for data, i in ranks.items():
            self.token_bytes[i] = data

    def encode_word(self, word: str) -> list[int]:
        return self.encoding._encode_single_piece(word)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))


_loaded: dict[str, Ranks] = {}


def ranks(path: str) -> Ranks:
    """One per worker process and file."""
    if path not in _loaded:
        _loaded[path] = Ranks(path)
    return _loaded[path]


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as r:
        return r.read_next_batch()


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text, block of a Parquet table: a block is a stretch of one file, split further by id if it is long."""
    meta = F.col("_metadata")
    parts = F.ceil(meta["file_block_length"] / F.lit(BLOCK_BYTES))
    sub = F.pmod(F.xxhash64("doc_id"), F.greatest(parts, F.lit(1)))
    return spark.read.parquet(path).select("doc_id", "text", F.xxhash64(meta["file_path"], meta["file_block_start"], sub).alias("block"))


def encode(docs: DataFrame, path: str, block: Column | None = None, digest: bool = False) -> DataFrame:
    """(doc_id, ids, decoded) for every row, or with ``digest`` (doc_id, n_tokens, ids_sha256, decoded_sha256).

    ``block`` groups rows whose words are listed together; by default a hash of the id, about as many groups as there
    are shuffle partitions.  Null texts count as empty and have no ids.  Repeated rows are kept.  An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    given = F.pmod(F.xxhash64("doc_id"), F.lit(parts)) if block is None else block
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), given.cast("long").alias("block"))

    def word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, set[str]] = {}
        for batch in batches:
            for b, t in zip(batch.column(1).to_pylist(), batch.column(0), strict=True):
                seen.setdefault(b, set()).update(pretokens(t.as_py()))
        for b, words in seen.items():
            dealt: list[list[str]] = [[] for _ in range(parts)]
            for w in words:
                dealt[zlib.crc32(w.encode()) % parts].append(w)
            full = [k for k in range(parts) if dealt[k]]
            lists = [_packed(pa.RecordBatch.from_arrays([pa.array(sorted(dealt[k]))], ["word"])) for k in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([b] * len(full), pa.int64()), pa.array(lists, pa.binary())], ["part", "block", "words"])

    def encode_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(path)
        known: dict[str, list[int]] = {}  # each distinct word of the partition is encoded once
        for batch in batches:
            out = []
            for data in batch.column(2):
                words = _unpacked(data.as_buffer()).column(0)
                ids = []
                for w in words.to_pylist():
                    if (got := known.get(w)) is None:
                        got = known[w] = r.encode_word(w)
                    ids.append(got)
                out.append(_packed(pa.RecordBatch.from_arrays([words, pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary())], ["block", "data"])

    def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, int]] = {}

        def flush(b: int) -> pa.RecordBatch:
            ids, texts, _ = held.pop(b)
            data = _packed(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.large_string())], ["doc_id", "text"]))
            return pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([data], pa.binary())], ["block", "data"])

        for batch in batches:
            for i, t, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                t = t.as_py()
                ids, texts, n = held.get(b, ([], [], 0))
                ids.append(i)
                texts.append(t)
                held[b] = (ids, texts, n + len(t))
                if n + len(t) >= PACK_CHARS:
                    yield flush(b)
        for b in list(held):
            yield flush(b)

    def reassemble(texts: pa.Table, lists: pa.Table) -> pa.Table:
        r = ranks(path)
        index: dict[str, int] = {}
        id_bytes: list[bytes] = []
        rendered: list[bytes] = []
        for data in lists.column("data"):
            got = _unpacked(data.as_buffer())
            for w, ids in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
                index[w] = len(id_bytes)
                id_bytes.append(np.array(ids, "<i4").tobytes())
                rendered.append(" ".join(map(str, ids)).encode())
        columns: list[list] = [[], [], [], []]
        for data in texts.column("data"):
            got = _unpacked(data.as_buffer())
            for i, t in zip(got.column(0).to_pylist(), got.column(1), strict=True):
                at = list(map(index.__getitem__, pretokens(t.as_py())))  # in order of position
                ids = np.frombuffer(b"".join(map(id_bytes.__getitem__, at)), "<i4")
                decoded = r.decode(ids)
                columns[0].append(i)
                if digest:
                    columns[1].append(len(ids))
                    columns[2].append(hashlib.sha256(b" ".join(map(rendered.__getitem__, at))).hexdigest())
                    columns[3].append(hashlib.sha256(decoded).hexdigest())
                else:
                    columns[1].append(ids)
                    columns[2].append(decoded)
        if digest:
            kinds, names = [pa.int64(), pa.int64(), pa.string(), pa.string()], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        else:
            kinds, names = [pa.int64(), pa.list_(pa.int32()), pa.binary()], ["doc_id", "ids", "decoded"]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    lists = (
        rows.select("text", "block")
        .mapInArrow(word_lists, "part int, block long, words binary")
        .repartition(parts, "part")
        .mapInArrow(encode_lists, "block long, data binary")
    )
    texts = rows.mapInArrow(pack_texts, "block long, data binary")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>, decoded binary"
    return texts.groupBy("block").cogroup(lists.groupBy("block")).applyInArrow(reassemble, schema)
