"""Alignment of two tokenizers through a dictionary of token groups.

Both tokenizers cut the same bytes.  Where tokens of both end at one byte a group ends, so a text is a row of groups,
each of a few A ids and a few B ids.  Texts are encoded once and written in packs: a pack lists its distinct groups with
their frequencies, and its documents by numbers in that list.  The lists meet by group, links are expanded once for each
distinct group and counted by its frequency, and what they add up to goes back to the packs by group.

A segment, which starts at a space after another character, is encoded for itself: neither tokenizer has a token that
crosses its start.  A worker keeps the segments it has met.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilo.llm.common import materialize
from vigilo.llm.wordbpe import byte_letters

#: Characters of text that make one pack.
PACK_CHARS = 2 << 20
#: Segments a worker keeps before it starts afresh.
KEEP = 200_000
#: A segment: white space, the characters after it, and all that follows up to the next space after a character.
SEGMENT = re.compile(r"\s*\S+(?:[^\S ]\s*\S*)*|\s+")
#: What the byte-level file's pre-tokenizer splits by: a fixed value of that kind of file.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_level(path: str):
    """(encoder of the file's merges, bytes of each id).  Ids of merged tokens must ascend as the merges do; then merging by id is merging by rule."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    value = {c: b for b, c in enumerate(byte_letters())}
    of_id = {i: bytes(map(value.__getitem__, token)) for token, i in model["vocab"].items()}
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(b <= a for a, b in zip(made, made[1:], strict=False)):
        raise ValueError(f"{path}: ids do not follow the merges")
    encoder = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks={d: i for i, d in of_id.items()}, special_tokens={})
    return encoder, [of_id.get(i, b"") for i in range(max(of_id) + 1)]


def pieces(path: str):
    """(encoder, bytes of each id) of a piece file that adds a space in front."""
    import sentencepiece

    encoder = sentencepiece.SentencePieceProcessor(model_file=path)
    byte = regex.compile(r"<0x([0-9A-F]{2})>")
    of_id = []
    for i in range(encoder.get_piece_size()):
        piece = encoder.id_to_piece(i)
        if (m := byte.fullmatch(piece)) and encoder.is_byte(i):
            of_id.append(bytes([int(m[1], 16)]))
        else:
            if "▁" in piece.lstrip("▁"):
                raise ValueError(f"{path}: the piece {piece!r} crosses a word's start")
            of_id.append(piece.replace("▁", " ").encode())
    return encoder, of_id


class Aligner:
    """Cuts texts into groups; keeps segments and the groups they consist of."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.a_bytes = byte_level(a_path)
        self.b, self.b_bytes = pieces(b_path)
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        self.space = self.b.piece_to_id("▁")
        self.clear()

    def clear(self) -> None:
        self.groups: list[str] = []
        self.number: dict[str, int] = {}
        self.n_a: list[int] = []
        self.n_b: list[int] = []
        self.of: dict[str, bytes | None] = {}  # segment: its groups' numbers; none if the bytes of its tokens differ from it
        self.line: dict[str, str] = {}  # segment: its groups, written out

    def _b_ids(self, segments: list[str]) -> list[list[int]]:
        got = self.b.encode([s[1:] for s in segments], num_threads=1)
        return [[self.space] if s == " " else ids for s, ids in zip(segments, got, strict=True)]

    def learn(self, segments: list[str]) -> None:
        """Encodes segments, each with a space in front."""
        a, b = [self.a.encode_ordinary(s) for s in segments], self._b_ids(segments)
        good = []
        for k, s in enumerate(segments):
            data = s.encode()
            if b"".join(map(self.b_bytes.__getitem__, b[k])) == data == b"".join(map(self.a_bytes.__getitem__, a[k])):
                good.append(k)
            else:
                self.of[s] = None
        if not good:
            return
        a, b = [a[k] for k in good], [b[k] for k in good]
        a_ids, b_ids = np.fromiter(chain.from_iterable(a), np.int64), np.fromiter(chain.from_iterable(b), np.int64)
        a_end, b_end = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        ends = np.intersect1d(a_end, b_end, assume_unique=True)
        a_to, b_to = (np.searchsorted(a_end, ends) + 1).tolist(), (np.searchsorted(b_end, ends) + 1).tolist()
        done = (np.searchsorted(a_to, np.cumsum([len(x) for x in a])) + 1).tolist()  # groups up to the end of each segment
        a_text, b_text = list(map(str, a_ids.tolist())), list(map(str, b_ids.tolist()))
        held, i, j = [], 0, 0
        numbers = []
        for p, q in zip(a_to, b_to, strict=True):
            one = f"{a_text[i]}|{b_text[j]}" if p - i == 1 and q - j == 1 else f"{','.join(a_text[i:p])}|{','.join(b_text[j:q])}"
            if (number := self.number.get(one)) is None:
                number = self.number[one] = len(self.groups)
                self.groups.append(one)
                self.n_a.append(p - i)
                self.n_b.append(q - j)
            held.append(one)
            numbers.append(number)
            i, j = p, q
        flat, start = np.array(numbers, np.int32), 0
        for k, stop in zip(good, done, strict=True):
            self.of[segments[k]] = flat[start:stop].tobytes()
            self.line[segments[k]] = ";".join(held[start:stop])
            start = stop

    def pack(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(group numbers of all texts, how many groups each text has, each text's groups written out)."""
        if len(self.of) > KEEP:
            self.clear()
        cut = [SEGMENT.findall(" " + t) if t else [] for t in texts]
        if new := set().union(*cut) - self.of.keys():
            self.learn(list(new))
        flat, counts, lines = [], [], []
        for k, segments in enumerate(cut):
            numbers = list(map(self.of.__getitem__, segments))
            if None in numbers:  # judged by the whole text, as its segments differ
                segments = [" " + texts[k]]
                self.learn(segments)
                numbers = [self.of[segments[0]]]
            if None in numbers:
                numbers = segments = []
            data = b"".join(numbers)
            flat.append(data)
            counts.append(len(data) // 4)
            lines.append(";".join(map(self.line.__getitem__, segments)))
        return np.frombuffer(b"".join(flat), np.int32), np.array(counts, np.int64), lines


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker process and pair of files."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


PACKS = (
    "pack long, groups array<struct<group:string,n:long>>, "
    "docs array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,distinct:int,groups_sha256:string{line}>>, held binary, times binary"
)


def packs(docs: DataFrame, a_path: str, b_path: str, written: bool = False) -> DataFrame:
    """One row for each pack of about PACK_CHARS characters: its distinct groups, its documents, and which groups each document holds how often.

    ``held`` and ``times`` are 32-bit integers: for each document its ``distinct`` places in ``groups``, and frequencies.
    """
    kind = PACKS.format(line=",groups:string" if written else "")

    def made(worker: Aligner, name: int, ids: list, texts: list) -> pa.RecordBatch:
        numbers, counts, lines = worker.pack(texts)
        starts = np.concatenate([[0], np.cumsum(counts)])
        known, place = np.unique(numbers, return_inverse=True)
        both, times = np.unique(np.repeat(np.arange(len(texts)), counts) * max(1, len(known)) + place, return_counts=True)
        doc, held = np.divmod(both, max(1, len(known)))
        n_a, n_b = (np.concatenate([[0], np.cumsum(np.array(x, np.int64)[numbers])]) if len(numbers) else np.zeros(len(starts), np.int64) for x in (worker.n_a, worker.n_b))
        total = np.bincount(place, minlength=len(known))
        groups = pa.StructArray.from_arrays([pa.array([worker.groups[k] for k in known.tolist()], pa.string()), pa.array(total, pa.int64())], ["group", "n"])
        columns = {
            "doc_id": pa.array(ids, pa.int64()),
            "n_a": pa.array(np.diff(n_a[starts]) if len(numbers) else counts),
            "n_b": pa.array(np.diff(n_b[starts]) if len(numbers) else counts),
            "n_groups": pa.array(counts),
            "distinct": pa.array(np.bincount(doc, minlength=len(texts)).astype(np.int32)),
            "groups_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() if x else "" for x in lines]),
        }
        if written:
            columns["groups"] = pa.array(lines)
        rows = pa.StructArray.from_arrays(list(columns.values()), list(columns))
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        data = [pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (held, times)]
        return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), whole(groups), whole(rows), *data], ["pack", "groups", "docs", "held", "times"])

    def apply(batches):
        worker, part, n = aligner(a_path, b_path), TaskContext.get().partitionId(), 0
        ids, texts, chars = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                texts.append(t.as_py())
                chars += len(texts[-1] or "") + 1
                if chars >= PACK_CHARS:
                    yield made(worker, part << 32 | n, ids, texts)
                    ids, texts, chars, n = [], [], 0, n + 1
        if ids:
            yield made(worker, part << 32 | n, ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, kind)


def dictionary(packed: DataFrame) -> DataFrame:
    """(group, n, a, b): each distinct group once, its frequency in the corpus, and its link.

    A link joins an A and a B token whose bytes end together; groups end wherever that happens, so the link of a group
    joins its last tokens.
    """
    listed = packed.select(F.explode("groups").alias("g")).groupBy("g.group").agg(F.sum("g.n").alias("n"))
    last = lambda k: F.substring_index(F.substring_index("group", "|", k), ",", -1).cast("int")
    return listed.select("group", "n", last(1).alias("a"), last(-1).alias("b"))


def link_counts(interned: DataFrame) -> DataFrame:
    """(a, b, count, best): how many links join the two ids, and whether no other A id is joined more often with this B id."""
    pairs = interned.groupBy("a", "b").agg(F.sum("n").alias("count"))
    most = pairs.groupBy(F.col("b").alias("b_of")).agg(F.max("count").alias("most"))  # a row for each id of the vocabulary at most
    return pairs.join(most, F.col("b") == F.col("b_of")).select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, written: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row; with ``written`` also groups.

    A text that is null or empty, or whose tokens' bytes are not a space and the text, has no tokens: zeros and ''.
    Rows with a null id and repeated rows are kept, each with its row; other columns are not looked at; an empty table
    gives an empty result.  Encoded packs are written in the shared folder once, so a lost executor costs a re-read.
    """
    packed = materialize(packs(docs, a_path, b_path, written), "align-packs")
    interned = materialize(dictionary(packed), "align-groups")
    worth = interned.join(link_counts(interned), ["a", "b"]).select("group", F.col("best").cast("int").alias("best"), "count")
    listed = packed.select("pack", F.posexplode("groups").alias("place", "g")).select("pack", "place", F.col("g.group").alias("group"))
    one = F.struct("place", "best", "count")
    told = listed.join(worth, "group").groupBy("pack").agg(F.sort_array(F.collect_list(one)).alias("worth"))  # a pack bounds the list
    told = told.select("pack", F.col("worth.best").alias("best"), F.col("worth.count").alias("count"))
    text = ", groups string" if written else ""

    def sums(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows, held, times, best, count = (batch.column(c)[k] for c in range(5))
                rows = pa.RecordBatch.from_struct_array(rows.values)
                place, often = (np.frombuffer(x.as_py() or b"", "<i4") for x in (held, times))
                upto = np.concatenate([[0], np.cumsum(rows.column("distinct").to_numpy())])
                out = []
                for values in (best, count):
                    worth_of = values.values.to_numpy().astype(np.int64) if values.is_valid else np.zeros(0, np.int64)
                    out.append(np.diff(np.concatenate([[0], np.cumsum(worth_of[place] * often)])[upto]))
                columns = [rows.column("doc_id"), rows.column("n_a"), rows.column("n_b"), rows.column("n_groups"), rows.column("n_groups"), *map(pa.array, out), rows.column("groups_sha256")]
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
                if written:
                    columns, names = [*columns, rows.column("groups")], [*names, "groups"]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + text
    return packed.select("pack", "docs", "held", "times").join(told, "pack", "left").select("docs", "held", "times", "best", "count").mapInArrow(sums, kind)
