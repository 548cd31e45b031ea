"""Fill-in-the-middle by a table-driven byte automaton.

A state of the automaton says how many continuation bytes a code point still owes and how much of a sentinel has been
seen.  One scan over UTF-8 bytes counts two kinds of transitions, those that complete a code point and those that
complete a sentinel.  Bytes are dealt to chunks that numpy scans side by side; a chunk is scanned from each state it
could start in, and the chunks' maps are then chained, so that a long text costs no more steps than a short one.  A
second pass scans only the chunks that hold a cut and finds its byte.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vigilo.llm.common import spared

#: Fixed values of the format: what marks prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are cut, and of 100 cut ones so many take the suffix first.
CUT_SHARE, SUFFIX_FIRST = 90, 20
#: Bytes of one chunk, and of all chunks that are scanned together.
CHUNK, SCAN_BYTES = 512, 4 << 20

#: States: nothing open; one, two or three continuation bytes owed; a sentinel's first, or first two, characters seen.
START, OWE1, OWE2, OWE3, OPENED, NAMED = range(6)
STATES = 6
UNIT, MARK = 1, 1 << 16  # what a transition adds to a counter that holds both kinds


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """(next state, what is counted), both by state * 256 + byte."""
    to = np.zeros((STATES, 256), np.intp)
    adds = np.zeros((STATES, 256), np.int64)
    for state in range(STATES):
        owed = {OWE1: 1, OWE2: 2, OWE3: 3}.get(state, 0)
        for byte in range(256):
            if 0x80 <= byte < 0xC0:  # a continuation byte ends a code point when it is the last one owed
                to[state, byte] = (START, START, OWE1, OWE2)[owed]
                adds[state, byte] = UNIT if owed == 1 else 0
            elif byte >= 0xC0:
                to[state, byte] = OWE1 if byte < 0xE0 else OWE2 if byte < 0xF0 else OWE3
            else:
                adds[state, byte] = UNIT
                if byte == ord("<"):
                    to[state, byte] = OPENED
                elif state == OPENED and chr(byte) in "PSM":
                    to[state, byte] = NAMED
                elif state == NAMED and byte == ord(">"):
                    adds[state, byte] += MARK
    return to.reshape(-1) * 256, adds.reshape(-1)


TO, ADDS = transitions()


@dataclass
class Scan:
    """Counts of each text, and what the second pass needs of each chunk."""

    units: np.ndarray  # code points of each text
    marks: np.ndarray  # sentinels of each text
    first: np.ndarray  # first chunk of each text, and one more
    before: np.ndarray  # code points of the text before each chunk
    state: np.ndarray  # state in which each chunk starts
    rows: np.ndarray  # chunks' bytes
    size: np.ndarray  # bytes of each text


def scan(texts: list[bytes], chunk: int = CHUNK) -> Scan:
    """The first pass over whole texts: every chunk from every state, then the chunks of each text in order."""
    size = np.array([len(t) for t in texts], np.int64)
    n_chunks = -(-size // chunk)
    first = np.concatenate([[0], np.cumsum(n_chunks)])
    total = int(first[-1])
    rows = np.zeros((total, chunk), np.uint8)
    flat = rows.reshape(-1)
    for t, at in zip(texts, first, strict=False):
        flat[at * chunk : at * chunk + len(t)] = np.frombuffer(t, np.uint8)
    length = np.full(total, chunk, np.int64)
    full = n_chunks > 0
    length[first[1:][full] - 1] = (size - (n_chunks - 1) * chunk)[full]
    state = np.repeat(np.arange(STATES, dtype=np.intp)[None] * 256, total, axis=0)
    count = np.zeros((total, STATES), np.int64)
    by_length = np.argsort(-length, kind="stable")  # chunks that have ended are left out of later steps
    columns = np.ascontiguousarray(rows[by_length].T)
    state_s, count_s = state[by_length], count[by_length]
    live = np.searchsorted(-length[by_length], -np.arange(chunk), side="left")
    for k in range(chunk):
        if not (m := live[k]):
            break
        at = state_s[:m] + columns[k, :m, None]
        count_s[:m] += ADDS[at]
        state_s[:m] = TO[at]
    state[by_length], count[by_length] = state_s // 256, count_s
    starts, before = np.zeros(total, np.intp), np.zeros(total, np.int64)
    units, marks = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    now = np.full(len(texts), START, np.intp)
    for k in range(int(n_chunks.max(initial=0))):  # the k-th chunk of every text that has one
        held = np.flatnonzero(n_chunks > k)
        c = first[held] + k
        starts[c], before[c] = now[held], units[held]
        got = count[c, now[held]]
        units[held] += got % MARK
        marks[held] += got // MARK
        now[held] = state[c, now[held]]
    return Scan(units, marks, first, before, starts, rows, size)


def byte_cuts(found: Scan, text: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The second pass: the byte after the first ``units`` code points of the texts numbered ``text``."""
    out = np.where(units >= found.units[text], found.size[text], 0)
    inside = np.flatnonzero((units > 0) & (units < found.units[text]))
    if not len(inside):
        return out
    # A chunk of its text holds the cut: chunks of all texts form one ascending line of (text, code points before).
    line = np.repeat(np.arange(len(found.units)), np.diff(found.first))
    span = int(found.units.max()) + 1
    c = np.searchsorted(line * span + found.before, text[inside] * span + units[inside], side="left") - 1
    need = units[inside] - found.before[c]
    state, done, place = found.state[c] * 256, np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
    for k in range(found.rows.shape[1]):
        at = state + found.rows[c, k]
        done += ADDS[at] % MARK
        state = TO[at]
        place[(place == 0) & (done == need)] = k + 1
    out[inside] = (c - found.first[text[inside]]) * found.rows.shape[1] + place
    return out


def draws(doc_id: int | None, seed: int = 1) -> tuple[int, int, int, int]:
    """Four numbers that the seed and the id decide; a null id counts as an empty one."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digits[k : k + 8], 16) for k in (0, 8, 16, 24))


def arranged(prefix: bytes, middle: bytes, suffix: bytes, form: str) -> bytes:
    if form == "spm":
        return b"".join((SUFFIX.encode(), suffix, PREFIX.encode(), prefix, MIDDLE.encode(), middle))
    return b"".join((PREFIX.encode(), prefix, SUFFIX.encode(), suffix, MIDDLE.encode(), middle))


def restore(output: bytes, form: str) -> bytes:
    """The exact text of an output.  No part holds a sentinel and none can arise at a seam, so the first of each counts."""
    if form == "plain":
        return output
    lead, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    head, _, rest = output.partition(second.encode())
    a, (b, _, middle) = head[len(lead) :], rest.partition(MIDDLE.encode())
    return (a + middle + b) if form == "psm" else (b + middle + a)


def transform(ids: list[int | None], texts: list[bytes], seed: int = 1) -> tuple[list[str], list[bytes], Scan, np.ndarray, np.ndarray]:
    """(form, output, scan, code points of the prefix, code points of prefix and middle) of whole texts."""
    found = scan(texts)
    h = np.array([draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
    a, b = h[:, 0] % (found.units + 1), h[:, 1] % (found.units + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    plain = (found.units == 0) | (found.marks > 0) | (h[:, 2] % 100 >= CUT_SHARE)
    form = np.where(plain, "plain", np.where(h[:, 3] % 100 < SUFFIX_FIRST, "spm", "psm")).tolist()
    cut = np.flatnonzero(~plain)
    x, y = byte_cuts(found, cut, low[cut]), byte_cuts(found, cut, high[cut])
    out = list(texts)
    for k, p, q in zip(cut.tolist(), x.tolist(), y.tolist(), strict=True):
        out[k] = arranged(texts[k][:p], texts[k][p:q], texts[k][q:], form[k])
    return form, out, found, low, high


def _groups(sizes: list[int], limit: int = SCAN_BYTES):
    """(start, stop) of runs of texts that hold at most ``limit`` bytes, or one text."""
    start, held = 0, 0
    for k, n in enumerate(sizes):
        if k > start and held + n > limit:
            yield start, k
            start, held = k, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


ADDED = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
    ]
)


def fill_in_middle(docs: DataFrame, digest: bool = False, seed: int = 1) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output; with ``digest`` output_sha256 and restored_sha256 instead of texts.

    The id decides where a text is cut and in which form it is written.  A text that is empty or null, or that holds
    a sentinel, stays plain; prefix_chars and middle_chars are then null.  Rows with a null id are cut as with an empty
    id; repeated rows each give their row; an empty table gives an empty result.  Other columns pass through but
    ``text`` where only digests are asked for; input columns named like an output are kept with an underscore at the end.
    Work is row by row, without a shuffle, and a long text is scanned in chunks like any other.
    """
    last = ["output_sha256", "restored_sha256"] if digest else ["output"]
    docs = spared(docs, *ADDED.fieldNames(), *last)
    fields = docs.schema.fieldNames()
    at_id, at_text = fields.index("doc_id"), fields.index("text")
    kept = [k for k in range(len(fields)) if not (digest and k == at_text)]
    schema = T.StructType([docs.schema.fields[k] for k in kept] + ADDED.fields + [T.StructField(c, T.StringType()) for c in last])

    def apply(batches):
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(at_text)), 0).to_pylist()
            for a, b in _groups(sizes):
                part = batch.slice(a, b - a)
                texts = [t or b"" for t in part.column(at_text).cast(pa.binary()).to_pylist()]
                form, out, found, low, high = transform(part.column(at_id).to_pylist(), texts, seed)
                plain = np.array([f == "plain" for f in form])
                columns = [part.column(k) for k in kept]
                columns += [pa.array(found.units), pa.array(form, pa.string()), pa.array(low, mask=plain), pa.array(high - low, mask=plain)]
                if digest:
                    columns += [pa.array([hashlib.sha256(x).hexdigest() for x in out]), pa.array([hashlib.sha256(restore(x, f)).hexdigest() for x, f in zip(out, form, strict=True)])]
                else:
                    columns.append(pa.array(out, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return docs.mapInArrow(apply, schema)
