"""Learned decision lists of quality rules.

Sequential covering on labelled statistics: a rule is a conjunction of thresholds that grows on two thirds of the
labelled rows by information gain and is pruned on the other third; the rows it covers are set aside and the next rule
is learned, until rules stop being precise.  The list becomes one ordered Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilo.llm.common import SPAN, spans
from vigilo.llm.quality_cnn import training_rows

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Labelled documents of each class that learning takes at most, smallest hash first.
TRAIN_ROWS_PER_CLASS = 3000
MAX_RULES, MAX_CONDITIONS = 12, 4
#: A rule enters the list only if the pruning rows it covers are rejects in this share at least.
PRECISION = 0.9

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What conditions look at: counts and ratios, all defined for empty texts.
#: None of them drifts with the length of a clean text, as the share of distinct words would.
FEATURES = ("symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "adjacent_share", "exclaim_per_word")


def _equal_neighbours(digests: bytearray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts 128-bit digests, and whether each in it after the first equals the one before."""
    a, b = np.frombuffer(digests, np.uint64).reshape(-1, 2).T
    order = np.lexsort((b, a))
    same = np.ones(max(len(order) - 1, 0), bool)
    for x in (a, b):
        x = x[order]
        same &= x[1:] == x[:-1]
    return order, same


def _covered(twice: np.ndarray, n: int) -> int:
    """Words of ``n`` in the windows that start at ``twice``, distinct places."""
    cover = np.zeros(n + 1, np.int32)
    cover[twice] += 1
    cover[twice + WINDOW] -= 1
    return int((np.cumsum(cover)[:n] > 0).sum())


def _long_words(data: bytes) -> tuple[int, int, int]:
    """n_words, n_repeat_words and words equal to the one before of a long text, by digests of its windows."""
    digests, tail, n, adjacent = bytearray(), [], 0, 0
    for part in spans(data):
        n += len(part)
        words = tail + part
        adjacent += sum(map(eq, part, words[len(tail) - 1 :] if tail else part[1:]))
        for i in range(len(words) - WINDOW + 1):
            digests += xxhash.xxh3_128_digest(b" ".join(words[i : i + WINDOW]))
        tail = words[1 - WINDOW :]
    order, same = _equal_neighbours(digests)
    twice = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    return n, _covered(twice, n), adjacent


def _long_lines(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them that are equal to an earlier one, of a long text."""
    digests, at = bytearray(), 0
    while at <= len(text):
        end = text.find("\n", at + SPAN)
        end = end if end >= 0 else len(text)
        for x in text[at:end].split("\n"):
            if x.strip(BLANKS):
                digests += xxhash.xxh3_128_digest(x.encode())
        at = end + 1
    _, same = _equal_neighbours(digests)
    return len(digests) // 16, int(same.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then lines, upper-case letters, words equal to the one before, exclamation marks.

    Long texts are measured by 128-bit digests of windows and lines, whose objects would take some 35 times the text.
    """
    if not text:
        return (0,) * 9
    word_chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    upper = sum(1 for c in text if c.isupper()) if not text.isascii() else len(text) - len(text.encode().translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    if len(text) > SPAN:
        n, repeat, adjacent = _long_words(text.encode())
        lines, dup = _long_lines(text)
        return n, word_chars, symbols, dup, repeat, lines, upper, adjacent, text.count("!")
    words = text.encode().split()  # of bytes: exactly the six ASCII blanks separate
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    n = len(words)
    distinct = len(set(words))
    repeat = 0
    if n > WINDOW and distinct < n:  # a window found twice needs a word found twice
        windows = list(zip(*(words[k:] for k in range(WINDOW))))
        first: dict[tuple, int] = {}
        twice = np.zeros(n + 1, np.int64)
        any_twice = False
        if len(set(windows)) < len(windows):
            for i, w in enumerate(windows):
                j = first.setdefault(w, i)
                if j != i:
                    any_twice = True
                    twice[[i, j]] = 1
        if any_twice:
            repeat = _covered(np.flatnonzero(twice), n)
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeat, len(lines), upper, sum(map(eq, words, words[1:])), text.count("!")


def features(m: np.ndarray) -> np.ndarray:
    """FEATURES of rows of ``measure``."""
    m = m.astype(np.float64)
    words = np.maximum(m[:, 0], 1)
    return np.stack([m[:, 2] / words, m[:, 3] / np.maximum(m[:, 5], 1), m[:, 4] / words, m[:, 6] / np.maximum(m[:, 1], 1), m[:, 7] / words, m[:, 8] / words], axis=1)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value >= threshold, else value <= threshold
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v >= self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Adds the condition of the highest information gain until only rejects are covered."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    for _ in range(MAX_CONDITIONS):
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p or not n:
            break
        base = np.log2(p / (p + n))
        best, gain = None, 1e-9
        for f, name in enumerate(FEATURES):
            v = x[inside, f]
            b = bad[inside]
            order = np.argsort(v, kind="stable")
            v, b = v[order], b[order]
            cum = np.cumsum(b)
            last = np.flatnonzero(np.append(v[1:] != v[:-1], True))
            for above in (False, True):
                if above:  # all from the first of each run of equal values on
                    starts = np.append(0, last[:-1] + 1)
                    pos = cum[-1] - np.where(starts > 0, cum[starts - 1], 0)
                    size, value = len(v) - starts, v[starts]
                else:
                    pos, size, value = cum[last], last + 1, v[last]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(pos > 0, pos * (np.log2(pos / size) - base), -1)
                k = int(gains.argmax())
                if gains[k] > gain:
                    # Halfway to the neighbouring value, so values between the two classes split evenly.
                    other = v[starts[k] - 1] if above and starts[k] else v[min(last[k] + 1, len(v) - 1)] if not above else value[k]
                    best, gain = Condition(name, above, float((value[k] + other) / 2)), gains[k]
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return tuple(rule)


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> tuple[Rule, float, int]:
    """The prefix of the rule worth most on the pruning rows, its precision there and the rejects it covers."""
    best: tuple[float, Rule, float, int] = (-2.0, (), 0.0, 0)
    for k in range(1, len(rule) + 1):
        at = covers(rule[:k], x)
        p, n = int((at & bad).sum()), int((at & ~bad).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[0]:
            best = (worth, rule[:k], p / (p + n) if p + n else 0.0, p)
    return best[1:]


def learn(x: np.ndarray, labels: np.ndarray, seed: int = 11) -> list[Rule]:
    """Ordered reject rules from feature rows and 0/1 labels; no rejects or no rows give an empty list."""
    bad = labels == 0
    rng = np.random.default_rng(seed)
    left = np.ones(len(x), bool)
    rules: list[Rule] = []
    for _ in range(MAX_RULES):
        rows = np.flatnonzero(left)
        if not bad[rows].any():
            break
        for _attempt in range(3):
            mix = rng.permutation(rows)
            grow, prune = mix[: 2 * len(mix) // 3], mix[2 * len(mix) // 3 :]
            rule, precision, hit = _prune(_grow(x[grow], bad[grow]), x[prune], bad[prune]) if len(grow) and len(prune) else ((), 0.0, 0)
            if rule and precision >= PRECISION and hit:
                break
        else:
            break
        rules.append(rule)
        left &= ~covers(rule, x)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Ordered conditional expression over the FEATURES columns: the first rule that holds rejects, else kept."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_ROWS_PER_CLASS) -> list[Rule]:
    """Rules for ``labels.quality``, from a bounded sample of labelled rows outside the held-out fifth."""
    rows, _ = training_rows(docs, labels, "quality", per_class)
    if not rows:
        return []
    return learn(features(np.array([measure(t) for t, _ in rows])), np.array([y for _, y in rows]))



def measured(rows: DataFrame, texts: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """The first column of ``rows``, counts and features of the texts of every row, repeated ones too.  Null text counts as empty."""
    from pyspark.sql import types as T

    first = rows.schema.fields[0]

    def apply(batches):
        for batch in batches:
            m = np.array([measure(t.as_py()) for t in texts(batch)], np.int64).reshape(-1, 9)
            f = features(m)
            arrays = [pa.array(m[:, k]) for k in range(len(COUNTS))] + [pa.array(f[:, k]) for k in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [first.name, *COUNTS, *FEATURES])

    return rows.mapInArrow(apply, T.StructType([first, *(T.StructField(c, T.LongType()) for c in COUNTS), *(T.StructField(c, T.DoubleType()) for c in FEATURES)]))


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """doc_id, counts, base_failed, kept for every row of ``docs``; repeated rows one each, an empty table gives an empty result."""
    counted = measured(docs.select("doc_id", F.col(text).alias("__text")), lambda batch: batch.column(1))
    return counted.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules)).select("doc_id", *COUNTS, "base_failed", "kept")


def keep_documents(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the learned list, with their columns.

    The whole row travels in one struct past the measurements, so no name of the input can clash, and its text only there.
    """
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    at = [c.lower() for c in docs.columns].index(text.lower())
    passed = measured(whole, lambda batch: batch.column(0).field(at)).where(~base_failed() & verdict(rules))
    return passed.select("row.*")
