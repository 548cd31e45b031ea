"""Toxicity by non-negative positive-unlabelled learning, in numpy.

Confirmed toxic texts are the positives; all other training texts, whatever their label, are unlabelled.  A linear model
over marks of words is trained on the non-negative risk estimate: with the class prior pi, sigmoid loss and expectations
P and U over the two samples, pi P[l(+)] + max(0, U[l(-)] - pi P[l(-)]); where the second part falls below zero a step
goes back up its slope, so that the model does not fit what the unlabelled sample cannot tell.

A mark is a word, or the first letters of one, with a level: it occurs; it occurs often for the length of the text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilo.llm.common import materialize, spared
from vigilo.llm.quality_cnn import remainder

#: Training texts at most: confirmed toxic ones, and unlabelled ones; smallest hash of the id first.
POSITIVES, UNLABELLED = 1500, 6000
#: Marks that the model weighs at most, and how many standard errors their lift must clear.
MARKS, ERRORS = 2048, 3.0
#: Share of toxic texts where labels hold no other.
PRIOR = 0.1
STEPS, RATE, RIDGE, UNLABELLED_BATCH, SEED, BIAS = 600, 0.05, 1e-4, 500, 7, -2.0
#: Lengths of the starts of words that count, and levels: (least occurrences, least share of words, words added to each text).
STARTS, LEVELS, CALM = (4, 5, 6, 7), ((1, 0.0), (2, 0.003), (3, 0.008)), 100
#: Words whose stems a worker keeps.
KEEP = 300_000

_word = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return _word.findall(text.lower())


def stems(word: str) -> list[str]:
    """The word itself, marked as whole, and its starts that are shorter than it."""
    return ["=" + word, *(word[:k] for k in STARTS if len(word) > k)]


def levels(times: int, n_words: int) -> int:
    """How many levels a stem reaches; each needs those below it."""
    reached = 0
    for least, share in LEVELS:
        if times < least or times < share * (n_words + CALM):
            break
        reached += 1
    return reached


def marks(text: str) -> list[str]:
    """All marks of a text: a stem, a space, a level."""
    found = words(text)
    times: Counter[str] = Counter()
    for w, k in Counter(found).items():
        for s in stems(w):
            times[s] += k
    return [f"{s} {q}" for s, k in times.items() for q in range(1, levels(k, len(found)) + 1)]


@dataclass
class Model:
    weights: dict[str, np.ndarray] = field(default_factory=dict)  # stem: what each level adds
    bias: float = BIAS


class Scorer:
    """Scores texts; keeps which stems of a word the model knows."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, tuple[str, ...]] = {}

    def marks(self, text: str) -> list[tuple[str, int]]:
        """(stem, levels reached) of the model's stems in a whole text."""
        found = words(text)
        if len(self.known) > KEEP:
            self.known.clear()
        times: Counter[str] = Counter()
        for w, k in Counter(found).items():
            if (own := self.known.get(w)) is None:
                own = self.known[w] = tuple(s for s in stems(w) if s in self.model.weights)
            for s in own:
                times[s] += k
        return [(s, levels(k, len(found))) for s, k in times.items()]

    def score(self, text: str | None) -> float:
        z = self.model.bias + sum(float(self.model.weights[s][:q].sum()) for s, q in sorted(self.marks(text or "")))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def risk_gradient(p: np.ndarray, u: np.ndarray, w: np.ndarray, b: float, prior: float) -> tuple[np.ndarray, float, bool]:
    """(slope by weights, slope by bias, whether the negative part is at or above zero) of the non-negative risk with sigmoid loss.

    Rows of ``p`` are positives, of ``u`` unlabelled.  Below zero the slope is that of the negative part, turned round.
    """
    sp, su = (1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40))) for x in (p, u))
    dp, du = sp * (1 - sp) / max(1, len(p)), su * (1 - su) / max(1, len(u))
    upper = su.mean() - prior * sp.mean() >= 0
    by_p, by_u = (-2 * prior * dp, du) if upper else (prior * dp, -du)
    return p.T @ by_p + u.T @ by_u, float(by_p.sum() + by_u.sum()), bool(upper)


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = SEED) -> tuple[np.ndarray, float]:
    """(weights, bias) of a linear model; rows are texts, columns marks."""
    rng = np.random.default_rng(seed)
    theta = np.zeros(positive.shape[1] + 1)
    theta[-1] = BIAS
    if not len(positive) or not len(unlabelled):
        return theta[:-1], BIAS
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    parts = max(1, len(unlabelled) // UNLABELLED_BATCH)
    step = 0
    while step < STEPS:
        op, ou = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for k in range(parts):
            own = op[k::parts] if len(op) > k else op
            g, gb, _ = risk_gradient(positive[own], unlabelled[ou[k::parts]], theta[:-1], theta[-1], prior)
            grad = np.append(g + RIDGE * theta[:-1], gb)
            step += 1
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
            rate = RATE * max(0.05, 1 - step / STEPS)
            theta -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, positive, unlabelled): distinct training texts outside the held-out fifth, at most POSITIVES + UNLABELLED.

    Positives are labelled toxic; the unlabelled are drawn from all documents, and of these no label is looked at.
    """
    usable = remainder() != 0
    first = lambda ids, n: ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    confirmed = first(labels.where((F.col("toxic") == 1) & usable).select("doc_id"), POSITIVES)
    drawn = first(docs.where(usable).select("doc_id"), UNLABELLED)
    ids = confirmed.select("doc_id", F.lit(1).alias("p"), F.lit(0).alias("u")).unionByName(drawn.select("doc_id", F.lit(0).alias("p"), F.lit(1).alias("u")))
    ids = ids.groupBy(F.col("doc_id").alias("__id")).agg(F.max("p").alias("p"), F.max("u").alias("u"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("__id"))  # bounded by the two numbers
    return texts.groupBy("text").agg(F.max("p").alias("positive"), F.max("u").alias("unlabelled"))


def chosen_marks(texts: DataFrame) -> list[tuple[str, float]]:
    """(mark, scale) of the marks that positives hold more often than unlabelled texts, by the lower bound of the log of the ratio."""

    def listed(batches):
        for batch in batches:
            for t, p, u in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                got = marks(t)
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.string()), pa.array([p] * len(got), pa.int64()), pa.array([u] * len(got), pa.int64())], ["mark", "p", "u"])

    total = texts.agg(F.sum("positive"), F.sum("unlabelled")).first()
    n_p, n_u = total[0] or 0, total[1] or 0
    if not n_p or not n_u:
        return []
    counted = texts.select("text", "positive", "unlabelled").mapInArrow(listed, "mark string, p long, u long").groupBy("mark").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    p, u = F.col("p") + 0.5, F.col("u") + 0.5
    spread = F.sqrt(F.greatest(1 / p + 1 / u - F.lit(1 / n_p + 1 / n_u), F.lit(1e-9)))
    lift = F.log(p / (n_p + 1)) - F.log(u / (n_u + 1)) - ERRORS * spread
    best = counted.where(F.col("p") >= 2).select("mark", lift.alias("lift")).where("lift > 0").orderBy(F.desc("lift"), "mark").limit(MARKS)
    return [(r.mark, r.lift) for r in best.collect()]


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> Model:
    """A model of ``labels.toxic``.  Without confirmed toxic texts it is constant.

    ``prior`` is the share of toxic texts; by default their share among labels outside the held-out fifth, PRIOR if
    these are all toxic.  Texts are marked and counted by Spark; marks of the bounded sample reach the driver, no texts.
    """
    if prior is None:
        share = labels.where(F.col("toxic").isin(0, 1) & (remainder() != 0)).agg(F.avg("toxic")).first()[0]
        prior = share if share and share < 1 else PRIOR
    texts = materialize(sample(docs, labels), "toxic-sample")
    picked = chosen_marks(texts)
    if not picked:
        return Model()
    place = {mark: k for k, (mark, _) in enumerate(picked)}

    def placed(batches):
        for batch in batches:
            held = [[place[x] for x in marks(t) if x in place] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(held, pa.list_(pa.int32()))], ["key", "positive", "unlabelled", "held"])

    rows = texts.select(F.xxhash64("text").alias("key"), "text", "positive", "unlabelled").mapInArrow(placed, "key long, positive int, unlabelled int, held array<int>").collect()
    rows.sort(key=lambda r: (r.key, r.held))
    scale = np.array([s for _, s in picked])
    sides = []
    for side in ("positive", "unlabelled"):
        held = [r.held for r in rows if r[side]]
        x = np.zeros((len(held), len(picked)), np.float32)
        for k, at in enumerate(held):
            x[k, at] = scale[at]
        sides.append(x)
    w, b = train(*sides, prior)
    weights: dict[str, np.ndarray] = {}
    for (mark, s), value in zip(picked, w, strict=True):
        stem, _, level = mark.rpartition(" ")
        weights.setdefault(stem, np.zeros(len(LEVELS)))[int(level) - 1] = s * value
    return Model(weights, b)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with a column toxicity_score, 0 to 1; other columns pass through.

    Null and empty texts get the score of a text without marks, repeated rows one each, an empty table an empty result.
    An input column named toxicity_score is kept with an underscore at its end.
    """
    docs = spared(docs, "toxicity_score")
    at = docs.schema.fieldNames().index(text)

    def apply(batches):
        scorer = Scorer(model)
        for batch in batches:
            yield batch.append_column("toxicity_score", pa.array([scorer.score(t.as_py()) for t in batch.column(at)], pa.float64()))

    return docs.mapInArrow(apply, T.StructType([*docs.schema.fields, T.StructField("toxicity_score", T.DoubleType())]))
