"""Byte-level convolutional quality classifier in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it.  Learned filters run over each chunk and
are max-pooled there; the pooled values are combined over chunks by their maximum, mean and minimum, and one logistic
unit makes a probability of them.  The chunk minimum lets monotonous passages show, which no single window does.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilo.llm.common import spared

KERNEL, STRIDE, EMBED, FILTERS = 8, 2, 6, 24
CHUNK, STEP = 512, 384
#: Labelled documents of each class that training takes at most, smallest hash first.
TRAIN_ROWS_PER_CLASS = 1500
EPOCHS, BATCH, SEED = 8, 48, 7
#: Positions convolved at a time.
BLOCK_CHUNKS = 256


@dataclass
class Model:
    embed: np.ndarray  # 257 x EMBED; the last row stands for padding
    filters: np.ndarray  # KERNEL*EMBED x FILTERS
    bias: np.ndarray
    weights: np.ndarray  # 3*FILTERS
    offset: float
    mean: np.ndarray
    scale: np.ndarray


def chunks(data: bytes) -> np.ndarray:
    """Rows of CHUNK byte values; each starts STEP after the last, the end is padded with 256."""
    n = max(1, -(-max(0, len(data) - CHUNK) // STEP) + 1)
    padded = np.full(STEP * (n - 1) + CHUNK, 256, np.int16)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


def _windows(model: Model, rows: np.ndarray) -> np.ndarray:
    """Embedded windows of each chunk: rows x positions x KERNEL*EMBED."""
    x = model.embed[rows]
    view = np.lib.stride_tricks.sliding_window_view(x, KERNEL, axis=1)[:, ::STRIDE]
    return np.ascontiguousarray(view.swapaxes(2, 3)).reshape(len(rows), view.shape[1], KERNEL * EMBED)


def pooled(model: Model, rows: np.ndarray, arg: bool = False):
    """Max-pooled filter values of each chunk, and with ``arg`` the places of the maxima."""
    out = np.empty((len(rows), FILTERS), np.float32)
    at = np.empty((len(rows), FILTERS), np.int32) if arg else None
    for k in range(0, len(rows), BLOCK_CHUNKS):
        part = rows[k : k + BLOCK_CHUNKS]
        w = _windows(model, part)
        z = (w.reshape(-1, w.shape[2]) @ model.filters).reshape(len(part), w.shape[1], FILTERS)
        if arg:
            at[k : k + len(part)] = z.argmax(axis=1)
        out[k : k + len(part)] = z.max(axis=1)
    out = np.maximum(out + model.bias, 0)
    return (out, at) if arg else out


def combine(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per document: max, mean and min of its chunks' pooled values."""
    return np.concatenate([np.maximum.reduceat(values, starts), np.add.reduceat(values, starts) / counts[:, None], np.minimum.reduceat(values, starts)], axis=1)


def _probability(model: Model, features: np.ndarray) -> np.ndarray:
    z = ((features - model.mean) / model.scale) @ model.weights + model.offset
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score_texts(model: Model, texts: list[str | None]) -> np.ndarray:
    """Probability of label 1 for each whole text; null counts as empty."""
    out = np.empty(len(texts))
    k = 0
    while k < len(texts):
        held, rows, first = [], 0, k
        while k < len(texts) and (not held or rows < 4 * BLOCK_CHUNKS):
            held.append(chunks((texts[k] or "").encode()))
            rows += len(held[-1])
            k += 1
        counts = np.array([len(x) for x in held])
        values = pooled(model, np.concatenate(held))
        out[first:k] = _probability(model, combine(values, np.concatenate([[0], np.cumsum(counts)[:-1]]), counts))
    return out


def train(texts: list[str], labels: list[int], prior: float, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Fit on labelled texts; classes weigh so that label 1 has the share ``prior``.  One class only: a constant model."""
    rng = np.random.default_rng(seed)
    model = Model(
        rng.normal(0, 0.5, (257, EMBED)).astype(np.float32),
        rng.normal(0, (2 / (KERNEL * EMBED)) ** 0.5, (KERNEL * EMBED, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        np.zeros(3 * FILTERS, np.float32),
        float(np.log(min(max(prior, 0.01), 0.99) / (1 - min(max(prior, 0.01), 0.99)))),
        np.zeros(3 * FILTERS, np.float32),
        np.ones(3 * FILTERS, np.float32),
    )
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        return model
    share = float(y.mean())
    weight = np.where(y > 0, prior / share, (1 - prior) / (1 - share))
    held = [chunks(t.encode()) for t in texts]
    model.weights += rng.normal(0, 0.1, 3 * FILTERS).astype(np.float32)
    params = [model.embed, model.filters, model.bias, model.weights, np.array([model.offset], np.float32)]
    m1 = [np.zeros_like(p) for p in params]
    m2 = [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(held))
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for b in range(0, len(order), BATCH):
            pick = order[b : b + BATCH]
            counts = np.array([len(held[i]) for i in pick])
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            rows = np.concatenate([held[i] for i in pick])
            values, at = pooled(model, rows, arg=True)
            f = combine(values, starts, counts)
            p = 1 / (1 + np.exp(-np.clip(f @ params[3] + params[4][0], -40, 40)))
            g = ((p - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
            gw, go = f.T @ g + 1e-4 * params[3], np.array([g.sum()], np.float32)
            gf = g[:, None] * params[3]
            doc = np.repeat(np.arange(len(pick)), counts)
            gmax, gmean, gmin = np.split(gf, 3, axis=1)
            fmax, _, fmin = np.split(f, 3, axis=1)
            gv = gmean[doc] / counts[doc][:, None] + gmax[doc] * (values == fmax[doc]) + gmin[doc] * (values == fmin[doc])
            gv = np.where(values > 0, gv, 0).astype(np.float32)
            c, k = np.nonzero(gv)
            place = at[c, k] * STRIDE
            bytes_at = rows[c[:, None], place[:, None] + np.arange(KERNEL)]
            x = model.embed[bytes_at].reshape(len(c), KERNEL * EMBED)
            gz = gv[c, k]
            gfilters = np.zeros_like(model.filters)
            for one in range(FILTERS):
                at_one = k == one
                gfilters[:, one] = gz[at_one] @ x[at_one]
            gx = (gz[:, None] * model.filters[:, k].T).reshape(-1, EMBED)
            gembed = np.zeros_like(model.embed)
            np.add.at(gembed, bytes_at.reshape(-1), gx)
            gbias = np.bincount(k, gz, FILTERS).astype(np.float32)
            step += 1
            for i, grad in enumerate((gembed, gfilters, gbias, gw.astype(np.float32), go)):
                m1[i] = 0.9 * m1[i] + 0.1 * grad
                m2[i] = 0.999 * m2[i] + 0.001 * grad * grad
                params[i] -= rate * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)
    # The filters are settled; the logistic unit is fitted to convergence on standardised features.
    counts = np.array([len(x) for x in held])
    values = pooled(model, np.concatenate(held))
    f = combine(values, np.concatenate([[0], np.cumsum(counts)[:-1]]), counts).astype(np.float64)
    model.mean, model.scale = f.mean(axis=0), f.std(axis=0) + 1e-3
    x = np.concatenate([(f - model.mean) / model.scale, np.ones((len(f), 1))], axis=1)
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 0.002 * len(f))
    ridge[-1] = 1e-9
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    model.weights, model.offset = w[:-1], float(w[-1])
    return model


def remainder(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5; 0 marks the rows held out from training.  Null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))


def training_rows(docs: DataFrame, labels: DataFrame, target: str, per_class: int) -> tuple[list[tuple[str, int]], float]:
    """A bounded sample of labelled texts outside the held-out fifth, and the share of label 1 among all such labels.

    At most ``per_class`` labels of each class, smallest hash of the id first; only their texts reach the driver.
    """
    usable = labels.where(F.col(target).isin(0, 1) & (remainder() != 0)).groupBy("doc_id").agg(F.min(target).alias("y"))
    sizes = dict(usable.groupBy("y").count().collect())
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.5
    picked = [usable.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1)]
    chosen = {r[0]: r[1] for x in picked for r in x.collect()}
    if not chosen:
        return [], prior
    ids = docs.sparkSession.createDataFrame(sorted(chosen.items()), "__id long, __y int")  # bounded by 2 x per_class
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("__id"))
    rows = sorted({r[0]: (r[1], r[2]) for r in found.select("doc_id", "text", "__y").toLocalIterator()}.items())
    return [r for _, r in rows], prior


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_ROWS_PER_CLASS) -> Model:
    """A model of ``labels.quality``; without labels a constant one."""
    rows, prior = training_rows(docs, labels, "quality", per_class)
    return train([t for t, _ in rows], [y for _, y in rows], prior)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with a column quality_score; other columns pass through.

    Null and empty texts are scored too, repeated rows each, and an empty table gives an empty result.  An input
    column named quality_score is kept with an underscore at its end.
    """
    docs = spared(docs, "quality_score")
    fields = docs.schema.fieldNames()

    def apply(batches):
        for batch in batches:
            yield batch.append_column("quality_score", pa.array(score_texts(model, batch.column(fields.index(text)).to_pylist())))

    return docs.mapInArrow(apply, T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())]))


def keep_documents(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with their columns as they were.

    The whole row travels in one struct, so no name of the input can clash, and its text only there.
    """
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    at = [c.lower() for c in docs.columns].index("text")

    def apply(batches):
        for batch in batches:
            yield batch.append_column("quality_score", pa.array(score_texts(model, batch.column(0).field(at).to_pylist())))

    scored = held.mapInArrow(apply, T.StructType([*held.schema.fields, T.StructField("quality_score", T.DoubleType())]))
    return scored.where(F.col("quality_score") >= least).select("row.*")
