"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled 1; everything else is unlabelled web text, whose share of good text (the class
prior) is estimated. A linear model over the shape of the text minimises the non-negative unbiased risk of Kiryo et
al. 2017:  pi * R_p+ + max(0, R_u- - pi * R_p-), logistic loss. Labels 0 are never used.

The features are frequencies of pairs of neighbouring byte classes (letters, capitals, digits, spaces, each
punctuation mark) and a few ratios, so they don't depend on the language; whole texts are read. The model is fitted on
bounded samples: POSITIVES ids and UNLABELLED ids, those with the smallest hashes, and one text of each.

Defined cases: a null or empty text has zero features and gets the model's score for them; without any positives or
without any unlabelled rows each score is 0.5; documents with a null doc_id are scored but never sampled; repeated
rows are scored each, and rows that share a sampled id give one row to the sample; further columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm import fitting
from chronoloom.llm.common import fresh_name, is_remainder

#: Bounds of the samples that the model is fitted on.
POSITIVES, UNLABELLED = 2500, 5000
#: The model uses so many features, those that vary most in the sample.
FEATURES = 300
#: A document is kept from this score on.
KEEP_FROM = 0.3
FOLDS, HELD_OUT = 5, 0

_CLASSES = 38


def _byte_classes() -> np.ndarray:
    of = np.full(256, 37, np.int64)  # control bytes
    of[128:] = 0
    of[97:123] = 0
    of[65:91] = 1
    of[48:58] = 2
    of[[32, 9]] = 3
    of[[10, 13]] = 4
    of[46], of[44] = 5, 6
    marks = [c for c in range(33, 127) if not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 or c in (44, 46))]
    of[marks] = 7 + np.arange(len(marks)) % 30
    return of


_CLASS_OF = _byte_classes()


#: Bytes of a text, and texts, that are worked on at once.
_PIECE, _ROWS = 1 << 20, 1000


def features(text: str | None) -> np.ndarray:
    """Counted piece by piece; the words' shares are of the whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(_CLASSES * _CLASSES + 4)
    if not raw:
        return out
    breaks = 0
    for k in range(0, len(raw), _PIECE):
        c = _CLASS_OF[np.frombuffer(raw, np.uint8, min(_PIECE + 1, len(raw) - k), k)]
        out[: _CLASSES * _CLASSES] += np.bincount(c[:-1] * _CLASSES + c[1:], minlength=_CLASSES * _CLASSES)
        breaks += int((c[:_PIECE] == 4).sum())
    out = np.sqrt(out / max(len(raw) - 1, 1))
    words = raw.split()
    n = max(1, len(words))
    out[-4:] = np.log1p(n) / 10, len(set(words)) / n, len(raw) / n / 20, breaks / len(raw)
    return out


def estimate_prior(score_p: np.ndarray, score_u: np.ndarray) -> float:
    """The share of positives among the unlabelled: the least ratio of tail masses U(s >= t) / P(s >= t).

    As U = pi P + (1 - pi) N, each ratio is at least pi, and equal to it where the tail holds no negatives. Tails with
    under half of the positives are left out as too noisy.
    """
    cuts = np.quantile(score_p, np.linspace(0.0, 0.5, 45))
    ratio = [(score_u >= t).mean() / max((score_p >= t).mean(), 1e-9) for t in cuts]
    return float(np.clip(min(ratio), 0.05, 0.99))


def _fit_logistic(x, y, weight, steps=120, rate=0.05, decay=1e-4):
    w, adam = np.zeros(x.shape[1]), fitting.Adam(x.shape[1], rate)
    for _ in range(steps):
        pull = (fitting.sigmoid(x @ w.astype(np.float32)) - y) * weight
        adam.step(w, x.T @ pull.astype(np.float32) + decay * w)
    return w


def fit_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 300, rate: float = 0.03, decay: float = 1e-4, beta: float = 0.0) -> np.ndarray:
    """Full-batch minimisation of the non-negative risk: where the negative part falls under -beta, the step goes up that part instead."""
    w, adam = np.zeros(xp.shape[1]), fitting.Adam(xp.shape[1], rate)
    for _ in range(steps):
        w32 = w.astype(np.float32)
        zp, zu = xp @ w32, xu @ w32
        sp, su = fitting.sigmoid(zp), fitting.sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up_minus = xu.T @ (su / len(zu)).astype(np.float32) - prior * (xp.T @ (sp / len(zp)).astype(np.float32))
        grad = prior * (xp.T @ ((sp - 1) / len(zp)).astype(np.float32)) + up_minus if negative >= -beta else -up_minus
        adam.step(w, grad + decay * w)
    return w


class PuModel:
    """The features used, their mean, scale and weights, and the prior that it was fitted with."""

    def __init__(self, used, mean, scale, weights, prior):
        self.used, self.mean, self.scale, self.weights, self.prior = used, mean, scale, weights, prior

    def scores(self, texts: list) -> list[float]:
        if self.weights is None:
            return [0.5] * len(texts)
        out = []
        for k in range(0, len(texts), _ROWS):
            x = (np.stack([features(t)[self.used] for t in texts[k : k + _ROWS]]) - self.mean) / self.scale
            out += fitting.sigmoid(x @ self.weights[:-1] + self.weights[-1]).tolist()
        return out


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> PuModel:
    """Learns from documents and labels outside the held-out fold, by their text and quality = 1 alone."""
    inside = F.col("doc_id").isNotNull() & ~is_remainder(F.col("doc_id"), folds, held_out)
    positive = fitting.sample_ids(labels.where(inside & (F.col("quality") == 1)), POSITIVES, 11)
    texts = docs.select("doc_id", "text").where(inside)
    unlabelled = fitting.sample_ids(texts, UNLABELLED, 12)
    # both samples are bounded by the constants above, so they may be broadcast
    tagged = F.broadcast(positive.withColumn("p", F.lit(1)).unionAll(unlabelled.withColumn("p", F.lit(0))))
    x, cols = fitting.vectors_of(fitting.one_text(texts.join(tagged, "doc_id"), "doc_id", "p").select("text", "p"), "text", features)
    p = np.array(cols["p"], dtype=bool)
    if not p.any() or p.all():
        return PuModel(None, None, None, None, 0.5)
    spread = x.std(0, dtype=np.float64)
    used = np.sort(np.argsort(-spread, kind="stable")[:FEATURES])
    x = x[:, used]
    mean, scale = x.mean(0, dtype=np.float64), np.maximum(spread[used], 0.02)
    x = np.hstack([((x - mean) / scale).astype(np.float32), np.ones((len(x), 1), np.float32)])
    xp, xu = x[p], x[~p]
    # a first classifier of positives against unlabelled rows orders the texts for the prior, each half by the other half's
    prior = []
    for k in (0, 1):
        a, b = (xp[k::2], xu[k::2]), (xp[1 - k :: 2], xu[1 - k :: 2])
        if len(b[0]) and len(b[1]) and len(a[0]) and len(a[1]):
            y = np.r_[np.ones(len(a[0])), np.zeros(len(a[1]))]
            w = _fit_logistic(np.vstack(a), y, np.r_[np.full(len(a[0]), 0.5 / len(a[0])), np.full(len(a[1]), 0.5 / len(a[1]))])
            prior.append(estimate_prior(b[0] @ w, b[1] @ w))
    pi = float(np.mean(prior)) if prior else 0.5
    return PuModel(used, mean, scale, fit_nnpu(xp, xu, pi), pi)


def score(docs: DataFrame, model: PuModel, out: str) -> DataFrame:
    """docs with the score of each whole text in the column named out."""
    return fitting.map_text(docs, "text", [(out, pa.float64(), "double")], lambda texts: [model.scores(texts)])


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), fit(docs, labels), "score")
    return scored.select("doc_id", is_remainder(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= KEEP_FROM, 1).otherwise(0).alias("predicted"))


def quality_stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pipeline stage: documents that score under KEEP_FROM go; the others stay as they are."""
    name = fresh_name(docs, "quality_score")
    return score(docs, fit(docs, labels), name).where(F.col(name) >= KEEP_FROM).drop(name)
