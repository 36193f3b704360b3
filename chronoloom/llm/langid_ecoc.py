"""Language identification by error-correcting output codes.

Each language gets a codeword; one binary classifier over hashed byte n-grams predicts each bit. A text's language is
the codeword at the least loss-weighted distance (Allwein et al. 2000: the logistic loss of the signed margins, summed
over the bits). score is the soft-min of the distances; a text whose two nearest codewords are closer than AMBIGUOUS is
flagged.

Learned from a sample of at most SAMPLE documents for each language, those that own a hash slot; whole texts are read.

Defined cases: a null text or one without a letter (Unicode's categories L*) is `und` with score 0 and not ambiguous; without any training rows
all are `und`; with one training language every text with a letter gets it with score 1; a null lang is never learned;
rows with a null doc_id are predicted but not learned from; repeated rows are predicted each; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm import fitting
from chronoloom.llm.common import is_remainder

#: Most documents learned from for each language.
SAMPLE = 800
#: Least gap between the two nearest codewords, in units of loss per bit, of a text that isn't ambiguous.
AMBIGUOUS = 0.15
FOLDS, HELD_OUT = 3, 1
DIMS = 2048

#: Characters of a text that are worked on at once.
_PIECE = 1 << 20
_FOLD = np.array([c if c >= 128 or 97 <= c < 123 else c + 32 if 65 <= c < 91 else 32 for c in range(256)], np.uint32)


def codewords(k: int) -> np.ndarray:
    """k codewords of +-1. Exhaustive code up to 6 languages; beyond, the best of several random dense codes by least distance."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 6:
        bits = np.array([[1] + [(j >> i) & 1 for i in range(k - 1)] for j in range(2 ** (k - 1) - 1)]).T
        return 2.0 * bits - 1
    rng, best, least = np.random.default_rng(5), None, -1.0
    for _ in range(40):
        code = rng.choice([-1.0, 1.0], size=(k, 12 * int(np.ceil(np.log2(k)))))
        code = code[:, np.abs(code.sum(0)) < k]
        gap = min((code[i] != code[j]).sum() for i in range(k) for j in range(i))
        if gap > least:
            best, least = code, gap
    return best


def has_letter(text: str | None) -> bool:
    """Whether a character is in one of Unicode's letter categories (L*); numerals such as fractions or Roman ones aren't."""
    return any(map(str.isalpha, text or ""))


def features(text: str | None) -> np.ndarray:
    """Square-rooted frequencies of hashed byte 1- to 3-grams; capitals folded, all but letters taken as one space. Counted piece by piece."""
    text = text or ""
    counts, sizes = np.zeros((3, DIMS)), np.zeros(3)
    tail = _FOLD[32:33]  # the last two folded bytes before the piece
    grams_of(tail, 0, counts, sizes)
    for k in range(0, len(text), _PIECE):
        a = _FOLD[np.frombuffer(text[k : k + _PIECE].lower().encode("utf-8", "surrogatepass"), np.uint8)]
        tail = _added(a, tail, counts, sizes)
    _added(_FOLD[32:33], tail, counts, sizes)
    return np.sqrt((counts / np.maximum(sizes, 1)[:, None]).sum(0))


def _added(a: np.ndarray, tail: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    a = a[(a != 32) | (np.concatenate([tail[-1:], a[:-1]]) != 32)]
    joined = np.concatenate([tail, a])
    grams_of(joined, len(tail), counts, sizes)
    return joined[-2:]


def grams_of(a: np.ndarray, known: int, counts: np.ndarray, sizes: np.ndarray) -> None:
    """Adds the grams that end after the first known bytes."""
    for n in (1, 2, 3):
        at = max(known, n - 1) - (n - 1)
        m = len(a) - n + 1
        if m <= at:
            continue
        if n == 1:
            g = a[at:] * np.uint32(2654435761)
        elif n == 2:
            g = (a[at:-1] * np.uint32(40503) + a[at + 1 :] * np.uint32(2246822519)) ^ np.uint32(0x9E3779B9)
        else:
            g = a[at:-2] * np.uint32(3266489917) + a[at + 1 : -1] * np.uint32(668265263) + a[at + 2 :] * np.uint32(374761393)
        g = g ^ (g >> np.uint32(15))
        g = g * np.uint32(2246822519)
        counts[n - 1] += np.bincount(g >> np.uint32(21), minlength=DIMS)
        sizes[n - 1] += m - at


class EcocModel:
    def __init__(self, langs: list[str], code: np.ndarray, mean, weights):
        self.langs, self.code, self.mean, self.weights = langs, code, mean, weights

    def decode(self, margins: np.ndarray) -> tuple[int, float, bool]:
        """Loss-weighted decoding of one text's margins: nearest codeword, its share, whether ambiguous."""
        loss = np.logaddexp(0, -self.code * margins).sum(1)
        near = np.exp(loss.min() - loss)
        two = np.sort(loss)[:2]
        return int(loss.argmin()), float(near.max() / near.sum()), bool(len(loss) > 1 and (two[1] - two[0]) / self.code.shape[1] < AMBIGUOUS)

    def predict(self, texts: list) -> list[list]:
        out = []
        for t in texts:
            if not self.langs or not has_letter(t):
                out.append(("und", 0.0, False))
            elif len(self.langs) == 1:
                out.append((self.langs[0], 1.0, False))
            else:
                i, share, unsure = self.decode(np.append(features(t) - self.mean, 1.0) @ self.weights)
                out.append((self.langs[i], share, unsure))
        return [list(c) for c in zip(*out, strict=True)] if out else [[], [], []]


def fit(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, steps: int = 150) -> EcocModel:
    learn = docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~is_remainder(F.col("doc_id"), folds, held_out))
    # SAMPLE rows a language: a bounded table, so it may be broadcast
    ids = F.broadcast(fitting.sample_ids_by(learn.select("doc_id", "lang"), "lang", SAMPLE, 21).select("doc_id").distinct())
    x, cols = fitting.vectors_of(fitting.one_text(learn.join(ids, "doc_id"), "doc_id", "lang").select("text", "lang"), "text", features)
    langs = sorted(set(cols["lang"]))
    code = codewords(len(langs))
    if len(langs) < 2:
        return EcocModel(langs, code, None, None)
    y = np.array([langs.index(v) for v in cols["lang"]])
    mean = x.mean(0, dtype=np.float64)
    x = np.hstack([(x - mean).astype(np.float32) * 1.0, np.ones((len(x), 1), np.float32)])
    target = ((code[y] + 1) / 2).astype(np.float32)
    weight = (1.0 / np.bincount(y)[y] / len(langs)).astype(np.float32)[:, None]
    w, adam = np.zeros((x.shape[1], code.shape[1])), fitting.Adam((x.shape[1], code.shape[1]), 0.3)
    for _ in range(steps):
        adam.step(w, x.T @ ((fitting.sigmoid(x @ w.astype(np.float32)) - target) * weight) + 1e-6 * w)
    return EcocModel(langs, code, mean, w)


def identify(docs: DataFrame, model: EcocModel) -> DataFrame:
    """docs with lang_pred, score and ambiguous."""
    out = [("lang_pred", pa.string(), "string"), ("score", pa.float64(), "double"), ("ambiguous", pa.bool_(), "boolean")]
    return fitting.map_text(docs, "text", out, model.predict)


def language_digest(docs: DataFrame) -> DataFrame:
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", is_remainder(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "lang_pred", "score", "ambiguous")
