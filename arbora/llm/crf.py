"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's own measurements and those of the lines before and after it give the
label's potential, a 2 x 2 table that of neighbouring labels; both are trained by gradient ascent on the likelihood of
sample documents whose lines bear their document's label. Forward-backward gives each line's marginal; the mean
of the marginals weighted by line length, through a logistic curve, is the document's quality.

Training reads at most PER_CLASS labelled documents of each class, whole. Whole texts are scored, each on its own. A text
without words (null, empty) scores 0; without labels of both classes every other text scores 1. Ties, repeated rows and
extra columns don't matter; no rows, no result.
"""

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import table
from arbora.llm.samples import fold, labelled

PER_CLASS, FOLDS, HELD_OUT, STEPS, CELLS = 1000, 3, 1, 150, 200_000
_SYMBOL = re.compile(r"[#*$%&|<>{}\[\]=~^@\\/_]")
_TRIPLE = 3


def measures(line: str, seen: dict[str, int]) -> list[float]:
    """What one line shows by itself; seen: lines of the document so far."""
    words = line.split()
    n = len(words)
    letters = max(len(line) - line.count(" "), 1)
    distinct = len(set(words)) / n
    grams = max(n - _TRIPLE + 1, 1)
    triple = len(set(zip(*(words[i:] for i in range(_TRIPLE))))) / grams if n >= _TRIPLE else 1.0
    upper = sum(w.isupper() for w in words) / n
    same = sum(a == b for a, b in zip(words, words[1:])) / n
    again = float(line in seen)
    seen[line] = 1
    return [
        min(len(_SYMBOL.findall(line)) / n, 2.0),
        min(line.count("!!") / n, 2.0),
        upper if n > 2 else 0.0,
        1 - distinct if n > 4 else 0.0,
        1 - triple,
        same,
        again,
        min(np.log1p(n) / 5, 2.0),
        min(letters / n / 10, 3.0),
        sum(c.isdigit() for c in line) / letters,
    ]


WIDTH = 10


def document(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features, lengths) of the lines with words. Features: own, previous and next line's, first, last, 1."""
    seen: dict[str, int] = {}
    lines = [x for x in (text or "").split("\n") if x.strip()]
    own = np.array([measures(x, seen) for x in lines], np.float32).reshape(len(lines), WIDTH)
    none = np.zeros((1, WIDTH), np.float32)
    ends = np.zeros((len(lines), 3), np.float32)
    if len(lines):
        ends[0, 0] = ends[-1, 1] = 1
        ends[:, 2] = 1
    return np.c_[own, np.r_[none, own][: len(lines)], np.r_[own, none][1:], ends], np.array([len(x) for x in lines], np.float64)


def forward_backward(unary: np.ndarray, mask: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (docs x lines x 2), pair marginals summed over lines (docs x 2 x 2) and log partition of padded chains."""
    n, t, _ = unary.shape
    psi, link = np.exp(np.clip(unary, -30, 30)), np.exp(np.clip(pair, -30, 30))
    alpha, beta, scale = np.zeros((n, t, 2)), np.ones((n, t, 2)), np.ones((n, t))
    for k in range(t):
        a = psi[:, k] if k == 0 else psi[:, k] * (alpha[:, k - 1] @ link)
        s = a.sum(1)
        alpha[:, k] = np.where(mask[:, k, None], a / s[:, None], alpha[:, k - 1] if k else 0.5)
        scale[:, k] = np.where(mask[:, k], s, 1)
    pairs = np.zeros((n, 2, 2))
    for k in range(t - 2, -1, -1):
        ahead = psi[:, k + 1] * beta[:, k + 1] / scale[:, k + 1, None]
        beta[:, k] = np.where(mask[:, k + 1, None], ahead @ link.T, 1)
        pairs += np.where(mask[:, k + 1, None, None], alpha[:, k, :, None] * link * ahead[:, None, :], 0)
    return alpha * beta, pairs, np.log(scale).sum(1)


def _padded(docs: list[np.ndarray], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, docs))
    unary, mask = np.zeros((len(docs), t, 2)), np.zeros((len(docs), t), bool)
    for i, d in enumerate(docs):
        unary[i, : len(d), 1] = d @ weight
        mask[i, : len(d)] = True
    return unary, mask


def _blocks(lengths: list[int]) -> list[list[int]]:
    """Indices grouped by similar length, so that padding stays within CELLS."""
    out, now = [], []
    for i in sorted((i for i, n in enumerate(lengths) if n), key=lambda i: lengths[i]):
        if now and (len(now) + 1) * lengths[i] > CELLS:
            out.append(now)
            now = []
        now.append(i)
    return [*out, now] if now else out


@dataclass
class Model:
    weight: np.ndarray
    pair: np.ndarray
    slope: float
    shift: float

    def good_share(self, texts) -> np.ndarray:
        """Length-weighted mean of the marginals of `good`; nan without words."""
        docs = [document(t) for t in texts]
        out = np.full(len(docs), np.nan)
        for block in _blocks([len(x) for x, _ in docs]):
            unary, mask = _padded([docs[i][0] for i in block], self.weight)
            marginal = forward_backward(unary, mask, self.pair)[0][:, :, 1]
            for row, i in enumerate(block):
                size = docs[i][1]
                out[i] = (marginal[row, : len(size)] * size).sum() / size.sum()
        return out

    def scores(self, texts) -> np.ndarray:
        share = self.good_share(texts)
        return np.where(np.isnan(share), 0.0, 1 / (1 + np.exp(-(self.slope * np.nan_to_num(share) + self.shift))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    design = np.c_[x, np.ones(len(x))]
    c = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y <= 0).sum(), 1)) * len(y)
    b = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        b -= np.linalg.solve((design * (c * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2), design.T @ (c * (p - y)) + 0.1 * b)
    return max(float(b[0]), 1e-3), float(b[1])


def fit(sample: list[tuple[str, int]], ridge: float = 1e-3) -> Model | None:
    """A model of (text, label) rows; None unless both labels occur."""
    docs = [(document(t)[0], y) for t, y in sample]
    docs = [(x, y) for x, y in docs if len(x)]
    labels = np.array([y for _, y in docs])
    if not (labels == 1).any() or not (labels == 0).any():
        return None
    weight, pair = np.zeros(docs[0][0].shape[1]), np.zeros((2, 2))
    share = {y: 0.5 / (labels == y).sum() for y in (0, 1)}
    theta, m, v = np.zeros(len(weight) + 4), 0.0, 0.0
    blocks = _blocks([len(x) for x, _ in docs])
    for step in range(1, STEPS + 1):
        weight, pair = theta[:-4], theta[-4:].reshape(2, 2)
        grad = np.zeros_like(theta)
        for block in blocks:
            unary, mask = _padded([docs[i][0] for i in block], weight)
            marginal, pairs, _ = forward_backward(unary, mask, pair)
            for row, i in enumerate(block):
                x, y = docs[i]
                k = share[y] / len(x)  # every document counts alike
                grad[:-4] += k * ((y - marginal[row, : len(x), 1]) @ x)
                told = np.zeros((2, 2))
                told[y, y] = len(x) - 1
                grad[-4:] += k * (told - pairs[row]).ravel()
        grad -= ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = Model(theta[:-4], theta[-4:].reshape(2, 2), 1.0, 0.0)
    model.slope, model.shift = _logistic(model.good_share([t for t, _ in sample if (t or "").strip()]), labels)
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """Fit on labelled documents outside the held-out fold."""
    return fit(labelled(docs, labels, "quality", fold(F.col("doc_id"), FOLDS) != HELD_OUT, per_class))


def score(text: Column, model: Model | None) -> Column:
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts.tolist()))

    return F.when(~F.rlike(text, F.lit(r"[^\x20\x09-\x0D]")), 0.0).otherwise(1.0) if model is None else run(text)


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), score(F.coalesce("text", F.lit("")), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
