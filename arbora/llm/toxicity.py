"""Toxicity by a support vector machine on a gap-weighted subsequence string kernel with Nyström landmarks.

The kernel of two words counts common subsequences of ORDER letters, each weighted by DECAY to the power of the
length it spans in both (at most SPAN), and is normalised; letters that are inserted into a word lower it but don't
break it. It is computed from the words' explicit subsequences, hashed to FEATURES places. Words are cut at white space, case-folded and stripped at the ends; runs of single letters, and words without the
marks inside them, are read as words too. A
sentence's feature for a landmark word is the kernel of its best word, mapped by K^-1/2 of the landmarks (Nyström). A
linear SVM (squared hinge) is trained on sentences: of the clean documents' sentences CLEAN at random are clean, of a toxic one the
most suspicious is toxic, chosen anew in each round; sentences with letters inserted into their words are added. A second
SVM on the same landmarks is trained in the same way on single words: those of clean documents are clean, of a toxic one's
distinct words the most suspicious share WORDS is toxic. A document's score is a logistic function of its three worst
sentences' margins, the share of bad sentences, and the share and number of suspicious words among its distinct ones;
suspicious are those that weigh more than all but RARE of the clean documents' words. The curve is fitted to what machines
of one half of the sample say of the other.

Training reads at most PER_CLASS labelled documents of each class; of their clean sentences the SVM sees CLEAN, SPOILED
spoiled ones and HARD hard ones a round, so in long documents it misses most. Toxic documents are read whole. Whole texts are scored, each on its own, so skew,
ties, repeated rows and the length of a text don't matter. A null or empty text scores 0; without labels of both classes all score 0. Extra columns don't matter; no rows, no result.
"""

import pickle
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import small_batches, table
from arbora.llm.samples import fold, labelled

ORDER, DECAY, SPAN, LANDMARKS, PER_CLASS, FOLDS = 3, 0.75, 7, 112, 1000, 5
FEATURES, CACHE = 1 << 18, 60_000
# Sentences that the SVM sees, so that long documents don't outgrow the driver: clean ones at random, spoiled clean ones,
# and in each round the hardest ones once more as long as there are fewer than MOST.
CLEAN, SPOILED, HARD, MOST = 10_000, 500, 2_000, 20_000
WORDS = 0.02  # share of a toxic document's distinct words that are taken for toxic
RARE = 0.0005  # share of clean documents' distinct words that count as suspicious
# Both by `choose` on 700 training documents of sf0.1, two seeds, among words 0.01 to 0.06 and rare 0.0005 to 0.004.
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
_INNER = re.compile(r"[\W_]+")
_EDGES = ".,;:!?\"'()[]{}<>|#*$%&-_"


def sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence."""
    out = []
    for part in _SENTENCE.split((text or "").lower()):
        words = [*filter(None, map(str.strip, part.split(), repeat(_EDGES)))]
        if 1 in map(len, words):
            run = ""
            for w in [*words, "  "]:
                if len(w) == 1:
                    run += w
                else:
                    if len(run) >= ORDER:
                        words.append(run)
                    run = ""
        if not "".join(words).isalnum():
            words += [x for x in (_INNER.sub("", w) for w in words if not w.isalnum()) if len(x) >= ORDER]
        if words:
            out.append(words)
    return out


_WEIGHTS = DECAY ** np.arange(1.0, 9.0)  # by the distance of the last letter from the first


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, feature, weight) of every word's subsequences of three letters within SPAN, the word's start being one.

    Equal ones of a word are added up, and each word's weights have norm 1.
    """
    text = "".join("^" + w for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 1 for w in words])
    keys = []
    for d2 in range(2, SPAN):
        n = max(len(codes) - d2, 0)
        same = np.flatnonzero(owner[:n] == owner[d2:])
        first, last, word = codes[same] * 1_000_003, codes[same + d2], owner[same] * FEATURES
        for d1 in range(1, d2):
            mixed = (first + codes[same + d1]) * 1_000_003 + last
            # word, feature and distance in one number: sorting is all that grouping takes
            keys.append(word + ((mixed * -7046029254386353131) >> 40 & (FEATURES - 1)) << 3 | d2)
    keys = np.sort(np.concatenate(keys))
    if not len(keys):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.float32)
    found = keys >> 3
    starts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
    found, weight = found[starts], np.add.reduceat(_WEIGHTS[keys & 7], starts)
    word = found // FEATURES
    norm = np.sqrt(np.bincount(word, weight**2, len(words)))
    return word, found % FEATURES, (weight / norm[word]).astype(np.float32)


@dataclass
class Marks:
    """The landmarks' features: `rows` has the place of each feature, or 0; of place p, `mark` and `weight` from first[p] on, up to
    first[p + 1], are the landmarks that have it and what it weighs there."""

    rows: np.ndarray
    first: np.ndarray
    mark: np.ndarray
    weight: np.ndarray
    n: int


def landmark_table(landmarks: list[str]) -> Marks:
    mark, feature, weight = subsequences(landmarks)
    order = np.argsort(feature, kind="stable")
    known, counts = np.unique(feature, return_counts=True)
    rows = np.zeros(FEATURES, np.int32)
    rows[known] = np.arange(1, len(known) + 1)
    return Marks(rows, np.r_[0, 0, np.cumsum(counts)], mark[order], weight[order].astype(np.float64), len(landmarks))


def kernel(words: list[str], marks: Marks, batch: int = 400) -> np.ndarray:
    """Normalised kernel of each word with each landmark of the table."""
    out = np.zeros((len(words), marks.n), np.float32)
    for at in range(0, len(words), batch):
        word, feature, weight = subsequences(words[at : at + batch])
        row = marks.rows[feature]
        shared = np.flatnonzero(row)  # most subsequences of a usual word occur in no landmark, the others in a few
        word, row, weight = word[shared], row[shared], weight[shared]
        n = marks.first[row + 1] - marks.first[row]
        place = np.repeat(marks.first[row] - np.cumsum(n) + n, n) + np.arange(n.sum())
        cell = np.repeat(word * marks.n, n) + marks.mark[place]
        part = out[at : at + batch]
        part[:] = np.bincount(cell, np.repeat(weight, n) * marks.weight[place], part.size).reshape(part.shape)
    return out


def best(table: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The greatest of each column over the rows `ids` of the table, for each run of `counts` ids."""
    order = np.argsort(-counts, kind="stable")
    starts, counts = (np.cumsum(counts) - counts)[order], counts[order]
    top = table[ids[starts]]
    k, n = 1, len(counts)
    while n := int(np.searchsorted(-counts[:n], -k)):  # the runs of more than k ids
        if n < 8:  # a few long runs: each by itself, in blocks
            for i in range(n):
                for a in range(starts[i] + k, starts[i] + counts[i], 4096):
                    np.maximum(top[i], table[ids[a : min(a + 4096, starts[i] + counts[i])]].max(axis=0), out=top[i])
            break
        np.maximum(top[:n], table[ids[starts[:n] + k]], out=top[:n])
        k += 1
    out = np.empty_like(top)
    out[order] = top
    return out


@dataclass
class Model:
    landmarks: list[str]
    weight: np.ndarray  # in landmark space: the Nyström map is folded in
    bias: float
    curve: np.ndarray  # logistic weights of the document's features
    word: np.ndarray  # the weight for single words
    bad: float = np.inf  # words that weigh more are suspicious
    _rows: dict[str, int] = field(default_factory=dict, repr=False)
    _table: np.ndarray | None = field(default=None, repr=False)
    _marks: Marks | None = field(default=None, repr=False)
    _weighed: np.ndarray | None = field(default=None, repr=False)  # what the first rows' words weigh

    def __getstate__(self):
        return self.__dict__ | {"_rows": {}, "_table": None, "_marks": None, "_weighed": None}

    def features(self, words: set[str]) -> None:
        """Make sure that the words' kernel rows are there. The table is dropped when it has grown to CACHE words."""
        if self._marks is None:
            self._marks = landmark_table(self.landmarks)
        if len(self._rows) > CACHE or self._table is None:
            self._rows, self._table, self._weighed = {}, np.zeros((0, len(self.landmarks)), np.float32), None
        new = sorted(words - self._rows.keys())
        if new:
            first = len(self._rows)
            self._rows.update((w, first + i) for i, w in enumerate(new))
            if len(self._table) < first + len(new):
                grown = np.zeros((first + len(new) + CACHE // 8, len(self.landmarks)), np.float32)
                grown[:first] = self._table[:first]
                self._table = grown
            for i in range(0, len(new), 8192):  # a part at a time, beside the table
                part = new[i : i + 8192]
                self._table[first + i : first + i + len(part)] = kernel(part, self._marks)

    def sentence_features(self, sents: list[list[str]]) -> np.ndarray:
        return self.sentences_and_words(sents)[0]

    def sentences_and_words(self, sents: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Each sentence's features, and the table's row of each of its words."""
        self.features(set(chain.from_iterable(sents)))
        ids = np.fromiter(map(self._rows.__getitem__, chain.from_iterable(sents)), np.int64)
        counts = np.fromiter(map(len, sents), np.int64, len(sents))
        ends = np.r_[0, np.cumsum(counts)]
        out = np.zeros((len(sents), len(self.landmarks)), np.float32)
        for i in range(0, len(sents), 512):  # a block of sentences at a time
            part = counts[i : i + 512]
            out[i : i + 512] = best(self._table, ids[ends[i] : ends[i + len(part)]], part)
        return out, ids

    def describe(self, texts) -> np.ndarray:
        """Per text: margins of its three worst sentences, share of sentences on the wrong side, share and number of
        suspicious ones among its distinct words, 1; nan without words."""
        out = np.full((len(texts), 7), np.nan)
        sents, counts, words = [], [], 0
        for i, t in enumerate(texts):
            found = sentences(t)
            sents += found
            counts.append((i, len(found)))
            words += sum(map(len, found))
            if words > 50_000 or i == len(texts) - 1:
                if sents:
                    features, ids = self.sentences_and_words(sents)
                    margin = features @ self.weight + self.bias
                    known = np.zeros(0, np.float32) if self._weighed is None else self._weighed
                    self._weighed = np.r_[known, self._table[len(known) : len(self._rows)] @ self.word.astype(np.float32)]
                    bad = self._weighed > self.bad
                    ends = np.r_[0, np.cumsum([len(s) for s in sents])]
                at = 0
                for row, n in counts:
                    if n:
                        m = np.clip(margin[at : at + n], -2, 2)
                        top = np.r_[np.sort(m)[::-1][:3], [-1.0] * max(3 - n, 0)]
                        own = np.unique(ids[ends[at] : ends[at + n]])
                        k = bad[own].sum()
                        out[row] = [*top, (m > 0).mean(), min(k / len(own) * 50, 3.0), min(np.log1p(k), 3.0), 1]
                    at += n
                sents, counts, words = [], [], 0
        return out

    def scores(self, texts) -> np.ndarray:
        x = self.describe(texts)
        return np.where(np.isnan(x[:, 0]), 0.0, 1 / (1 + np.exp(-np.clip(np.nan_to_num(x) @ self.curve, -50, 50))))


def _spoiled(word: str, rng: np.random.Generator) -> str:
    """The word with characters inserted between its letters."""
    if rng.random() < 0.5:
        return rng.choice(list(".-*_")).join(word)
    at = int(rng.integers(1, max(len(word), 2)))
    return word[:at] + str(rng.choice(list("*.-xq"))) + word[at:]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 200, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by accelerated gradient descent."""
    x1 = np.c_[x, np.ones(len(x))].astype(np.float64)
    weight = weight / weight.sum()
    rate = 1 / (2 * np.einsum("ij,ij,i->", x1, x1, weight) + ridge)
    w = v = np.zeros(x1.shape[1])
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x1 @ v))
        grad = -2 * (weight * y * slack) @ x1 + ridge * np.r_[v[:-1], 0]
        new = v - rate * grad
        v, w = new + k / (k + 3) * (new - w), new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Weights of a logistic curve by Newton steps with a small ridge; positives weigh as if they were `share` of all."""
    c = np.where(y > 0, share / (y > 0).mean(), (1 - share) / (y <= 0).mean())
    b, ridge = np.zeros(x.shape[1]), np.diag([0.1] * (x.shape[1] - 1) + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b = b - np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(b)), x.T @ (c * (p - (y > 0))) + ridge @ b)
    return b


def _word_machine(model: Model, root: np.ndarray, bags: list[list[str]], clean: Counter, weighed, odds: dict, rng: np.random.Generator, words: float, rare: float) -> tuple[np.ndarray, float]:
    """The SVM of single words and what all but `rare` of the clean ones weigh at most: those of clean documents are clean,
    of each toxic one the most suspicious `words` of its distinct words are toxic, chosen anew in each round."""
    vocabulary = sorted(clean)
    bags = [d for d in bags if d]
    model.features({*vocabulary, *(w for d in bags for w in d)})
    rows = [np.array([model._rows[w] for w in d]) for d in bags]
    usual = np.array([model._rows[w] for w in vocabulary])
    often = np.array([clean[w] for w in vocabulary])
    chance = np.sqrt(often)
    taken = rng.choice(len(usual), min(CLEAN, len(usual)), replace=False, p=chance / chance.sum())
    scores = [np.array([weighed(w) if w in odds else -9.0 for w in d]) for d in bags]
    for _ in range(3):
        chosen = [r[np.argsort(-sc)[: max(int(len(sc) * words), 1)]] for r, sc in zip(rows, scores)]
        positive = np.concatenate(chosen)
        mass = np.concatenate([np.full(len(k), 1.0 / len(k) / len(bags)) for k in chosen])
        x = model._table[np.r_[positive, usual[taken]]] @ root
        w, _ = _svm(x, np.r_[np.ones(len(positive)), -np.ones(len(taken))], np.r_[mass, 1.5 * chance[taken] / chance[taken].sum()])
        weight = root @ w
        every = model._table[: len(model._rows)] @ weight.astype(np.float32)
        scores = [every[r] for r in rows]
        taken = np.r_[taken, np.argsort(-every[usual])[:HARD]]
    return weight, float(np.quantile(np.repeat(every[usual], often), 1 - rare))


def _machines(sample: list[tuple[str, int]], seed: int, words: float = WORDS, rare: float = RARE) -> Model | None:
    """The landmarks and the machines of sentences and words; None unless both labels occur among texts with words."""
    y = np.array([label for _, label in sample])
    if not (y == 1).any() or not (y == 0).any():
        return None
    rng = np.random.default_rng(seed)
    docs = [[[*map(sys.intern, s)] for s in sentences(t)] for t, _ in sample]
    seen = {0: Counter(), 1: Counter()}
    for d, label in zip(docs, y):
        seen[int(label)].update({w for s in d for w in s if len(w) >= ORDER})
    n = {k: max((y == k).sum(), 1) for k in (0, 1)}
    odds = {w: np.log((c + 0.5) / n[1]) - np.log((seen[0][w] + 0.5) / n[0]) for w, c in seen[1].items()}
    weighed = lambda w: odds[w] * np.sqrt(min(seen[1][w], 50))
    suspicious = sorted(odds, key=lambda w: (-weighed(w), w))[: LANDMARKS * 5 // 8]
    usual = [w for w, _ in sorted(seen[0].items(), key=lambda x: (-x[1], x[0])) if w not in suspicious]
    marks = suspicious + usual[: (LANDMARKS - len(suspicious)) // 2]
    rest = usual[(LANDMARKS - len(suspicious)) // 2 :]
    marks += [rest[i] for i in rng.permutation(len(rest))[: LANDMARKS - len(marks)]]
    values, vectors = np.linalg.eigh(kernel(marks, landmark_table(marks)).astype(np.float64))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0.05))) @ vectors.T
    model = Model(marks, np.zeros(len(marks)), 0.0, np.zeros(7), np.zeros(len(marks)))

    clean = [s for d, label in zip(docs, y) if not label for s in d]
    bags = [d for d, label in zip(docs, y) if label and d]
    if not bags or not clean:
        return None
    feats = [model.sentence_features(d) for d in bags]
    worst = lambda s: max((weighed(w) for w in s if w in odds), default=-9.0)
    chosen = [int(np.argmax([worst(s) for s in d])) for d in bags]
    negative = model.sentence_features([clean[i] for i in rng.permutation(len(clean))[:CLEAN]])
    hurt = [[_spoiled(w, rng) for w in s if len(w) >= 4] for s in (clean[i] for i in rng.permutation(len(clean))[:SPOILED])]
    negative = np.r_[negative, model.sentence_features([s for s in hurt if s])]
    for _ in range(4):
        positive = np.stack([f[k] for f, k in zip(feats, chosen)])
        spoil = []
        for d, k in zip(bags, chosen):
            top = max(d[k], key=lambda w: odds.get(w, -9.0))
            spoil.append([_spoiled(w, rng) if w == top else w for w in d[k]])
        extra = model.sentence_features(spoil)
        x = np.r_[positive, extra, negative] @ root
        sign = np.r_[np.ones(2 * len(positive)), -np.ones(len(negative))]
        mass = np.r_[np.full(len(positive), 1.0 / len(positive)), np.full(len(positive), 0.3 / len(positive)), np.full(len(negative), 1.5 / len(negative))]
        w, model.bias = _svm(x, sign, mass)
        model.weight = root @ w
        chosen = [int(np.argmax(f @ model.weight)) for f in feats]
        hard = np.argsort(-(negative @ model.weight))[:HARD]
        negative = np.r_[negative, negative[hard]] if len(negative) < MOST else negative
    model.word, model.bad = _word_machine(model, root, [sorted({w for s in d for w in s if len(w) >= ORDER}) for d in bags], seen[0], weighed, odds, rng, words, rare)
    return model


def fit(sample: list[tuple[str, int]], share: float | None = None, seed: int = 1) -> Model | None:
    """A model of (text, label) rows; None unless both labels occur. share: of label 1 where the sample came from.

    The curve is fitted to what machines of one half of the sample say of the other half.
    """
    halves, said = [sample[::2], sample[1::2]], []
    for half, rest in (halves, halves[::-1]):  # one at a time: their tables are large
        other = _machines(rest, seed)
        if other is not None:
            said.append((other.describe([t for t, _ in half]), np.array([label for _, label in half])))
    model = _machines(sample, seed)
    if model is None:
        return None
    if len(said) < 2:
        said = [(model.describe([t for t, _ in sample]), np.array([label for _, label in sample]))]
    x, y = (np.concatenate(part) for part in zip(*said))
    ok = ~np.isnan(x[:, 0])
    model.curve = _logistic(x[ok], y[ok], share or float((y == 1).mean()))
    return pickle.loads(pickle.dumps(model))  # without its tables


def choose(sample: list[tuple[str, int]], words: tuple[float, ...], rare: tuple[float, ...], share: float, seed: int = 1) -> dict[tuple[float, float], float]:
    """Loss of each pair of the shares WORDS and RARE, by cross-validation within a sample of training rows.

    Machines of one half describe the other; the curve of one half's descriptions is judged on the other half's. Classes weigh as
    in `fit`: label 1 is `share` of all. Held-out rows are not for this.
    """
    halves, out = [sample[::2], sample[1::2]], {}
    for pair in ((w, r) for w in words for r in rare):
        said = []
        for half, rest in (halves, halves[::-1]):
            x = _machines(rest, seed, *pair).describe([t for t, _ in half])
            ok = ~np.isnan(x[:, 0])
            said.append((x[ok], np.array([label for _, label in half])[ok]))
        loss = []
        for (x, y), (u, v) in (said, said[::-1]):
            margin = np.where(v > 0, 1, -1) * (u @ _logistic(x, y, share))
            each = np.log1p(np.exp(-np.clip(margin, -50, 50)))
            loss.append(share * each[v > 0].mean() + (1 - share) * each[v <= 0].mean())
        out[pair] = float(np.mean(loss))
    return out


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, per_class: int = PER_CLASS) -> Model | None:
    """Fit on labelled documents outside fold 0."""
    small_batches(docs.sparkSession)
    train_rows = fold(F.col("doc_id"), folds) != 0
    share = labels.filter(train_rows).agg(F.avg("toxic")).first()[0]
    return fit(labelled(docs, labels, "toxic", train_rows, per_class), share)


_live: dict[bytes, Model] = {}


def _kept(model: Model) -> Model:
    """The model that this worker process already has, so that the words' kernels outlive a task."""
    key = pickle.dumps(model)
    if key not in _live:
        _live.clear()
        _live[key] = model
    return _live[key]


def score(text: Column, model: Model | None) -> Column:
    """Score of each text, 0 to 1."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _kept(model)
        for texts in parts:
            yield pd.Series(own.scores(texts.tolist()))

    return F.lit(0.0) if model is None else run(text)


def keep(docs: DataFrame, model: Model | None) -> DataFrame:
    """Documents that score below 0.5, with their columns."""
    return docs.filter(score(F.coalesce("text", F.lit("")), model) < 0.5)


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), score(F.coalesce("text", F.lit("")), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
