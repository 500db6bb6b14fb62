"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Positives are trusted good texts, everything else is unlabelled. The share of good texts among the unlabelled, the class
prior, is estimated from the two score distributions. A small network is then trained to minimise
prior * R+(f) + max(0, R-_unlabelled(f) - prior * R-_positive(f)); where the second part goes below zero, its gradient is
taken the other way, so the network can't earn risk by memorising positives as negatives.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechloom.llm.common import bound_batches, map_columns, texts
from speechloom.llm.labelled import finish, hash_sample, labelled_ids, scorer, texts_of

#: Rows the model is fitted on at most, of each kind: a bounded sample by hash of the id.
FIT_POSITIVE, FIT_UNLABELLED = 6000, 12000
HIDDEN, EPOCHS, SEED = 24, 60, 20

_WORD_MARK = re.compile(r"[^\s\w]+")
_VOWEL = re.compile("[aeiouyáàâäéèêëíìîïóòôöúùûüæœø]")
NAMES = (
    "log_words mean_length spread_length upper capitalised exclaim pipe symbol digit stop_mark comma marked_words distinct repeats distinct_pairs"
    " short_words lone_marks line_repeats log_lines non_ascii top_word longest_word vowels"
).split()


def features(text: str) -> list[float]:
    """Shape and repetition of a whole text; the empty text is all zero."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    chars = len(text)
    data = np.frombuffer(text.encode("utf-32-le"), "<u4")
    count = np.bincount(np.minimum(data, 255), minlength=256)
    letters_up, letters_low = count[65:91].sum(), count[97:123].sum()
    up = (letters_up + count[192:223].sum()) / max(1, letters_up + letters_low + count[192:255].sum())
    lengths = np.fromiter(map(len, words), np.int64, n)
    distinct: dict[str, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = text.split("\n")
    symbols = count[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 123, 125, 126]].sum()
    sample = len(text) - len(_VOWEL.sub("", text.lower()))
    return [
        np.log1p(n),
        lengths.mean(),
        lengths.std(),
        up,
        sum(w[0].isupper() for w in words) / n,
        count[33] / n,
        count[124] / n,
        symbols / n,
        count[48:58].sum() / chars,
        (count[46] + count[63]) / n,
        count[44] / n,
        len(_WORD_MARK.findall(text)) / n,
        len(distinct) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        (pairs + 1) / n,
        (lengths <= 3).mean(),
        sum(len(w) == 1 and not w.isalnum() for w in distinct) / n,
        1 - len(set(lines)) / len(lines),
        np.log1p(len(lines)),
        count[128:].sum() / chars,
        max(distinct.values()) / n,
        np.log1p(lengths.max()),
        sample / chars,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.02) -> float:
    """The share of positives among the unlabelled: the least ratio of the two tails above a score, over tails that are
    large enough for the ratio to be told from noise (the positives are the only ones in the best of them)."""
    p, u = np.sort(positive), np.sort(unlabelled)
    grid = np.quantile(p, np.linspace(0, 1 - least, 200))
    tail_p = 1 - np.searchsorted(p, grid, "left") / len(p)
    tail_u = 1 - np.searchsorted(u, grid, "left") / len(u)
    slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    at = np.argmin((tail_u + slack) / np.maximum(tail_p, 1e-9))
    return float(np.clip(tail_u[at] / tail_p[at], 0.05, 0.99))


def _train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, epochs: int, seed: int = SEED, hidden: int = HIDDEN) -> Model:
    """prior None: a plain positive-against-unlabelled classifier, for estimating it."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    d = p.shape[1]
    theta = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta], 0

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def back(x, weights):
        """Gradient of sum(weights * logit), and the logits."""
        w1, b1, w2, b2 = theta
        h = np.maximum(x @ w1 + b1, 0)

        def grad(g):
            gh = np.outer(g, w2) * (h > 0)
            return [x.T @ gh, gh.sum(0), h.T @ g, np.array([g.sum()])]

        return h @ w2 + b2, grad

    pu_batch, pp_batch = 512, 256
    for _ in range(epochs):
        iu, ip = rng.permutation(len(u)), rng.permutation(len(p))
        for k in range(0, len(u), pu_batch):
            xu = u[iu[k : k + pu_batch]]
            xp = p[np.take(ip, range(k // 2, k // 2 + pp_batch), mode="wrap")]
            zu, gu = back(xu, None)
            zp, gp = back(xp, None)
            su, sp = sigmoid(zu), sigmoid(zp)
            if prior is None:
                grads = [a + b for a, b in zip(gp((sp - 1) / len(xp)), gu(su / len(xu)), strict=True)]
            else:
                # Logistic losses: l+ = softplus(-z), l- = softplus(z).
                negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
                part = [a - b for a, b in zip(gu(su / len(xu)), gp(prior * sp / len(xp)), strict=True)]
                if negative >= 0:
                    grads = [a + b for a, b in zip(gp(prior * (sp - 1) / len(xp)), part, strict=True)]
                else:
                    grads = [-a for a in part]
            step += 1
            for i, g in enumerate(grads):
                g = g + 1e-4 * theta[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                theta[i] = theta[i] - 3e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, theta[0], theta[1], theta[2], float(theta[3][0]), prior or 0.0)


def fit(positive: np.ndarray, unlabelled: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Prior first, on halves that the plain classifier hasn't seen; then the classifier of least non-negative risk."""
    hp, hu = len(positive) // 2, len(unlabelled) // 2
    rough = _train(positive[:hp], unlabelled[:hu], None, max(4, epochs // 4))
    prior = class_prior(rough.logit(positive[hp:]), rough.logit(unlabelled[hu:]))
    return _train(positive, unlabelled, prior, epochs)


FEATURES = "doc_id long, x array<double>"
#: Rows of each kind without which no model is fitted.
LEAST = 10


def with_features(docs: DataFrame) -> DataFrame:
    bound_batches(docs.sparkSession)
    return map_columns(texts(docs, "doc_id"), FEATURES, lambda batches: ({"doc_id": b["doc_id"], "x": [features(t) for t in b["text"]]} for b in batches))


def fitted(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model of trusted good texts against the others, of any length; only their features reach the driver. None with fewer
    than LEAST trusted texts, or others."""
    good = labelled_ids(labels, "quality", 1, FIT_POSITIVE)
    positive = with_features(texts_of(docs, good)).collect()
    rest = with_features(hash_sample(docs.select("doc_id", "text"), FIT_UNLABELLED, good))
    unlabelled = rest.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(2 * FIT_UNLABELLED).collect()
    if len(positive) < LEAST or len(unlabelled) < LEAST:
        return None
    matrix = lambda rows: np.array([r.x for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.x))])
    rng = np.random.default_rng(SEED)
    p, u = matrix(positive), matrix(unlabelled)
    return fit(p[rng.permutation(len(p))], u[rng.permutation(len(u))])


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, or, with keep, the rows of docs predicted good as they are.

    Null texts count as empty ones and are scored like any other; equal texts score alike; with fewer than ten
    trusted texts, or others, every score is 0.5; an empty table gives an empty one.
    """
    model = fitted(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    score = scorer(docs, lambda batch: shared.value.score(np.array([features(t) for t in batch])).tolist() if shared.value else [0.5] * len(batch), keep)
    return finish(score, docs, threshold, keep, good=1)
