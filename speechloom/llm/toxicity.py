"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two words sums, over every sequence of three characters that both hold with gaps, decay ** (span in one +
span in the other), for spans up to SPAN; it is normalised. Gaps let a word with inserted characters stay close to the
plain one, and padding marks let beginnings count. The machine is a squared-hinge linear one in the Nystroem space of the
landmark words; as that kernel has explicit features (character triples), its decision folds into one weight a triple.

It is trained on labelled sentences by a multiple-instance rule. Labels are of texts: sentences of clean texts are clean,
and of the sentences of toxic texts that no clean one holds, those are toxic which the words found so far convict. First
come words that stand in toxic texts' sentences and in none of clean ones as often as chance would never have it; then, in
rounds, the machine is fitted, sentences are labelled anew by it, and words of toxic ones that it is sure of join the
positive examples, clean words that look worst the negative ones. A sentence, and a text, weighs the sum of what its words
weigh (the machine's decision on each, held to 0..1), calibrated on whole labelled texts; so one stray word that looks like
an insult isn't enough where texts that hold one are labelled clean.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from speechloom.llm.common import Bounded
from speechloom.llm.labelled import finish, fitting, labelled_ids, scorer, texts_of

DECAY, SPAN, LANDMARKS = 0.6, 7, 500
#: What an example inside the margin costs.
COST = 5.0
#: A word in this share of the sentences of the strongest witness is one too.
STRONG = 0.04
#: A witness leans at least so far towards toxic sentences.
LEANING = 10
#: A sentence of a toxic text is toxic where its words weigh so much together.
CONVICTED = 0.5
#: The fit reads at most this many labelled texts of each kind, out of those no longer than FIT_CHARS.
FIT_TOXIC, FIT_CLEAN, FIT_CHARS = 2500, 5000, 20_000
#: Words longer than this are read in windows that overlap by half.
LONG = 32
#: Distinct words each Python worker keeps.
WORDS_KEPT = 900_000
LETTERS = 96

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_MARKS = "'\"`.,;:!?|()[]{}<>*&%$#/\\-_~+=@^«»“”„‘’…–—¿¡"
_INNER = re.compile(r"[\W_]+")
_SPELT = re.compile(r"(?<!\S)(?:[^\W\d_][^\w\s]?\s){2,}[^\W\d_](?=[^\w\s]?(?:\s|$))")
_CODE = np.array([(c - 96 if 97 <= c <= 122 else c - 64 if 65 <= c <= 90 else 27 + c - 48 if 48 <= c <= 57 else 37) for c in range(128)], np.int64)


def units(text: str) -> set[str]:
    """The distinct words of a text in lower case without marks around them; those with marks inside also without these;
    runs of letters spelt one by one also joined."""
    low = text.lower()
    found = {w.strip(_MARKS) for w in low.split()}
    found.discard("")
    found |= {_INNER.sub("", w) for w in found if not w.isalnum()}
    if _SPELT.search(low):
        found |= {_INNER.sub("", m[0]) for m in _SPELT.finditer(low)}
    return found


def windows(word: str) -> list[str]:
    word = _EDGES.sub("", word)
    if len(word) <= LONG:
        return [word] if word else []
    return [word[i : i + LONG] for i in range(0, len(word) - LONG // 2, LONG // 2)]


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all words with two marks in front and one behind, and the word each belongs to."""
    data = np.frombuffer("".join(f"\0\0{w}\0" for w in words).encode("utf-32-le"), "<u4").astype(np.int64)
    lengths = np.fromiter((len(w) + 3 for w in words), np.int64, len(words))
    letter = np.where(data < 128, _CODE[np.minimum(data, 127)], 40 + data % (LETTERS - 40))
    letter[data == 0] = 0
    return letter, np.repeat(np.arange(len(words)), lengths)


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kernel's explicit features: (word, triple, weight), each triple of a word once, normalised to length one."""
    letter, owner = codes(words)
    n, keys, weights = len(letter), [], []
    for span in range(3, SPAN + 1):
        last = span - 1
        if n <= last:
            break
        same = np.flatnonzero(owner[: n - last] == owner[last:])
        for mid in range(1, last):
            keys.append(((owner[same] * LETTERS + letter[same]) * LETTERS + letter[same + mid]) * LETTERS + letter[same + last])
            weights.append(np.full(len(same), DECAY ** (span - 3)))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key, weight = key[first], np.add.reduceat(weight, first)
    word, triple = np.divmod(key, LETTERS**3)
    norm = np.sqrt(np.bincount(word, weight * weight, len(words)))
    return word, triple, weight / norm[word]


@dataclass
class Model:
    """Decision weights by triple, the intercept, and the text-level calibration."""

    weights: np.ndarray
    bias: float
    slope: float = 4.0
    shift: float = -2.0

    def name(self) -> str:
        return hashlib.sha1(self.weights.tobytes() + repr((self.bias, self.slope, self.shift)).encode()).hexdigest()

    def decide(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias)
        for k in range(0, len(words), 4000):
            part = words[k : k + 4000]
            word, triple, value = triples(part)
            out[k : k + len(part)] += np.bincount(word, value * self.weights[triple], len(part))
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.shift, -40, 40)))


def dense(words: list[str], landmarks: list[str], whiten: np.ndarray | None = None) -> np.ndarray:
    """Kernel matrix between words and landmarks, times whiten where given, a few words at a time."""
    lw, lt, lv = triples(landmarks)
    used, column = np.unique(lt, return_inverse=True)
    table = np.zeros((len(used), len(landmarks)), np.float32)
    table[column, lw] = lv
    out = np.zeros((len(words), len(landmarks) if whiten is None else whiten.shape[1]))
    for k in range(0, len(words), 100):
        part = words[k : k + 100]
        w, t, v = triples(part)
        at = np.minimum(np.searchsorted(used, t), len(used) - 1)
        hit = used[at] == t
        rows = np.zeros((len(part), len(used)), np.float32)
        rows[w[hit], at[hit]] = v[hit]
        near = rows @ table
        out[k : k + len(part)] = near if whiten is None else near.astype(float) @ whiten
    return out


def train_words(positive: list[str], negative: list[str], hard: list[str]) -> Model:
    """Landmarks (of either kind, the hard ones first), whitening, then a squared-hinge machine by Newton steps on the
    active examples."""
    part = LANDMARKS // 4
    rng = np.random.default_rng(10)
    pick = lambda xs, n: [xs[i] for i in sorted(rng.permutation(len(xs))[:n])]
    landmarks = sorted({*pick(positive, 2 * part), *hard[:part], *pick(negative, part)})
    values, vectors = np.linalg.eigh(dense(landmarks, landmarks))
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    x = dense(positive + negative, landmarks, whiten)
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    cost = np.where(y > 0, COST * min(20.0, max(1, len(negative)) / len(positive)), COST)
    size = x.shape[1] + 1
    ridge = np.eye(size)
    ridge[-1, -1] = 1e-6
    theta = np.zeros(size)
    for _ in range(50):
        active = np.flatnonzero(y * (x @ theta[:-1] + theta[-1]) < 1)
        left, right = ridge.copy(), np.zeros(size)
        for k in range(0, len(active), 1000):
            part = active[k : k + 1000]
            a, c = np.c_[x[part], np.ones(len(part))], cost[part]
            left += a.T @ (a * c[:, None])
            right += a.T @ (c * y[part])
        new = np.linalg.solve(left, right)
        if np.abs(new - theta).max() < 1e-9:
            break
        theta = new
    beta = whiten @ theta[:-1]
    w, t, v = triples(landmarks)
    weights = np.bincount(t, v * beta[w], LETTERS**3)
    return Model(weights.astype(np.float32), float(theta[-1]))


def labelled_sentences(texts: list[str], toxic: list[int]) -> tuple[dict[str, list[int]], set[str]]:
    """Toxic sentences with the texts they stand in, and clean ones. A sentence that a clean text holds too is clean."""
    clean = {s for t, y in zip(texts, toxic, strict=True) if not y for s in _SENTENCE.split(t)}
    bad: dict[str, list[int]] = {}
    for i, (t, y) in enumerate(zip(texts, toxic, strict=True)):
        for s in set(_SENTENCE.split(t)) - clean if y else ():
            bad.setdefault(s, []).append(i)
    return bad, clean


def word_counts(sentences) -> Counter:
    """In how many different sentences each word stands, however often these are copied."""
    counted: Counter = Counter()
    for s in sentences:
        counted.update({p for w in units(s) for p in windows(w)})
    return counted


def leaning(clean: Counter, sentences: Counter) -> dict[str, float]:
    """How many times more often a word stands in toxic sentences than in clean ones, all words taken together as 1."""
    ratio = sum(sentences.values()) / max(1, sum(clean.values()))
    return {w: n / (clean[w] + 0.5) / ratio for w, n in sentences.items()}


def witnesses(bad: dict[str, list[int]], clean: Counter, sentences: Counter) -> list[str]:
    """The words that explain the toxic labels: greedily the one that covers the most toxic texts without a witness yet, of
    those that clean sentences hardly hold. Words that are merely rare add no text to those the insults explain. A word
    counts from so many sentences on that not one of the vocabulary would stand in as many toxic ones, and no clean one, by chance."""
    share = sum(sentences.values()) / max(1, sum(sentences.values()) + sum(clean.values()))
    least = max(3, math.ceil(math.log(max(2, len(sentences) + len(clean))) / -math.log(min(0.9, max(1e-6, share)))))
    lean = leaning(clean, sentences)
    pure: dict[str, set[int]] = {w: set() for w, n in sentences.items() if len(w) > 2 and n >= least and lean[w] >= LEANING}
    for s, held in bad.items():
        for w in {p for u in units(s) for p in windows(u)}.intersection(pure):
            pure[w].update(held)
    out, covered = [], set()
    heap = [(-len(x), w) for w, x in pure.items()]
    heapq.heapify(heap)
    while heap:
        gain, w = heapq.heappop(heap)
        now = len(pure[w] - covered)
        if now < least:
            continue
        if now < -gain:
            heapq.heappush(heap, (-now, w))
            continue
        out.append(w)
        covered |= pure[w]
    most = max((sentences[w] for w in out), default=0)
    return sorted({*out, *(w for w in pure if sentences[w] >= max(least, STRONG * most))})


def disguised(word: str, rng: np.random.Generator) -> list[str]:
    """Forms of an insult with a character put in, doubled or swapped for a gap, as further positive examples."""
    if len(word) < 4:
        return []
    out = []
    for at in rng.permutation(len(word) - 1)[:3] + 1:
        put = "abcdefghijklmnopqrstuvwxyz0123456789"[rng.integers(36)]
        out += [word[:at] + put + word[at:], word[:at] + word[at - 1] + word[at:]]
    return out


def fit(texts: list[str], toxic: list[int]) -> Model | None:
    """None where there are no examples of both kinds."""
    if not any(toxic) or all(toxic):
        return None
    bad, clean_sentences = labelled_sentences(texts, toxic)
    clean, sentences = word_counts(clean_sentences), word_counts(bad)
    # With too few labelled texts for witnesses, the few words that lean most towards toxic ones.
    positive = sorted(witnesses(bad, clean, sentences) or sorted(sentences, key=lambda w: (clean[w], -sentences[w], w))[:5])
    bags = [sorted({p for u in units(t) for p in windows(u)}) for t in sorted(bad)]
    del bad, clean_sentences
    lean = leaning(clean, sentences)
    doubtful = {w for w in sentences if lean[w] >= 6}
    words = sorted(set(clean) - set(positive) - doubtful)
    rng = np.random.default_rng(11)
    common = {w for w, _ in clean.most_common(1500)} - set(positive) - doubtful
    negative = sorted(common | {words[i] for i in rng.permutation(len(words))[:3000]})
    pool = sorted(common | {words[i] for i in rng.permutation(len(words))[:60_000]})
    positive = sorted({*positive, *(v for w in positive for v in disguised(w, rng))})
    model = train_words(positive, negative, [])
    held = sorted(sentences)
    for _ in range(3):
        # Clean words that look worst, and words of sentences that are toxic by now which look surely so, join the examples.
        decided = model.decide(pool)
        hard = [pool[i] for i in np.argsort(-decided, kind="stable")[:1000]]
        value = dict(zip(held, model.decide(held).tolist(), strict=True))
        toxic_bags = [ws for ws in bags if sum(min(1.0, max(0.0, value[w])) for w in ws) >= CONVICTED]
        more = {w for ws in toxic_bags for w in ws if value[w] > 0.6 and lean[w] >= LEANING and len(w) > 2}
        positive, negative = sorted({*positive, *more}), sorted({*negative, *hard} - more)
        model = train_words(positive, negative, hard)
    calibrate(model, evidence(texts, model), np.array(toxic))
    return model


def evidence(texts: list[str], model: Model) -> np.ndarray:
    """What the words of each text weigh together; 0 without words."""
    cache = Bounded(50_000, lambda ws: weigh_units(ws, model))
    out = []
    for t in texts:
        u = units(t)
        known = cache.view(u)
        out.append(sum(map(known.__getitem__, u)))
    return np.array(out, float)


def weigh_units(found: list[str], model: Model) -> list[float]:
    """The machine's decision on each word (a long one's worst window), held to 0..1."""
    parts = [windows(u) for u in found]
    flat = [p for ps in parts for p in ps]
    values = iter(np.clip(model.decide(flat), 0, 1).tolist() if flat else ())
    return [max((next(values) for _ in ps), default=0.0) for ps in parts]


def calibrate(model: Model, weighed: np.ndarray, toxic: np.ndarray) -> None:
    """Logistic fit of label on evidence with equal weight for both kinds, lightly ridged."""
    x, y = np.c_[weighed, np.ones(len(weighed))], toxic.astype(float)
    c = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)
    theta = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        grad = x.T @ (c * (p - y)) + np.array([0.5, 0.0]) * theta
        hess = (x * (c * p * (1 - p))[:, None]).T @ x + np.diag([0.5, 1e-6])
        theta = theta - np.linalg.solve(hess, grad)
    model.slope, model.shift = (float(t) for t in theta)


def fitted(docs: DataFrame, labels: DataFrame) -> Model | None:
    parts = [(y, texts_of(docs, labelled_ids(labels, "toxic", y, n, fitting(docs, FIT_CHARS)), FIT_CHARS)) for y, n in ((1, FIT_TOXIC), (0, FIT_CLEAN))]
    rows = sorted((r.doc_id, r.text, y) for y, df in parts for r in df.collect())
    return fit([t for _, t, _ in rows], [y for _, _, y in rows])


_CACHE: dict[str, Bounded] = {}


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, or, with keep, the rows of docs not predicted toxic as they are.

    A text without words (null, empty, marks only) scores as one without any sign of toxicity; equal texts score alike;
    without labels of both kinds every score is 0; an empty table gives an empty one.
    """
    fit_model = fitted(docs, labels)
    name = fit_model and fit_model.name()
    shared = docs.sparkSession.sparkContext.broadcast(fit_model)

    def score(batch: list[str]) -> list[float]:
        model = shared.value
        if model is None:
            return [0.0] * len(batch)
        if name not in _CACHE:
            _CACHE.clear()
            _CACHE[name] = Bounded(WORDS_KEPT, lambda found: weigh_units(found, model))
        found = [units(t) for t in batch]
        known = _CACHE[name].view(set().union(*found))
        return model.score(np.array([sum(map(known.__getitem__, u)) for u in found], float)).tolist()

    return finish(scorer(docs, score, keep), docs, threshold, keep, good=0)
