"""Toxicity by multiple-instance learning.

A sentence's score is a logistic function of the words in it, and a document's score is the
noisy-or of its sentences: 1 minus the product of (1 - score). Only documents have labels; the
sentence model is fitted through the noisy-or, so it learns which sentences offend, and they
can be located afterwards.

A sentence without weighted features has no part in either, nor has one that scores below
LEAST_SENTENCE in scoring, so length alone does not raise a score.

Defined results: null and empty texts score 0; texts of any length are scored whole; equal
texts score alike; without documents of both labels every score is 0; further columns pass
through, as scoring is a column expression.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansight.llm.common import trim
from plansight.llm.samples import labelled

#: Most training documents of each label; documents in which a feature must stand; z-score from which a feature gets a weight.
PER_CLASS, LEAST_DOCS, LEAST_Z = 2500, 3, 3.0
#: Score below which a sentence counts as clean, so that the many sentences of a long clean text do not add up.
LEAST_SENTENCE = 0.1
#: A word's features are itself and its beginnings of these lengths, so that inflected forms share weight.
BEGINNINGS = (3, 4, 5, 6)
#: Words whose weighted features a worker remembers; it forgets all when there are more.
REMEMBERED = 1 << 16
_TOKEN = re.compile(r"\w+|[.!?\n]+")


def sentences(text: str | None) -> Iterator[tuple[int, int, list[str]]]:
    """Start, end and lower-case words of each sentence that has a word."""
    start, end, words = 0, 0, []
    for m in _TOKEN.finditer(text or ""):
        token = m[0]
        if token[0] in ".!?\n":
            if words:
                yield start, m.end(), words
            words = []
        else:
            if not words:
                start = m.start()
            words.append(token.lower())
            end = m.end()
    if words:
        yield start, end, words


def word_features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


@dataclass
class SentenceModel:
    """Feature weights and the bias of the logistic sentence scores."""

    weights: dict[str, float]
    bias: float
    memory: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False, compare=False)

    def weighted(self, token: str) -> tuple[str, ...]:
        """The features of a word that have a weight."""
        found = self.memory.get(token)
        if found is None:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            found = tuple(f for f in word_features(token.lower()) if f in self.weights)
            if len(token) <= 64:
                self.memory[token] = found
        return found

    def sentence(self, held: set[str]) -> float:
        """The score of a sentence from its weighted features; it has none without any, or below LEAST_SENTENCE."""
        if not held or not math.isfinite(self.bias):
            return 0.0
        p = 1 / (1 + math.exp(-max(-700.0, self.bias + sum(self.weights[f] for f in held))))
        return p if p >= LEAST_SENTENCE else 0.0

    def sentence_scores(self, text: str | None) -> list[float]:
        """The scores above 0, in the order of the sentences."""
        weighted, out, held = self.weighted, [], set()
        for token in [*_TOKEN.findall(text or ""), "."]:
            if token[0] in ".!?\n":
                if held:
                    out.append(self.sentence(held))
                    held = set()
            else:
                held.update(weighted(token))
        return [p for p in out if p]

    def score(self, text: str | None) -> float:
        """The noisy-or of the sentence scores."""
        return _noisy_or(self.sentence_scores(text))

    def offending(self, text: str | None, least: float = 0.5) -> list[tuple[int, int, float]]:
        """Start, end and score of the sentences that score ``least`` or more."""
        found = ((start, end, self.sentence({f for w in words for f in self.weighted(w)})) for start, end, words in sentences(text))
        return [x for x in found if x[2] >= max(least, LEAST_SENTENCE)]

    def judged(self, text: str | None, least: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
        """Score and offending sentences; a text's sentences are located only if one offends."""
        scores = self.sentence_scores(text)
        return _noisy_or(scores), self.offending(text, least) if any(p >= least for p in scores) else []


def _noisy_or(scores: list[float]) -> float:
    return -math.expm1(sum(math.log1p(-min(p, 1 - 1e-16)) for p in scores)) if scores else 0.0


def fit(sample: pd.DataFrame, steps: int = 400, rate: float = 0.1, ridge: float = 2e-3) -> SentenceModel:
    """Fits the sentence model to (text, label, share) by gradient steps on the noisy-or likelihood."""
    y = sample["label"].to_numpy()
    if len(set(y.tolist())) < 2:
        return SentenceModel({}, -math.inf)
    seen = (Counter(), Counter())
    for label, text in zip(y, sample["text"], strict=True):
        words = {w for _, _, words in sentences(text) for w in words}
        seen[label].update({f for w in words for f in word_features(w)})
    totals = (max(1, int((y == 0).sum())), max(1, int((y == 1).sum())))
    chosen = []
    for word in seen[0].keys() | seen[1].keys():
        a, b = seen[1][word], seen[0][word]
        if a + b >= LEAST_DOCS:
            pool = (a + b) / (totals[0] + totals[1])
            z = (a / totals[1] - b / totals[0]) / math.sqrt(pool * (1 - pool) * (1 / totals[0] + 1 / totals[1]) + 1e-12)
            if z >= LEAST_Z or z <= -2 * LEAST_Z:
                chosen.append(word)
    index = {word: i for i, word in enumerate(sorted(chosen))}
    del seen
    rows, columns, doc_of = [], [], []
    for d, text in enumerate(sample["text"]):
        for _, _, words in sentences(text):
            found = [index[f] for f in {f for w in words for f in word_features(w)} if f in index]
            if found:
                rows += [len(doc_of)] * len(found)
                columns += found
                doc_of.append(d)
    rows, columns, doc_of = (np.array(x, np.int64) for x in (rows, columns, doc_of))
    share = sample["share"].to_numpy() / sample["share"].sum()
    w, bias = np.zeros(len(index) + 1), np.array([-6.0])
    w[-1] = bias[0]
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        s = w[-1] + np.bincount(rows, w[columns], minlength=len(doc_of))
        log_clean = -np.bincount(doc_of, np.logaddexp(0, s), minlength=len(sample))
        clean = np.exp(np.minimum(log_clean, -1e-12))
        pull = share * np.where(y == 1, -clean / (1 - clean), 1.0)
        p = 1 / (1 + np.exp(-np.clip(s, -500, 500)))
        at = pull[doc_of] * p
        grad = np.append(np.bincount(columns, at[rows], minlength=len(index)), at.sum())
        grad[:-1] += ridge * w[:-1] / max(1, len(index))
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return SentenceModel({word: float(w[i]) for word, i in index.items()}, float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "toxic") -> SentenceModel:
    """Fits on at most PER_CLASS documents of each label, of the rows that ``learn`` allows."""
    return fit(labelled(docs, labels, label, PER_CLASS, F.lit(True) if learn is None else learn))


def toxicity(model: SentenceModel, text: Column | str) -> Column:
    """The documents' scores. The model goes with the function; its size is bounded by the training sample."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([model.score(x) for x in batch], dtype="float64")
        trim()

    return score(text)


JUDGED = "struct<score:double,offending:array<struct<start:long,end:long,score:double>>>"


def judged(model: SentenceModel, text: Column | str, least: float = 0.5) -> Column:
    """The documents' scores and their offending sentences, in code points, by one pass over the texts."""

    @F.pandas_udf(JUDGED)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [model.judged(x, least) for x in batch]
            located = [[{"start": a, "end": b, "score": p} for a, b, p in sentences] for _, sentences in found]
            yield pd.DataFrame({"score": pd.Series([score for score, _ in found], dtype="float64"), "offending": pd.Series(located, dtype=object)})
        trim()

    return judge(text)
