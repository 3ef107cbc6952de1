"""Quality by Bradley-Terry ranking.

A document's strength is linear in its features. It is learnt from preference pairs (a good
document against a poor one) by logistic loss on the difference of their features. All labelled
documents take part: they are dealt into groups, and all pairs within a group count. The strength
at the quantile that separates the poor share of the training rows is the threshold, and the
score is a logistic function of the strength that takes the value 0.3 there.

Defined results: null and empty texts have the features of no words and are scored like any
text; texts of any length are read whole; equal texts score alike; without documents of both
labels every score is 0.5; further columns pass through, as scoring is a column expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansight.llm.common import Scratch, packed, trim
from plansight.llm.textstats import measure

#: Documents of the rarer label that one of the other meets in pairs, about; score at the threshold.
GROUP, AT_THRESHOLD = 64, 0.3
#: Labels up to which their table is broadcast; bins of a count for the threshold.
BROADCAST_ROWS, BINS = 1_000_000, 4096


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of features for each text."""
    texts, lines = measure(data, bounds)
    count = len(bounds) - 1
    total = lambda x: np.bincount(lines.owner, x, minlength=count)
    words = np.maximum(texts.words, 1)
    letters = np.maximum(total(lines.letters), 1)
    upper, per_word = total(lines.upper) / letters, texts.word_chars / words
    expected = np.minimum(1.0, 3.0 / np.log(words + 19.0))  # share of distinct words falls with length
    shares = [
        texts.symbols / words, total(lines.pipes) / words, total(lines.bangs) / words, upper, texts.dup_lines / np.maximum(total(np.ones(len(lines.owner))), 1),
        texts.repeat_words / words, np.maximum(0, expected - texts.distinct / words), total(lines.digits) / np.maximum(texts.word_chars, 1),
        np.maximum(0, per_word - 8) / 8, np.maximum(0, 4 - per_word) / 4,
        1 - letters / np.maximum(texts.word_chars, 1),
    ]
    shares = np.clip(np.array(shares, float).T, 0, 4)
    few = [texts.words == 0, np.maximum(0, 20 - texts.words) / 20]
    return np.column_stack([np.sqrt(shares), shares > 0.3, *few]).astype(float)


#: Features of a text.
WIDTH = features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]


@dataclass
class Ranking:
    """Strength of a feature row, its threshold and the scale of the score."""

    weights: np.ndarray
    threshold: float
    scale: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        strength = rows @ self.weights
        shifted = self.scale * (strength - self.threshold) + math.log(AT_THRESHOLD / (1 - AT_THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(shifted, -500, 500)))


def _pair_sums(good: np.ndarray, poor: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Over all pairs of a good and a poor row: loss, gradient, second derivatives and number of pairs, in one array."""
    margin = (good @ w)[:, None] - (poor @ w)[None, :]
    wrong = 1 / (1 + np.exp(np.clip(margin, -500, 500)))  # chance given to the wrong order
    curve = wrong * (1 - wrong)
    grad = poor.T @ wrong.sum(0) - good.T @ wrong.sum(1)
    across = good.T @ (curve @ poor)
    second = (good * curve.sum(1)[:, None]).T @ good + (poor * curve.sum(0)[:, None]).T @ poor - across - across.T
    return np.concatenate([[np.logaddexp(0, -margin).sum()], grad, second.ravel(), [margin.size]])


def _solve(sums: Callable[[np.ndarray], np.ndarray], width: int, steps: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """The weights of the least mean loss, by Newton's steps, halved where they go too far. ``sums`` gives _pair_sums of all pairs."""
    w, at, least, step = np.zeros(width), np.zeros(width), math.inf, np.zeros(width)
    for _ in range(steps):
        got = sums(w)
        got = got / got[-1]
        loss, grad, second = got[0] + ridge / 2 * w @ w, got[1 : 1 + width] + ridge * w, got[1 + width : -1].reshape(width, width)
        if loss > least + 1e-12:
            step = step / 2
        else:
            at, least = w, loss
            step = np.linalg.solve(second + ridge * np.eye(width), grad)
        if np.abs(step).max() < 1e-7:
            break
        w = at - step
    return np.round(at, 9)  # sums in another order give the same weights


def fit(sample: pd.DataFrame) -> Ranking:
    """Fits to (text, label, share) held in memory."""
    rows = np.concatenate([features(data, bounds) for _, data, bounds in packed(sample["text"])]) if len(sample) else np.zeros((0, 1))
    y = sample["label"].to_numpy()
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(poor):
        return _unlearnt()
    w = _solve(lambda w: _pair_sums(rows[good], rows[poor], w), rows.shape[1])
    strength, share = rows @ w, sample["share"].to_numpy()
    order = np.argsort(strength, kind="stable")
    reached = np.cumsum(share[order]) / share.sum()
    cut = min(int(np.searchsorted(reached, share[poor].sum() / share.sum())), len(order) - 1)
    # between the last strength of the poor share and the next one above it
    above = min(cut + 1, len(order) - 1)
    threshold = float((strength[order[cut]] + strength[order[above]]) / 2)
    return Ranking(w, threshold, 1.0)


def _unlearnt() -> Ranking:
    return Ranking(np.zeros(WIDTH), 0.0, 0.0 if AT_THRESHOLD == 0.5 else math.nan)


def _measured(text: str) -> Column:
    @F.pandas_udf("binary")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([row.tobytes() for _, data, bounds in packed(batch) for row in features(data, bounds)], dtype=object)
        trim()

    return measured(text)


def _rows(held: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(held), float).reshape(-1, WIDTH)


def _learnt(docs: DataFrame, labels: DataFrame, learn: Column, label: str) -> DataFrame:
    """(label, place, features) of every document with a label 0 or 1 that ``learn`` allows. Texts are not shuffled."""
    usable = labels.filter(learn & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    docs = docs.select("doc_id", "text")
    if usable.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rows = docs.join(F.broadcast(usable), "doc_id").select("doc_id", "label", _measured("text").alias("features"))
    else:
        rows = docs.select("doc_id", _measured("text").alias("features")).join(usable, "doc_id")
    return rows.select("label", F.xxhash64("doc_id").alias("place"), "features")


def _grouped(learnt: DataFrame, counts: dict[int, int]) -> DataFrame:
    """(labels, features) of groups in which each document of the commoner label meets about GROUP of the other.

    Groups are dealt by hashes of the ids. Every document is in one; those of the rarer label are
    repeated in the parts of their group, so that no part grows with the labels' ratio.
    """
    rare = min(counts, key=lambda x: (counts[x], x))
    few, many = counts[rare], counts[1 - rare]
    groups, parts = max(1, few // GROUP), max(1, math.ceil(many / few / GROUP))
    own = F.array(F.pmod(F.shiftrightunsigned("place", 32), F.lit(parts)))
    part = F.when(F.col("label") == rare, F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).otherwise(own)
    dealt = learnt.withColumn("group", F.pmod("place", F.lit(groups))).withColumn("part", F.explode(part))
    held = dealt.groupBy("group", "part").agg(F.sort_array(F.collect_list(F.struct("place", "label", "features"))).alias("held"))
    return held.select("held.label", "held.features")


def _all_sums(grouped: DataFrame, w: np.ndarray) -> np.ndarray:
    """The sums of _pair_sums over all groups."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + len(w) + len(w) ** 2)
        for batch in batches:
            for label, held in zip(batch.column("label"), batch.column("features"), strict=True):
                y, rows = np.array(label.as_py()), _rows(held.as_py())
                total += _pair_sums(rows[y == 1], rows[y == 0], w)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})
        trim()

    return sum(np.frombuffer(r["sums"], float) for r in grouped.mapInArrow(add, "sums binary").collect())


def kth(values: DataFrame, k: int) -> tuple[float, float]:
    """The ``k``-th smallest ``value``, counted from 1, and the next one, by counts in ever narrower bins."""
    v, before = F.col("value"), 0
    low, high = values.agg(F.min(v), F.max(v)).first()
    while low < high:
        inside = values.filter((v >= low) & (v <= high)).groupBy(F.floor((v - low) / (high - low) * BINS).alias("bin"))
        for row in inside.agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).orderBy("bin").collect():
            if before + row["n"] >= k:
                break
            before += row["n"]
        low, high = row["low"], row["high"]
    upto, above = values.agg(F.count_if(v <= low), F.min(F.when(v > low, v))).first()
    return low, low if upto > k or above is None else above


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "quality") -> Ranking:
    """Fits on all labelled documents of the rows that ``learn`` allows; rows of one id count each by its own text."""
    scratch = Scratch(docs.sparkSession, "quality")
    learnt = scratch.save(_learnt(docs, labels, F.lit(True) if learn is None else learn, label), "learnt")
    counts = {0: 0, 1: 0} | {r["label"]: r["count"] for r in learnt.groupBy("label").count().collect()}
    if not min(counts.values()):
        scratch.drop("learnt")
        return _unlearnt()
    grouped = scratch.save(_grouped(learnt, counts), "grouped")
    w = _solve(lambda w: _all_sums(grouped, w), WIDTH)

    @F.pandas_udf("double")
    def strength(held: pd.Series) -> pd.Series:
        return pd.Series(_rows(held) @ w)

    values = scratch.save(learnt.select(strength("features").alias("value")), "strengths")
    # between the last strength of the poor share and the next one above it
    threshold = sum(kth(values, counts[0])) / 2
    scratch.drop("learnt", "grouped", "strengths")
    return Ranking(w, threshold, 1.0)


def quality(model: Ranking, text: Column | str) -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parts = [model.score(features(data, bounds)) for _, data, bounds in packed(batch)]
            yield pd.Series(np.nan_to_num(np.concatenate(parts), nan=0.5) if parts else [], dtype="float64")
        trim()

    return score(text)
