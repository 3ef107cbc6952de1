"""Line labelling by a linear-chain conditional random field.

Every line that holds a word is content or boilerplate. Two-state Viterbi decoding of a trained
chain marks the lines, and a document is kept if content lines hold enough of its words. There
are no labelled lines, so the chain is trained on a bounded sample of documents whose lines
plain rules mark (symbols, shouting, separators, repeats); the chain then weighs these signs
together with a line's neighbours.

Defined results: a null text is empty; a text without words has no lines and is not kept; a
text of any length is read whole; equal texts are judged alike; without a sample the chain has
its starting weights, which mark by the rules' signs; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansight.llm.common import packed, trim
from plansight.llm.samples import texts_of
from plansight.llm.textstats import Lines, measure

#: Most training documents; share of words in content lines from which a document is kept; fewest words; most repeated words of 100.
SAMPLE, CONTENT_SHARE, LEAST_WORDS, MOST_REPEATED = 2000, 0.5, 50, 50
CONTENT, BOILERPLATE = 0, 1


def line_features(lines: Lines) -> np.ndarray:
    """0/1 signs of each line, the last one always 1."""
    words, letters = np.maximum(lines.words, 1), np.maximum(lines.letters, 1)
    upper, symbols, pipes, bangs = lines.upper / letters, lines.symbols / words, lines.pipes / words, lines.bangs / words
    digits, plain = lines.digits / np.maximum(lines.chars, 1), lines.letters / np.maximum(lines.chars, 1)
    signs = [
        symbols > 0.1, symbols > 0.5, symbols > 1.5, pipes > 0.1, pipes > 0.3, bangs > 0.2, bangs > 0.6, upper > 0.3, upper > 0.7, lines.repeated,
        lines.distinct < 0.5 * words, lines.distinct < 0.8 * words, digits > 0.3, plain < 0.5, words < 3, words < 8, words > 30, lines.stopped, np.ones(len(words), bool),
    ]
    return np.array(signs, dtype=np.float64).T.reshape(len(words), len(signs))


def rule_marks(lines: Lines) -> np.ndarray:
    """The sample's labels: a line with an outright sign of boilerplate."""
    words, letters = np.maximum(lines.words, 1), np.maximum(lines.letters, 1)
    shouting = (lines.upper > 0.7 * letters) & (lines.letters >= 8)
    return ((lines.symbols > 0.5 * words) | (lines.pipes > 0.2 * words) | (lines.bangs > 0.6 * words) | shouting | (lines.repeated & (lines.words >= 3)) | (lines.distinct < 0.3 * words)).astype(int)


@dataclass
class Chain:
    """Emission weights (signs x 2) and transition weights (from x to)."""

    emit: np.ndarray
    move: np.ndarray

    def decode(self, rows: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        """Viterbi marks of all lines, of many documents side by side; ``owner`` ascends."""
        scores = rows @ self.emit
        starts = np.searchsorted(owner, np.arange(texts))
        lengths = np.diff(np.append(starts, len(owner)))
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        marks = np.zeros(len(owner), int)
        if not len(owner):
            return marks
        back = np.zeros((len(owner), 2), np.int8)
        best = np.zeros((texts, 2))
        active = texts
        for t in range(lengths[0]):
            active = int(np.searchsorted(-lengths, -t, side="left"))  # documents longer than t lines
            at = starts[:active] + t
            if t == 0:
                best[:active] = scores[at]
                continue
            ways = best[:active, :, None] + self.move[None]
            back[at] = ways.argmax(1)
            best[:active] = ways.max(1) + scores[at]
        state = best.argmax(1)
        for t in range(lengths[0] - 1, -1, -1):
            active = int(np.searchsorted(-lengths, -t, side="left"))
            at = starts[:active] + t
            marks[at] = state[:active]
            state[:active] = np.where(t > 0, back[at, state[:active]], state[:active])
        return marks


def start() -> Chain:
    width = 19
    emit = np.zeros((width, 2))
    emit[[1, 4, 6, 8, 9], BOILERPLATE] = 4.0
    emit[-1, CONTENT] = 2.0
    return Chain(emit, np.array([[0.5, -0.5], [-0.5, 0.5]]))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def fit(texts: list[str], steps: int = 150, rate: float = 0.1, ridge: float = 1e-3, longest: int = 400) -> Chain:
    """Maximum likelihood by forward-backward over the sample's documents, their lines in runs of at most ``longest``."""
    runs = []
    for _, data, bounds in packed(texts):
        _, lines = measure(data, bounds)
        rows, marks = line_features(lines), rule_marks(lines)
        edges = np.searchsorted(lines.owner, np.arange(len(bounds)))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            runs += [(rows[k : min(k + longest, b)], marks[k : min(k + longest, b)]) for k in range(a, b, longest)]
    chain = start()
    if not runs:
        return chain
    runs.sort(key=lambda x: -len(x[1]))
    lengths = np.array([len(m) for _, m in runs])
    rows, marks = np.concatenate([r for r, _ in runs]), np.concatenate([m for _, m in runs])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    active = [int((lengths > t).sum()) for t in range(lengths[0])]
    truth = np.zeros_like(chain.move)
    inner = np.ones(len(marks), bool)
    inner[starts] = False
    np.add.at(truth, (marks[np.flatnonzero(inner) - 1], marks[inner]), 1)
    gold = np.eye(2)[marks]
    first, second = [np.zeros_like(x) for x in (chain.emit, chain.move)], [np.zeros_like(x) for x in (chain.emit, chain.move)]
    for step in range(1, steps + 1):
        scores = rows @ chain.emit
        ahead, behind, moved = np.zeros_like(scores), np.zeros_like(scores), np.zeros((2, 2))
        for t, n in enumerate(active):
            at = starts[:n] + t
            ahead[at] = scores[at] if t == 0 else scores[at] + _log_sum(ahead[at - 1][:, :, None] + chain.move, 1)
        total = _log_sum(ahead[starts + lengths - 1], 1)
        for t in range(len(active) - 2, -1, -1):
            at = starts[: active[t + 1]] + t
            into = chain.move + (scores[at + 1] + behind[at + 1])[:, None, :]
            behind[at] = _log_sum(into, 2)
            moved += np.exp(ahead[at][:, :, None] + into - total[: active[t + 1], None, None]).sum(0)
        each = np.exp(ahead + behind - np.repeat(total, lengths)[:, None])
        grads = [rows.T @ (each - gold) / len(marks) + ridge * chain.emit, (moved - truth) / len(marks) + ridge * chain.move]
        for i, (w, g) in enumerate(zip((chain.emit, chain.move), grads, strict=True)):
            first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.99 * second[i] + 0.01 * g**2
            w -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-9)
    return chain


def train(docs: DataFrame) -> Chain:
    """Fits on at most SAMPLE documents, chosen by a hash of the id."""
    chosen = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("doc_id").alias("place")).orderBy("place", "doc_id").limit(SAMPLE).distinct()
    return fit(texts_of(docs, chosen)["text"].tolist())


VERDICT = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,content_words:long,content_lines:long,lines:long,base_failed:boolean,kept:boolean>"


def judge(chain: Chain, data: np.ndarray, bounds: np.ndarray) -> pd.DataFrame:
    texts, lines = measure(data, bounds)
    count = len(bounds) - 1
    content = chain.decode(line_features(lines), lines.owner, count) == CONTENT
    content_words = np.bincount(lines.owner, lines.words * content, minlength=count).astype(np.int64)
    failed = (texts.words < LEAST_WORDS) | (100 * texts.repeat_words > MOST_REPEATED * texts.words)
    return pd.DataFrame({
        "n_words": texts.words, "word_chars": texts.word_chars, "n_symbols": texts.symbols, "n_dup_lines": texts.dup_lines, "n_repeat_words": texts.repeat_words,
        "content_words": content_words, "content_lines": np.bincount(lines.owner[content], minlength=count), "lines": np.bincount(lines.owner, minlength=count),
        "base_failed": failed, "kept": ~failed & (content_words >= CONTENT_SHARE * texts.words) & (texts.words > 0),
    })


def verdict(chain: Chain, text: Column | str) -> Column:
    """A struct of a document's counts and whether it is kept."""

    @F.pandas_udf(VERDICT)
    def decide(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [judge(chain, data, bounds) for _, data, bounds in packed(batch)]
            yield pd.concat(parts, ignore_index=True) if parts else judge(chain, np.zeros(0, np.uint8), np.zeros(1, np.int64))
        trim()

    return decide(text)
