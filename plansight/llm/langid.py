"""Language identification by a string kernel.

The kernel of two texts is the number of n-grams (1 to 3 characters) that both hold, over the
root of the product of their numbers of n-grams. Its Nystroem approximation by landmark texts
gives features, on which one ridge regression per language is fitted, one against the rest.
Texts are scored in batches: the 0/1 matrix of the landmarks' n-grams in the texts, times the
landmarks' presence matrix with the regressions folded in.

N-grams are over lower-case characters, with white space as one and digits as one. An n-gram's
code is a hash of its characters, so scripts of any size keep theirs apart.

Defined results: a null text, or one without a letter, is ``und`` with score 0; short texts
need one letter; texts of any length are read whole; without labelled rows every text is
``und``; ties go to the language first by code point; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansight.llm.common import trim
from plansight.llm.samples import texts_of

#: Most training texts of a language and of all; landmarks; bits of an n-gram's code; ridge.
PER_LANGUAGE, IN_ALL, LANDMARKS, CODE_BITS, RIDGE = 500, 4000, 200, 18, 1e-3
CODES = 1 << CODE_BITS
#: Odd multipliers that turn a character's place in an n-gram into its part of the code.
_TIMES = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def _folded() -> np.ndarray:
    """Every code point as itself, but all white space as a blank and all digits as 0."""
    out = np.arange(0x110000, dtype=np.uint32)
    for code in range(0x20000):
        if chr(code).isspace():
            out[code] = 32
        elif chr(code).isdigit():
            out[code] = 48
    return out


_FOLDED = _folded()


def ngrams(text: str) -> np.ndarray:
    """Hashed codes of the 1-, 2- and 3-grams, with repeats."""
    one = _FOLDED[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)] + np.uint32(1)
    parts = [one * np.uint32(m) for m in _TIMES]
    two = parts[1][:-1] + np.bitwise_xor(parts[0][1:], np.uint32(0x5BD1E995))
    three = two[:-1] * np.uint32(0x2C1B3C6D) + parts[2][2:]
    codes = np.concatenate([parts[0], two * np.uint32(0x297A2D39), three])
    return (codes ^ (codes >> np.uint32(15))) * np.uint32(0x846CA68B) >> np.uint32(32 - CODE_BITS)


@dataclass
class KernelModel:
    """The codes of the landmarks' n-grams, their weights per language, and the languages."""

    codes: np.ndarray
    weights: np.ndarray
    languages: list[str]

    def predict(self, texts: list[str | None], batch: int = 256) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        usable = [i for i, x in enumerate(texts) if x and any(c.isalpha() for c in x)]
        for first in range(0, len(usable), batch):
            chosen = usable[first : first + batch]
            present, sizes = presence([texts[i] for i in chosen], self.codes)
            values = (present @ self.weights) / np.sqrt(sizes)[:, None]
            best = values.argmax(1)
            spread = np.exp(np.clip(6 * (values - values.max(1, keepdims=True)), -50, 0))
            for k, i in enumerate(chosen):
                names[i] = self.languages[best[k]]
                scores[i] = 1 / spread[k].sum()
        return names, scores


def presence(texts: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the codes each text holds, and how many distinct n-grams it has in all."""
    out, sizes, flags = np.zeros((len(texts), len(codes)), np.float32), np.ones(len(texts)), np.zeros(CODES, bool)
    for i, text in enumerate(texts):
        found = ngrams(text)
        flags[found] = True
        sizes[i] = max(1, np.count_nonzero(flags))
        out[i] = flags[codes]
        flags[found] = False
    return out, sizes


def fit(sample: pd.DataFrame) -> KernelModel:
    """Fits to (text, lang)."""
    sample = sample[np.array([bool(x) and any(c.isalpha() for c in x) for x in sample["text"]], bool)]
    languages = sorted(set(sample["lang"]))
    if not languages:
        return KernelModel(np.zeros(0, np.int64), np.zeros((0, 0)), [])
    texts = sample["text"].tolist()
    marks = [texts[i] for i in np.unique(np.linspace(0, len(texts) - 1, min(LANDMARKS, len(texts))).astype(int))]
    seen = np.zeros(CODES, bool)
    for text in marks:
        seen[ngrams(text)] = True
    codes = np.flatnonzero(seen)
    of_marks, mark_sizes = presence(marks, codes)
    of_marks /= np.sqrt(mark_sizes)[:, None]
    kernel_marks = (of_marks @ of_marks.T).astype(float)
    values, vectors = np.linalg.eigh(kernel_marks)
    kept = values > 1e-6 * values.max()
    half = vectors[:, kept] / np.sqrt(values[kept])  # kernel_marks to the power of -1/2
    rows = []
    for first in range(0, len(texts), 256):
        present, sizes = presence(texts[first : first + 256], codes)
        rows.append(((present @ of_marks.T) / np.sqrt(sizes)[:, None]) @ half)
    rows = np.concatenate(rows).astype(float)
    names = sample["lang"].to_numpy()
    wanted = np.where(names[:, None] == np.array(languages, object)[None, :], 1.0, -1.0)
    counts = (wanted > 0).sum(0)
    weight = 1 / counts[[languages.index(x) for x in names]]  # languages count alike
    weight = weight / weight.sum()
    solved = np.linalg.solve((rows * weight[:, None]).T @ rows + RIDGE * np.eye(rows.shape[1]) / len(texts) * 10, (rows * weight[:, None]).T @ wanted)
    return KernelModel(codes, (of_marks.T @ (half @ solved)).astype(np.float32), languages)


def train(docs: DataFrame, learn: Column | None = None) -> KernelModel:
    """Fits on at most PER_LANGUAGE texts of a language and IN_ALL texts, chosen by a hash of the id."""
    usable = docs.filter((F.lit(True) if learn is None else learn) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    hashed = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("hash"))
    # a language sends on some times the rows it needs, by their hashes, so that no task ranks all rows of one
    share = F.least(F.lit(1.0), F.lit(8.0 * PER_LANGUAGE) / F.count("*"))
    few = hashed.groupBy("lang").agg((share * float(1 << 31)).cast("long").alias("below"))
    hashed = hashed.join(few, "lang").filter(F.pmod("hash", F.lit(1 << 31)) < F.col("below"))
    by_hash = Window.partitionBy("lang").orderBy("hash", "doc_id")
    chosen = hashed.withColumn("place", F.row_number().over(by_hash)).filter(F.col("place") <= PER_LANGUAGE).orderBy("place", "lang", "doc_id").limit(IN_ALL)
    return fit(texts_of(usable, chosen.select("doc_id", "lang", "place").distinct()).sort_values(["place", "lang", "doc_id"]))


def language(model: KernelModel, text: Column | str) -> Column:
    """A struct of lang_pred and score."""

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, scores = model.predict(batch.tolist())
            yield pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": scores})
        trim()

    return predict(text)
