"""Texts and tables that are made to break an operator."""

import random

import numpy as np
import pandas as pd
import pytest

from plansight.llm import hilbert, line_dedup, near_dedup, toxicity
from plansight.llm.common import packed, ship, word_hashes
from plansight.llm.textstats import measure


def thue_morse(order, a="a", b="b"):
    """Two words of 2**order letters whose polynomial hashes modulo 2**64 are equal for any base, from order 10 on."""
    x, y = a, b
    for _ in range(order):
        x, y = x + y, y + x
    return x, y


@pytest.mark.parametrize("order", [3, 10, 12])
def test_words_that_fool_polynomials(spark, order):
    ship(spark)
    x, y = thue_morse(order)
    [(_, data, bounds)] = packed([f"{x} {y} {x}"], 1 << 20)
    hashes = word_hashes(data, bounds)[0]
    assert hashes[0] == hashes[2] != hashes[1]
    [(_, data, bounds)] = packed([f"{x}\n{y}\n{x}", f"{x} {x} {x} {y} {y} {y}"], 1 << 20)
    counts, _ = measure(data, bounds)
    assert counts.dup_lines.tolist() == [1, 0] and counts.repeat_words.tolist() == [0, 0]
    docs = spark.createDataFrame([(1, f"{x} two three four five"), (2, f"{y} two three four five"), (3, f"{x} Two three four five")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_exact_check_is_on_words_not_hashes(spark, monkeypatch):
    """Where the sketch takes different texts for alike, the shingles themselves decide."""
    monkeypatch.setattr(near_dedup, "signature", lambda hashes: np.zeros(near_dedup.HASHES, np.uint16))
    nodes = np.array([1, 2, 3])
    found = list(near_dedup._verify(nodes, ["a b c d e f g", "a b c d e f h", "A b c d e f g"], nodes, None))
    assert found in ([(1, 3)], [(3, 1)])


def test_a_bucket_of_unlike_texts_and_one_of_copies(spark, monkeypatch):
    """All texts share one band; those outside the pivot's component still find each other, through several blocks."""
    ship(spark)
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 4)
    pick = random.Random(3)
    words = lambda n: [f"w{pick.randrange(10**6)}" for _ in range(n)]
    rows, n = [], 0
    for size in (9, 5, 1, 1, 2):
        base = words(60)
        for _ in range(size):
            rows.append((n, " ".join([*base, *words(2)])))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sketch = docs.mapInArrow(near_dedup._sketch, "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, sig binary")
    nodes = sketch.selectExpr("doc_id AS node", "array(1L) AS bands", "sig")
    from plansight.llm.common import Scratch
    from plansight.llm.graph import connected_components

    scratch = Scratch(spark, "t")
    got = connected_components(near_dedup.candidates(nodes, scratch), scratch, "c").collect()
    parts: dict = {}
    for r in got:
        parts.setdefault(r["component"], set()).add(r["node"])
    assert sorted(map(sorted, parts.values())) == [list(range(9)), list(range(9, 14)), [16, 17]]


def test_ties_go_to_the_smaller_id(spark):
    """200 vectors at equal distances of each other."""
    ship(spark)
    rows = [(k, [1.0 if j == k else 0.0 for j in range(200)]) for k in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hilbert.nearest(df, df.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got] == [*range(1, 11), *range(10)]


def test_long_clean_texts_are_not_toxic():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)]
    say = lambda: " ".join(rng.choice(words, 8)) + "."
    rows = [(" ".join(say() for _ in range(rng.integers(3, 12))) + (" you awful grub. " if k % 4 == 0 else ""), int(k % 4 == 0), 1.0) for k in range(600)]
    model = toxicity.fit(pd.DataFrame(rows, columns=["text", "label", "share"]))
    unknown = "never seen anywhere before. " * 20_000
    known = " ".join(say() for _ in range(20_000))
    assert model.score(unknown) < 0.1
    assert model.score(known) < 0.7
    assert model.score(known + " you awful grub. " + unknown) > 0.7
    score, found = model.judged(known + " You awful grub.")
    assert score > 0.7 and [known_text(known + " You awful grub.", x) for x in found] == ["You awful grub."]


def known_text(text, found):
    return text[found[0] : found[1]].strip()


def test_noisy_or_equals_brute_force():
    """Scores over random sentences, and the gradient's direction: fitting raises the likelihood."""
    rng = np.random.default_rng(9)
    model = toxicity.SentenceModel({"bad": 2.5, "vile": 1.0, "kind": -3.0}, -1.5)
    for _ in range(200):
        sentences = [rng.choice(["bad", "vile", "kind", "plain", "day"], rng.integers(1, 5)).tolist() for _ in range(rng.integers(1, 6))]
        clean = 1.0
        for words in sentences:
            held = set(words) & model.weights.keys()
            p = 1 / (1 + np.exp(-(model.bias + sum(model.weights[w] for w in held)))) if held else 0.0
            clean *= 1 - (p if p >= toxicity.LEAST_SENTENCE else 0)
        assert model.score(". ".join(" ".join(s) for s in sentences)) == pytest.approx(1 - clean)


def test_rows_with_one_id_lose_no_line(spark):
    rows = [(1, "the same line"), (5, "a line found nowhere else"), (5, "the same line"), (6, "twice\nonly here"), (6, "twice\nonly here"), (7, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.deduplicate(docs, least_words=1).collect())
    assert got == [(1, "the same line"), (5, ""), (5, "a line found nowhere else"), (6, "twice\nonly here"), (6, "twice\nonly here"), (7, "")]
