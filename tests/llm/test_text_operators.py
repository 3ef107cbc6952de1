import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plansight.llm import bpe, chat, langid, line_crf, mixing, quality, toxicity
from plansight.llm.common import packed, ship
from plansight.llm.textstats import measure

ODD = ["", None, " ", "a", "a\na\na b\n", "x  y\tz x y z x y", "é É x\n\né É x", "日本語 \U0001f600 \x00 ab▁cd <|endoftext|>", "word " * 3000, "no space" * 2000, "\n\n", "A | B | C !!\nA | B | C !!"]


@pytest.fixture
def odd(spark):
    ship(spark)
    rows = [(k, x, None, "s") for k, x in enumerate(ODD)] + [(None, "null id", "en", None), (0, "", None, "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def codec(spark):
    P = pytest.importorskip("public_tokenizers")
    return bpe.ByteBpe(spark, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def test_bpe_equals_tiktoken_and_round_trips(spark, odd):
    import public_tokenizers as P
    import tiktoken

    tokens = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    # a column with the name of the new one is replaced
    got = codec(spark).encode_and_decode(odd.withColumn("keep", F.col("text")).withColumn("ids", F.lit(1))).collect()
    assert len(got) == odd.count()
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == theirs.encode_ordinary(r["keep"] or "")
        assert bytes(r["decoded"]) == (r["keep"] or "").encode()
    assert codec(spark).encode(odd.limit(0)).count() == 0


def test_bpe_codec_with_a_full_memory(monkeypatch):
    import public_tokenizers as P

    tokens = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    monkeypatch.setattr(bpe, "REMEMBERED", 4)
    small = bpe.Codec(tokens, bpe.model_bytes(tokens), P.PATTERN)
    for text in ("one two three four five six", "six five one", "zzz one one"):
        assert small.decode(small.encode(text)) == text.encode()


def brute_counts(x):
    words = re.findall(r"[^\x20\x09-\x0D]+", x)
    lines = [line for line in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered), len(set(words))


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_text_counts_equal_brute_force(most):
    got = []
    for _, data, bounds in packed(ODD, most):
        t, _ = measure(data, bounds)
        got += list(zip(*(getattr(t, c).tolist() for c in ("words", "word_chars", "symbols", "dup_lines", "repeat_words", "distinct")), strict=True))
    assert got == [brute_counts(x or "") for x in ODD]


def test_viterbi_equals_brute_force():
    import itertools

    rng = np.random.default_rng(3)
    chain = line_crf.Chain(rng.normal(size=(3, 2)), rng.normal(size=(2, 2)))
    lengths = [4, 0, 1, 6]
    owner, rows = np.repeat(np.arange(4), lengths), rng.normal(size=(sum(lengths), 3))
    got, at = chain.decode(rows, owner, 4), 0
    for n in lengths:
        scores = rows[at : at + n] @ chain.emit
        best = max(itertools.product((0, 1), repeat=n), key=lambda y: sum(scores[i, s] for i, s in enumerate(y)) + sum(chain.move[a, b] for a, b in itertools.pairwise(y)))
        assert got[at : at + n].tolist() == list(best)
        at += n


def test_line_verdicts(spark, odd):
    pick = np.random.default_rng(8)
    good = "\n".join(" ".join("".join(pick.choice(list("abcdefgh"), 6)) for _ in range(12)) + "." for _ in range(8))
    junk = "\n".join("BUY %%% NOW!! *** | ### &&&" + f" {k}" for k in range(40))
    docs = odd.unionByName(spark.createDataFrame([(100, good, "en", "s"), (101, junk, "en", "s")], odd.schema))
    got = {r["doc_id"]: r["v"] for r in docs.select("doc_id", line_crf.verdict(line_crf.train(docs), "text").alias("v")).collect()}
    assert got[100]["kept"]
    assert not got[101]["kept"]
    assert got[0]["base_failed"] and not got[1]["kept"]
    assert line_crf.train(docs.limit(0)).emit.shape == (19, 2)


def test_toxicity_learns_sentences(spark, odd):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(200)]
    say = lambda: " ".join(rng.choice(words, 8)) + "."
    rows = [(k, " ".join(say() for _ in range(rng.integers(3, 12))) + (" you awful grub. " if k % 4 == 0 else ""), int(k % 4 == 0), 1.0) for k in range(400)]
    model = toxicity.fit(pd.DataFrame(rows, columns=["doc_id", "text", "label", "share"]))
    assert model.score(say() + " you awful grub. " + say()) > 0.7
    assert model.score(" ".join(say() for _ in range(40))) < 0.3
    assert model.score(None) == model.score("") == 0.0
    text = say() + " You awful grub."
    [(start, end, _)] = model.offending(text)
    assert text[start:end] == "You awful grub."
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none = toxicity.train(odd, empty)
    assert {r[0] for r in odd.select(toxicity.toxicity(none, "text")).collect()} == {0.0}


def test_noisy_or_of_sentences():
    model = toxicity.SentenceModel({"bad": 3.0}, -2.0)
    p = 1 / (1 + np.exp(-1.0))
    # a sentence without weighted words has no part in it
    assert model.score("bad day. fine day.\nbad") == pytest.approx(1 - (1 - p) ** 2)


def test_quality_ranks(spark, odd):
    good = ["A calm text with several different words about a river and its banks. " * 1 + str(k) for k in range(60)]
    poor = ["BUY!! " * 30 + "### $$$ " * 10 + str(k) for k in range(20)]
    sample = pd.DataFrame({"text": good + poor, "label": [1] * 60 + [0] * 20, "share": 1.0})
    model = quality.fit(sample)
    score = lambda xs: np.concatenate([model.score(quality.features(d, b)) for _, d, b in packed(xs)])
    assert (score(good) >= 0.3).all() and (score(poor) < 0.3).all()
    assert score(["", None]).tolist() == score([None, ""]).tolist()
    none = quality.train(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r[0] for r in odd.select(quality.quality(none, "text")).collect()} == {0.5}


def test_quality_learns_from_all_labelled_documents(spark):
    """Of 9,000 good documents all but a few are plain; the model and its threshold follow every one, and repeat."""
    def text(k):
        return f"A calm text {k} with several different words about a river and its banks." if k % 9 else f"12 34 56 {k} 78 90 11 and {k} more figures, of 1999"

    rows = [(k, text(k), 1) for k in range(9000)] + [(9000 + k, f"BUY!! ### $$$ {k} " * 5, 0) for k in range(300)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    learnt = quality._learnt(docs, labels, F.lit(True), "quality")
    counts = {r["label"]: r["count"] for r in learnt.groupBy("label").count().collect()}
    assert counts == {0: 300, 1: 9000}
    grouped = quality._grouped(learnt, counts).select(F.explode(F.arrays_zip("label", "features")).alias("x"))
    assert grouped.filter("x.label = 1").count() == 9000
    model = quality.train(docs, labels)
    again = quality.train(docs.repartition(7), labels)
    assert np.array_equal(model.weights, again.weights) and model.threshold == again.threshold
    scored = docs.join(labels, "doc_id").select("quality", quality.quality(model, "text").alias("score")).collect()
    assert all((r["score"] >= 0.3) == (r["quality"] == 1) for r in scored)
    values = spark.createDataFrame([(float(x),) for x in [5, 1, 1, -3, 2, 2, 2, 1e300]], "value double")
    assert [quality.kth(values, k) for k in (1, 2, 6, 7, 8)] == [(-3, 1), (1, 1), (2, 5), (5, 1e300), (1e300, 1e300)]


def test_language(spark, odd):
    rng = np.random.default_rng(2)
    say = lambda syllables: " ".join("".join(rng.choice(syllables, 2)) for _ in range(20))
    kinds = {"aa": ["ka", "lo", "mi"], "bb": ["stra", "gru", "plo"]}
    rows = [(k, say(kinds[lang]), lang, "s") for k, lang in enumerate(["aa", "bb"] * 60)]
    docs = spark.createDataFrame(rows, odd.schema)
    model = langid.train(docs, learn=F.col("doc_id") % 4 != 2)
    got = docs.select("lang", langid.language(model, "text").alias("p")).collect()
    assert all(r["lang"] == r["p"]["lang_pred"] and 0 <= r["p"]["score"] <= 1 for r in got)
    assert model.predict([None, "", "123 !", "kalo"])[0] == ["und", "und", "und", "aa"]
    assert langid.fit(pd.DataFrame({"text": [], "lang": []})).predict(["kalo"])[0] == ["und"]


def test_chat_round_trip(spark):
    turns = [(1, 0, "system", "be <b>nice</b>"), (1, 1, "user", r"\l \b </turn>"), (1, 2, "assistant", "ok\n"), (1, 3, "assistant", None), (1, 4, "user", "bye"), (2, 0, "us>er\n<", "hi"), (None, 0, None, "x"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = chat.format_examples(df).withColumn("turns", chat.read_turns(F.col("text"))).withColumn("loss", chat.read_loss(F.col("text"), F.col("loss_start"), F.col("loss_end"))).orderBy("conv_id", "example").collect()
    by = {}
    for r in got:
        by.setdefault(r["conv_id"], []).append(r)
    assert [r["loss"] for r in by[1]] == ["ok\n", "", ""]
    assert [r["tail"] for r in by[1]] == [False, False, True]
    assert [(t["role"], t["text"]) for t in by[1][-1]["turns"]] == [(a, b or "") for c, _, a, b in turns if c == 1]
    assert [(t["role"], t["text"]) for t in by[2][0]["turns"]] == [("us>er\n<", "hi")]
    assert [t["text"] for t in by[3][-1]["turns"]] == ["a", "b"]
    assert chat.format_examples(df.limit(0)).count() == 0


def water_fill(sizes, weights=(5, 2, 1)):
    names = sorted((n for n in sizes if n is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    left, target, open_ = sum(sizes.values()) * 1.5, dict.fromkeys(names, 0.0), {n: weights[k % 3] for k, n in enumerate(names)}
    while open_:
        level = left / sum(open_.values())
        over = [n for n in open_ if level * open_[n] > 2 * sizes[n]]
        if not over:
            return target | {n: level * w for n, w in open_.items()}
        for n in over:
            target[n] = 2.0 * sizes[n]
            left -= target[n]
            del open_[n]
    return target


def test_mixing_targets_and_copies(spark):
    rng = np.random.default_rng(4)
    rows = [(k, "w " * int(rng.integers(0, 40)), rng.choice(["a", "b", "é", "Z", "zz"]).item()) for k in range(3000)] + [(9000 + k, "n " * 7, None) for k in range(50)] + [(9999, None, "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(rows)
    sizes: dict = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = water_fill(sizes)
    taken: dict = {}
    for r in mixed:
        assert r["__mix_target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["__mix_copies"] <= 2
        taken[r["source"]] = taken.get(r["source"], 0) + r["__mix_copies"] * r["__mix_size"]
    for source, target in want.items():
        assert taken[source] == pytest.approx(target, rel=0.15, abs=120)
    assert sorted(mixing.mix(docs).select("doc_id", "__mix_copies").collect()) == sorted((r["doc_id"], r["__mix_copies"]) for r in mixed)
    assert mixing.mix(docs.limit(0)).count() == 0
