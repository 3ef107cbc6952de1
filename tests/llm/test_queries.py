"""Every opN_ query over the smallest tables with odd rows added: names, types, folds and thresholds, against brute force where there is one."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plansight.llm import queries

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "x", "one two three four", "é É\né É", "日本語 \U0001f600 ▁ <|endoftext|>", "word " * 5000, "no_space" * 4000, "same line\nsame line\n\nsame line", "ok.\n" * 2000]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """sf0.001 with odd documents, a repeated row, columns whose names clash with those of the operators, and labels for some."""
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(900_000 + k, x, None if k % 2 else "en", None if k % 3 else "s", None) for k, x in enumerate(ODD)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.orderBy("doc_id").limit(1))
    for clash in ("label", "score", "size", "node", "key", "at", "place", "ids", "words", "v"):
        docs = docs.withColumn(clash, F.lit("clash"))
    docs.write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "conversations", "embeddings"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    for name in ("documents", "labels", "conversations", "embeddings"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture(scope="module")
def texts(spark, tables):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]


CONTRACT = {
    "op1_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op2_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op4_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6_chat_format": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op7_mix_sources": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op8_quality_ranking": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_nearest_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op10_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
}


@pytest.mark.parametrize("name", CONTRACT)
def test_columns_and_empty_tables(spark, empty, name):
    got = queries.QUERIES[name](spark, empty)
    assert ", ".join(f"{c} {t}" for c, t in got.dtypes).startswith(CONTRACT[name])
    assert got.count() == (1 if name.startswith("op6") else 0)  # op6's own conversation


def test_line_dedup_of_no_documents(spark, empty):
    assert queries.op5_line_dedup(spark, empty).count() == 0


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_byte_bpe(spark, tables, texts):
    P = pytest.importorskip("public_tokenizers")
    import tiktoken

    from plansight.llm import bpe

    ranks = {t: k for k, t in enumerate(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")))}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for doc_id, text in texts:
        ids = np.array(theirs.encode_ordinary(text or ""), "<u4")
        want.append((doc_id, len(ids), sha(ids.tobytes()), sha((text or "").encode())))
    assert sorted(map(tuple, queries.op1_byte_bpe(spark, tables).collect())) == sorted(want)


def folds(found, texts, parts, rest):
    assert sorted(r["doc_id"] for r in found) == sorted(d for d, _ in texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == rest) for r in found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_toxicity(spark, tables, texts):
    found = queries.op2_toxicity(spark, tables).collect()
    folds(found, texts, 3, 1)
    by, text_of = {r["doc_id"]: r for r in found}, dict(texts)
    for r in found:
        # a document's score is the noisy-or of at least its offending sentences, which lie in it
        assert r["predicted"] == int(r["score"] >= 0.7)
        assert r["score"] >= 1 - np.prod([1 - x["score"] for x in r["offending"]]) - 1e-9
        assert all(0 <= x["start"] < x["end"] <= len(text_of[r["doc_id"]]) for x in r["offending"])
    assert by[900_000]["score"] == by[900_001]["score"] == 0
    assert by[900_010]["predicted"] == 0  # 2,000 clean sentences


def test_quality_rules(spark, tables, texts):
    for r in queries.op3_quality_rules(spark, tables).collect():
        text = dict(texts)[r["doc_id"]] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows: dict = {}
        for k in range(len(words) - 2):
            windows.setdefault(tuple(words[k : k + 3]), []).append(k)
        covered = {k + i for places in windows.values() if len(places) > 1 for k in places for i in range(3)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r["base_failed"] and r["kept"])


def test_language(spark, tables, texts):
    found = queries.op4_language_id(spark, tables).collect()
    folds(found, texts, 4, 2)
    for r in found:
        text = dict(texts)[r["doc_id"]]
        assert (r["lang_pred"] == "und") == (text is None or not any(c.isalpha() for c in text))
    known = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in found if r["held_out"] and known.get(r["doc_id"]) and r["lang_pred"] != "und"]
    assert np.mean([r["lang_pred"] == known[r["doc_id"]] for r in held]) > 0.9


def test_quality_ranking(spark, tables, texts):
    found = queries.op8_quality_ranking(spark, tables).collect()
    folds(found, texts, 5, 0)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in found)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(r["predicted"], labels[r["doc_id"]]) for r in found if r["doc_id"] in labels]
    assert np.mean([a == b for a, b in judged]) > 0.9


def test_mixing(spark, tables, texts):
    found = queries.op7_mix_sources(spark, tables).collect()
    again = queries.op7_mix_sources(spark, tables).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))
    sizes: dict = {}
    for doc_id, text in texts:
        sizes.setdefault(doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", text or "")))
    assert all(r["size"] == sizes[r["doc_id"]] and r["taken"] <= 2 * r["size"] for r in found)


def test_near_dedup(spark, tables, texts):
    found = {r["doc_id"]: r for r in queries.op10_near_dedup(spark, tables).collect()}

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        return frozenset(zip(*(words[k:] for k in range(5)), strict=False)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])

    sets = {doc_id: shingles(text) for doc_id, text in texts}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 3 * max(len(x), len(y)) <= 4 * min(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in found.items()} == {d: (len(sets[d]), root(d), root(d) == d) for d in sets}


def test_nearest_neighbours(spark, tables):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, vectors = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    found: dict = {}
    for r in queries.op9_nearest_neighbours(spark, tables).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    asked = {int(q) for q in ids if q % 100 == 0}
    assert set(found) == asked
    hit = total = 0
    for q in asked:
        d = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(1))
        want = [int(ids[k]) for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        got = [found[q][k] for k in range(1, 11)]
        assert [s for _, s in got] == pytest.approx([d[ids == v][0] for v, _ in got], rel=1e-12)
        assert got == sorted(got, key=lambda x: (x[1], x[0]))
        hit, total = hit + len({v for v, _ in got} & set(want)), total + 10
    assert hit >= 0.9 * total
