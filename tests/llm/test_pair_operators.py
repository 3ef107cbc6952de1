import itertools
import random

import numpy as np
import pytest

from plansight.llm import hilbert, line_dedup, near_dedup
from plansight.llm.common import Scratch, ship
from plansight.llm.graph import connected_components


def components_of(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    pick = random.Random(5)
    links = [(pick.randrange(60), pick.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 130)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "src long, dst long"), Scratch(spark, "t"), "c").collect()}
    want = components_of({n for x in links for n in x}, links)
    assert got == {n: c for n, c in want.items() if n in got}
    assert {n for a, b in links if a != b for n in (a, b)} == set(got)
    assert connected_components(spark.createDataFrame([], "src long, dst long"), Scratch(spark, "t"), "e").count() == 0


def near_copies(seed, count):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdefghij") for _ in range(5))
    texts = [None, "", "  ", "one two", "One TWO", "one two three"]
    for _ in range(count):
        base = [word() for _ in range(pick.randint(30, 80))]
        for _ in range(pick.randint(1, 5)):
            copy = list(base)
            for _ in range(pick.randint(0, 3)):
                copy[pick.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return texts


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


@pytest.mark.parametrize("blocks", [(1024, 512), (3, 2)])
def test_near_copies_equal_brute_force(spark, monkeypatch, blocks):
    """The second case forces every group through several blocks."""
    ship(spark)
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", blocks[0])
    monkeypatch.setattr(near_dedup, "GROUP_BLOCK", blocks[1])
    texts = near_copies(7, 25)
    docs = spark.createDataFrame([(k, x, "y") for k, x in enumerate(texts)] + [(None, "a b c d e f", "y")], "doc_id long, text string, node string")
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs).collect()}
    sets = [shingles(x) for x in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components_of(range(len(sets)), links)
    assert {k: got[k]["component_id"] for k in want} == want
    assert {k: got[k]["n_shingles"] for k in want} == {k: len(s) for k, s in enumerate(sets)}
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_posterior_bound():
    assert near_dedup.least_matches(16) < near_dedup.least_matches(128) < 96
    assert near_dedup.least_matches(128, miss=0.5) > near_dedup.least_matches(128)


def test_lines(spark):
    line = "the quick brown rabbit jumped across several sleeping hounds behind yonder wooden fence while another creature watched quietly from distant hills"
    near = line.replace("the quick", "a quick")  # a short word, which the SimHash leaves out, so the lines surely meet
    other = "completely different sentences should remain untouched because nothing resembles their particular arrangement of chosen vocabulary anywhere else today"
    docs = spark.createDataFrame([(2, f"{line}\nshort line here\n{other}", "z"), (1, f"{line.upper()}!", "z"), (3, near, "z"), (4, "short line here", "z"), (5, None, "z"), (6, "", "z"), (7, f"{other}\n{other}", "z"), (None, line, "z")], "doc_id long, text string, at string")
    got = {r["doc_id"]: r for r in line_dedup.deduplicate(docs, gone="gone").collect()}
    assert got[1]["text"] == f"{line.upper()}!"
    assert got[2]["text"] == f"short line here\n{other}"
    assert got[3]["text"] == ""
    assert got[4]["text"] == "short line here"
    assert got[5]["text"] is None and got[6]["text"] == ""
    assert got[7]["text"] == "" and got[7]["gone"] == [0, 1]
    assert got[None]["text"] == line
    assert line_dedup.deduplicate(docs.limit(0)).count() == 0


def test_simhash_of_narrow_and_wide_lines(spark):
    """The lanes' majority equals a plain count of bits."""
    from pyspark.sql import functions as F

    pick = random.Random(2)
    lines = [" ".join("".join(pick.choice("abcdef") for _ in range(pick.randint(3, 8))) for _ in range(n)) for n in (20, 254, 255, 256, 700)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc"]: r["bits"] for r in line_dedup.occurrences(docs, "doc_id", "text").collect()}
    hashed = {r["w"]: r["h"] for r in docs.select(F.explode(F.split("text", " ")).alias("w")).distinct().select("w", F.xxhash64("w").alias("h")).collect()}
    for k, line in enumerate(lines):
        long = [hashed[w] for w in line.split() if len(w) >= line_dedup.LONG]
        assert got[k] == sum(1 << b for b in range(63) if 2 * sum(h >> b & 1 for h in long) > len(long) - len(long) % 2)


def test_hilbert_neighbours_touch():
    """Along the curve every step moves by one cell in one dimension."""
    grid = np.array(list(itertools.product(range(8), repeat=2)))
    keys = hilbert.hilbert_keys(grid, 3)
    walk = grid[sorted(range(64), key=lambda k: keys[k].tobytes())]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_nearest(spark):
    ship(spark)
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(500, 12)).round(3)
    vectors[50:90] = vectors[0]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(1000, None), (1100, [0.0] * 12), (1200, [1.0]), (1300, [float("nan")] * 12), (1400, [None] + [1.0] * 11)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in hilbert.nearest(df, df.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {0, 100, 200, 300, 400}
    for q, found in got.items():
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
        want = [k for k in np.lexsort((np.arange(500), d)) if k != q][:10]
        assert [k for k, _ in found] == want
        assert [s for _, s in found] == pytest.approx(d[want])
    assert hilbert.nearest(df.limit(0), df.limit(0)).count() == 0
    few = df.filter("vec_id < 3")
    assert hilbert.nearest(few, few.filter("vec_id = 0")).count() == 2
