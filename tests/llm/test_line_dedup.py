import random

from plansight.llm import line_dedup, queries


def op5(spark, tmp_path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return {r["doc_id"]: r["text"] for r in queries.op5_line_dedup(spark, str(tmp_path)).collect()}


def test_equal_lines_of_any_length_leave(spark, tmp_path):
    """Lines of few words, or of a script without spaces, are grouped too; lines without a word stay."""
    chinese = "这是一个没有空格的很长的句子需要去重"
    got = op5(spark, tmp_path, [f"Home\nabout us\n--\n{chinese}", f"home!\n\n--\nAbout  us\nother\n{chinese}", "HOME"])
    assert got == {0: f"Home\nabout us\n--\n{chinese}", 1: "\n--\nother", 2: ""}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def planted(seed, count, sizes):
    """Lines and a copy of each with one word changed, put in, left out, split or joined."""
    pick = random.Random(seed)
    word = lambda n: "".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lines, copies = [], []
    for k in range(count):
        words = [word(pick.randint(4, 9)) for _ in range(pick.choice(sizes))]
        other, at = list(words), pick.randrange(len(words) - 1)
        change = [
            [words[at][:-1] + "é"], [words[at][:2] + words[at][3:]], [words[at] + "s"], [words[at], "of"], [words[at][:2], words[at][2:]],
        ][k % 5]
        other[at : at + 1] = change
        if k % 7 == 0:
            other = [*words[:at], words[at] + words[at + 1], *words[at + 2 :]]
        lines.append(" ".join(words))
        copies.append(" ".join(other))
    return lines, copies


def test_lines_with_one_edited_word_leave(spark, tmp_path):
    """Every copy that the edit similarity admits is found, by brute force over the planted pairs."""
    lines, copies = planted(3, 120, (3, 5, 8, 12, 20, 60))
    got = op5(spark, tmp_path, lines + copies)
    for k, (line, copy) in enumerate(zip(lines, copies, strict=True)):
        near = distance(line, copy) <= max(len(line), len(copy)) // 10
        assert got[k] == line and got[len(lines) + k] == ("" if near else copy), (line, copy)


def test_spread_edits_leave(spark):
    """Letters changed all over a line, three to five in a hundred: of 300 copies 285 and more leave, and what leaves is its own line's."""
    pick = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(300):
        line = " ".join("".join(pick.choice(letters) for _ in range(pick.randint(2, 9))) for _ in range((8, 12, 20, 40, 80)[k % 5]))
        copy = list(line)
        for at in pick.sample([i for i, c in enumerate(line) if c != " "], max(1, len(line) * (3, 5)[k % 2] // 100)):
            copy[at] = pick.choice(letters)
        rows += [(2 * k, line), (2 * k + 1, "".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc"], r["kept_doc"]) for r in line_dedup.repeated_lines(docs, least_words=1).collect()}
    assert found <= {(2 * k + 1, 2 * k) for k in range(300)} and len(found) >= 285, len(found)


def blocks_in_common(a, b, blocks):
    edges = [63 * k // blocks for k in range(blocks + 1)]
    return sum(not (a ^ b) >> low & ((1 << (high - low)) - 1) for low, high in zip(edges, edges[1:], strict=False))


def test_links_do_not_depend_on_the_number_of_lines(spark, monkeypatch):
    """Pairs with enough blocks in common and no part of their texts leave however large a count is; a large one has no broadcast."""
    pick = random.Random(11)
    word = lambda n: "".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    pairs = []
    for _ in range(300):
        words = [word(9) for _ in range(40)]
        other = list(words)
        for at in (4, 14, 24, 34):
            other[at] = words[at][:-1] + "é"
        pairs.append((" ".join(words), " ".join(other)))
    docs = spark.createDataFrame([(2 * k + n, line) for k, pair in enumerate(pairs) for n, line in enumerate(pair)], "doc_id long, text string")
    bits = {r["doc"]: r["bits"] for r in line_dedup.occurrences(docs, "doc_id", "text").collect()}
    few = [k for k in range(len(pairs)) if blocks_in_common(bits[2 * k], bits[2 * k + 1], line_dedup.BLOCKS) >= line_dedup.CHOSEN]
    assert few
    chosen = docs.filter(docs["doc_id"].isin([2 * k + n for k in few for n in (0, 1)]))
    monkeypatch.setattr(type(docs), "count", lambda self: 1 << 25)
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(chosen).collect()}
    assert got == {2 * k + n: "" if n else pairs[k][0] for k in few for n in (0, 1)}


def test_lines_of_few_long_words_take_part(spark, tmp_path):
    """Figures, short words and one long word have a SimHash, and a copy with one other character leaves."""
    lines = ["12 07 1999 340 55 8 19 201 77", "it is as it was and so it goes on", "这是一个 没有很多 空格的 句子需要 去重", "supercalifragilistic"]
    near = [line[:-1] + "x" for line in lines]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r["doc"] for r in line_dedup.occurrences(docs, "doc_id", "text", 1).filter("bits IS NOT NULL").collect()} == {0, 1, 2, 3}
    assert op5(spark, tmp_path, lines + near) == {k: line if k < 4 else "" for k, line in enumerate([*lines, *near])}


def test_links_against_all_pairs(spark):
    """Of all pairs of lines within the edit similarity, nine tenths or more are in one group; and no group joins what brute force does not."""
    import duckdb
    import regex

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = {}
    for r in line_dedup.repeated_lines(docs, least_words=1).collect():
        kept[r["doc"], r["at"]] = (r["kept_doc"], r["kept_at"])
    plain, places = {}, {}
    for r in docs.select("doc_id", "text").collect():
        for at, line in enumerate((r["text"] or "").split("\n")):
            x = regex.sub(r"[^\p{L}\p{N}\p{M}]+", " ", line.lower()).strip(" ")
            if x:
                plain[r["doc_id"], at] = x
                places.setdefault(x, []).append((r["doc_id"], at))
    texts = sorted(places)
    db = duckdb.connect()
    db.execute("CREATE TABLE t (k INT, x VARCHAR)")
    db.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    pairs = db.execute("SELECT a.k, b.k FROM t a JOIN t b ON a.k < b.k AND abs(length(a.x) - length(b.x)) <= greatest(length(a.x), length(b.x)) // 10 AND levenshtein(a.x, b.x) <= greatest(length(a.x), length(b.x)) // 10").fetchall()
    group = lambda x: min(kept.get(p, p) for p in places[x])
    found = [group(texts[a]) == group(texts[b]) for a, b in pairs if min(len(texts[a]), len(texts[b])) >= line_dedup.EDITS]
    assert len(found) >= 30 and sum(found) >= 0.9 * len(found), (sum(found), len(found))
    assert all(group(x) == min(kept.get(p, p) for p in [q]) for x in texts for q in places[x])  # equal lines are in one group
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, b in pairs:
        parent[root(b)] = root(a)
    at = {x: k for k, x in enumerate(texts)}
    assert all(root(at[plain[place]]) == root(at[plain[stays]]) for place, stays in kept.items())


def test_every_copy_within_the_edit_similarity_leaves(spark, monkeypatch):
    """As many edits as a link may have, evenly spread or anywhere, in lines of 9 to 900 characters: all copies leave, in one round or in many."""
    pick = random.Random(17)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(240):
        size = pick.choice((9, 10, 11, 19, 20, 35, 60, 89, 90, 99, 150, 260, 530, 900))
        line = "".join(pick.choice(letters) if at % 7 else pick.choice(letters + " ") for at in range(size)).strip().replace("  ", "x")
        most = max(len(line) // 10, 1)
        places = [len(line) * j // most + len(line) // most // 2 for j in range(most)] if k % 2 else pick.sample(range(len(line)), most)
        copy = list(line)
        for at in places:
            copy[at] = ("", "1", copy[at] + "2")[pick.choice((0, 1, 2) if k % 3 else (1,))]
        copy = " ".join("".join(copy).split())
        if distance(line, copy) <= max(len(line), len(copy)) // 10:
            rows += [(2 * k, line), (2 * k + 1, copy)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(rows) >= 400
    for size in (line_dedup.ROUND, 2500):
        monkeypatch.setattr(line_dedup, "ROUND", size)
        found = {(r["doc"], r["kept_doc"]) for r in line_dedup.repeated_lines(docs, least_words=1).collect()}
        assert found == {(k, k - 1) for k, _ in rows if k % 2}


def test_exact_search_looks_a_line_up_at_few_places(spark):
    """A line is looked up at half of its characters at most, and rounds that share a class of length share its rows."""
    from pyspark.sql import functions as F

    pick = random.Random(23)
    lines = [(k, "".join(pick.choice("abcdefgh ijklmnop") for _ in range(300)), 300, None) for k in range(100)]
    lines = spark.createDataFrame(lines, "node long, plain string, size int, component long")
    rows = lambda low, high: line_dedup._beginnings(lines, F.lit(True), low, high, False).count()
    assert 100 * 300 // 5 < rows(0, 1 << 30) <= 100 * 300 // 2
    assert sum(rows(low, high) for low, high in [(0, 2), (2, 3), (3, 1 << 30)]) == rows(0, 1 << 30)


def test_common_grams_bring_few_lines_together(spark, monkeypatch):
    """Lines of a few syllables meet by their rarer grams or by whole stretches: a fifth of the meetings by chance; what is found does not depend on which grams are common."""
    from pyspark.sql import functions as F

    pick = random.Random(29)
    syllables = ["the", "tion", "re", "er", "on", "ing", "an", "at"]
    word = lambda: "".join(pick.choice(syllables) for _ in range(pick.randint(1, 3)))
    texts = [" ".join(word() for _ in range(45)) for _ in range(300)]
    lines = spark.createDataFrame([(k, x, len(x), None) for k, x in enumerate(texts)], "node long, plain string, size int, component long")
    common = line_dedup._common_grams(lines)

    def meetings(common):
        sides = [way(lines, F.lit(True), 0, 1 << 30, False, common).groupBy("key").count() for way in (line_dedup._stretches, line_dedup._beginnings)]
        return sides[0].join(sides[1].withColumnRenamed("count", "m"), "key").agg(F.sum(F.col("count") * F.col("m"))).first()[0]

    assert meetings(common) <= meetings(b"") / 5
    rows = []
    for k, text in enumerate(texts[:100]):
        copy = list(text)
        for at in pick.sample(range(len(text)), len(text) // 10):
            copy[at] = "1"
        rows += [(2 * k, text), (2 * k + 1, " ".join("".join(copy).split()))]
    near = {(2 * k + 1, 2 * k) for k, (text, (_, copy)) in enumerate(zip(texts[:100], rows[1::2], strict=True)) if distance(text, copy) <= max(len(text), len(copy)) // 10}
    assert len(near) >= 95
    for count in (30, line_dedup.COMMON):
        monkeypatch.setattr(line_dedup, "COMMON", count)
        found = {(r["doc"], r["kept_doc"]) for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), least_words=1).collect()}
        assert near <= found, (count, len(near - found))
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") != "8000"
