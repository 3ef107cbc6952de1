"""Fuzzy line deduplication across documents, in DataFrame operations alone.

Lines are normalised (lower case; runs of anything but letters, digits and marks become one
space). Equal ones collapse to one node each. A node has a 63-bit SimHash of its longer words,
or of all words where fewer than LEAST_LONG are long, cut into BLOCKS blocks. Nodes meet if they
share CHOSEN of the blocks and a class of length, as lines whose SimHashes differ in at most
BLOCKS - CHOSEN bits must, or the line's beginning or end, or one of its four quarters.
Candidates are verified by the edit similarity of their normalised texts. One line of a bucket,
its pivot, a frequent one, meets all others, and pairs that this connects are settled. Of each
connected group of lines the first occurrence, by document id and line number, stays; the others
leave their documents.

That settles most lines cheaply. Then an exact search finds every pair within the edit similarity
that is not connected yet, by pigeonhole: of so many stretches as a line may have edits, and one
more, one is as it was in the other line. There is even one for which the stretches from it to the
line's end have fewer edits than they are, counted from it to any later one. So its place, counted from the end, moves by
no more than the stretches after it, and the next stretch has at most one edit, which leaves one of
its halves as it was. The longer line of a pair gives of each stretch the gram, a few characters, of the
least hash; the shorter one gives the least gram of every window as long as a stretch, which neighbouring windows share, so that
it is looked up at less than half of its characters. Grams that are common among all lines come after the others in that order,
and a stretch of common grams alone is met by the whole of it, as common grams would have most lines meet by chance. Both meet by that gram, a class of length and a class of place, and pass
on if the whole stretch is there and a half of what follows agrees too. This runs in rounds of
some lengths each, so that few of these rows exist at once. Nothing is capped.

Defined results: lines without a letter, digit or mark always stay, and so do lines of fewer than
``least_words`` words (LEAST_WORDS if not given; the queries give 1, so that all others are compared); a line of a million words or more has
no SimHash and meets others by its parts; a null text stays null and an empty
text empty; a document all of whose lines leave keeps its row with an empty text; lines of any
length are read whole. Rows with the same id and different texts are told apart by a hash of the
text, which also orders them; rows with the same id and text are one document and lose the
same lines. Rows with a null id stay as they are; an empty table gives an empty table; further columns pass through.
"""

from __future__ import annotations

import contextlib
import itertools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plansight.llm.common import Scratch
from plansight.llm.graph import connected_components

#: Fewest words of a line that is compared, where the caller does not say; letters from which a word is long, and fewest long words that stand for a line in its SimHash.
LEAST_WORDS, LONG, LEAST_LONG = 5, 5, 4
#: Edit similarity of a link, as 1 - 1 / this. A line of fewer characters can only equal another.
EDITS = 10
#: Least words of a line that is also cut into quarters, which are of three words then.
QUARTERED = 12
#: Characters up to which two texts are compared whole at once; words of a chunk of longer ones.
WHOLE, CHUNK = 500, 32
#: Common ends of two texts are cut off before their edits are counted, by steps of these many characters.
STEPS = [1 << k for k in range(30, -1, -1)]
#: Blocks of a SimHash and how many of them make a key.
BLOCKS, CHOSEN = 4, 2
#: Lane widths. A sum over words of every lane-th bit of their hashes counts 63 / lane bits at once, for fewer than 2**lane - 1 words.
LANES = (7, 9, 21)
#: Classes of length of the exact search in a factor of e: a line and the shortest one that may link to it are in one or neighbouring classes.
CLASSES = 4
#: Most characters of a stretch of the exact search; fewest; most characters of a gram.
STRETCH, LEAST_STRETCH, GRAM = 9, 5, 6
#: Grams of the longest stretch but the last one.
INNER = STRETCH - GRAM
#: Classes of grams by hash, and how many of them, the fullest, are common. They decide what two lines meet by, not whether they do.
GRAM_CLASSES, COMMON = 1 << 16, 2000
#: A common gram in the order of grams: after all others.
LAST = (1 << 63) - 1
#: Stretches that follow a stretch found and are compared, before two lines are compared whole.
AHEAD = 9
#: As many of them are compared where a stretch of long lines is found, as such lines have many stretches in common by chance.
SOON = 4
#: Characters of the lines of a round of the exact search: the larger of a number and a share of all.
ROUND, ROUNDS = 8_000_000, 20
#: Spark's settings for the exact search. Java does not compile a method of more than 8000 bytes of code; and a filter that Spark infers would make its rows again.
SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.constraintPropagation.enabled": "false"}
#: Rows up to which a table of line numbers is broadcast (about 40 bytes a row); beyond it Spark shuffles.
BROADCAST_ROWS = 1_000_000

#: Where a line stands: its document, the hash of the document's text, and its number.
ADDRESS = ["doc", "copy", "at"]
CUT = ["begin", "end", "begin2", "end2", "q0", "q1", "q2", "q3"]


def normalise(line: Column) -> Column:
    return _spaced(F.lower(line))


def _spaced(lowered: Column) -> Column:
    # a gap that is one space already is not matched, which saves most of the replacements
    return F.trim(F.regexp_replace(lowered, r"[^\p{L}\p{N}\p{M}](?:[^\p{L}\p{N}\p{M}]+|(?<! ))", " "))


def _lanes(value: int, lane: int) -> Column:
    """A 63-bit number with ``value`` in each lane of ``lane`` bits."""
    return F.lit(sum(value << k for k in range(0, 63, lane))).cast("long")


def _majority(hashes: Column, lane: int) -> Column:
    """The bits that more than half of the hashes have. Adding what is missing to a full half makes a lane's top bit tell."""
    tops, ones = _lanes(1 << (lane - 1), lane), _lanes(1, lane)
    lift = (F.lit((1 << (lane - 1)) - 1).cast("long") - F.shiftright(F.size(hashes), 1)) * ones
    every = lambda k: lambda sums, h: sums + F.shiftrightunsigned(h, k).bitwiseAND(ones)
    out = F.lit(0).cast("long")
    for k in range(lane):
        counted = F.aggregate(hashes, F.lit(0).cast("long"), every(k))
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned((counted + lift).bitwiseAND(tops), lane - 1), k))
    return out


def simhash(hashes: Column) -> Column:
    """63 bits; null for no hash and for a million or more. The narrower the lanes, the fewer sums."""
    count = F.size(hashes)
    out = F.when(count <= 0, F.lit(None).cast("long"))
    for lane in LANES:
        out = out.when(count < (1 << (lane - (lane == LANES[-1]))) - 1, _majority(hashes, lane))
    return out


def _doubling(number: Column) -> Column:
    """The place of a number's highest bit."""
    return (F.length(F.bin(number)) - 1).cast("int")


def _shorter(size: Column) -> Column:
    """The shortest line that may link to one of this length."""
    return size - F.floor(size / EDITS).cast("int")


def _stretch(size: Column) -> Column:
    """A length of which a line has two stretches at its ends and a tenth of it between them; in steps of a half or a third."""
    most = F.floor(_shorter(size) / 2).cast("int")
    step = F.call_function("shiftleft", F.lit(1), _doubling(most))
    return step + F.when(most >= step + F.shiftright(step, 1), F.shiftright(step, 1)).otherwise(0)


def _part_keys(plain: Column, words: Column, size: Column) -> list[Column]:
    """Hashes of parts of a line, null where it has no such part.

    Its beginning and its end, of its own stretch and that of the shortest line that may
    link to it, so that lines of different lengths have a stretch in common; and its quarters.
    """
    keys = []
    own, other = _stretch(size), _stretch(_shorter(size))
    for stretch, wanted in ((own, size >= EDITS), (other, (size >= EDITS) & (other != own))):
        keys.append(F.when(wanted, F.xxhash64(F.lit("<"), stretch, F.substr(plain, F.lit(1), stretch))))
        keys.append(F.when(wanted, F.xxhash64(F.lit(">"), stretch, F.substr(plain, size - stretch + 1, stretch))))
    count = F.size(words)
    edges = [F.floor(count * k / 4).cast("int") for k in range(5)]
    for k in range(4):
        keys.append(F.when((size >= EDITS) & (count >= QUARTERED), F.xxhash64(F.lit(k), count, F.slice(words, edges[k] + 1, edges[k + 1] - edges[k]))))
    return [key.alias(name) for name, key in zip(CUT, keys, strict=True)]


def block_keys(bits: Column, size: Column, blocks: int = BLOCKS, chosen: int = CHOSEN) -> list[Column]:
    """A key for each combination of blocks and each class of length: a hash of its number, the class and its blocks' bits; null where there is none.

    A class is a doubling of the length. A line is also in the class of the shortest one that may link to it.
    """
    edges = [63 * k // blocks for k in range(blocks + 1)]
    keys = []
    own, other = _doubling(size), _doubling(_shorter(size))
    for n, combination in enumerate(itertools.combinations(range(blocks), chosen)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in combination)
        part = bits.bitwiseAND(F.lit(mask).cast("long"))
        keys += [F.when(bits.isNotNull(), F.xxhash64(F.lit(n), own, part)), F.when(bits.isNotNull() & (other != own), F.xxhash64(F.lit(n), other, part))]
    return keys


def _addressed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, copy, text) of the rows with an id."""
    return docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("copy"), F.col(text).alias("text"))


def line_hashes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, copy, at, h1, h2, size, count, bits, begin, ...) of every line; at counts from 0, size its normalised characters and count its words."""
    lines = _addressed(docs, doc_id, text).select("doc", "copy", F.posexplode(F.split(F.lower("text"), "\n")).alias("at", "line"))
    # steps, and no filter among them, else Spark splits and hashes the line again for each use of its words
    lines = lines.select(*ADDRESS, _spaced(F.col("line")).alias("plain"))
    lines = lines.select(*ADDRESS, "plain", F.length("plain").alias("size"), F.split("plain", " ").alias("words"))
    parts = _part_keys(F.col("plain"), F.col("words"), F.col("size"))
    lines = lines.select(*ADDRESS, F.xxhash64("plain").alias("h1"), F.xxhash64(F.lit(1), "plain").alias("h2"), "size", *parts, "words")
    lines = lines.withColumn("long", F.filter("words", lambda word: F.length(word) >= LONG))
    counted = F.when(F.size("long") >= LEAST_LONG, F.col("long")).otherwise(F.col("words"))
    lines = lines.select(*ADDRESS, "h1", "h2", "size", F.size("words").alias("count"), F.transform(counted, lambda word: F.xxhash64(word)).alias("hashes"), *CUT)
    return lines.select(*ADDRESS, "h1", "h2", "size", "count", F.when(F.col("size") >= EDITS, simhash(F.col("hashes"))).alias("bits"), *CUT)


def compared(lines: DataFrame, least_words: int) -> DataFrame:
    """Those lines that take part: with a letter, digit or mark, and of ``least_words`` words."""
    return lines.filter((F.col("size") > 0) & (F.col("count") >= least_words))


def occurrences(docs: DataFrame, doc_id: str, text: str, least_words: int = LEAST_WORDS) -> DataFrame:
    return compared(line_hashes(docs, doc_id, text), least_words)


def _joinable(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table as the small side of a join: broadcast if its rows were counted to be few, hashed by shuffle if not."""
    return F.broadcast(table) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table.hint("shuffle_hash")


def _texts(nodes: DataFrame, docs: DataFrame, doc_id: str, text: str, scratch: Scratch) -> DataFrame:
    """(node, plain, size) for nodes given by an occurrence (node, doc, copy, at), dealt out by size, so that a reader of some sizes skips the other files."""
    lines = _addressed(docs, doc_id, text).select("doc", "copy", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    found = lines.join(_joinable(nodes, nodes), ADDRESS).select("node", "line")
    # written twice, so that the shuffles of the two steps do not lie on disk together
    found = scratch.save(found.select("node", normalise(F.col("line")).alias("plain")).withColumn("size", F.length("plain")), "unsorted")
    found = scratch.save(found.repartitionByRange("size").dropDuplicates(["size", "node"]).sortWithinPartitions("size"), "texts")
    scratch.drop("unsorted")
    return found


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(src, dst, link) for the distinct pairs whose lengths allow a link: whether their texts (node, plain) reach the edit similarity."""
    both = pairs.distinct().join(texts.select(F.col("node").alias("src"), F.col("plain").alias("a")), "src").join(texts.select(F.col("node").alias("dst"), F.col("plain").alias("b")), "dst")
    both = both.withColumn("most", F.floor(F.greatest(F.length("a"), F.length("b")) / EDITS).cast("int")).filter(F.abs(F.length("a") - F.length("b")) <= F.col("most"))
    # what two texts have in common at their ends needs no edits; the count's time grows with the square of the rest
    for _ in range(2):
        both = both.withColumn("least", F.least(F.length("a"), F.length("b"))).withColumn("same", _common("a", "b", "least"))
        both = both.select("src", "dst", "most", *[F.reverse(F.substr(F.col(x), F.col("same") + 1)).alias(x) for x in "ab"])
    # so few characters that all may be edited, or a sum over chunks that is small enough, prove a link; only where they do not, the rest is compared whole
    rest = F.greatest(F.length("a"), F.length("b"))
    proven = (rest <= F.col("most")) | (rest > WHOLE) & (_edits_by_chunks("a", "b", "most") <= F.col("most"))
    # written as a column: a filter would be pushed below the steps above and run each of them many times
    # most links need far fewer edits than they may have, and a count that may end sooner takes less time
    return both.select("src", "dst", (proven | F.expr("levenshtein(a, b, most div 4) >= 0") | F.expr("levenshtein(a, b, most) >= 0")).alias("link"))


def _common(a: str, b: str, least: str) -> Column:
    """The number of characters that two texts have in common at their beginnings; ``least``: the length of the shorter one."""
    a, b, least = F.col(a), F.col(b), F.col(least)
    step = lambda at, n: F.when((at + n <= least) & (F.substr(a, at + 1, n) == F.substr(b, at + 1, n)), at + n).otherwise(at)
    steps = F.slice(F.array(*map(F.lit, STEPS)), F.lit(len(STEPS)) - _doubling(F.greatest(least, F.lit(1))), _doubling(F.greatest(least, F.lit(1))) + 1)
    return F.aggregate(steps, F.lit(0), step)


def _edits_by_chunks(a: str, b: str, most: str) -> Column:
    """At least the edit distance of two texts: the sum of those of their chunks of CHUNK words; it ends early beyond ``most``."""
    words = [F.split(F.col(x), " ") for x in (a, b)]
    count = F.floor((F.greatest(*map(F.size, words)) - 1) / CHUNK).cast("int")
    chunk = lambda x: lambda k: F.concat_ws(" ", F.slice(x, k * CHUNK + 1, CHUNK), F.when(F.size(x) > k * CHUNK, ""))
    chunks = [F.transform(F.sequence(F.lit(0), count), chunk(x)) for x in words]
    pairs = F.zip_with(*chunks, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.aggregate(pairs, F.lit(0), lambda sum, p: F.when(sum > F.col(most), sum).otherwise(sum + F.levenshtein(p["x"], p["y"])))


def _buckets(keyed: DataFrame) -> DataFrame:
    """(key, node, pivot, members) of the keys that several nodes have. A bucket's pivot is the node of the smallest number, which is a frequent line."""
    keyed = keyed.filter(F.col("key").isNotNull()).repartition("key")
    shared = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("pivot")).filter(F.col("members") > 1)
    return keyed.join(shared.hint("shuffle_hash"), "key")  # the join reads the same exchange as the count


def _joined(components: DataFrame, more: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The components after further links; what is known goes in as one link from each node."""
    if more.isEmpty():
        return components
    known = components.select(F.col("node").alias("src"), F.col("component").alias("dst"))
    return scratch.save(connected_components(known.unionByName(more), scratch, name), f"components-{name}")


def _stars(bucketed: DataFrame) -> DataFrame:
    return bucketed.filter(F.col("node") != F.col("pivot")).select(F.col("pivot").alias("src"), F.col("node").alias("dst"))


def _class(size: Column) -> Column:
    return F.floor(F.log(size) * CLASSES).cast("int")


def _width_of(kind: Column) -> Column:
    """Characters of a class of place in a line of a class of length: two tenths of the shortest such line."""
    return F.greatest(F.floor(F.exp(kind / F.lit(float(CLASSES))) * 2 / EDITS), F.lit(1))


def _width() -> Column:
    return _width_of(F.col("class"))


def _stretch_of(size: Column) -> Column:
    """Characters of a stretch of a line; a line is cut into one stretch more than it may have edits."""
    tens = F.floor(size / EDITS)
    return F.least(F.floor(tens * EDITS / (tens + 1)), F.lit(STRETCH)).cast("int")


def _letters(lines: DataFrame) -> DataFrame:
    """The lines with four bytes for each character, so that a piece anywhere in a long text is found at once."""
    return lines.withColumn("codes", F.encode("plain", "UTF-32")).drop("plain")


def _piece(at: Column, count: Column) -> Column:
    return F.substr("codes", (at * 4 + 1).cast("int"), (count * 4).cast("int"))


def _text(at: Column, count: Column) -> Column:
    return F.decode(_piece(at, count), "UTF-32")


def _grams() -> list[Column]:
    """Hashes of grams of a window of p characters from ``at``: all but the last, the greatest number where a window has fewer; the last; and the one before the window."""
    gram = F.least(F.col("p"), F.lit(GRAM))
    inner = [F.when(F.col("p") > gram + k, F.xxhash64(_piece(F.col("at") + k, gram))).otherwise(F.lit(LAST)) for k in range(INNER)]
    last, before = F.xxhash64(_piece(F.col("at") + F.col("p") - gram, gram)), F.xxhash64(_piece(F.col("at") - 1, gram))
    return [*[x.alias(f"g{k}") for k, x in enumerate(inner)], last.alias("last_gram"), before.alias("gram_before")]


def _gram_class(gram: Column) -> Column:
    return gram.bitwiseAND(F.lit(GRAM_CLASSES - 1))


def _common_grams(lines: DataFrame) -> bytes:
    """The classes of grams that are common among the lines (plain, size), as bits, four in a byte."""
    rows = _letters(lines.filter(F.col("size") >= GRAM)).select("codes", F.explode(F.sequence(F.lit(0), F.col("size") - GRAM, F.lit(STRETCH))).alias("at"))
    found = rows.groupBy(_gram_class(F.xxhash64(_piece(F.col("at"), F.lit(GRAM)))).alias("class")).count()
    bits = bytearray(GRAM_CLASSES // 4)
    for r in found.orderBy(F.desc("count"), "class").limit(COMMON).collect():
        bits[r["class"] // 4] |= 1 << r["class"] % 4
    return bytes(bits)


def _ordered(rows: DataFrame, common: bytes) -> DataFrame:
    """Rows whose grams have their place in the order of grams, and the least of a window's but its last as inner."""
    grams = [*[f"g{k}" for k in range(INNER)], "last_gram", "gram_before"]

    def order(gram: str) -> Column:
        of = _gram_class(F.col(gram)).cast("int")
        held = F.ascii(F.substr(F.lit(common), F.shiftright(of, 2) + 1, F.lit(1)).cast("string"))
        return F.when(F.call_function("shiftright", held, of.bitwiseAND(F.lit(3))).bitwiseAND(F.lit(1)) == 1, F.lit(LAST)).otherwise(F.col(gram)).alias(gram)

    # the number keeps a filter from being moved below, where each gram would be looked up many times
    rows = rows.withColumns({gram: order(gram) for gram in grams}).withColumn("once", F.monotonically_increasing_id()) if common else rows
    return rows.withColumn("inner", F.least(*grams[:INNER]))


def _least_gram(rows: DataFrame) -> DataFrame:
    """Rows with the first of a window's grams in their order and how far it is from the window's beginning, leftmost; the whole window where all are common."""
    at = F.col("p") - F.least(F.col("p"), F.lit(GRAM))
    for k in reversed(range(INNER)):
        at = F.when((F.col(f"g{k}") == F.col("inner")) & (F.col("inner") <= F.col("last_gram")), k).otherwise(at)
    gram = F.least("inner", "last_gram")
    return rows.withColumn("off", at.cast("int")).withColumn("gram", F.when(gram == LAST, F.xxhash64(F.lit(LAST), _piece(F.col("at"), F.col("p")))).otherwise(gram))


def _first(at: Column, size: Column) -> Column:
    """The first stretch of a line that begins at a character or after it."""
    count = F.floor(size / EDITS) + 1
    return F.floor((at * count + size - 1) / size)


def _key(gram: str) -> Column:
    return F.xxhash64(F.col(gram), F.col("p"), F.col("class"), F.col("place")).alias("key")


def _ahead(far: bool) -> int:
    """Characters from a stretch's beginning that are compared where it is found."""
    return STRETCH * (SOON + 1) if far else 2 * STRETCH + 1


def _stretches(lines: DataFrame, classes: Column, low: int, high: int, far: bool, common: bytes = b"") -> DataFrame:
    """(key, dst, dst_in, dst_size, ...) of each line's stretches, for all lines that are no longer, by the first gram of each in their order: off is where that begins in it."""
    size, i = F.col("size"), F.col("i")
    cut = _letters(lines.filter(size >= EDITS)).select("*", F.explode(F.sequence(_class(_shorter(size)), _class(size))).alias("class")).filter(classes)
    cut = cut.withColumn("count", F.floor(size / EDITS).cast("int") + 1).withColumn("p", _stretch_of(size)).withColumn("width", _width())
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("i")).withColumn("at", F.floor(i.cast("long") * size / F.col("count")).cast("int"))
    after, from_end = F.col("count") - 1 - i, size - F.col("at")
    reached = (from_end + after >= F.col("width") * low) & (from_end - after - STRETCH < F.col("width") * high)
    cut = cut.withColumn("after", after).filter(reached).select("*", *_grams(), F.monotonically_increasing_id().alias("once"))
    cut = _least_gram(_ordered(cut, common))
    cut = cut.select("node", "component", "size", "class", "codes", "p", "width", "at", "after", "once", "gram", "off")
    gram_from_end = size - F.col("at") - F.col("off")
    places = F.sequence(F.floor((gram_from_end - F.col("after")) / F.col("width")), F.floor((gram_from_end + F.col("after")) / F.col("width")))
    rows = cut.withColumn("text", _text(F.col("at"), F.lit(_ahead(far)))).select("*", F.explode(places).alias("place")).filter((F.col("once") >= 0) & F.col("place").between(low, high - 1))
    return rows.select(
        _key("gram"), F.col("node").alias("dst"), F.col("component").alias("dst_in"), size.alias("dst_size"), _shorter(size).alias("dst_least"),
        (size - F.col("at") - F.col("off")).alias("dst_end"), F.col("off").alias("dst_off"), F.col("after").alias("dst_after"), F.col("p").alias("dst_p"), F.col("text").alias("dst_text"),
    )


def _beginnings(lines: DataFrame, classes: Column, low: int, high: int, far: bool, common: bytes = b"") -> DataFrame:
    """(key, src, src_in, src_size, ...) of the first gram of every window of a line as long as the stretches of the lines that are no shorter.

    A gram that is the first of several windows is given once. The text begins as many characters before it as a stretch may.
    """
    size = F.col("size")
    longest = F.floor(size * EDITS / (EDITS - 1)).cast("int")
    parts = _letters(lines.withColumn("class", _class(size)).filter(classes)).withColumn("width", _width())
    parts = parts.select("*", F.explode(F.array_distinct(F.array(_stretch_of(size), _stretch_of(longest)))).alias("p")).withColumn("last", F.least(size - F.col("p"), (size - F.col("width") * low).cast("int")))
    parts = parts.withColumn("from", F.greatest(F.lit(0), size - F.col("width") * high - STRETCH).cast("int")).filter((F.col("p") >= LEAST_STRETCH) & (F.col("from") <= F.col("last")))
    # a number that is not the same in each run keeps the filter from being moved below the hashes, which would be made many times then
    rows = parts.select("node", "component", "size", "class", "codes", "width", "p", F.explode(F.sequence("from", "last")).alias("at")).select("*", *_grams(), F.monotonically_increasing_id().alias("once"))
    # the first gram was another one's in the window before, if that left or this one's last gram comes before all others
    rows = _ordered(rows, common).filter((F.col("once") >= 0) & ((F.col("at") == 0) | (F.col("gram_before") <= F.col("inner")) | (F.col("last_gram") < F.col("inner"))))
    rows = _least_gram(rows).select("node", "component", "size", "class", "codes", "p", "width", "gram", (F.col("at") + F.col("off")).alias("pos"))
    rows = rows.withColumn("place", F.floor((size - F.col("pos")) / F.col("width"))).filter(F.col("place").between(low, high - 1))
    lead = F.least(F.col("pos"), F.lit(INNER))
    return rows.select(
        _key("gram"), F.col("node").alias("src"), F.col("component").alias("src_in"), size.alias("src_size"),
        (size - F.col("pos")).alias("src_end"), lead.alias("src_lead"), _text(F.col("pos") - lead, F.lit(_ahead(far) + INNER)).alias("src_text"),
    )


def _rounds(lines: DataFrame) -> list[tuple[int, int, int, int]]:
    """(least size, greatest size, low, high): classes of length, one or several in a round, or the places of a large one from low to below high."""
    found = lines.groupBy(_class(F.col("size")).alias("class")).agg(F.min("size").alias("least"), F.max("size").alias("most"), F.sum("size").alias("all"), F.max(F.floor(F.col("size") / _width_of(_class(F.col("size"))))).alias("place")).orderBy("class").collect()
    most = max(ROUND, sum(r["all"] for r in found) // ROUNDS)
    rounds, held = [], 0
    for r in found:
        if r["all"] > most:
            places = r["place"] + 1
            parts = min(-(-r["all"] // most), places)
            edges = [places * part // parts for part in range(parts)]
            rounds += [(r["least"], r["most"], low, high) for low, high in zip(edges, [*edges[1:], places], strict=True)]
            held = most
        elif rounds and held + r["all"] <= most:
            rounds[-1] = (rounds[-1][0], r["most"], 0, 1 << 30)
            held += r["all"]
        else:
            rounds.append((r["least"], r["most"], 0, 1 << 30))
            held = r["all"]
    return rounds


def _near_ahead(met: DataFrame, texts: DataFrame, dealt: int) -> DataFrame:
    """(src, dst, settled) of the pairs whose texts, from where a stretch was found, are as near as a stretch that few edits follow asks.

    Up to AHEAD stretches after it have no more edits than they are, and as many characters may move over the window's end.
    Pairs that met at several places (often) are not tried so. Of up to WHOLE characters, only those within the edit similarity are given, as settled; the others are yet to be verified.
    """
    # a number of partitions is named, as Spark would put these few rows, each of which takes long, into a single one
    for of, x in (("dst", "a"), ("src", "b")):
        met = met.repartition(dealt, of).join(texts.select(F.col("node").alias(of), "plain"), of)
        met = met.withColumn("at", F.length("plain") - F.col(f"{of}_end"))
        if of == "dst":
            size, at = F.length("plain"), F.col("at").cast("long")
            count, i = F.floor(size / EDITS) + 1, _first(at, size)
            met = met.select("*", (size <= WHOLE).alias("settled"), (count - 1).cast("int").alias("most"), F.least(count - 1 - i, F.lit(AHEAD)).cast("int").alias("ahead"), (F.floor((F.least(i + AHEAD, count - 1) + 1) * size / count) - at).cast("int").alias("width"))
        met = met.withColumn(x, F.substr("plain", F.col("at") + 1, F.col("width"))).withColumn(f"whole_{x}", F.when(F.col("settled"), F.col("plain"))).drop("plain", "at")
    near = met.filter("CASE WHEN NOT often AND levenshtein(a, b, 2 * ahead) < 0 THEN false WHEN settled THEN levenshtein(whole_a, whole_b, most) >= 0 ELSE true END")
    return near.select("src", "dst", "settled").distinct()


def _met(stretches: DataFrame, beginnings: DataFrame, far: bool) -> DataFrame:
    """(src, dst, src_end, dst_end) where a stretch of dst whose least gram src has too is there as a whole, at a place that the edits allow, and what follows is as near as it must be.

    The ends are the characters from the stretch's beginning to the line's end. In two steps, and with few operations in each, as Java does not compile a long method.
    """
    there = lambda k, n: F.substr("src_text", F.col("at") + k, n)
    own = lambda k, n: F.substr("dst_text", F.lit(1) + k, n)
    p, half, far_end = F.col("dst_p"), F.shiftright("dst_p", 1), F.col("dst_p") - F.shiftright("dst_p", 1)
    longer = (F.col("src_size") < F.col("dst_size")) | (F.col("src_size") == F.col("dst_size")) & (F.col("src") < F.col("dst"))
    ok = longer & F.coalesce(F.col("src_in") != F.col("dst_in"), F.lit(True)) & (F.col("src_size") >= F.col("dst_least"))
    ok = ok & (F.abs(F.col("src_end") - F.col("dst_end")) <= F.col("dst_after")) & (F.col("src_lead") >= F.col("dst_off"))
    ok = ok & (F.substr("src_text", F.col("src_lead") - F.col("dst_off") + 1, p) == F.substr("dst_text", F.lit(1), p))
    ends = [(F.col(x) + F.col("dst_off")).alias(x) for x in ("src_end", "dst_end")]
    # the number keeps the second step from being made a part of the first
    met = stretches.hint("shuffle_hash").join(beginnings, "key").filter(ok)
    met = met.select("src", "dst", *ends, "dst_after", "dst_p", "src_text", "dst_text", (F.col("src_lead") - F.col("dst_off") + 1).alias("at"), F.monotonically_increasing_id().alias("once"))
    ok = (F.col("dst_after") <= 0) | (there(p, half) == own(p, half))
    for moved in (0, -1, 1):
        ok = ok | (there(p + half + moved, far_end) == own(p + half, far_end))
    if far:  # as in _near_ahead, by fewer stretches
        ahead = F.least(F.col("dst_after"), F.lit(SOON))
        ok = ok & (F.call_function("levenshtein", own(F.lit(0), (ahead + 1) * STRETCH), there(F.lit(0), (ahead + 1) * STRETCH), ahead * 2) >= 0)
    return met.filter((F.col("once") >= 0) & ok).select("src", "dst", "src_end", "dst_end")


@contextlib.contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    before = {name: spark.conf.get(name) for name in SETTINGS}
    try:
        for name, value in SETTINGS.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def exact_links(texts: DataFrame, components: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(src, dst) of all lines (node, plain, size) within the edit similarity that are in different components; None where there is no line."""
    lines = texts.join(_joinable(components, components), "node", "left").repartitionByRange("size").sortWithinPartitions("size")
    lines = scratch.save(lines, "exact-lines")
    scratch.drop("texts")
    dealt = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near, common = None, _common_grams(lines)
    for n, (least, most, low, high) in enumerate(_rounds(lines)):
        longest = most * EDITS // (EDITS - 1)
        # a class of length is in one round, or in as many as its places are dealt to
        classes = F.col("class").between(_class(F.lit(least)), _class(F.lit(most)))
        here = lambda to: lines.filter(F.col("size").between(least, to)).repartition(dealt, "node")  # noqa: B023, E731
        far = least > WHOLE
        met = _met(_stretches(here(longest), classes, low, high, far, common), _beginnings(here(most), classes, low, high, far, common), far)
        # near copies meet at many places: such a pair is one row, and compared whole
        met = met.groupBy("src", "dst").agg(F.min(F.struct("src_end", "dst_end")).alias("spot"), (F.count("*") > 1).alias("often"))
        with _settings(texts.sparkSession):
            met = scratch.save(met.select("src", "dst", "spot.*", "often"), f"exact-{n}")
        known = lines.filter(F.col("size").between(least, longest)).select("node", "plain")
        found = scratch.save(_near_ahead(met, known, dealt), f"near-{n}")
        scratch.drop(f"exact-{n}")
        near = found if near is None else near.unionByName(found)
    if near is None:
        return None
    rest = scratch.save(verified(near.filter("NOT settled").select("src", "dst"), lines), "near-rest").filter("link")
    scratch.drop("exact-lines")
    return near.filter("settled").select("src", "dst").unionByName(rest.select("src", "dst"))


def fuzzy_components(lines: DataFrame, docs: DataFrame, doc_id: str, text: str, scratch: Scratch) -> DataFrame:
    """(node, component) of the lines that link to another; from (node, doc, copy, at, size, bits, begin, ...)."""
    texts = _texts(lines.filter(F.col("size") >= EDITS - 1).select("node", *ADDRESS), docs, doc_id, text, scratch)
    keys = F.array(*CUT, *block_keys(F.col("bits"), F.col("size")))
    pairs = scratch.save(_stars(_buckets(lines.filter(F.col("size") >= EDITS).select("node", F.explode(keys).alias("key")))).distinct(), "bucketed")
    links = scratch.save(verified(pairs, texts), "stars").filter("link").select("src", "dst")
    components = scratch.save(connected_components(links, scratch, "first"), "components-1")
    scratch.drop("bucketed", "stars")
    more = exact_links(texts, components, scratch)
    components = components if more is None else _joined(components, more, scratch, "exact")
    scratch.drop("texts")
    return components


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc, copy, at, kept_doc, kept_at) of every line that leaves, and the occurrence that stays in its place."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    found = compared(scratch.save(line_hashes(docs, doc_id, text), "found", hashes=True), least_words)
    distinct = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in (*ADDRESS, "size", "bits", *CUT)])
    # frequent lines get small numbers
    rare = F.greatest(31 - _doubling(F.col("n")), F.lit(0)).cast("long")
    lines = scratch.save(distinct.withColumn("node", F.shiftleft(rare, 57).bitwiseOR(F.monotonically_increasing_id())), "lines", hashes=True)
    components = fuzzy_components(lines, docs, doc_id, text, scratch)
    grouped = lines.select("node", "h1", "h2", "n").join(_joinable(components, components), "node", "left").filter(F.col("component").isNotNull() | (F.col("n") > 1))
    grouped = scratch.save(grouped.select("h1", "h2", F.coalesce("component", "node").alias("group")), "grouped")
    members = scratch.save(found.select(*ADDRESS, "h1", "h2").join(_joinable(grouped, grouped), ["h1", "h2"]).select(*ADDRESS, "group"), "members")
    scratch.drop("found", "lines", "grouped")
    # written first: joined to its own aggregation, a large group would be one task's; so it is broadcast, or its rows are split by Spark
    kept = scratch.save(members.groupBy("group").agg(F.min(F.struct(*ADDRESS)).alias("kept")), "kept")
    joined = members.join(_joinable(kept, kept), "group").filter(F.struct(*ADDRESS) != F.col("kept"))
    repeated = scratch.save(joined.select(*ADDRESS, F.col("kept.doc").alias("kept_doc"), F.col("kept.at").alias("kept_at")), "repeated")
    scratch.drop("members", "kept")
    return repeated


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gone: str | None = None, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents without their repeated lines; ``gone``, if given, names a column for the numbers of the lines that left."""
    repeated = repeated_lines(docs, doc_id, text, least_words)
    per_doc = repeated.groupBy(F.col("doc").alias("__line_doc"), F.col("copy").alias("__line_of")).agg(F.sort_array(F.collect_set("at")).alias("__line_gone"))
    per_doc = _joinable(per_doc, repeated)
    joined = docs.withColumn("__line_copy", F.xxhash64(text)).join(per_doc, (F.col(doc_id) == F.col("__line_doc")) & (F.col("__line_copy") == F.col("__line_of")), "left")
    # a step of its own, so that the text is split once and not for each line
    joined = joined.withColumn("__lines", F.when(F.col("__line_gone").isNotNull(), F.split(F.col(text), "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__line_gone"))
    left = F.array_join(F.transform(stay, lambda at: F.get(F.col("__lines"), at)), "\n")
    out = joined.withColumn(text, F.when(F.col("__line_gone").isNull(), F.col(text)).otherwise(left))
    if gone is not None:
        out = out.withColumn(gone, F.coalesce("__line_gone", F.array().cast("array<int>")))
    return out.drop("__line_doc", "__line_of", "__line_gone", "__line_copy", "__lines")
