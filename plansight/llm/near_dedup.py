"""Near-duplicate documents by MinHash bands and sequential Bayesian verification.

Texts with the same set of shingles become one node. Nodes that share a band of MinHashes are
candidates. Their signatures, of hashes that the bands do not use, are compared a batch at a
time: a pair is dropped as soon as the posterior chance that its similarity reaches the
threshold falls below ``MISS``. Pairs that survive the first batches join their nodes to groups,
and within a group the pairs that survive all batches are verified on the full sets of shingles,
which are sequences of words there and not hashes.

A bucket's pivot meets all others first, and only what this leaves outside the pivot's component
meets the rest, in blocks. A group is worked on in blocks of a bounded number of texts and
shingles. Pairs of nodes that are already connected need no check, so a bucket or a group of
copies of one text costs time in proportion to its size; what the blocks leave unconnected is
compared with the whole group, again in blocks.

Defined results: null and empty texts, and those without words, have no shingles and stand
alone; a text of fewer than five words is one shingle; texts of any length are read whole; rows
with the same id are one document; a row with a null id stands alone with a null component;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansight.llm.common import Scratch, mix64, shingle_sets, trim
from plansight.llm.graph import connected_components

#: Words in a shingle; similarity of a link, as a fraction; miss probability of a comparison.
WORDS, SHARE, MISS = 5, (75, 100), 1e-4
#: Bands and hashes in one. A pair at the threshold has none in common once in 9,000 times.
BANDS, ROWS = 24, 4
#: Hashes of the verification, those of a batch, and those that travel with the candidates.
HASHES, BATCH, EARLY = 128, 16, 64
#: Times that a pair may be looked at, by which its miss probability is divided: a pair at the threshold is pruned at any of them once in 18,000 times.
LOOKS = (HASHES + EARLY) // BATCH
#: Most nodes in a block of a bucket, most texts and shingles in a block of a group, and the group's nodes that stand in every block.
BUCKET_BLOCK, GROUP_BLOCK, BLOCK_SHINGLES, PIVOTS = 1024, 512, 1_000_000, 4

#: Ids up to which their table is broadcast (8 bytes an id).
BROADCAST_ROWS = 1_000_000

_SEEDS = mix64(np.arange(1, 2 * (BANDS * ROWS + HASHES) + 1, dtype=np.uint64)).reshape(2, -1)
_XOR, _TIMES = _SEEDS[0], _SEEDS[1] | np.uint64(1)


def minhashes(hashes: np.ndarray, of: slice) -> np.ndarray:
    """The smallest value of each hash function over a set, a few thousand elements at a time."""
    a, b = _XOR[of, None], _TIMES[of, None]
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 2048):
        np.minimum(out, ((hashes[None, k : k + 2048] ^ a) * b).min(1), out=out)
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    return (minhashes(hashes, slice(BANDS * ROWS, None)) >> np.uint64(48)).astype(np.uint16)


def least_matches(compared: int, share: float = SHARE[0] / SHARE[1], miss: float = MISS) -> int:
    """Fewest matches of ``compared`` hashes at which P(similarity >= share) is at least ``miss``, from a uniform prior.

    The posterior after m matches is Beta(m + 1, compared - m + 1); its upper tail is a binomial sum.
    """
    tail = 0.0
    for m in range(compared + 1):
        tail += math.comb(compared + 1, m) * share**m * (1 - share) ** (compared + 1 - m)
        if tail >= miss:
            return m
    return compared


def surviving(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (i, j) of rows that no batch of hashes prunes, and their numbers of matches."""
    matches = np.zeros(len(i), np.int32)
    for k in range(0, left.shape[1], BATCH):
        for part in range(0, len(i), 1 << 16):
            at = slice(part, part + (1 << 16))
            matches[at] += (left[i[at], k : k + BATCH] == right[j[at], k : k + BATCH]).sum(1, dtype=np.int32)
        keep = matches >= least_matches(min(k + BATCH, left.shape[1]), miss=MISS / LOOKS)
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j, matches


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            part = batch.slice(k, 1024)
            sizes, prints, bands, signatures = [], [], [], []
            for hashes in shingle_sets(part.column(1).to_pylist(), WORDS):
                sizes.append(len(hashes))
                if not len(hashes):
                    prints.append((0, 0))
                    bands.append([])
                    signatures.append(b"")
                    continue
                prints.append((int(mix64(hashes).sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix64(hashes ^ np.uint64(0x5851F42D4C957F2D))))))
                low = minhashes(hashes, slice(BANDS * ROWS)).reshape(BANDS, ROWS)
                key = np.arange(1, BANDS + 1, dtype=np.uint64)
                for r in range(ROWS):
                    key = mix64(key ^ low[:, r])
                bands.append(key.view(np.int64))
                signatures.append(signature(hashes).tobytes())
            prints = np.array(prints, np.uint64).reshape(-1, 2).view(np.int64)
            columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "fp1", "fp2", "bands", "sig"])
    trim()


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of equal leading columns, from batches sorted by them; a group ends where the keys change."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        if last is not None and tuple(c[0] for c in columns) != last and held:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def _edges(src: list, dst: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])


def _stars(count: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each row to the row of most pairs that its pairs lead to."""
    degree = np.bincount(np.concatenate([i, j]), minlength=count)
    order = np.argsort(np.concatenate([i, j]), kind="stable")
    beside = np.concatenate([j, i])[order]
    at = np.concatenate(([0], np.cumsum(degree)))
    done, out = np.zeros(count, bool), []
    for root in np.argsort(-degree, kind="stable").tolist():
        if done[root] or not degree[root]:
            continue
        done[root], queue = True, [root]
        while queue:
            x = queue.pop()
            near = beside[at[x] : at[x + 1]]
            near = np.unique(near[~done[near]])
            done[near] = True
            out += [(y, root) for y in near.tolist()]
            queue += near.tolist()
    return out


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (src, dst, sig of src, sig of dst): the pairs whose early hashes survive."""
    for batch in batches:
        if batch.num_rows:
            row = np.arange(batch.num_rows)
            kept, _, _ = surviving(_signatures(batch.column(2)), _signatures(batch.column(3)), row, row)
            yield _edges(batch.column(0).to_numpy()[kept], batch.column(1).to_numpy()[kept])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, block, node, component, minor, sig) sorted by key and block: stars of the nodes whose early hashes survive.

    Only pairs of different components, one of them a minor node, are compared.
    """
    for group in _grouped(batches, 2):
        nodes, component = group.column(2).to_numpy(), group.column(3).to_numpy()
        i, j = _wanted(component, np.array(group.column(4).to_pylist(), bool))
        if len(i):
            signatures = _signatures(group.column(5).combine_chunks())
            i, j, _ = surviving(signatures, signatures, i, j)
            stars = np.array(_stars(len(nodes), i, j), np.int64).reshape(-1, 2)
            yield _edges(nodes[stars[:, 0]], nodes[stars[:, 1]])
    trim()


def _wanted(component: np.ndarray, minor: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of different components; one of them minor, if that is given."""
    i, j = np.triu_indices(len(component), 1)
    wanted = component[i] != component[j]
    if minor is not None:
        wanted &= minor[i] | minor[j]
    return i[wanted], j[wanted]


def word_shingles(text: str) -> set[tuple[bytes, ...]]:
    """The shingles themselves, A-Z taken as a-z; a text of fewer words is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes, both know ASCII only
    return set(zip(*(words[k:] for k in range(WORDS)), strict=False)) if len(words) >= WORDS else {tuple(words)} if words else set()


def linked(left: set, right: set) -> bool:
    """Whether two sets reach the threshold, in whole numbers."""
    if SHARE[1] * min(len(left), len(right)) < SHARE[0] * max(len(left), len(right)):
        return False
    same = len(left & right)
    return SHARE[1] * same >= SHARE[0] * (len(left) + len(right) - same)


def _verify(nodes: np.ndarray, texts: list[str], component: np.ndarray, minor: np.ndarray | None) -> Iterator[tuple[int, int]]:
    """A spanning forest of the exact links. ``component``: what is known to be connected; ``minor``: if given, one of a pair must be so."""
    i, j = _wanted(component, minor)
    if not len(i):
        return
    signatures = np.stack([signature(x) for x in shingle_sets(texts, WORDS)])
    i, j, matches = surviving(signatures, signatures, i, j)
    names = {c: k for k, c in enumerate(dict.fromkeys(component.tolist()))}
    of, parent, sets = [names[c] for c in component.tolist()], list(range(len(names))), {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def shingles(x: int) -> set:
        if x not in sets:
            sets[x] = word_shingles(texts[x])
        return sets[x]

    order = np.argsort(-matches, kind="stable")
    for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
        a, b = root(of[x]), root(of[y])
        if a != b and linked(shingles(x), shingles(y)):
            parent[a] = b
            yield int(nodes[x]), int(nodes[y])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (group, block, node, component, minor, text) sorted by group and block: exact links. A null minor stands for any."""
    src, dst = [], []
    for group in _grouped(batches, 2):
        if group.num_rows > 1:
            nodes, component = group.column(2).to_numpy(), group.column(3).to_numpy()
            minor = None if group.column(4).null_count else np.array(group.column(4).to_pylist(), bool)
            for x, y in _verify(nodes, group.column(5).to_pylist(), component, minor):
                src.append(x)
                dst.append(y)
        if len(src) >= 65536:
            yield _edges(src, dst)
            src, dst = [], []
    yield _edges(src, dst)
    trim()


EDGE = "src long, dst long"


def _run(rows: DataFrame, keys: list[str], function) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(function, EDGE)


def _block(node: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), node), blocks)


def _cells(rest: DataFrame, group: str) -> DataFrame:
    """Rows (group, block, node, component, minor) in which every minor node meets every node of its group.

    From (group, node, component, minor, wide, deep): a block (row, column) holds one of ``deep``
    parts of the minor nodes and one of ``wide`` parts of all.
    """
    count = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    across = rest.select(group, "node", "component", "wide", F.explode(count("deep")).alias("row"), _block("node", F.col("wide")).alias("column"), F.lit(False).alias("minor"))
    down = rest.filter("minor").select(group, "node", "component", "wide", _block("node", F.col("deep")).alias("row"), F.explode(count("wide")).alias("column"), F.lit(True).alias("minor"))
    cells = across.unionByName(down).select(group, (F.col("row") * F.col("wide") + F.col("column")).alias("block"), "node", "component", "minor")
    return cells.groupBy(group, "block", "node", "component").agg(F.max("minor").alias("minor"))


def candidates(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(src, dst): a forest of the pairs that share a band and whose early hashes survive; from (node, bands, sig)."""
    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("size")).filter(F.col("size") > 1)
    bucketed = scratch.save(keys.join(shared, "key"), "bucketed")
    early = nodes.select("node", F.substring("sig", 1, 2 * EARLY).alias("sig"))
    pairs = bucketed.filter(F.col("node") != F.col("pivot")).select(F.col("node").alias("src"), F.col("pivot").alias("dst")).distinct()
    pairs = pairs.join(early.withColumnsRenamed({"node": "src", "sig": "src_sig"}), "src").join(early.withColumnsRenamed({"node": "dst", "sig": "dst_sig"}), "dst")
    stars = scratch.save(pairs.select("src", "dst", "src_sig", "dst_sig").mapInArrow(_survivors, EDGE), "stars")
    components = scratch.save(connected_components(stars, scratch, "stars"), "star-components")

    # what is outside its pivot's component meets the whole bucket
    placed = bucketed.filter(F.col("size") > 2).join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    main = components.select(F.col("node").alias("pivot"), F.col("component").alias("main"))
    placed = placed.join(main, "pivot", "left").withColumn("minor", F.col("component") != F.coalesce("main", "pivot"))
    placed = scratch.save(placed.select("key", "node", "component", "minor", "size"), "placed")
    outside = placed.filter("minor").groupBy("key").agg(F.ceil(F.count("*") / BUCKET_BLOCK).alias("deep"))
    rest = placed.join(outside, "key").withColumn("wide", F.ceil(F.col("size") / BUCKET_BLOCK))
    cells = _cells(rest, "key").join(early, "node").select("key", "block", "node", "component", "minor", "sig")
    more = scratch.save(_run(cells, ["key", "block"], _forest), "rest")
    scratch.drop("bucketed", "placed", "star-components")
    return stars.unionByName(more)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketch = scratch.save(texts.mapInArrow(_sketch, "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, sig binary"), "sketch")
    known = sketch.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    same = ["fp1", "fp2", "n_shingles"]
    sets = scratch.save(known.groupBy(*same).agg(F.min("doc_id").alias("node")), "sets")
    nodes = scratch.save(known.join(sets.withColumnRenamed("node", "doc_id"), ["doc_id", *same], "left_semi").select(F.col("doc_id").alias("node"), "n_shingles", "bands", "sig"), "nodes")
    forest = scratch.save(candidates(nodes, scratch), "forest")
    groups = scratch.save(connected_components(forest, scratch, "groups").select("node", F.col("component").alias("g")).join(nodes.select("node", "n_shingles"), "node"), "grouped")

    # exact links within blocks of a group; the nodes that most pairs led to stand in every block
    blocks = F.ceil(F.greatest(F.count("*") / GROUP_BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES))
    sized = scratch.save(groups.join(groups.groupBy("g").agg(blocks.alias("blocks")), "g").select("g", "node", "n_shingles", "blocks"), "sized")
    roots = forest.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("met")).join(sized.filter(F.col("blocks") > 1), "node")
    by_met = Window.partitionBy("g").orderBy(F.col("met").desc(), "node")
    pivots = roots.withColumn("place", F.row_number().over(by_met)).filter(F.col("place") <= PIVOTS)
    placed = sized.select("g", _block("node", F.col("blocks")).alias("block"), "node").unionByName(
        pivots.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "node")
    )
    placed = placed.distinct().select("g", "block", "node", F.col("node").alias("component"), F.lit(None).cast("boolean").alias("minor"))
    # only grouped texts are needed, twice; ids counted to be few go to the texts, else both are shuffled
    few = sized.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    wanted = sized.select(F.col("node").alias("doc_id"))
    written = texts.filter(F.col("text").isNotNull()).join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), "doc_id", "left_semi")
    written = scratch.save(written.withColumnRenamed("doc_id", "node"), "written")
    links = scratch.save(_run(placed.join(written, "node").select("g", "block", "node", "component", "minor", "text"), ["g", "block"], _exact), "links")
    components = scratch.save(connected_components(links, scratch, "first"), "components")

    # groups of several blocks that are not one component yet: what is outside the largest one against all
    large = sized.filter(F.col("blocks") > 1).join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counts = large.groupBy("g", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    largest = counts.groupBy("g").agg(F.max(F.struct("n", "component", "s")).alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("parts")).filter(F.col("parts") > 1)
    parts = lambda n, s: F.ceil(F.greatest(n / GROUP_BLOCK, s / BLOCK_SHINGLES))
    wide, deep = parts(F.col("n"), F.col("s")), parts(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s"))
    rest = large.select("g", "node", "component").join(largest.select("g", F.col("main.component").alias("main"), wide.alias("wide"), deep.alias("deep")), "g")
    cells = _cells(rest.withColumn("minor", F.col("component") != F.col("main")), "g")
    more = scratch.save(_run(cells.join(written, "node").select("g", "block", "node", "component", "minor", "text"), ["g", "block"], _exact), "more")
    if not more.isEmpty():
        known = components.select(F.col("node").alias("src"), F.col("component").alias("dst"))
        components = scratch.save(connected_components(known.unionByName(more), scratch, "second"), "all-components")
    scratch.drop("nodes", "stars", "rest", "forest", "grouped", "sized", "written", "links", "more")

    members = sketch.select("doc_id", *same).join(sets, same, "left").withColumn("node", F.coalesce("node", "doc_id"))
    joined = members.join(components, "node", "left").withColumn("component_id", F.coalesce("component", "node"))
    return joined.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
