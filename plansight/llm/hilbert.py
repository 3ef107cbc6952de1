"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are turned, projected and shifted in several ways, and each way orders them along a
Hilbert curve. Spark range-partitions every ordering. A query meets the vectors whose place in
an ordering is within a window around its own; the windows' findings are merged and reranked by
the exact distance in double precision.

Equal vectors are one point, which keeps its smallest ids, as many as a query can need. So a
crowd of copies takes one place in an ordering and ties resolve exactly.

Defined results: a vector that is null, zero, of another length than most, or holds null or
non-finite components takes no part; with fewer candidates than asked for, all are returned; an
empty table gives an empty table; repeated rows count once; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plansight.llm.common import Scratch

#: Orderings; projected dimensions; bits of a dimension. Window on either side: a share of all points, and at least so many places.
ORDERINGS, DIMENSIONS, BITS = 16, 16, 6
WINDOW_SHARE, LEAST_WINDOW = 0.04, 200
#: Points of a block of an ordering, and places whose queries meet a block together.
BLOCK, QUERY_SPAN = 4096, 409_600
#: Rows that the scale of the projections is taken from.
SAMPLE = 5000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Keys of grid cells (n x d) on the Hilbert curve, as n x (d * bits / 8) bytes that sort along it.

    Works through the bits from the highest: each level exchanges and flips the lower bits
    as the curve turns there, and a Gray code over the dimensions gives the key's bits.
    """
    x = cells.astype(np.uint32).T.copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        here, below = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for k in range(d):
            flip = (x[k] & here) > 0
            swap = np.where(flip, 0, (x[0] ^ x[k]) & below).astype(np.uint32)
            x[0] ^= np.where(flip, below, swap).astype(np.uint32)
            if k:
                x[k] ^= swap
    for k in range(1, d):
        x[k] ^= x[k - 1]
    turned = np.zeros(x.shape[1], np.uint32)
    for level in range(bits - 1, 0, -1):
        turned ^= np.where((x[-1] >> np.uint32(level)) & 1, np.uint32((1 << level) - 1), 0).astype(np.uint32)
    x ^= turned
    return np.packbits(np.stack([(x[k] >> np.uint32(level)) & 1 for level in range(bits - 1, -1, -1) for k in range(d)], axis=1).astype(np.uint8), axis=1)


def _frames(width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each ordering a projection of orthonormal rows, and a shift of up to half the grid."""
    pick = np.random.default_rng(11)
    turns = [np.linalg.qr(pick.normal(size=(width, width)))[0][:, : min(DIMENSIONS, width)] for _ in range(ORDERINGS)]
    return np.stack(turns), pick.random((ORDERINGS, min(DIMENSIONS, width)))


def _vectors(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _order_rows(low: np.ndarray, high: np.ndarray, width: int):
    """A function from rows (uid, vec) to rows (ord, key, uid), one for each ordering."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, shifts = _frames(width)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, uid = _vectors(batch.column(1).to_pylist()), batch.column(0)
            for t in range(ORDERINGS):
                at = ((vectors @ turns[t]) - low[t]) / np.maximum(high[t] - low[t], 1e-300)
                cells = np.clip((np.clip(at, 0, 1) + shifts[t]) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                keys = hilbert_keys(cells, BITS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(uid), t, np.int32)), pa.array([k.tobytes() for k in keys], pa.binary()), uid], ["ord", "key", "uid"])

    return rows


def _nearest(most: int):
    """From cogroups of points (uid, place, vec) and queries (uid, place, window, vec): each query's nearest points in its window."""

    def find(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(queries):
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "uid": pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})
        p, places, uid = _vectors(points["vec"].tolist()), points["place"].to_numpy(), points["uid"].to_numpy()
        squares, out = (p * p).sum(1), []
        for first in range(0, len(queries), 512):
            some = queries.iloc[first : first + 512]
            q = _vectors(some["vec"].tolist())
            rough = squares[None] - 2 * (q @ p.T) + (q * q).sum(1)[:, None]
            rough[np.abs(places[None] - some["place"].to_numpy()[:, None]) > some["window"].to_numpy()[:, None]] = np.inf
            # all that rounding may have exchanged with the last one asked for, and so all that tie with it
            slack = 8e-16 * (p.shape[1] + 8) * (squares.max() + (q * q).sum(1))
            last = np.partition(rough, min(most, len(p)) - 1, axis=1)[:, min(most, len(p)) - 1] + slack
            for k, query in enumerate(some["uid"].to_numpy()):
                chosen = np.flatnonzero((rough[k] <= last[k]) & np.isfinite(rough[k]))
                exact = np.sqrt(((p[chosen] - q[k]) ** 2).sum(1))
                best = np.lexsort((uid[chosen], exact))[:most]
                out.append(pd.DataFrame({"query": np.full(len(best), query), "uid": uid[chosen][best], "distance": exact[best]}))
        return pd.concat(out, ignore_index=True)

    return find


def nearest(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k nearest among the other rows of ``vectors``.

    Queries must be rows of ``vectors``; a query's own id is no candidate.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hilbert")
    as_doubles = F.col(embedding).cast("array<double>").alias("v")
    usable = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), as_doubles).filter(F.col("id").isNotNull() & usable).withColumn("width", F.size("v"))
    widths = rows.groupBy("width").count().orderBy(F.desc("count"), "width").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not widths:
        return empty
    width = widths[0]["width"]
    # points: the window ranks ids before the shuffle already, so a crowd of copies sends k + 1 ids from each task
    rows = rows.filter(F.col("width") == width).select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).distinct()
    first = Window.partitionBy("v").orderBy("id")
    least = rows.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1)
    points = least.groupBy("v").agg(F.min("id").alias("uid"), F.sort_array(F.collect_list("id")).alias("ids"))
    points = scratch.save(points.select("uid", "ids", "v"), "points")
    asked = queries.select(F.col(vec_id).cast("long").alias("query_id"), as_doubles).filter(F.col("query_id").isNotNull() & usable & (F.size("v") == width)).distinct()
    asked = scratch.save(asked.join(points.select("v", "uid"), "v").select("query_id", "uid"), "asked")

    # fit the scale of the projections on a bounded sample
    sample = points.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).select("v").toPandas()
    turns, _ = _frames(width)
    seen = np.einsum("nw,twd->tnd", np.array(sample["v"].tolist(), float), turns)
    low, high = seen.min(1), seen.max(1)
    total = points.count()
    window = max(LEAST_WINDOW, int(np.ceil(WINDOW_SHARE * total)))

    binary = scratch.save(points.select("uid", "v").mapInArrow(_to_bytes, "uid long, vec binary"), "binary")
    ordered = binary.mapInArrow(_order_rows(low, high, width), "ord int, key binary, uid long")
    parts = max(ORDERINGS, int(np.ceil(ORDERINGS * total / 500_000)))
    ordered = ordered.repartitionByRange(parts, "ord", "key", "uid").sortWithinPartitions("ord", "key", "uid")
    ordered = scratch.save(ordered.select("ord", "uid", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row")), "ordered")
    # a place is the row's number in its ordering: rows before it in its part, and in the ordering's earlier parts
    sizes = ordered.groupBy("ord", "part").agg(F.count("*").alias("n"), F.min("row").alias("from"))
    before = Window.partitionBy("ord").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("from")).select("ord", "part", "start")
    placed = ordered.join(starts, ["ord", "part"]).select("ord", "uid", (F.col("row") + F.col("start")).alias("place"))
    placed = scratch.save(placed.join(binary, "uid"), "placed")
    scratch.drop("ordered")

    reach = lambda size: F.sequence(F.greatest(F.floor((F.col("place") - window) / size), F.lit(0).cast("long")), F.floor((F.col("place") + window) / size))
    block, span = F.floor(F.col("place") / BLOCK), F.floor(F.col("place") / QUERY_SPAN)
    met_points = placed.select("ord", block.alias("block"), F.explode(reach(QUERY_SPAN)).alias("span"), "uid", "place", "vec")
    met_queries = placed.join(asked.select("uid").distinct(), "uid", "left_semi").select("ord", F.explode(reach(BLOCK)).alias("block"), span.alias("span"), "uid", "place", F.lit(window).cast("long").alias("window"), "vec")
    met_queries = met_queries.select(*[F.col(c).alias(c) for c in met_queries.columns])  # columns of its own, as both sides come from one table
    cell = ["ord", "block", "span"]
    found = met_points.groupBy(*cell).cogroup(met_queries.groupBy(*cell)).applyInPandas(_nearest(k + 1), "query long, uid long, distance double")

    # merge the orderings, then give points their ids back
    merged = found.groupBy("query", "uid").agg(F.min("distance").alias("distance"))
    by_distance = Window.partitionBy("query").orderBy("distance", "uid")
    merged = scratch.save(merged.withColumn("place", F.row_number().over(by_distance)).filter(F.col("place") <= k + 1).select("query", "uid", "distance"), "merged")
    scratch.drop("placed", "binary")
    answers = asked.withColumnRenamed("uid", "query").join(merged, "query").join(points.select("uid", "ids"), "uid").select("query_id", F.explode("ids").alias("vec_id"), F.col("distance").alias("score"))
    by_score = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = answers.filter(F.col("vec_id") != F.col("query_id")).withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in values], pa.binary())], ["uid", "vec"])
