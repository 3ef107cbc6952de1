"""Mixing sources to target weights, in DataFrame operations alone.

Tokens are counted per source, each source gets a target by water filling, and a document is
emitted floor(rate) times plus once more by a seeded coin whose chance is the rate's fraction.

Defined results: a null text has size 0; a null source is a source of its own and comes last;
a source without words has target 0 and rate 0, so its documents get no copy; repeated rows
share their id's coin; an empty table gives an empty table; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the sources in the order of their code points, repeating; share of all words that the mix takes; most repetitions.
WEIGHTS, SHARE_PERCENT, MOST = (5, 2, 1), 150, 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def coin(doc_id: Column, seed: str = SEED) -> Column:
    """A number from 0 to below 1 that the id and the seed alone decide."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|" + seed)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """One row per source from (source, size): source, source_size, target.

    A target is the smaller of the source's cap and its weight times a common level; the
    level is where the targets use up the share. Sources in the order of cap over weight are
    capped up to some place, so running sums over that order give the level of every place,
    and the right one is the first at which the next source stays below its cap. These
    windows hold one row per source, after the sizes were summed.
    """
    summed = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = summed.withColumn("place", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", "place", weight.cast("long").alias("weight"), (F.col("source_size") * most).alias("cap"))
    by_fill = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("place").asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = (F.sum("source_size").over(everything) * share_percent / 100.0 - (F.sum("cap").over(by_fill) - F.col("cap"))) / (F.sum("weight").over(everything) - F.sum("weight").over(by_fill) + F.col("weight"))
    levels = ranked.withColumn("level", level)
    # a source fits below its cap only from the place on where the level does not reach the cap
    settled = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("fill"), "place", "level"))).over(everything)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(settled * F.col("weight"), F.col("cap").cast("double")))
    return levels.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """Every document with its size, source_size, target and number of copies.

    The table of sources has one row for each; Spark joins it by broadcast only where its
    size is below the session's threshold and splits skewed sources otherwise.
    """
    own = {name: f"__mix_{name}" for name in ("size", "source", "source_size", "target", "copies")}
    sized = docs.withColumns({own["size"]: word_count(F.col(text)), own["source"]: F.col(source)})
    targets = source_targets(sized.select(F.col(own["source"]).alias("source"), F.col(own["size"]).alias("size")))
    targets = targets.select(F.col("source").alias("__mix_of"), F.col("source_size").alias(own["source_size"]), F.col("target").alias(own["target"]))
    joined = sized.join(targets, F.col(own["source"]).eqNullSafe(F.col("__mix_of"))).drop("__mix_of", own["source"])
    rate = F.when(F.col(own["source_size"]) > 0, F.col(own["target"]) / F.col(own["source_size"])).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (coin(F.col(doc_id), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn(own["copies"], copies)


def emit(mixed: DataFrame, keep: list[str]) -> DataFrame:
    """The mix itself: each document as often as its number of copies says."""
    return mixed.filter(F.col("__mix_copies") > 0).withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_copies")))).select(*keep)
