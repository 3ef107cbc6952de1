"""Bounded samples of rows, to fit the classifiers on."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansight.sources.scratch import ease

#: Most bytes of a sample's texts. A text that does not fit is left out whole.
MOST_BYTES = 64 << 20


def texts_of(docs: DataFrame, chosen: DataFrame, most_bytes: int = MOST_BYTES) -> pd.DataFrame:
    """The chosen rows (doc_id, place, ...), whose number is bounded, with their texts; by place, so that a rerun gives the same.

    Of rows with the same id the smallest text counts. Texts are taken in the order of their
    places as long as they fit into ``most_bytes``.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy(*chosen.columns).agg(F.min("text").alias("text"))
    upto = F.sum(F.octet_length("text")).over(Window.orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = texts.withColumn("upto", upto).filter(F.col("upto") <= most_bytes).drop("upto").toPandas()
    return found.sort_values(["place", "doc_id"]).reset_index(drop=True)


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, learn: Column) -> pd.DataFrame:
    """At most ``per_class`` texts of each label 0 and 1, with ``share``: how many labelled rows each stands for.

    Rows are taken in the order of a hash of the id. Only ids and labels are sorted; the
    chosen ids, whose number is bounded, then pick the texts by a broadcast join.
    """
    usable = labels.filter(learn & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"), F.xxhash64("doc_id").alias("place")).distinct()
    totals = {row["label"]: row["count"] for row in usable.groupBy("label").count().collect()}
    # a label's first rows are kept by every task, so no task sorts all rows of a label
    first = lambda label: usable.filter(F.col("label") == label).orderBy("place", "doc_id").limit(per_class)
    found = texts_of(docs, first(0).unionByName(first(1)))
    ease(docs.sparkSession._jvm)
    found = found.sort_values(["doc_id", "text"]).reset_index(drop=True)
    taken = found["label"].value_counts().to_dict()
    found["share"] = found["label"].map(lambda x: totals[x] / taken[x]).astype(float)
    return found
