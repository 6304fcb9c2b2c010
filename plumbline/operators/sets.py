"""Set operations in which one side wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlay(base: DataFrame, *over: DataFrame, key: str) -> DataFrame:
    """Union by key; a later table's row replaces an earlier one's.  `layer` tells whose row it is."""
    layers = [d.withColumn("layer", F.lit(i).cast("long")) for i, d in enumerate((base, *over))]
    whole = layers[0]
    for d in layers[1:]:
        whole = whole.unionByName(d)
    others = [c for c in whole.columns if c != key]
    return whole.groupBy(key).agg(F.max(F.struct("layer", *[c for c in others if c != "layer"])).alias("_r")).select(key, "_r.*")


def first_wins(*tables: DataFrame, key: str) -> DataFrame:
    """Union by key; an earlier table's row stays."""
    return overlay(*reversed(tables), key=key).withColumn("layer", F.lit(len(tables) - 1).cast("long") - F.col("layer"))


def pending(found: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What was found and is not done."""
    return found.join(done.select(key), key, "left_anti")


def fill(salvaged: DataFrame, reserve: DataFrame, key: str) -> DataFrame:
    """The salvaged rows, and from the reserve only those whose key the salvage lacks."""
    return salvaged.unionByName(reserve.join(salvaged.select(key), key, "left_anti"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side only, as multisets, with `side`."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))
