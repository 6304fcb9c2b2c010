"""Links between keyed records: existence, resolution, first match, ladders, as-of and range lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.shared import written


def present(wanted: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """The wanted keys that exist."""
    return wanted.join(targets.select(key), key, "left_semi")


def missing(wanted: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """The wanted keys that do not exist; a null key never does."""
    return wanted.join(targets.select(key), key, "left_anti")


def missing_by_kind(links: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """For each kind of link (sources (src, dst), targets (dst)): edge, missing dst, how many refer to it."""
    out = None
    for edge, (sources, targets) in links.items():
        found = missing(sources, targets, "dst").groupBy("dst").agg(F.count("*").alias("n_refs"), F.min("src").alias("first_src"))
        found = found.select(F.lit(edge).alias("edge"), "dst", "n_refs", "first_src")
        out = found if out is None else out.unionByName(found)
    return out


def resolve(links: DataFrame, targets: DataFrame, key: str, kind: str, implied: str) -> DataFrame:
    """links with `status`: ok, missing, or type where the target's kind is not the implied one.

    targets (key, kind).  A link that implies nothing (null) is ok at any kind.
    """
    joined = links.join(targets.select(key, F.col(kind).alias("_kind"), F.lit(True).alias("_there")), key, "left")
    status = (
        F.when(F.col("_there").isNull(), F.lit("missing"))
        .when(F.col(implied).isNotNull() & (F.col(implied) != F.col("_kind")), F.lit("type"))
        .otherwise(F.lit("ok"))
    )
    return joined.withColumn("status", status).drop("_kind", "_there")


def first_match(wanted: DataFrame, places: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each wanted key with its first place in the given order; keys without one keep nulls."""
    best = places.groupBy(key).agg(F.min(F.struct(*order, *[c for c in places.columns if c not in (key, *order)])).alias("_p"))
    return wanted.join(best.select(key, "_p.*"), key, "left")


def ladder(candidates: DataFrame, key: str, rung: str, proof: Column) -> DataFrame:
    """For each key the candidate of the lowest rung whose proof holds; keys without one have no row."""
    others = [c for c in candidates.columns if c not in (key, rung)]
    return candidates.where(proof).groupBy(key).agg(F.min(F.struct(rung, *others)).alias("_c")).select(key, "_c.*")


def newest_valid(history: DataFrame, valid: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """For each group the newest entry of its history whose key is valid (an as-of pick)."""
    good = history.join(valid.select(key), key, "left_semi")
    return good.groupBy(group).agg(F.max_by(key, order).alias(key), F.max(order).alias(order))


def in_layer(points: DataFrame, layers: DataFrame, position: str, low: str, high: str, width: int) -> DataFrame:
    """points joined to the one layer with low <= position < high.

    A range join made an equi-join: layers are listed under every cell of `width` positions
    that they touch, and a point looks in its own cell.  No layer table is compared whole.
    """
    cell = lambda c: F.floor(F.col(c) / width)
    listed = layers.withColumn("_cell", F.explode(F.sequence(cell(low), F.floor((F.col(high) - 1) / width))))
    met = points.withColumn("_cell", cell(position)).join(listed, "_cell")
    return met.where((F.col(position) >= F.col(low)) & (F.col(position) < F.col(high))).drop("_cell")


def compare_positional(left: DataFrame, right: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """Two lists by (key, position): the positions at which they differ, and how."""
    a = left.select(key, position, F.col(value).alias("left_value"))
    b = right.select(key, position, F.col(value).alias("right_value"))
    both = a.join(b, [key, position], "full_outer")
    how = (
        F.when(F.col("right_value").isNull(), F.lit("ends early"))
        .when(F.col("left_value").isNull(), F.lit("too long"))
        .when(F.col("left_value") != F.col("right_value"), F.lit("mismatch"))
    )
    return both.withColumn("difference", how).where("difference is not null")


def ranked(df: DataFrame, by: list[Column], name: str, within: list[str] | None = None) -> DataFrame:
    """df with 0-based positions in an order, within groups."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*(within or [])).orderBy(*by)) - 1).cast("long"))


def positions(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """0-based positions in one total order, without one task that sorts everything.

    The rows are dealt by range and sorted in place; the partitions' sizes, one row each,
    give every partition its first position.
    """
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "positions")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1
    return dealt.withColumn("_local", local).join(starts, "_part").withColumn(name, (F.col("_start") + F.col("_local")).cast("long")).drop("_part", "_local", "_start")
