"""Adjacent-row rules: order, spans, first violations, batches, cumulative histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.links import positions


def out_of_order(df: DataFrame, by: list[str], value: str, within: list[str], strict: bool = False) -> DataFrame:
    """Rows whose value is below (strict: not above) the one before in its group, with `previous`."""
    before = F.lag(value).over(Window.partitionBy(*within).orderBy(*by))
    bad = F.col("previous") >= F.col(value) if strict else F.col("previous") > F.col(value)
    return df.withColumn("previous", before).where(bad)


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys with more than one row, and how many."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def spans(df: DataFrame, by: str, within: list[str], end: Column) -> DataFrame:
    """Each entry's end: the start of the next in its group, or for the last one `end`."""
    following = F.lead(by).over(Window.partitionBy(*within).orderBy(by))
    return df.withColumn("end", F.coalesce(following, end))


def first_violation(findings: DataFrame, group: str, order: list[str], text: str) -> DataFrame:
    """For each group the text of its first finding."""
    return findings.groupBy(group).agg(F.min(F.struct(*order, text)).alias("_f")).select(group, F.col(f"_f.{order[0]}").alias(order[0]), F.col(f"_f.{text}").alias(text))


def fanout(df: DataFrame, byte: str) -> DataFrame:
    """The cumulative histogram of a leading byte: byte, n, total up to and with it (256 rows at most)."""
    counts = df.groupBy(byte).agg(F.count("*").alias("n"))
    upto = Window.orderBy(byte).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("total", F.sum("n").over(upto))


def batched(df: DataFrame, by: list[str], size: int) -> DataFrame:
    """Rows in batches of `size`, in order."""
    return positions(df, by, "_at").withColumn("batch", F.floor(F.col("_at") / size).cast("long")).drop("_at")


def line_context(lines: DataFrame, kind: str, within: str, order: str, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """Lines that may not stand where they do: allowed gives, for a kind, the kinds before it that are right ('' for the start)."""
    before = F.coalesce(F.lag(kind).over(Window.partitionBy(within).orderBy(order)), F.lit(""))
    bad = F.lit(False)
    for k, preceding in allowed.items():
        bad = bad | ((F.col(kind) == k) & ~F.col("_before").isin(*preceding))
    return lines.withColumn("_before", before).where(bad).drop("_before")
