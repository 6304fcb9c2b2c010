"""Mixing sources to target weights, with hash thresholds instead of a sort.

Every document has a 60-bit hash.  A source's share of the mix is a number of whole
passes over it and a budget of words for one more, partial pass, which takes the
documents whose hash lies under the source's threshold.  Thresholds nest: what a smaller
budget takes, a larger one takes too.

The thresholds come from histograms.  Words are summed by source and the top 12 bits of
the hash; the bucket in which a source's budget ends is refined by the next 12 bits, and
what is left of it (a sixteen-millionth of the source) by whole hashes.  The documents
are then filtered by comparing hashes; they are never sorted or moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.session import written

_BITS = 12
_HASH_BITS = 60


def words(text: Column) -> Column:
    """The number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash60(key: Column, salt: str) -> Column:
    """The first 60 bits of an MD5, as a long: the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), key).cast("binary")), 1, _HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, size) -> source, size, target: words of the mix that each source is to give.

    Sources by code point, null last, weigh `weights` in turn.  share * all sizes is split
    by weight; a target stops at most * size, and what is over is split again by weight
    among the others, until none is above.  That settles at one level L with
    target = min(most * size, L * weight): in order of most * size / weight, the first
    sources are capped, and L is what is left over for the weight that is left.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("_rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int")).cast("long")
    weighed = weighed.select("source", "size", "_rank", weight.alias("_w"), (F.col("size") * most).alias("_cap"))
    up = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    level = weighed.withColumns(
        {
            "_all": F.sum("size").over(everyone) * F.lit(float(share)),
            "_capped": F.coalesce(F.sum("_cap").over(up), F.lit(0)),
            "_left": F.sum("_w").over(everyone) - F.coalesce(F.sum("_w").over(up), F.lit(0)),
        }
    ).withColumn("_level", (F.col("_all") - F.col("_capped")) / F.col("_left"))
    # the level holds from the first source on that is not capped by it
    first = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), F.col("_rank"), F.col("_level")))).over(everyone)
    level = level.withColumn("_from", first)
    position = F.struct((F.col("_cap") / F.col("_w")).alias("col1"), F.col("_rank").alias("_rank"))
    at = F.struct(F.col("_from.col1").alias("col1"), F.col("_from._rank").alias("_rank"))
    target = F.when(F.col("_from").isNull() | (position < at), F.col("_cap").cast("double")).otherwise(F.col("_from._level") * F.col("_w"))
    return level.select("source", "size", F.least(target, F.col("_cap").cast("double")).alias("target"))


def _ended(histogram: DataFrame, by: list[str]) -> DataFrame:
    """The first bucket of each source (group `by`) that ends above its budget, and the words before it."""
    upto = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    summed = histogram.withColumn("_end", F.sum("n").over(upto))
    found = summed.where(F.col("_end") + F.col("before") > F.col("budget"))
    return found.groupBy(*by).agg(
        F.min("bucket").alias("bucket"), F.min("_end").alias("_e"), F.min_by("n", "bucket").alias("_n"), F.min_by(F.struct("before", "budget"), "bucket").alias("_b")
    ).select(*by, "bucket", F.col("_b.budget").alias("budget"), (F.col("_b.before") + F.col("_e") - F.col("_n")).alias("before"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """sized (source key _s, hash, size), budgets (_s, budget) -> _s, threshold.

    A source takes the documents with hash < threshold.  Among the hashes of the bucket in
    which the budget ends, one is taken if the middle of its words is within the budget, so
    a source misses its budget by half of one hash's words at most (documents with an equal
    hash, as repeated rows have, go together).  A source whose budget holds all of it has no
    row here.
    """
    shift = _HASH_BITS - _BITS
    first = sized.groupBy("_s", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("n"))
    first = first.join(budgets, "_s").withColumn("before", F.lit(0).cast("long"))
    one = written(_ended(first, ["_s"]).withColumnRenamed("bucket", "_b1"), "mix1")
    inside = sized.withColumn("_b1", F.shiftright("hash", shift)).join(one, ["_s", "_b1"])
    inside = written(inside, "mixinside")
    second = inside.groupBy("_s", "_b1", F.shiftright("hash", shift - _BITS).alias("bucket")).agg(
        F.sum("size").alias("n"), F.first("budget").alias("budget"), F.first("before").alias("before")
    )
    two = written(_ended(second, ["_s"]).withColumnRenamed("bucket", "_b2"), "mix2")
    last = inside.select("_s", "hash", "size", F.shiftright("hash", shift - _BITS).alias("_b2")).join(two, ["_s", "_b2"])
    last = last.groupBy("_s", "hash").agg(F.sum("size").alias("n"), F.first("budget").alias("budget"), F.first("before").alias("before"))
    upto = Window.partitionBy("_s").orderBy("hash").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("_end", F.col("before") + F.sum("n").over(upto))
    within = 2 * F.col("_end") - F.col("n") <= 2 * F.col("budget")
    return last.groupBy("_s").agg(F.coalesce(F.max(F.when(within, F.col("hash") + 1)), F.min("hash")).alias("threshold"))


def mix(
    docs: DataFrame, carried: list[str], weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, salt: str = "mix"
) -> DataFrame:
    """(doc_id, text, source, carried columns) -> doc_id, size, source_size, target, copies, taken, carried; one row per row.

    copies is how often the mix takes the document (0 to most), taken = copies * size.  A
    null source is a source of its own, a null text has size 0, a null doc_id is replaced by
    the text as the hash's key.  Reruns agree: nothing depends on order or partitions.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit(""))))
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    extra = [F.col(c).alias(f"_c{i}") for i, c in enumerate(carried)]
    each = docs.select("doc_id", source.alias("_s"), hash60(key, salt).alias("hash"), words(F.col("text")).alias("size"), F.col("source").cast("string").alias("_source"))
    sized = written(each.select("_s", "_source", "hash", "size"), "mixsized")
    sizes = sized.groupBy("_s").agg(F.first("_source").alias("source"), F.sum("size").alias("size"))
    goal = targets(sizes, weights, share, most).withColumn("_s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    passes = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("long")
    goal = goal.withColumn("passes", F.least(passes, F.lit(most).cast("long"))).withColumn("budget", F.col("target") - F.col("passes") * F.col("size"))
    goal = written(goal, "mixtargets")
    cut = thresholds(sized.select("_s", "hash", "size"), goal.select("_s", "budget"))
    goal = goal.join(cut, "_s", "left").select(
        "_s", F.col("size").alias("source_size"), "target", "passes", F.coalesce("threshold", F.lit(0)).alias("threshold")
    )
    goal = written(goal, "mixplan")
    again = docs.select("doc_id", *extra, source.alias("_s"), hash60(key, salt).alias("hash"), words(F.col("text")).alias("size"))
    copies = F.least(F.col("passes") + (F.col("hash") < F.col("threshold")).cast("long"), F.lit(most).cast("long"))
    return again.join(goal, "_s").select(
        "doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"),
        *[F.col(f"_c{i}").alias(f"c{i}") for i in range(len(carried))],
    )


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of docs, each as often as the mix takes it (a wordless row is taken as its hash says)."""
    out = mix(docs, docs.columns, **how)
    out = out.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
