"""URL filters: written rules first, then association rules mined from labelled pages.

A url is a set of tokens.  Spark's FP-growth finds the token combinations that are
frequent among labelled pages together with the label `block`.  A combination becomes a
rule if its confidence is a multiple of the share of blocked pages (its lift), more than
chance makes likely, and no part of it is a rule already.  A rule is indexed by its rarest token, so a
url meets only rules that share a rare token with it; the rest of the rule is then
compared.  Everything runs as DataFrame operations in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.session import written

ALLOW, BLOCK = "allow", "block"
_CLASS = "="
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """A written rule: a host with all its subdomains, and what their path starts with."""

    verdict: str
    text: str  # host, then path

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def written_rule(host_: Column, path_: Column, rules: list[Rule]) -> Column:
    """The longest written rule that fits, as struct(length, rule, verdict); null for none."""
    fits = [
        F.when(
            ((host_ == r.host) | host_.endswith(f".{r.host}")) & path_.startswith(r.path),
            F.struct(F.lit(len(r.text)).alias("length"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")


def tokens(url: Column) -> Column:
    """The distinct tokens of a url: host, runs of letters of the host and of the path, query keys, fragment.

    A null url, or one without ://, has the tokens of its query and fragment, if any.
    """
    h, p = host(url), path(url)
    tagged = lambda tag, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))
    words = lambda text: F.split(F.translate(text, _UPPER, _LOWER), r"[^\p{L}\p{M}]+")
    query = F.coalesce(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"^([^=]*)", 1))
    return F.array_distinct(
        F.concat(
            tagged("host:", F.array(h)),
            tagged("in host:", words(h)),
            tagged("in path:", words(p)),
            tagged("query:", keys),
            F.when(F.contains(F.coalesce(url, F.lit("")), F.lit("#")), F.array(F.lit("fragment:"))).otherwise(F.array().cast("array<string>")),
        )
    )


_RULES = "rule_id long, key string, rest array<string>, confidence double, support double"


def mine(
    labelled: DataFrame, min_support: float = 0.002, min_lift: float = 1.5, least: int = 5, chance: float = 1.64, partitions: int | None = None
) -> DataFrame:
    """(url, blocked boolean) -> association rules tokens => block: rule_id, key, rest, confidence, support.

    Rows without a url or label do not count.  A rule is held up by min_support of the rows
    and by `least` blocked rows at least; its confidence is min_lift times the share b of
    blocked rows, and above b by `chance` standard deviations of a share of its n rows,
    sqrt(b (1 - b) / n).  A rule that contains another is dropped, as it blocks nothing more.
    key is the rule's rarest token, ties to the first by code point; rest its other tokens.
    Of no rows, or no blocked ones, there are no rules.
    """
    spark = labelled.sparkSession
    rows = labelled.where("url is not null and blocked is not null")
    said = F.when(F.col("blocked"), F.lit(_CLASS + BLOCK)).otherwise(F.lit(_CLASS + ALLOW))
    items = written(rows.select(F.array_append(tokens(F.col("url")), said).alias("items")), "urltokens")
    n, bad = items.agg(F.count("*"), F.count_if(F.array_contains("items", _CLASS + BLOCK))).first()
    if n < least or not bad:
        return spark.createDataFrame([], _RULES)
    growth = FPGrowth(itemsCol="items", minSupport=max(min_support, least / n), minConfidence=min(1.0, min_lift * bad / n))
    if partitions:
        growth = growth.setNumPartitions(partitions)
    model = growth.fit(items)
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    found = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == _CLASS + BLOCK))
    over = F.sqrt(F.lit(bad / n * (1 - bad / n)) * F.col("confidence") / (F.col("support") * F.lit(n)))
    found = found.where((F.col("lift") >= min_lift) & (F.col("confidence") - F.lit(bad / n) >= F.lit(chance) * over))
    found = found.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support").where(~F.exists("tokens", lambda x: x.startswith(_CLASS)))
    found = written(found.withColumn("rule_id", F.xxhash64("tokens")), "urlfound")
    rarest = (
        found.select("rule_id", F.explode("tokens").alias("token"))
        .join(single, "token")
        .groupBy("rule_id")
        .agg(F.min(F.struct("freq", "token"))["token"].alias("key"))
    )
    ruled = found.join(rarest, "rule_id").select(
        "rule_id", "key", F.array_remove("tokens", F.col("key")).alias("rest"), "confidence", "support"
    )
    part = ruled.select("key", F.col("rest").alias("_rest"))
    larger = found.select("rule_id", "tokens", F.explode("tokens").alias("key")).join(part, "key")
    larger = larger.where((F.size("_rest") + 1 < F.size("tokens")) & (F.size(F.array_except("_rest", "tokens")) == 0))
    return ruled.join(larger.select("rule_id").distinct(), "rule_id", "left_anti")


def judge(pages: DataFrame, rules: list[Rule], mined: DataFrame) -> DataFrame:
    """(page_id, url) -> page_id, host, path, rule, verdict, confidence; one row per row.

    The longest written rule decides; where none fits, a mined rule blocks, and everything
    else is allowed.  confidence is that of the best mined rule that matches, null for none.
    A null url has an empty host and path and is allowed.  Every distinct url is matched
    once; copies and repeated rows get equal rows.
    """
    index = written(mined, "urlrules")
    urls = pages.where("url is not null").select("url").distinct().withColumn("_t", tokens(F.col("url")))
    met = urls.select("url", "_t", F.explode("_t").alias("key")).join(index, "key")
    matched = met.where(F.size(F.array_except("rest", "_t")) == 0).groupBy("url").agg(F.max("confidence").alias("confidence"))
    rows = pages.select(F.col("page_id"), F.col("url")).join(matched, "url", "left")
    rows = rows.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "confidence")
    rows = rows.withColumn("_rule", written_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("_rule.verdict", F.when(F.col("confidence").isNotNull(), F.lit(BLOCK)), F.lit(ALLOW))
    return rows.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "confidence")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels (doc_id, quality, toxic) of pages (page_id = doc_id): blocked if any says poor or toxic."""
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    each = labels.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(bad).alias("blocked"))
    return pages.select("page_id", "url").join(each, F.col("page_id") == F.col("doc_id")).select("url", "blocked")
