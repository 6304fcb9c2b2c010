"""Rules for names: refs, submodules, control-file aliases, numbers with suffixes, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes that no ref name may hold, besides control bytes and the space.
_REF_FORBIDDEN = r"[\x00-\x20\x7F~^:?\[\\*]"


def refname_ok(name: Column, one_level: bool = False) -> Column:
    """Whether a ref name is well formed.

    No empty component, none that starts with a dot or ends in .lock; no "..", no "@{", no
    forbidden byte, no final dot; not "@" alone; two components at least unless one_level.
    """
    parts = F.split(name, "/")
    bad_part = F.exists(parts, lambda p: (p == "") | p.startswith(".") | p.endswith(".lock"))
    ok = ~name.rlike(_REF_FORBIDDEN) & ~F.contains(name, F.lit("..")) & ~F.contains(name, F.lit("@{")) & ~name.endswith(".") & (name != "@") & ~bad_part
    return ok if one_level else ok & (F.size(parts) > 1)


def refname_fault(name: Column) -> Column:
    """The first rule a ref name breaks, or null."""
    parts = F.split(name, "/")
    return (
        F.when(name == "", F.lit("empty"))
        .when(name == "@", F.lit("at"))
        .when(name.rlike(_REF_FORBIDDEN), F.lit("byte"))
        .when(F.contains(name, F.lit("..")), F.lit("dots"))
        .when(F.contains(name, F.lit("@{")), F.lit("reflog"))
        .when(F.exists(parts, lambda p: p == ""), F.lit("component"))
        .when(F.exists(parts, lambda p: p.startswith(".")), F.lit("dot"))
        .when(F.exists(parts, lambda p: p.endswith(".lock")), F.lit("lock"))
        .when(name.endswith("."), F.lit("final dot"))
        .when(F.size(parts) < 2, F.lit("one level"))
    )


def submodule_name_ok(name: Column) -> Column:
    """Not empty, and no component, by either slash, is two dots."""
    return (name != "") & ~F.exists(F.split(name, r"[/\\]"), lambda p: p == "..")


def may_be_alias(name: Column) -> Column:
    """Whether a name can be an alias of a control file at all: a cheap test that passes all true ones.

    It starts with a dot or a tilde, with g and then i or a tilde, with m and then a or a
    tilde (either case), or a byte above ASCII is among its first two.
    """
    low = F.lower(F.substring(name, 1, 2))
    return low.rlike("^[.~]") | low.rlike("^g[i~]") | low.rlike("^m[a~]") | low.rlike(r"[^\x00-\x7F]")


def size_with_suffix(text: Column) -> Column:
    """Digits with k, m or g behind (powers of 1024) as a long; null for anything else."""
    number = F.try_to_number(F.nullif(F.regexp_extract(text, r"^([0-9]{1,15})[kKmMgG]?$", 1), F.lit("")), F.lit("9" * 15)).cast("long")
    unit = F.lower(F.regexp_extract(text, r"([kKmMgG])$", 1))
    return number * F.when(unit == "k", F.lit(1 << 10)).when(unit == "m", F.lit(1 << 20)).when(unit == "g", F.lit(1 << 30)).otherwise(F.lit(1))


def truth(text: Column) -> Column:
    """Words for yes and no, and numbers; null for anything else.  A null value (a bare key) is yes."""
    low = F.lower(text)
    return (
        F.when(text.isNull() | low.isin("true", "yes", "on"), True)
        .when(low.isin("false", "no", "off", ""), False)
        .when(low.rlike("^-?[0-9]{1,18}$"), low.cast("long") != 0)
    )


def split_key(key: Column) -> Column:
    """struct(section, subsection, name): cut at the first and the last dot."""
    first = F.substring_index(key, ".", 1)
    last = F.substring_index(key, ".", -1)
    middle = F.substring(key, F.length(first) + 2, F.length(key) - F.length(first) - F.length(last) - 2)
    return F.struct(
        F.lower(first).alias("section"),
        F.when(F.length(key) - F.length(F.replace(key, F.lit("."), F.lit(""))) > 1, middle).alias("subsection"),
        F.lower(last).alias("name"),
    )


def binary_size(n: Column) -> Column:
    """A number of bytes in binary units with two decimals."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for unit, power in (("KiB", 10), ("MiB", 20), ("GiB", 30), ("TiB", 40)):
        out = F.when(n >= 1 << power, F.concat(F.format_number(n / float(1 << power), "0.00"), F.lit(f" {unit}"))).otherwise(out)
    return out
