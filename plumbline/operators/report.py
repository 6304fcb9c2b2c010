"""Findings: severities, order, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import model

KEY = ["phase", "grp", "pos", "oid", "seq"]


def graded(findings: DataFrame, severities: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """Findings with their severity as printed: ignored ones and those of skipped ids dropped, fatal shown as error, info as warning.

    severities has one row a check (73 of them; the catalogue is its bound).
    """
    out = findings.join(F.broadcast(severities), "msg_id").where(F.col("severity") != model.IGNORE)
    if skip is not None:
        out = out.join(skip, "oid", "left_anti")
    shown = F.when(F.col("severity") == model.FATAL, model.ERROR).when(F.col("severity") == model.INFO, model.WARN).otherwise(F.col("severity"))
    return out.withColumn("severity", shown)


def status(findings: DataFrame, bit: Column, by: list[str] | None = None) -> DataFrame:
    """The bit-or of all findings' bits; 0 without findings."""
    return findings.groupBy(*(by or [])).agg(F.coalesce(F.bit_or(bit), F.lit(0)).cast("long").alias("status"))


def ordered(findings: DataFrame) -> DataFrame:
    """The report's order: phase, group, position, id, sequence; total, so every run prints alike."""
    return findings.orderBy(*KEY)


def rendered(severity: Column, kind: Column, oid: Column, msg_id: Column, text: Column) -> Column:
    return F.concat(severity, F.lit(" in "), kind, F.lit(" "), oid, F.lit(": "), msg_id, F.lit(": "), text)
