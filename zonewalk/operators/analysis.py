"""Questions asked of finished reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewalk.functions import names

#: Top-level domains that analyses may leave out.
EXEMPT_TLDS = ("gov", "mil", "us")


def not_empty(collection: Column) -> Column:
    return F.coalesce(F.size(collection), F.lit(0)) > 0


def without_exempt(rows: DataFrame, name: str, exempt: DataFrame, tlds: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose name is neither in `exempt` (name) nor under one of `tlds`."""
    under = F.coalesce(F.try_element_at(names.labels(F.col(name)), F.lit(-1)).isin(*tlds), F.lit(False)) if tlds else F.lit(False)
    return rows.where(~under).join(exempt.select(F.col("name").alias(name)).distinct(), name, "left_anti")


def available(domains: DataFrame, registered: DataFrame) -> DataFrame:
    """Domains that nobody has registered."""
    return domains.join(registered.select("domain").distinct(), "domain", "left_anti")


#: Words by which registries say that a name is not registered.
UNREGISTERED = ("no match", "not found", "no data found", "no entries found", "status: free", "status: available")


def registration(lookups: DataFrame) -> DataFrame:
    """Adds `registered` to look-ups (status, text): null where there was no answer, so such names count as neither."""
    free = reduce(Column.__or__, [F.lower("text").contains(x) for x in UNREGISTERED])
    return lookups.withColumn("registered", F.when(F.col("status") == "answered", ~free))


def row_at(rows: DataFrame, key: str, value: int) -> DataFrame:
    """The row with this label in an explicit key column."""
    return rows.where(F.col(key) == value)


def numeric_second_label(name: Column) -> Column:
    """Whether the label before the last is a number."""
    return F.coalesce(F.try_element_at(names.labels(name), F.lit(-2)).rlike("^[0-9]+$"), F.lit(False))


def under_suffix(slds: Column, suffix: str) -> Column:
    """Of an array of names, those directly under `suffix`."""
    dotted = suffix if suffix.endswith(".") else suffix + "."
    return F.filter(slds, lambda x: x.endswith("." + dotted))
