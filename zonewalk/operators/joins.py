"""Joins of nameservers, addresses and zones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_glue(nameservers: DataFrame, glue: DataFrame) -> DataFrame:
    """Nameservers (.., ns) with each address that glue (ns, ip) has; ip is null where there is none."""
    return nameservers.join(glue, "ns", "left")


def merged(parts: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """The union of server maps: all distinct values of each key, sorted."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias(value))


def unresolved(names: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    """Names without a result yet."""
    return names.join(resolved.select(key).distinct(), key, "left_anti")


def in_progress(dependencies: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """Dependencies on names that are being resolved themselves."""
    return dependencies.join(active.select(key).distinct(), key, "left_semi")


def addresses_of(nameservers: DataFrame, addresses: DataFrame) -> DataFrame:
    """Each nameserver's known addresses, once."""
    return nameservers.join(addresses, "ns").distinct()
