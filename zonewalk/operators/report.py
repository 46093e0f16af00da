"""One report row per query, from facts and problems in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATEGORIES = tuple(p + c for p in ("", "ps_") for c in ("ns", "ipv4", "ipv6", "tld", "sld"))
MISCONFIGURED = ("ip_ns_records", "missing_ns_records")
#: Numbers of the record types NS, A and AAAA, by which codes are given.
RECORD_TYPES = ("2", "1", "28")


def by_name(problems: DataFrame, keys: list[str]) -> DataFrame:
    """For each name the questions that failed, in order: (keys, name, queries); their codes by record type, and `timeout` if so."""
    codes = [F.col(c).alias(kind) for c, kind in zip(("rcode", "rcode_a", "rcode_aaaa"), RECORD_TYPES)]
    summary = F.struct("nameserver", F.struct(*codes, F.when(F.col("timeout"), True).alias("timeout")).alias("rcodes"))
    return problems.groupBy(*keys, "name").agg(F.array_sort(F.collect_set(summary)).alias("queries"))


def _as_map(rows: DataFrame, keys: list[str], key: str, value: str, out: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(out))


def hazards(problems: DataFrame) -> DataFrame:
    """(query, hazardous_domains): name to its failed questions."""
    return _as_map(by_name(problems.where("kind = 'hazardous'"), ["query"]), ["query"], "name", "queries", "hazardous_domains")


def misconfigurations(problems: DataFrame) -> DataFrame:
    """(query, misconfigured_domains): kind to name to its failed questions."""
    inner = _as_map(by_name(problems.where(F.col("kind").isin(*MISCONFIGURED)), ["query", "kind"]), ["query", "kind"], "name", "queries", "of_name")
    return _as_map(inner, ["query"], "kind", "of_name", "misconfigured_domains")


def sets(facts: DataFrame) -> DataFrame:
    """(query, one sorted array per category)."""
    return facts.groupBy("query").agg(*[F.array_sort(F.collect_set(F.when(F.col("category") == c, F.lower("value")))).alias(c) for c in CATEGORIES])


def report(hosts: DataFrame, facts: DataFrame, problems: DataFrame) -> DataFrame:
    """The report of every query: empty sets and maps where there is nothing to say. The query is echoed as it was given."""
    out = hosts.select("query").distinct().join(misconfigurations(problems), "query", "left").join(hazards(problems), "query", "left").join(sets(facts), "query", "left")
    return out.select("query", *[F.coalesce(c, F.create_map().cast(out.schema[c].dataType)).alias(c) for c in ("misconfigured_domains", "hazardous_domains")], *[F.coalesce(c, F.expr("cast(array() as array<string>)")).alias(c) for c in CATEGORIES])


def classify(states: DataFrame) -> DataFrame:
    """Adds `kind` to states (pass, servers, numeric, cyclic): null if servers were found."""
    kind = F.when(F.col("servers") > 0, None).when(F.col("cyclic"), "cyclic").when(F.col("pass") == 1, "missing_ns_records").when(F.col("numeric"), "ip_ns_records").otherwise("hazardous")
    return states.withColumn("kind", kind)
