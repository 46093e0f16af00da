"""Public-suffix split of host names by joins with a rule table, without a library."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewalk.functions import names
from zonewalk.plans.storage import stored


@dataclass
class Rules:
    """A prepared rule table and the labels of its longest rule."""

    table: DataFrame
    depth: int


def prepared(suffixes: DataFrame | Rules) -> Rules:
    """Prepare rules once for several splits."""
    if isinstance(suffixes, Rules):
        return suffixes
    table = stored(rules(suffixes), "suffix-rules")
    return Rules(table, table.select(F.coalesce(F.max(F.size(names.labels(F.col("key")))), F.lit(1))).first()[0])


def rules(suffixes: DataFrame) -> DataFrame:
    """(key, plain, wild, except_) from rules in column `suffix`: `co.uk`, `*.ck`, `!www.ck`; dots at the end are optional."""
    rule = F.lower(F.trim("suffix"))
    key = names.norm_host(F.regexp_replace(rule, r"^(!|\*\.)", ""))
    kinds = {"plain": ~rule.rlike(r"^(!|\*\.)"), "wild": rule.startswith("*."), "except_": rule.startswith("!")}
    return suffixes.select(key.alias("key"), *[k.alias(n) for n, k in kinds.items()]).where("key is not null").groupBy("key").agg(*[F.bool_or(n).alias(n) for n in kinds])


def with_suffix(hosts: DataFrame, host: str, suffixes: DataFrame | Rules) -> DataFrame:
    """Adds subdomain, domain, suffix and registrable to `hosts` for the normal name in column `host`.

    The longest rule counts; an exception rule takes its own name less one label. Without any rule the last label is the
    suffix. There is one left join per label that the longest rule has, each with the whole rule table, so no rows are
    shuffled by host while the table is within the session's broadcast threshold. The added columns replace ones of the
    same names.
    """
    ready = prepared(suffixes)
    table, depth = ready.table, ready.depth
    out = hosts.drop("subdomain", "domain", "suffix", "registrable").withColumn("_parts", names.labels(F.col(host)))
    size, exception = F.lit(1), F.lit(None).cast("int")
    for i in range(1, depth + 1):
        own = table.select(F.col("key").alias(f"_k{i}"), *[F.col(c).alias(f"_{c}{i}") for c in ("plain", "wild", "except_")])
        out = out.withColumn(f"_n{i}", names.last_labels(F.col("_parts"), i)).join(own, F.col(f"_n{i}") == F.col(f"_k{i}"), "left")
        size = F.greatest(size, F.when(F.col(f"_wild{i}") & (F.size("_parts") > i), i + 1).when(F.col(f"_plain{i}"), i))
        exception = F.coalesce(F.when(F.col(f"_except_{i}"), i - 1), exception)
    out = out.withColumn("_size", F.least(F.coalesce(exception, size), F.size("_parts")))
    inner = F.size("_parts") - F.col("_size")
    added = {
        "subdomain": F.array_join(F.slice("_parts", 1, F.greatest(inner - 1, F.lit(0))), "."),
        "domain": F.when(inner > 0, F.element_at("_parts", F.when(inner > 0, inner).otherwise(1))).otherwise(""),
        "suffix": F.coalesce(names.last_labels(F.col("_parts"), F.col("_size")), F.lit("")),
    }
    out = out.select(*[c for c in out.columns if not c.startswith("_")], "_parts", *[v.alias(k) for k, v in added.items()])
    return out.withColumn("registrable", F.when(F.col("domain") != "", F.concat("domain", F.lit("."), "suffix")).otherwise(F.col("suffix"))).drop("_parts")


def sld(domain: Column, suffix: Column) -> Column:
    """Second-level name: the registrable name, or a suffix of several labels itself; null for a single label."""
    return F.when(domain != "", F.concat(domain, F.lit("."), suffix)).when(F.size(names.labels(suffix)) > 1, suffix)


def tld(domain: Column, suffix: Column) -> Column:
    """The suffix; of a name that is a suffix of several labels, the suffix less its first label."""
    parts = names.labels(suffix)
    return F.when((domain == "") & (F.size(parts) > 1), names.parent_name(parts)).otherwise(suffix)
