"""Resource records: from text lines to rows, and what a row says about a name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewalk.functions import names

RECORD = ("name", "ttl", "class", "type", "data")


def tokenise(lines: DataFrame, text: str = "rr_text") -> DataFrame:
    """Splits record lines into RECORD columns; blank lines, `;` comments and lines of under five fields go.

    A cell may hold several lines; further fields of a line are ignored, columns of the same names are replaced.
    """
    line = F.explode(F.split(F.col(text), "\n")).alias("_line")
    kept = [c for c in lines.columns if c not in (text, *RECORD)]
    rows = lines.select(*kept, line).where((F.trim("_line") != "") & ~F.ltrim("_line").startswith(";"))
    fields = F.split(F.trim("_line"), r"\s+")
    return rows.withColumn("_f", fields).where(F.size("_f") >= 5).select(*kept, *[F.get("_f", F.lit(i)).alias(c) for i, c in enumerate(RECORD)])


def of_types(rows: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Records of these types; `ANY` keeps all."""
    return rows if "ANY" in types else rows.where(F.col("type").isin(*types))


def last_wins(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Of records of one response with the same data, the last; ties by owner."""
    rest = [c for c in rows.columns if c not in (*keys, "data")]
    picked = rows.groupBy(*keys, "data").agg(F.max_by(F.struct(*rest), F.struct(order, "name")).alias("_r"))
    return picked.select(*keys, "data", *[F.col(f"_r.{c}").alias(c) for c in rest])


def address_kind(type_: Column) -> Column:
    return F.when(type_ == "A", "ipv4").when(type_ == "AAAA", "ipv6")


def tab_separated(rows: DataFrame) -> DataFrame:
    return rows.select(*[c for c in rows.columns if c not in RECORD], F.concat_ws("\t", "name", "type", "data").alias("line"))


def nameservers(rows: DataFrame, current: str, strict: bool = True) -> DataFrame:
    """NS records whose owner is the current name or above it, with `ns`."""
    return rows.where((F.col("type") == "NS") & names.within(F.col(current), F.col("name"), strict)).withColumn("ns", F.lower("data"))


def addresses(rows: DataFrame) -> DataFrame:
    """A and AAAA records whatever their owner, as (..., host, ip, kind)."""
    return rows.where(F.col("type").isin("A", "AAAA")).withColumns({"host": F.lower("name"), "ip": F.lower("data"), "kind": address_kind(F.col("type"))})


def own_addresses(rows: DataFrame, current: str) -> DataFrame:
    return addresses(rows).where(F.col("host") == F.col(current))


def promoted(rows: DataFrame, current: str, is_ns: str) -> DataFrame:
    """Names that are resolved as nameservers and have an address: each is its own nameserver."""
    return own_addresses(rows, current).where(F.col(is_ns)).withColumn("ns", F.col(current))


def out_of_bailiwick(own: Column, other: Column) -> Column:
    """Whether the registrable names differ."""
    return ~own.eqNullSafe(other)


def glue_sets(rows: DataFrame) -> DataFrame:
    """All addresses of each host, sorted."""
    return addresses(rows).groupBy("host").agg(F.array_sort(F.collect_set("ip")).alias("ips"))


def sets_by_type(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct nameservers and addresses per key, sorted, as arrays."""
    data = F.lower("data")
    pick = {"ns": "NS", "ipv4": "A", "ipv6": "AAAA"}
    return rows.groupBy(*keys).agg(*[F.array_sort(F.collect_set(F.when(F.col("type") == t, data))).alias(k) for k, t in pick.items()])
