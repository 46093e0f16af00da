"""Column expressions for host names; a normal name is lower case and ends with a dot."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_host(host: Column) -> Column:
    """Lower case with a trailing dot; null for blank input."""
    low = F.lower(F.trim(host))
    return F.when(low != "", F.when(low.endswith("."), low).otherwise(F.concat(low, F.lit("."))))


def labels(host: Column) -> Column:
    return F.filter(F.split(host, "[.]"), lambda x: x != "")


def labels_reversed(host: Column) -> Column:
    return F.reverse(labels(F.trim(host)))


def last_labels(parts: Column, n: Column | int) -> Column:
    """The name of the last n labels; null if there are fewer."""
    count = F.lit(n) if isinstance(n, int) else n
    return F.when((F.size(parts) >= count) & (count > 0), F.concat(F.array_join(F.slice(parts, F.size(parts) - count + 1, count), "."), F.lit(".")))


def parent_name(parts: Column) -> Column:
    """All labels but the first; null for a single label."""
    return last_labels(parts, F.size(parts) - 1)


def superdomains(parts: Column) -> Column:
    """Names from the top-level domain down to the whole name."""
    n = F.size(parts)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.array_join(F.slice(parts, n - i + 1, i), "."), F.lit("."))))


def is_tld(parts: Column) -> Column:
    return F.size(parts) == 1


def numeric_label(parts: Column) -> Column:
    """Whether the last label is a number, as in an address that stands where a name should."""
    return F.coalesce(F.try_element_at(parts, F.lit(-1)).rlike("^[0-9]+$"), F.lit(False))


def within(name: Column, owner: Column, strict: bool = True) -> Column:
    """Whether `owner` is `name` or above it; not strict: whether it is a substring of it anywhere."""
    owner = F.lower(owner)
    return (name == owner) | name.endswith(F.concat(F.lit("."), owner)) | (owner == ".") if strict else F.contains(name, owner)


def ps_prefix(is_suffix: Column, category: Column) -> Column:
    """The category, marked if it was reached through a public suffix."""
    return F.concat(F.when(is_suffix, "ps_").otherwise(""), category)
