import pytest
from pyspark.sql import functions as F

from zonewalk.functions import names, suffix


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("raw, want", [("A.Com", "a.com."), ("a.com.", "a.com."), ("  ", None), ("", None)])
def test_norm_host(spark, raw, want):
    assert one(spark, names.norm_host(F.col("h")), h=raw) == want


def test_chain_and_parent(spark):
    parts = names.labels(F.col("h"))
    assert one(spark, names.superdomains(parts), h="www.a.co.uk.") == ["uk.", "co.uk.", "a.co.uk.", "www.a.co.uk."]
    assert one(spark, names.parent_name(parts), h="www.a.com.") == "a.com."
    assert one(spark, names.parent_name(parts), h="com.") is None
    assert one(spark, names.labels_reversed(F.col("h")), h=" a.b.c. ") == ["c", "b", "a"]


@pytest.mark.parametrize("host, want", [("10.0.0.9.", True), ("a.com.", False), ("x9.", False), ("", False)])
def test_numeric_label(spark, host, want):
    assert one(spark, names.numeric_label(names.labels(F.col("h"))), h=host) is want


def test_owner_match_strict_and_substring(spark):
    loose = names.within(F.col("n"), F.col("o"), strict=False)
    strict = names.within(F.col("n"), F.col("o"))
    assert one(spark, loose, n="google.com.", o="le.com.") and not one(spark, strict, n="google.com.", o="le.com.")
    assert one(spark, strict, n="a.b.com.", o="B.com.") and one(spark, strict, n="b.com.", o="b.com.")


RULES = ["com", "uk", "co.uk", "*.ck", "!www.ck"]


@pytest.mark.parametrize(
    "host, subdomain, domain, suffix_, sld, tld",
    [
        ("www.a.co.uk.", "www", "a", "co.uk.", "a.co.uk.", "co.uk."),
        ("co.uk.", "", "", "co.uk.", "co.uk.", "uk."),
        ("com.", "", "", "com.", None, "com."),
        ("a.b.ck.", "", "a", "b.ck.", "a.b.ck.", "b.ck."),
        ("x.www.ck.", "x", "www", "ck.", "www.ck.", "ck."),
        ("a.unknown.", "", "a", "unknown.", "a.unknown.", "unknown."),
        ("10.0.0.9.", "10.0", "0", "9.", "0.9.", "9."),
    ],
)
def test_suffix_split(spark, host, subdomain, domain, suffix_, sld, tld):
    rules = spark.createDataFrame([(r,) for r in RULES], "suffix string")
    split = suffix.with_suffix(spark.createDataFrame([(host, "old")], "h string, domain string"), "h", rules)
    got = split.select("subdomain", "domain", "suffix", suffix.sld(F.col("domain"), F.col("suffix")), suffix.tld(F.col("domain"), F.col("suffix"))).first()
    assert tuple(got) == (subdomain, domain, suffix_, sld, tld)
