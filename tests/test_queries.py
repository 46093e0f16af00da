import os
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import DataFrame

import __spark_entry__
from zonewalk.operators import fetch
from zonewalk.plans import resolve
from zonewalk.queries import delegation

SF = "/root/testdata/sf0.001"
#: Whole resolutions, minutes each; the rows of demand_fetch are those of full_report with two counts.
SLOW = {"report_row", "reuse_all_servers", "demand_fetch", "reresolve", "limited_report"}


def canonical(rows, columns):
    return sorted(str([r[c] for c in columns]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(delegation.QUERIES) - SLOW))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "documents", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.sql(delegation.ORACLES[name])
    want = [dict(zip(found.columns, r)) for r in found.fetchall()]
    got = [r.asDict() for r in delegation.QUERIES[name](spark, SF).collect()]
    columns = sorted(found.columns)
    assert canonical(got, columns) == canonical(want, columns)


class Stop(Exception):
    pass


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["reuse_all_servers", "full_report", "report_row", "demand_fetch", "limited_report"])
def test_resolutions_do_not_read_the_pages_again(spark, monkeypatch, name):
    """Hosts and answers that a resolution reads in every round come from what was written of the pages, not from the pages."""
    given, table_port = [], fetch.table_port

    def port(responses):
        given.append(responses)
        return table_port(responses)

    def stop(hosts, responses, *args, **kwargs):
        given.extend(x for x in (hosts, responses) if isinstance(x, DataFrame))
        raise Stop

    monkeypatch.setattr(fetch, "table_port", port)
    monkeypatch.setattr(delegation.resolve, "resolve", stop)
    with pytest.raises(Stop):
        delegation.QUERIES[name](spark, SF)
    assert len(given) == 2 and all(frame.inputFiles() and not any("pages.parquet" in f for f in frame.inputFiles()) for frame in given)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_second_resolution_does_not_read_the_pages_again(spark, monkeypatch):
    """Neither run of reresolve reads the pages, and what changed between them is worked out once."""
    given, kept, table_port = [], [], fetch.table_port

    def port(responses):
        given.append(responses)
        return table_port(responses)

    def resolved(hosts, responses, *args, **kwargs):
        given.extend(x for x in (hosts, responses) if isinstance(x, DataFrame))
        if "kept" in kwargs:
            kept.append(kwargs["kept"])
            raise Stop
        rows = spark.createDataFrame([("com.", "10.0.0.1")], "domain string, nameserver string")
        return SimpleNamespace(answers=resolve.Answers(rows, rows.toDF("answer", "ip")))

    monkeypatch.setattr(fetch, "table_port", port)
    monkeypatch.setattr(delegation.resolve, "resolve", resolved)
    with pytest.raises(Stop):
        delegation.QUERIES["reresolve"](spark, SF)
    assert len(given) == 4 and all(frame.inputFiles() and not any("pages.parquet" in f for f in frame.inputFiles()) for frame in given)
    assert [f.split("/")[-2].startswith("changed-") for f in kept[0].questions.inputFiles()] == [True]


def test_entry(spark):
    if os.path.isdir(SF):
        assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
