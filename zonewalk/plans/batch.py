"""Batch runs: only what is not done, failures into a retry queue, a second pass over them, reports compiled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewalk.functions.suffix import Rules, prepared
from zonewalk.operators import fetch
from zonewalk.operators.report import report
from zonewalk.plans import resolve
from zonewalk.plans.storage import exists
from zonewalk.sources import readers

#: Seconds that the questions of one host may take in all.
HOST_SECONDS = 60.0


def pending(hosts: DataFrame, done: DataFrame) -> DataFrame:
    """Hosts (query) without a finished report."""
    return hosts.distinct().join(done.select("query").distinct(), "query", "left_anti")


def retry_queue(log: DataFrame) -> DataFrame:
    """(query) whose last attempt failed; log: (query, attempt, status). Each once, by its own row."""
    last = log.groupBy("query").agg(F.max_by("status", "attempt").alias("status"))
    return last.where("status = 'failed'").select("query")


def write_retries(queue: DataFrame, path: str) -> None:
    queue.select(F.col("query").alias("value")).write.mode("append").text(path)


def crawl(spark: SparkSession, hosts: DataFrame, target: str, step: Callable[[DataFrame], DataFrame], passes: int = 2) -> DataFrame:
    """Run `step` over the hosts that `target` has no report of, then over the failures, `passes` times in all.

    step(hosts) gives the reports (query, ...) of the hosts that it got through; a host without a report has failed.
    Reports are appended to target/reports, so a run that was cut off goes on where it stopped; failures of each pass are
    appended to target/retry. Gives what failed to the end. What a step gives is stored once and all else is read from
    there, so a step that asks a live network is run once a pass and no host is lost or reported twice.
    """
    left = hosts.select("query").distinct()
    for _ in range(passes):
        if exists(spark, f"{target}/reports"):
            left = pending(left, readers.read_reports(spark, f"{target}/reports"))
        left = readers.stored(left, "asked")
        done = readers.stored(step(left), "pass")
        readers.write_reports(done, f"{target}/reports")
        left = left.join(done.select("query"), "query", "left_anti")
        if left.isEmpty():
            break
        write_retries(left, f"{target}/retry")
    return left


def reporting(port: DataFrame | resolve.Port, suffixes: DataFrame | Rules, roots: DataFrame, limit: float | None = HOST_SECONDS, compat: bool = False) -> Callable[[DataFrame], DataFrame]:
    """A step for `crawl`: reports of the hosts whose questions took `limit` seconds at most in all; the rest have failed.

    What was answered is kept from pass to pass and costs nothing again, so the next pass asks, and is charged for, only what
    timed out or was not asked before a host was over its limit.
    """
    rules, kept = prepared(suffixes), None
    port = fetch.table_port(port) if isinstance(port, DataFrame) else port

    def step(hosts: DataFrame) -> DataFrame:
        nonlocal kept
        done = resolve.resolve(hosts, port, rules, roots, compat, kept, limit)
        kept = done.answers.without(done.answers.questions.where("timeout"))
        reach = resolve.reached(hosts, done)
        through = hosts if limit is None else readers.stored(resolve.within(hosts, reach, done, limit), "through")
        facts, trouble = resolve.told(hosts, done, rules, reach)
        return report(through, *(rows.join(through, "query", "left_semi") for rows in (facts, trouble)))

    return step
