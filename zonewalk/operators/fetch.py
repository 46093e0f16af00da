"""From questions to answers: fan-out to servers, the recorded response table, fallback and reuse, retries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewalk.plans.storage import stored

NXDOMAIN = 3
#: What is kept of a response's codes: those of the NS, A and AAAA questions, and whether it was given up.
CODES = ("rcode", "rcode_a", "rcode_aaaa", "timeout")


def fan_out(names: DataFrame, servers: DataFrame, zone: str = "parent") -> DataFrame:
    """One question for each name and address of each server of its zone; servers: (zone, ns, ip)."""
    return names.join(servers.withColumnRenamed("zone", zone), zone).dropDuplicates(["name", "ip"])


def distinct_questions(questions: DataFrame) -> DataFrame:
    """Each (domain, nameserver) once, so that it is asked once."""
    return questions.select("domain", "nameserver").distinct()


def recorded(questions: DataFrame, responses: DataFrame) -> DataFrame:
    """The recorded answers to questions (domain, nameserver); unanswered ones are timeouts."""
    found = questions.join(responses, ["domain", "nameserver"], "left")
    return found.withColumn("timeout", F.coalesce("timeout", F.lit(True)))


def table_port(responses: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A port that answers questions (domain, nameserver) from a table of recorded responses.

    The table is written once, as each call reads all of it: what it is derived from is read once, however many calls there are.
    """
    responses = stored(responses, "responses")
    return lambda questions: responses.join(questions, ["domain", "nameserver"], "left_semi")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(domain, nameserver) whose recorded answers differ, or stand in one table only."""
    said = lambda rows: rows.groupBy("domain", "nameserver").agg(F.array_sort(F.collect_list(F.struct("seq", "rr_text", *CODES))).alias("said"))
    both = said(before).withColumnRenamed("said", "was").join(said(after), ["domain", "nameserver"], "full")
    return both.where(~F.col("was").eqNullSafe(F.col("said"))).select("domain", "nameserver")


def is_nxdomain(rcode: Column, timeout: Column) -> Column:
    return ~F.coalesce(timeout, F.lit(False)) & F.coalesce(rcode == NXDOMAIN, F.lit(False))


def last_attempt(attempts: DataFrame, keys: list[str], attempt: str, values: list[str]) -> DataFrame:
    """Of several attempts at a key, the values of the last one."""
    picked = attempts.groupBy(*keys).agg(F.max_by(F.struct(attempt, *values), attempt).alias("_last"), F.count(F.lit(1)).alias("attempts"))
    return picked.select(*keys, "attempts", *[F.col(f"_last.{c}").alias(c) for c in (attempt, *values)])


def summaries(responses: DataFrame) -> DataFrame:
    """Per (domain, nameserver): how many records it gave, whether it says that the name does not exist, and its codes.

    The NS question's code says whether a name exists. Tables without codes of the other questions have null for them, and
    without `elapsed`, the seconds that an answer took, no answer takes any.
    """
    elapsed = F.col("elapsed").cast("double") if "elapsed" in responses.columns else F.lit(0.0)
    codes = [F.max(c if c in responses.columns else F.lit(None).cast("int")).alias(c) for c in CODES[:3]]
    return responses.groupBy("domain", "nameserver").agg(
        F.count("rr_text").alias("n"), F.bool_or(is_nxdomain(F.col("rcode"), F.col("timeout"))).alias("nx"), *codes, F.bool_or(F.coalesce("timeout", F.lit(False))).alias("timeout"),
        F.coalesce(F.max(elapsed), F.lit(0.0)).alias("elapsed"),
    )


def over_limit(spent: DataFrame, key: str | list[str], seconds: str, limit: float) -> DataFrame:
    """(key) whose questions took over `limit` seconds in all: their pass has failed."""
    return spent.groupBy(key).agg(F.sum(seconds).alias("_s")).where(F.col("_s") > limit).select(key)


def outcomes(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """What each question (name, original, ip) comes to: `answer` gives the name whose records count, `reuse` the servers asked.

    A first answer with records counts. An empty one that is not NXDOMAIN is asked again by the original name; if that is
    empty too and not NXDOMAIN, the servers being asked stay in charge, all of them. Codes are those of the first answer.
    No recorded answer is a timeout. answers: `summaries`.
    """
    first = answers.select(F.col("domain").alias("name"), F.col("nameserver").alias("ip"), F.col("n").alias("n1"), F.col("nx").alias("nx1"), *CODES)
    second = answers.select(F.col("domain").alias("original"), F.col("nameserver").alias("ip"), F.col("n").alias("n2"), F.col("nx").alias("nx2"))
    both = asked.join(first, ["name", "ip"], "left").join(second, ["original", "ip"], "left")
    n1, n2 = F.coalesce("n1", F.lit(0)), F.coalesce("n2", F.lit(0))
    nx1, nx2 = F.coalesce("nx1", F.lit(False)), F.coalesce("nx2", F.lit(False))
    empty = (n1 == 0) & ~nx1
    answer = F.when(n1 > 0, F.col("name")).when(empty & (F.col("name") != F.col("original")) & (n2 > 0), F.col("original"))
    reuse = empty & ((F.col("name") == F.col("original")) | ((n2 == 0) & ~nx2))
    return both.withColumns({"answer": answer, "reuse": reuse, "timeout": F.coalesce("timeout", F.lit(True))}).drop("n1", "nx1", "n2", "nx2")
