"""Packing into length buckets whose boundaries minimise padding, and batches within a token budget in each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from zonewalk.llm.common import materialise

BUCKETS = 16
TOKEN_BUDGET = 65536


def token_length(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ and one end of document; null counts as empty."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t-\\r]+")) + 1).cast("long")


def boundaries(longest: np.ndarray, count: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper boundaries of at most `buckets` buckets with the least padding, by dynamic programming over the histogram.

    There are count[i] texts of longest[i] tokens, ascending. A bucket pads its texts to its boundary; as the tokens
    themselves are the same for any choice, the least sum of boundaries is the least padding. The best for i + 1 lengths
    with one bucket more is the least over j of best[j] + longest[i] * (texts after j up to i): lines in longest[i]
    whose slopes fall with j, so their lower envelope is built once and walked once per bucket. Numbers are exact integers.
    """
    ends, n = [int(x) for x in longest], len(longest)
    if not n:
        return []
    upto = np.concatenate(([0], np.cumsum(np.asarray(count, dtype=np.int64)))).tolist()
    best = [e * u for e, u in zip(ends, upto[1:])]  # with one bucket
    choice: list[list[int]] = []
    for _ in range(1, min(buckets, n)):
        now, chosen = best.copy(), [-1] * n
        hull: list[tuple[int, int, int]] = []  # (slope, offset, j)
        at = 0
        for i in range(1, n):
            slope, offset = -upto[i], best[i - 1]
            while len(hull) > at + 1:
                (m1, b1, _), (m2, b2, _) = hull[-2], hull[-1]
                if (b2 - b1) * (m1 - slope) < (offset - b1) * (m1 - m2):
                    break
                hull.pop()
            hull.append((slope, offset, i - 1))
            x = ends[i]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            value = hull[at][0] * x + hull[at][1] + x * upto[i + 1]
            if value < now[i]:
                now[i], chosen[i] = value, hull[at][2]
        choice.append(chosen)
        best = now
    out, i, k = [], n - 1, len(choice)
    while i >= 0:
        while k and choice[k - 1][i] < 0:
            k -= 1
        out.append(ends[i])
        i, k = (choice[k - 1][i], k - 1) if k else (-1, 0)
    return out[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """(doc_id, n_tokens, bucket, boundary, batch, place) for every row of `docs` (doc_id, text).

    A text is in the bucket with the smallest boundary that holds it; boundaries are the best for the exact histogram of
    all lengths. A batch holds as many texts of a bucket, padded to its boundary, as the token budget allows, and one at
    least: a text over the budget is a batch by itself and is never cut. Within a bucket, texts are numbered by the
    task that read them and by doc_id within it, so no key can make a group large; batch and place follow from the number.
    Null text is empty: one token, the end. An empty table gives an empty result; rows that repeat a doc_id, or have
    none, are packed each; texts of equal length are in the same bucket; further columns are ignored.
    """
    spark = docs.sparkSession
    part = F.shiftright(F.monotonically_increasing_id(), 33)
    sized = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), token_length(F.col("text")).alias("n_tokens"), part.alias("part")), "lengths")
    lengths = sized.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("n_tokens")
    ends = boundaries(lengths.n_tokens.to_numpy(), lengths.n.to_numpy(), buckets)
    if not ends:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_tokens", "bucket", "boundary", "batch", "place")]))
    which = F.lit(len(ends) - 1)
    for i in range(len(ends) - 2, -1, -1):
        which = F.when(F.col("n_tokens") <= ends[i], i).otherwise(which)
    placed = sized.withColumn("bucket", which.cast("long"))
    # A group's first number is the count of the groups before it in its bucket: counts first, then numbers within.
    counts = placed.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("bucket", "part", (F.sum("n").over(Window.partitionBy("bucket").orderBy("part")) - F.col("n")).alias("before"))
    numbered = placed.withColumn("own", F.row_number().over(Window.partitionBy("bucket", "part").orderBy("doc_id", "n_tokens")) - 1)
    boundary = F.element_at(F.array(*[F.lit(e).cast("long") for e in ends]), (F.col("bucket") + 1).cast("int"))
    number, holds = F.col("before") + F.col("own"), F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.col("boundary")))
    out = numbered.join(before, ["bucket", "part"]).withColumn("boundary", boundary)
    return out.select("doc_id", "n_tokens", "bucket", "boundary", F.floor(number / holds).cast("long").alias("batch"), (number % holds).cast("long").alias("place"))
