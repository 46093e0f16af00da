"""Source divergence audit: how far the sources of a language are from each other in their terms, exactly.

A group is a (lang, source), and the divergence of two groups is a sum over all kept terms of the language, most of which
neither group holds. Inclusion and exclusion over the supports spares them. Terms that one group holds are priced as if
the other had none, from a histogram of counts: all terms of one count cost the same. Terms that both hold, found by joining
postings, correct that. Terms that neither holds cost a constant each, and their number follows from the supports.

Numbers are 64-bit integers throughout; only the product with 10^9 in a probability is a decimal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonewalk.llm.common import Filter, materialise, pieces, released
from zonewalk.llm.terms import LETTERS, split

LEAST_DOCS, TOP = 10, 10
UNIT = 1_000_000_000
#: Bytes of text whose counts a Python worker combines at once; one longer text makes a piece of its own.
PIECE_BYTES = 8 << 20
GROUP = ["lang", "source"]


def named(docs: DataFrame) -> DataFrame:
    """(lang, source, text); null is empty."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP], "text")


def postings(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs): occurrences of a term in a group and the documents that have it, written.

    Counts are combined within a piece of text and again within a task before they move.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, PIECE_BYTES):
            terms, sizes = split(texts, LETTERS)
            if not len(terms):
                continue
            width = len(terms.dictionary)
            of_doc = np.repeat(np.arange(len(sizes)), sizes)
            once, count = np.unique(of_doc * width + terms.indices.to_numpy(), return_counts=True)
            langs, sources = (part.column(i).dictionary_encode() for i in (0, 1))
            group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            keys, which = np.unique(group[once // width] * width + once % width, return_inverse=True)
            sums = np.bincount(which, weights=count).astype(np.int64)
            of = keys // width
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(of // len(sources.dictionary))), sources.dictionary.take(pa.array(of % len(sources.dictionary))), terms.dictionary.take(pa.array(keys % width)).cast(pa.large_string()).cast(pa.string()), pa.array(sums), pa.array(np.bincount(which))],
                names=[*GROUP, "term", "count", "docs"],
            )

    rows = named(docs).mapInArrow(released(run), "lang string, source string, term string, count long, docs long")
    return materialise(rows.groupBy(*GROUP, "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "postings")


def kept_postings(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, count, total) of the terms that `least_docs` documents of the language have; total is the language's count."""
    every = postings(docs)
    kept = materialise(every.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total")).where(F.col("docs") >= least_docs).drop("docs"), "kept-terms")
    chosen = Filter.of(kept.select("lang", "term"), kept.count())
    return materialise((chosen.passed(every) if chosen else every).drop("docs").join(kept, ["lang", "term"]), "kept-postings")


def share(count: Column | str, total: Column | str, kept: Column | str) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)); null where no term is kept."""
    c, n, v = (F.col(x) if isinstance(x, str) else x for x in (count, total, kept))
    exact = F.lit(UNIT).cast("decimal(18,0)") * (c + 2).cast("decimal(20,0)")
    below = (n + 2 * v).cast("decimal(20,0)")
    return F.when(v > 0, F.call_function("div", exact, below) + 1)


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of `docs` (lang, source, text).

    Part `pair`: each other source of the language by its divergence, all ranks. Part `term`: the `top` terms that the group
    has more of than its language, by what they add. Equal values are ranked by item. Null lang, source and text are empty;
    a group without kept terms has its pairs; a language without kept terms has pairs of value 0; a source alone in its
    language has none. Repeated rows count each; an empty table gives an empty result; further columns are ignored; a text
    of any length is counted whole.
    """
    held = kept_postings(docs, least_docs)
    of_lang = held.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_total"))
    of_group = held.groupBy(*GROUP).agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("support"))
    groups = named(docs).select(*GROUP).distinct().join(of_group, GROUP, "left").join(of_lang, "lang", "left").na.fill(0, ["n", "support", "kept", "lang_total"])
    groups = materialise(groups.withColumn("none", share(F.lit(0), "n", "kept")), "divergence-groups")
    priced = materialise(held.join(groups.drop("support"), GROUP).withColumn("p", share("count", "n", "kept")), "priced-postings")
    a, b = groups.alias("a"), groups.alias("b")
    pairs = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") < F.col("b.source")))
    key = [F.col("a.lang").alias("lang"), F.col("a.source").alias("low"), F.col("b.source").alias("high")]
    neither = F.when(F.col("a.kept") > 0, (F.col("a.kept") - F.col("a.support") - F.col("b.support")) * apart(F.col("a.none"), F.col("b.none"))).otherwise(0)
    constants = pairs.select(*key, neither.cast("long").alias("value"))
    # Terms of one group, priced as if the other had none of them.
    histogram = priced.groupBy(*GROUP, "p").agg(F.count(F.lit(1)).alias("terms"))
    h, other = histogram.alias("h"), groups.alias("o")
    one = h.join(other, (F.col("h.lang") == F.col("o.lang")) & (F.col("h.source") != F.col("o.source")))
    one_sided = one.select(F.col("h.lang").alias("lang"), F.least("h.source", "o.source").alias("low"), F.greatest("h.source", "o.source").alias("high"), (F.col("terms") * apart(F.col("h.p"), F.col("o.none"))).alias("value"))
    # Terms of both: their own price for the two one-sided ones, and the constant that was taken off twice.
    x, y = (priced.select(*GROUP, "term", "p", "none").alias(s) for s in ("a", "b"))
    both = x.join(y, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.source") < F.col("b.source")))
    p, q, p0, q0 = (F.col(c) for c in ("a.p", "b.p", "a.none", "b.none"))
    overlaps = both.select(*key, (apart(p, q) - apart(p, q0) - apart(p0, q) + apart(p0, q0)).alias("value"))
    summed = [r.groupBy("lang", "low", "high").agg(F.sum("value").alias("value")) for r in (one_sided, overlaps)]
    value = materialise(constants.union(summed[0]).union(summed[1]).groupBy("lang", "low", "high").agg(F.sum("value").alias("value")), "divergence-pairs")
    pair = value.select("lang", F.col("low").alias("source"), F.col("high").alias("item"), "value").union(value.select("lang", "high", "low", "value"))
    q = share("total", "lang_total", "kept")
    term = priced.withColumn("q", q).where("p > q").select(*GROUP, F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    own = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.withColumn("rank", F.row_number().over(own)).select(*GROUP, F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(pair, "pair").union(ranked(term, "term").where(F.col("rank") <= top))
