"""Strongly connected parts of a dependency graph, without a list of its paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewalk.plans.storage import Growing, stored

MAX_ROUNDS = 1000


def _ends(edges: DataFrame) -> DataFrame:
    """(name, leaving, entering): how many edges leave each name, and how many enter it."""
    end = lambda name, leaving, entering: F.struct(F.col(name).alias("name"), F.lit(leaving).alias("leaving"), F.lit(entering).alias("entering"))
    return edges.select(F.explode(F.array(end("src", 1, 0), end("dst", 0, 1))).alias("e")).select("e.*").groupBy("name").agg(F.sum("leaving").alias("leaving"), F.sum("entering").alias("entering"))


def _cut(edges: DataFrame, number: int) -> DataFrame:
    """`edges` with `from_cut` and `to_cut`: whether their ends are taken out in this round.

    A name may be taken out where at most one edge leaves it, or enters it, so that no more edges come of it than go. Of
    two such neighbours the one of lower rank goes; ranks are drawn anew each round, so of a long chain a third goes at once.
    """
    rank = F.struct(F.xxhash64("name", F.lit(number)), "name")
    may = _ends(edges).where("least(leaving, entering) <= 1").select("name", rank.alias("rank"))
    at = lambda end, out: may.select(F.col("name").alias(end), F.col("rank").alias(out))
    both = edges.join(at("src", "a"), "src").join(at("dst", "b"), "dst")
    stays = both.select(F.when(F.col("a") > F.col("b"), F.col("src")).otherwise(F.col("dst")).alias("name")).distinct()
    goes = may.join(stays, "name", "left_anti").select("name", F.lit(True).alias("cut"))
    marked = edges.join(goes.toDF("src", "from_cut"), "src", "left").join(goes.toDF("dst", "to_cut"), "dst", "left")
    return stored(marked.select("src", "dst", F.coalesce("from_cut", F.lit(False)).alias("from_cut"), F.coalesce("to_cut", F.lit(False)).alias("to_cut")), "marked")


def _bridged(marked: DataFrame) -> DataFrame:
    """The edges that are left once names were taken out: who led to one leads to where it led."""
    into = marked.where("to_cut").select("src", F.col("dst").alias("via"))
    on = marked.where("from_cut").select(F.col("src").alias("via"), "dst")
    kept = marked.where("not from_cut and not to_cut").select("src", "dst")
    return kept.union(into.join(on, "via").select("src", "dst").where("src <> dst")).distinct()


def _coloured(edges: DataFrame) -> DataFrame:
    """(name, colour): the largest name that leads to each, itself included. Each round tells on only what changed."""
    now = changed = stored(_ends(edges).select("name", F.col("name").alias("colour")), "colours")
    for _ in range(MAX_ROUNDS):
        told = changed.withColumnRenamed("name", "src").join(edges, "src").groupBy(F.col("dst").alias("name")).agg(F.max("colour").alias("got"))
        changed = stored(told.join(now, "name").where("got > colour").select("name", F.col("got").alias("colour")), "changed")
        if changed.isEmpty():
            return now
        now = stored(now.join(changed.withColumnRenamed("colour", "got"), "name", "left").select("name", F.coalesce("got", "colour").alias("colour")), "colours")
    raise RuntimeError(f"no fixed point in {MAX_ROUNDS} rounds")


def _taken(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, part) of the part that gave each colour, and the edges that are left among other names of one colour."""
    colours = _coloured(edges)
    at = lambda end, out: colours.select(F.col("name").alias(end), F.col("colour").alias(out))
    within = stored(edges.join(at("src", "colour"), "src").join(at("dst", "other"), "dst").where("colour = other").select("src", "dst", "colour"), "within")
    found = new = stored(colours.where("name = colour"), "back")
    for _ in range(MAX_ROUNDS):
        back = within.join(new.select(F.col("name").alias("dst")), "dst", "left_semi").select(F.col("src").alias("name"), "colour").distinct()
        new = stored(back.join(found, "name", "left_anti"), "back")
        if new.isEmpty():
            gone = found.select("name")
            left = within.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select("src", "dst")
            return found.withColumnRenamed("colour", "part"), stored(left, "edges")
        found = found.union(new)
    raise RuntimeError(f"no fixed point in {MAX_ROUNDS} rounds")


def strong_parts(edges: DataFrame) -> DataFrame:
    """(name, part) of every name of edges (src, dst); part: the smallest name of those that lead there and back, itself included.

    Names that at most one edge leaves or enters are taken out, neighbours never together, and those that led to one lead
    on to where it led: what leads where is unchanged among the rest, so rings and chains are gone after a number of rounds
    that grows with the logarithm of their length. What is left is coloured, by the largest name that leads there; who leads
    back to that name within the colour is its part, and edges between colours are in none. At last the names that were
    taken out come back, last ones first: one that stands between two names of a part belongs to it. No round has more
    edges than the graph. Edges with a null end are passed over. Raises RuntimeError beyond MAX_ROUNDS.
    """
    spark = edges.sparkSession
    every = stored(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    parts, rounds, left = Growing(spark, "parts"), [], stored(every.where("src <> dst"), "edges")
    parts.add(left.select(F.col("src").alias("name"), F.col("dst").alias("part")).limit(0))
    for number in range(MAX_ROUNDS):
        marked = _cut(left, number)
        if not marked.where("from_cut or to_cut").isEmpty():
            rounds.append(marked)
            left = stored(_bridged(marked), "edges")
        elif left.isEmpty():
            break
        else:
            found, left = _taken(left)
            parts.add(found)
    else:
        raise RuntimeError(f"no fixed point in {MAX_ROUNDS} rounds")
    for marked in reversed(rounds):
        known = parts.all().withColumnRenamed("name", "other")
        part_of = lambda rows: rows.join(known, "other", "left").select("name", F.coalesce("part", "other").alias("part")).distinct()  # noqa: B023, E731
        before = part_of(marked.where("to_cut").select(F.col("dst").alias("name"), F.col("src").alias("other")))
        after = part_of(marked.where("from_cut").select(F.col("src").alias("name"), F.col("dst").alias("other")))
        parts.add(before.join(after, ["name", "part"]))
    names = every.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    told = stored(names.join(parts.all(), "name", "left").select("name", F.coalesce("part", "name").alias("part")), "parts")
    first = told.groupBy("part").agg(F.min("name").alias("first"))
    return told.join(first, "part").select("name", F.col("first").alias("part"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """(src) that reach themselves: those with an edge within their part."""
    every = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    parts = stored(strong_parts(every), "parts")
    at = lambda end, out: parts.select(F.col("name").alias(end), F.col("part").alias(out))
    return every.join(at("src", "a"), "src").join(at("dst", "b"), "dst").where("a = b").select("src").distinct()
