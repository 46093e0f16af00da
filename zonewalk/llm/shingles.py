"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

SimHash fingerprints of the sets within two bits, found by pigeonring filtering, give the first candidates: close copies.
No Hamming radius on 64 bits finds the rest: at similarity 0.8 two fingerprints differ in about ten bits, with a spread of
three, and no segments long enough to be keys stay equal. So the bands of circulant MinHash signatures give further
candidates, all but 2 in 10^8 of the pairs at 0.8. Every candidate is checked on the sets themselves (64-bit hashes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewalk.llm.common import drop_rows, materialise
from zonewalk.llm.minhash import components, marked, row_key
from zonewalk.llm.simhash import links

SHINGLE = 5


def close_fingerprints(seen: DataFrame) -> DataFrame:
    """Candidate pairs (u, v) of nodes: those with one fingerprint, each with the first of them, and fingerprints within two bits."""
    classes = materialise(seen.where("node is not null and doc_id is not null").groupBy("fp").agg(F.min("node").alias("rep"), F.max("node").alias("last")), "near-classes")
    same = seen.select("fp", "node").join(classes.where("rep < last"), "fp").where("node <> rep").select(F.col("rep").alias("u"), F.col("node").alias("v"))
    near = links(classes.select("fp", F.col("rep").alias("node"))).union(same)
    return near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def similar_groups(docs: DataFrame) -> DataFrame:
    """(row, doc_id, keep_id, kept) for every text of `docs` (doc_id, text) that has a near copy.

    Of a group the row with the smallest doc_id is kept, of several rows with that doc_id one. Null text counts as empty;
    texts without words are near copies of each other; rows without doc_id are in no group; rows equal in doc_id and text
    share one verdict; an empty table gives an empty result. A text of any length is compared whole.
    """
    seen = marked(docs, SHINGLE)
    groups = components(seen, close_fingerprints(seen))
    # Texts of one set are near copies too, whether or not another set is near; those without words are one group.
    node = F.coalesce("component", "node", F.lit(0))
    of = seen.where("doc_id is not null").select("row", "doc_id", "node").join(groups, "node", "left").select("row", "doc_id", node.alias("group")).distinct()
    keep = of.groupBy("group").agg(F.min(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return of.join(keep, "group").select("row", "doc_id", F.col("keep.doc_id").alias("keep_id"), (F.col("keep.row") == F.col("row")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, one of each group of near copies, and those in no group; all columns stay.

    Each row has its own verdict, by doc_id and text; of rows equal in both one stays. A row without doc_id stays. Further
    columns may have any names; an empty table gives an empty result.
    """
    gone = materialise(similar_groups(docs.select("doc_id", "text")).where("not kept").select(F.col("row").alias("id")), "near-gone")
    key = F.when(F.col("doc_id").isNotNull(), row_key())
    again = materialise(docs.select(key.alias("id")).where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("id"), "near-repeats")
    return drop_rows(docs, {"id": key}, gone, again)
