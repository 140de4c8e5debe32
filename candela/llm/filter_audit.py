"""Interaction of filters: which of several filters remove what, in every order.

1. Each document gets a mask with one bit per filter that it fails.  Four filters
   look at the document's own text; the fifth fails a text that a smaller doc_id has.
2. Equal texts are grouped (by SHA-256 and length of the whole text).  A group is
   counted per part and labels with its smallest doc_id, so that copies are merged
   before the shuffle and no row is joined back to its group.
3. Counts are added up into the 32 cells of the mask, per part: all that is left of
   the corpus.  The 120 orders of the filters are enumerated over a part's cells.

Everything is a DataFrame expression.

Defined results: a null text counts as the empty one (no words: filter A fails, no
other does unless a smaller doc_id has an empty text); a null part is the empty
string; a null doc_id counts as larger than all others and has no labels; rows that
share doc_id and text fail nothing for each other; several labels of a doc_id count
if any of them says 1; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

WORD = r"[^\x20\x09-\x0D]+"
FILTERS = "ABCDE"
#: The bit of the filter that compares documents.
COPY = 1 << FILTERS.index("E")
CELLS = 1 << len(FILTERS)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def own_mask(text: Column, words: Column) -> Column:
    """The bits of filters A to D: few words, few different words, many capitals, a symbol."""
    distinct, n = F.size(F.array_distinct(words)), F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, _UPPER, ""))
    fails = [n < 50, distinct * F.lit(100).cast("long") < n * F.lit(65).cast("long"), capitals * F.lit(100).cast("long") > F.length(text) * F.lit(5).cast("long"), text.rlike("[#$%&*|]")]
    return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)), F.lit(0))


def _flags(labels: DataFrame, id_col: str) -> DataFrame:
    """One row per labelled id: id, good, toxic."""
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    return labels.filter(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").cast("long").alias("id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))


def masks(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, digest, chars, own (mask of A to D), id, good, toxic: a row per document, texts left behind."""
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = stage(rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), F.length("text").alias("chars"), own_mask(F.col("text"), F.col("words")).alias("own")), "audit-masks")
    known = rows.filter("id is not null").join(_flags(labels, id_col), "id", "left")
    none = rows.filter("id is null").withColumns({"good": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    return known.unionByName(none).na.fill(0, ["good", "toxic"])


def histogram(rows: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: the documents of each cell, and how many of them have the labels. rows: as masks() gives them."""
    group = ["digest", "chars", "own"]
    smallest = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id")))
    # Rows at a kind's smallest id, counted in the same aggregation: equal ids are counted with their number first.
    by_id = rows.groupBy(*group, "part", "good", "toxic", "id").agg(F.count("*").alias("n"))
    kinds = by_id.groupBy(*group, "part", "good", "toxic").agg(smallest.alias("least"), F.sum("n").alias("n"), F.min_by("n", F.struct(F.col("id").isNull(), "id")).alias("at_least"))
    texts = kinds.groupBy(*group).agg(F.min("least").alias("first"), F.collect_list(F.struct("part", "good", "toxic", "least", "n", "at_least")).alias("kinds"))
    # A text's kinds are its combinations of part and labels: none of them is a list of documents.
    each = texts.select("own", "first", F.explode("kinds").alias("k"))
    firsts = F.when(F.col("k.least") == F.col("first"), F.col("k.at_least")).otherwise(0)
    split = F.array(F.struct(F.col("own").alias("mask"), firsts.alias("n")), F.struct((F.col("own") + COPY).alias("mask"), (F.col("k.n") - firsts).alias("n")))
    cells = each.select("k.part", "k.good", "k.toxic", F.explode(split).alias("c")).filter("c.n > 0")
    return cells.groupBy("part", "c.mask").agg(F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("good")).alias("good"), F.sum(F.col("c.n") * F.col("toxic")).alias("toxic"))


def audit(cells: DataFrame) -> DataFrame:
    """One row per part, order and step. cells: as histogram() gives them.

    part, filter_order, step, kept (after the step), removed (at it), redundant (failing
    its filter, removed earlier), unique_fails (failing its filter alone), good_lost and
    toxic_lost (removed at it, with the label), shapley (removed by its filter, over all orders).
    """
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    orders = [
        (order, k + 1, 1 << FILTERS.index(f), sum(1 << FILTERS.index(x) for x in order[:k]))
        for order in map("".join, permutations(FILTERS)) for k, f in enumerate(order)
    ]
    step = lambda o: F.struct(F.lit(o[0]).alias("filter_order"), F.lit(o[1]).alias("step"), F.lit(o[2]).alias("bit"), F.lit(o[3]).alias("before"))
    # A literal list of 600 steps: the plan's size, not the corpus', so rows of parts are multiplied by a constant.
    rows = parts.select("part", "cells", F.explode(F.array(*map(step, orders))).alias("o"))
    bit, before = F.col("o.bit"), F.col("o.before")

    def total(value, where) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(where(c["mask"]), value(c)).otherwise(0))

    n = lambda c: c["n"]
    fails = lambda m: m.bitwiseAND(bit) != 0
    clear = lambda m: m.bitwiseAND(before) == 0
    here = lambda m: fails(m) & clear(m)
    # A document that fails k filters is removed by each of them in 120 / k of the orders.
    share = lambda c: c["n"] * F.element_at(F.array(*(F.lit(120 // k) for k in range(1, 6))), F.greatest(F.bit_count(c["mask"]), F.lit(1)))
    return rows.select(
        "part",
        "o.filter_order",
        "o.step",
        total(n, lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        total(n, here).alias("removed"),
        total(n, lambda m: fails(m) & ~clear(m)).alias("redundant"),
        total(n, lambda m: m == bit).alias("unique_fails"),
        total(lambda c: c["good"], here).alias("good_lost"),
        total(lambda c: c["toxic"], here).alias("toxic_lost"),
        total(share, fails).alias("shapley"),
    )


def filter_interactions(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The audit of docs' five filters; labels: id_col, quality, toxic."""
    return audit(stage(histogram(masks(docs, labels, part_col, id_col, text_col)), "audit-cells"))
