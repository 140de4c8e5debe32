"""Mixing sources to target weights on a low-discrepancy schedule.

1. A document's size is its number of words.  Sources weigh 5, 2, 1, repeating in
   their order, and share `share` times all words by weight; a target stops at `most`
   times its source's size, and the excess is shared by weight among the others until
   none is above (in closed form: sources in order of size over weight fill up first).
2. A source's documents are put in a shuffled order (hash of the id) and their words,
   one after the other, are cut into blocks of `block_words`; only the last is shorter.
3. A source needs as many slots as its target has blocks.  Slot j of D has the golden-
   ratio point (j * a mod D) / D, a being the number coprime to D near D / golden ratio
   whose continued fraction is the flattest.  These points are the D multiples of 1 / D
   in golden-ratio order, so mapping them through the cumulative slot counts gives each
   source exactly its slots, spread evenly over every stretch of the schedule.
4. Slots are ranked per source; rank k takes pass k / blocks over the source, in a
   strided order of its blocks, and is joined with the words of its block.  The last
   pass stops at the target: its last slot may take part of a block.

Nothing is drawn at random: the same rows give the same schedule.  Ranks, places and
sums over a source are found in two levels, so no task holds a source.

Defined results: a null or blank text has size 0 and is in no slot; a null source is a
source of its own, the last one; a source without words has target 0; a table without
words has targets 0 and no slots; ids may be null or repeat (each row is placed by
itself); an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.positions import join_on, positioned
from .common import stage

WORD = r"[^\x20\x09-\x0D]+"
#: Greater than any number of blocks and prime: steps of it visit every block once.
_STRIDE = 2**61 - 1
#: Slots that one row unfolds to at once.
_CHUNK = 65_536


def _quotients(a: int, b: int) -> list[int]:
    out = []
    while b:
        out.append(a // b)
        a, b = b, a % b
    return out


def golden_step(n: int, tries: int = 64) -> int:
    """The number below n, coprime to it and near n / golden ratio, whose ratio to n has the smallest largest partial quotient."""
    if n < 3:
        return 1
    middle = round(n * (math.isqrt(5 * 10**40) - 10**20) / (2 * 10**20))
    near = sorted({x for x in range(middle - tries, middle + tries + 1) if 0 < x < n and math.gcd(x, n) == 1}, key=lambda x: (abs(x - middle), x))
    # Quotients after the first: the ratio is below 1.
    return min(near, key=lambda x: (max(_quotients(x, n)[1:]), sum(_quotients(x, n)), abs(x - middle), x), default=1)


def _times(a: Column, b, n) -> Column:
    """a * b mod n of longs, without overflow."""
    wide = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("decimal(19,0)")
    return F.pmod(wide(a) * wide(b), wide(n)).cast("long")


def sized(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", seed: str = "mix") -> DataFrame:
    """doc_id, source, size, shuffled (place in the source's order) and print (tells rows of one id apart)."""
    key, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    mixed = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    return docs.select(key.alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), mixed.alias("shuffled"), F.xxhash64(text).alias("print"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, block_words: int = 1024) -> DataFrame:
    """One row per source: source, source_no, source_size, target, and how its blocks and slots are laid out.

    Tables of one row per source, ordered by ranges like any other.
    """
    sums = stage(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sizes")
    numbered = positioned(sums.withColumn("all", F.lit(0)), ["all"], ["source"], "source_no", name="mix-sources")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod("source_no", F.lit(len(weights))) + 1).cast("int")).cast("long")
    numbered = stage(numbered.withColumns({"weight": weight, "cap": F.col("source_size") * most}).withColumn("fills", F.col("cap") / F.col("weight")), "mix-weights")
    whole = numbered.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).first()
    words, total = whole["words"] or 0, whole["weights"] or 1
    # The first source in order of cap / weight that its share of what is left doesn't fill: all before it are full.
    filling = positioned(numbered, ["all"], ["fills", "source_no"], "rank", {"full": "cap", "gone": "weight"}, name="mix-filling")
    left, over = F.lit(share * words) - F.col("full"), F.lit(total) - F.col("gone")
    level = filling.filter(F.col("weight") * left / over <= F.col("cap")).agg(F.min_by(F.struct(left.alias("left"), over.alias("over")), "rank").alias("level")).first()["level"]
    left, over = (level["left"], level["over"]) if level else (0.0, 1)
    size, limit = F.col("source_size"), F.col("take")
    laid = numbered.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(left)) / F.lit(over)))
    laid = laid.withColumn("take", F.floor("target").cast("long"))
    per = F.lit(block_words).cast("long")
    some = F.greatest(size, F.lit(1))
    laid = laid.withColumns({"full_blocks": F.expr(f"source_size div {block_words}"), "blocks": F.expr(f"(source_size + {block_words - 1}) div {block_words}"), "passes": F.floor(limit / some).cast("long"), "rest": F.pmod(limit, some)})
    laid = laid.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / per).cast("long"))
    laid = positioned(laid, ["all"], ["source_no"], "place", {"first_slot": "slots"}, name="mix-layout").drop("all", "cap", "fills", "place")
    return stage(laid, "mix-targets")


def schedule(sources: DataFrame, block_words: int = 1024) -> DataFrame:
    """slot, source_no, pass, block, words: which words of which block each slot of the mix takes (from the block's start). sources: as targets() gives them."""
    end = sources.agg(F.max(F.col("first_slot") + F.col("slots")).alias("n")).first()["n"] or 0
    step = golden_step(end)
    back = pow(step, -1, end) if end > 1 else 0
    first, last = F.col("first_slot"), F.col("first_slot") + F.col("slots") - 1
    # Intervals of points, cut at multiples of _CHUNK and dealt out before they unfold.
    cut = sources.filter("slots > 0").select("source_no", first.alias("first"), last.alias("last"), F.explode(F.sequence(F.expr(f"first_slot div {_CHUNK}"), F.expr(f"(first_slot + slots - 1) div {_CHUNK}"))).alias("chunk"))
    cut = cut.repartition("chunk", "source_no")
    points = cut.select("source_no", F.explode(F.sequence(F.greatest("first", F.col("chunk") * _CHUNK), F.least("last", (F.col("chunk") + 1) * _CHUNK - 1))).alias("point"))
    # The slot whose golden-ratio point this is.
    slots = stage(points.select("source_no", _times(F.col("point"), back, max(1, end)).alias("slot")).withColumn("stretch", F.expr(f"slot div {max(256, -(-end // 4096))}")), "mix-slots")
    counts = slots.groupBy("source_no", "stretch").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source_no").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source_no", "stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("source_no", "stretch").orderBy("slot")
    ranked = slots.join(stage(counts, "mix-ranks"), ["source_no", "stretch"]).withColumn("rank", F.col("earlier") + F.row_number().over(inside) - 1)
    ranked = ranked.join(sources.select("source_no", "source_size", "full_blocks", "blocks", "passes", "rest"), "source_no")
    ranked = ranked.withColumns({"pass": F.expr("rank div blocks"), "nth": F.expr("rank % blocks")})
    strided = F.when(F.col("nth") < F.col("full_blocks"), F.pmod(_times(F.col("nth"), F.pmod(F.lit(_STRIDE), F.greatest("full_blocks", F.lit(1))), F.greatest("full_blocks", F.lit(1))) + F.col("pass"), F.greatest("full_blocks", F.lit(1)))).otherwise(F.col("nth"))
    holds = F.when(F.col("nth") < F.col("full_blocks"), F.lit(block_words).cast("long")).otherwise(F.col("source_size") - F.col("full_blocks") * block_words)
    limit = F.when(F.col("pass") < F.col("passes"), F.col("source_size")).otherwise(F.col("rest"))
    return ranked.select("slot", "source_no", "pass", strided.alias("block"), F.least(holds, limit - F.col("nth") * block_words).alias("words"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, block_words: int = 1024, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(documents, pieces).

    documents: a row per document: row (tells it apart), doc_id, source, size, source_size, target.
    pieces: slot (place in the mix), pass, row, doc_id, from_word, to_word: what a slot takes of a document, 0-based, end exclusive.
    """
    sizes = stage(sized(docs, source_col, id_col, text_col, seed), "mix-documents")
    sources = targets(sizes, weights, share, most, block_words)
    placed = join_on(sizes, sources.select("source", "source_no", "source_size", "target"), ["source"])
    placed = positioned(placed, ["source_no"], ["shuffled", "doc_id", "size", "print"], "nth", {"start": "size"}, name="mix-placed")
    placed = stage(placed.select(F.struct("source_no", "nth").alias("row"), "doc_id", "source", "size", "source_size", "target", "start"), "mix-rows")
    blocks = F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))
    held = placed.filter("size > 0").select("row", F.col("row.source_no").alias("source_no"), "doc_id", "start", "size", F.explode(blocks).alias("block"))
    met = held.join(schedule(sources, block_words), ["source_no", "block"])
    at = F.col("block") * block_words
    lo, hi = F.greatest(F.col("start"), at), F.least(F.col("start") + F.col("size"), at + F.col("words"))
    pieces = met.filter(hi > lo).select("slot", "pass", "row", "doc_id", (lo - F.col("start")).alias("from_word"), (hi - F.col("start")).alias("to_word"))
    return placed.drop("start"), pieces


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """A row per document: doc_id, size, source_size, target (of its source), taken (words that the mix takes of it, repeats counted)."""
    rows, pieces = mix(docs, **options)
    taken = pieces.groupBy("row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    return rows.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, pieces: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """slot, pass, doc_id, from_word, words: the pieces with their words, in slots' order within each output file. Ids must be unique."""
    words = F.regexp_extract_all(F.col("__text"), F.lit(WORD), F.lit(0))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    cut = F.slice(words, (F.col("from_word") + 1).cast("int"), (F.col("to_word") - F.col("from_word")).cast("int"))
    out = pieces.join(texts, "doc_id").select("slot", "pass", "doc_id", "from_word", cut.alias("words"))
    return out.repartitionByRange("slot").sortWithinPartitions("slot", "doc_id", "from_word")
