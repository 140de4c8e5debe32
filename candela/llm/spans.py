"""Match spans of a regular expression as column expressions (code points, end exclusive).

Spark's SQL functions give matches but not where they stand.  Splitting the text
by the same expression gives what lies between the matches, and both run over the
same leftmost non-overlapping matches; the lengths of gaps and matches, added up,
are the spans.  Patterns must not match the empty string.

A step of an aggregation copies its state, so matches are gone through in blocks:
an inner aggregation collects a block's results, an outer one the blocks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,end:int,text:string,group:string,gap:string>>"


_BLOCK = 256


def _blocks(items: Column) -> Column:
    """Array of arrays of _BLOCK items; one empty block for an empty array."""
    last = F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / _BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(items, c * _BLOCK + 1, F.lit(_BLOCK)))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def matches(text: Column, kind: str, pattern: str, group: int = 0, gap: int = 0, when: Column | None = None) -> Column:
    """Array of (kind, start, end, text, group, gap); gap: as many characters of what stands before the match, earlier matches among it.

    Empty for null texts, for texts without a match and where `when` is not true.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.transform(found, lambda _: F.lit(""))
    gaps = F.split(text, pattern, -1)

    def state(at: Column, tail: Column, spans: Column) -> Column:
        """tail: the `gap` characters before the place it has come to."""
        return F.struct(at.alias("at"), tail.alias("tail"), spans.alias("spans"))

    def step(now: Column, m: Column) -> Column:
        lo = now["at"] + F.length(m["gap"])
        hi = lo + F.length(m["text"])
        before = F.right(F.concat(now["tail"], m["gap"]), F.lit(gap)) if gap else F.lit("")
        tail = F.right(F.concat(now["tail"], m["gap"], m["text"]), F.lit(gap)) if gap else F.lit("")
        span = F.struct(F.lit(kind).alias("kind"), lo.alias("start"), hi.alias("end"), m["text"].alias("text"), m["group"].alias("group"), before.alias("gap"))
        return state(hi, tail, F.concat(now["spans"], F.array(span)))

    def block(now: Column, items: Column) -> Column:
        start = state(now["at"], now["tail"], F.array().cast(SPAN))
        return F.aggregate(items, start, step, lambda s: state(s["at"], s["tail"], F.concat(now["spans"], F.array(s["spans"]))))

    # The last gap, after the last match, has no match of its own.
    zipped = F.arrays_zip(found.alias("text"), groups.alias("group"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"))
    start = state(F.lit(0), F.lit(""), F.array().cast(f"array<{SPAN}>"))
    spans = _let(zipped, lambda items: F.aggregate(_blocks(items), start, block, lambda s: F.flatten(s["spans"])))
    has = text.rlike(pattern)
    return F.when(has if when is None else when & has, spans).otherwise(F.array().cast(SPAN))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by <kind>; a span that overlaps the one before it widens that one's gap."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def state(at: Column, parts: Column) -> Column:
        return F.struct(at.alias("at"), parts.alias("parts"))

    def step_in(chunk: Column, begin: Column):
        def step(now: Column, s: Column) -> Column:
            clear = F.substr(chunk, now["at"] - begin + 1, s["start"] - now["at"])
            wide = state(F.greatest(now["at"], s["end"]), now["parts"])
            cut = state(s["end"], F.concat(now["parts"], F.array(clear, F.concat(F.lit("<"), s["kind"], F.lit(">")))))
            return F.when((s["start"] < now["at"]) & (now["at"] > 0), wide).otherwise(cut)

        return step

    none = F.array().cast("array<string>")

    def block(now: Column, items: Column) -> Column:
        # A block's part of the text, so that no span is sought from the text's start.
        last = F.array_max(F.transform(items, lambda s: s["end"]))
        part = F.substr(text, now["at"] + 1, last - now["at"])
        add = lambda s: state(s["at"], F.concat(now["parts"], F.array(F.array_join(s["parts"], ""))))
        return _let(part, lambda chunk: F.aggregate(items, state(now["at"], none), step_in(chunk, now["at"]), add))

    whole = F.aggregate(_blocks(ordered), state(F.lit(0), none), block, lambda s: F.concat(F.array_join(s["parts"], ""), F.substr(text, s["at"] + 1)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
