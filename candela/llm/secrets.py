"""Secret scan with a trigram inverted index.

Each rule's regular expression is analysed for the trigrams that any match must
contain; that gives a Boolean query (AND / OR over trigrams of the lower-cased
text).  The index posts, for every trigram that some query names, the rows that
have it, as bitmaps over blocks of each file's rows; a query is answered by
intersecting and uniting postings.  Candidates are then verified with the rule's
expression on the whole text.  A rule without mandatory trigrams (a run of
hexadecimal figures) scans every text.

Everything is a DataFrame or SQL expression.  Text is never shuffled unless the
answers, some bits per document, are too large for Spark to broadcast.

Defined results: null and empty texts have no spans; rows are told by file and
place, so ids may be null or negative and repeat; repeated rows give repeated results; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import bit, fresh_name, located, stage


@dataclass(frozen=True)
class Rule:
    """group and least: the group whose length must be `least` at least (0: the whole match)."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


#: The base rules, in the order that sorts spans of one start. Loops are possessive where nothing could be given back.
BASE = [
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}"),
]
#: Further rules with fixed prefixes.
MORE = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    # Only where a run of its characters starts, or each eyJ in a long run would be tried up to the run's end.
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
]

# What follows the first line of a private key: all up to its END line; where that is missing (no END line
# before the next BEGIN), the header lines of the format and then the base64 lines. Line ends may be written
# as \n, lines may be indented, quoted or joined; a run of 40 figures needs no line end.
_GAP = r"""(?:[\s"'`>|,]|\\[nrt]?)*+"""
_END_OF_LINE = r"""(?:(?<==)(?![A-Za-z0-9+/])|(?=[\x20\t,]*+(?:[\r\n"'`\\]|\z)))"""
_FIGURES = r"(?:[A-Za-z0-9+/]|\\/)"
KEY_BODY = (
    r"\A(?:(?:[^-]++|-(?!----(?:BEGIN|END)\x20))*+-----END\x20[A-Z\x20]*PRIVATE\x20KEY(?:\x20BLOCK)?-----"
    rf"|(?:{_GAP}[A-Za-z][A-Za-z0-9-]*+:\x20[^\r\n\\]*+)*+(?:{_GAP}(?:{_FIGURES}{{40,}}+={{0,2}}|={{0,2}}{_FIGURES}++={{0,2}}{_END_OF_LINE}))*+)"
)


# --- Boolean trigram queries -------------------------------------------------
# A query is True (all documents), a trigram, or ("and" | "or", frozenset of queries).


def _all(queries) -> object:
    parts = set()
    for q in queries:
        if q is not True:
            parts |= q[1] if isinstance(q, tuple) and q[0] == "and" else {q}
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", frozenset(parts))


def _any(queries) -> object:
    parts = set()
    for q in queries:
        if q is True:
            return True
        parts |= q[1] if isinstance(q, tuple) and q[0] == "or" else {q}
    return next(iter(parts)) if len(parts) == 1 else ("or", frozenset(parts))


def _of(strings: set[str]) -> object:
    """What texts that contain one of the strings must contain."""
    return _any(_all(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


#: What an escape stands for: a character; what isn't here and is a letter or a figure stands for several or for none.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a"}
_QUANTIFIER = re.compile(r"(?:([*+?])|\{(\d*)(?:(,)(\d*))?\})[?+]?")
_GROUP = re.compile(r"\(\?(?:(?P<around><?[=!])|P?<\w+>|[a-zA-Z-]*:|>|(?P<flags>[a-zA-Z-]+\)))|\(")


class _Needs:
    """Reads a pattern from left to right, as Java and Python both have it; each part gives (the lower-case strings it matches, if few; a query that holds anyway).

    Concatenations are folded over sets of exact strings; where a set would exceed
    `most` strings, or an element is open-ended, the set so far turns into a query.
    """

    def __init__(self, pattern: str, most: int):
        self.pattern, self.most, self.at = pattern, most, 0

    def here(self, some: str) -> bool:
        return self.pattern[self.at : self.at + 1] in some if self.at < len(self.pattern) else False

    def alternatives(self) -> tuple[set[str] | None, object]:
        found = [self.sequence()]
        while self.here("|"):
            self.at += 1
            found.append(self.sequence())
        if len(found) == 1:
            return found[0]
        strings = None if any(s is None for s, _ in found) else set().union(*(s for s, _ in found))
        return (strings if strings is not None and len(strings) <= self.most else None), _any(q for _, q in found)

    def sequence(self) -> tuple[set[str] | None, object]:
        run, queries, exact = {""}, [], True
        while self.at < len(self.pattern) and not self.here("|)"):
            strings, query = self.repeated(*self.element())
            queries.append(query)
            if strings is None or len(run) * len(strings) > self.most:
                queries.append(_of(run))
                run, exact = strings or {""}, False
            else:
                run = {a + b for a in run for b in strings}
        return (run if exact else None), _all([*queries, _of(run)])

    def repeated(self, strings: set[str] | None, query: object) -> tuple[set[str] | None, object]:
        if not (m := _QUANTIFIER.match(self.pattern, self.at)) or m[0][:2] == "{}":
            return strings, query
        self.at = m.end()
        low = {"*": 0, "+": 1, "?": 0}[m[1]] if m[1] else int(m[2] or 0)
        high = {"*": None, "+": None, "?": 1}[m[1]] if m[1] else low if not m[3] else int(m[4]) if m[4] else None
        if strings is not None and (low, high) == (0, 1):
            return strings | {""}, True
        if strings is not None and low == high and len(strings) ** low <= self.most:
            return reduce(lambda a, _: {x + y for x in a for y in strings}, range(low), {""}), query
        return None, query if low else True

    def element(self) -> tuple[set[str] | None, object]:
        if m := _GROUP.match(self.pattern, self.at):
            self.at = m.end()
            if m["flags"]:
                return {""}, True
            inner = self.alternatives()
            self.at += 1
            return ({""}, True) if m["around"] else inner
        if self.here("["):
            return self.members(), True
        if self.here("^$"):
            self.at += 1
            return {""}, True
        if self.here("."):
            self.at += 1
            return None, True
        if self.pattern[self.at : self.at + 2] in ("\\b", "\\B", "\\A", "\\Z", "\\z"):
            self.at += 2
            return {""}, True
        c = self.character()
        return (None if c is None else {c.lower()}), True

    def character(self) -> str | None:
        """The character named here; None where it is one of several."""
        c = self.pattern[self.at]
        self.at += 1
        if c != "\\":
            return c
        c = self.pattern[self.at]
        self.at += 1
        if c in "pPQEkNuUXRcC0":
            raise ValueError(f"\\{c} is not read: {self.pattern}")
        if c == "x":
            self.at += 2
            return chr(int(self.pattern[self.at - 2 : self.at], 16))
        return ESCAPES.get(c, None if c.isalnum() else c)

    def members(self) -> set[str] | None:
        """The characters of a class; None where it is negated or has a long range."""
        self.at += 1
        chars: set[str] | None = set()
        if self.here("^"):
            self.at, chars = self.at + 1, None
        begin = self.at
        while not self.here("]") or self.at == begin:
            if self.here("["):
                raise ValueError(f"a class in a class is not read: {self.pattern}")
            low = high = self.character()
            if low is not None and self.here("-") and self.pattern[self.at + 1] != "]":
                self.at += 1
                high = self.character()
            if low is None or high is None or ord(high) - ord(low) >= 8:
                chars = None
            elif chars is not None:
                chars |= {chr(c).lower() for c in range(ord(low), ord(high) + 1)}
        self.at += 1
        return chars


def trigram_query(pattern: str, most: int = 64) -> object:
    """The Boolean query of trigrams that each match of the pattern needs (lower case)."""
    reader = _Needs(pattern, most)
    query = reader.alternatives()[1]
    if reader.at < len(pattern):
        raise ValueError(f"a bracket without its opening at {reader.at}: {pattern}")
    return query


def trigrams(query: object) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*(trigrams(q) for q in query[1]))


# --- index and search --------------------------------------------------------


def build_index(docs: DataFrame, grams: list[str], file: str, row: str, text_col: str = "text") -> DataFrame:
    """Postings: gram, file, block of the file's rows and the bitmap of the block's rows that contain it, written to the shared folder."""
    low, row_ = F.lower(F.col(f"`{text_col}`").cast("string")), F.col(row)
    present = F.array_compact(F.array(*(F.when(F.col("low").contains(g), F.lit(g)) for g in grams)))
    return stage(
        docs.select(F.col(file).alias("file"), row_.alias("row"), low.alias("low"))
        .select("file", "row", F.explode(present).alias("gram"))
        .groupBy("gram", "file", F.bitmap_bucket_number("row").alias("block"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("row")).alias("bits")),
        "secret-postings",
    )


def conjunctions(query: object) -> list[list[str]]:
    """The query as alternatives, each a list of trigrams that must all be there.

    An alternative that asks for all that another asks for, and more, adds nothing and goes.
    """
    if isinstance(query, str):
        return [[query]]
    parts = [conjunctions(q) for q in sorted(query[1], key=str)]
    found = {frozenset(c) for p in parts for c in p} if query[0] == "or" else {frozenset().union(*pick) for pick in product(*parts)}
    return sorted(sorted(c) for c in found if not any(other < c for other in found))


def candidates(index: DataFrame, queries: dict[str, object]) -> DataFrame:
    """file, block and, for each rule, the bitmap of its candidates.

    Postings of one alternative are intersected, alternatives of one rule united: two
    aggregations of bitmaps for all rules together.
    """
    wanted: dict[str, list] = {}
    for kind, query in queries.items():
        for term, grams in enumerate(conjunctions(query)):
            for g in grams:
                wanted.setdefault(g, []).append(F.struct(F.lit(kind).alias("kind"), F.lit(term).alias("term"), F.lit(len(grams)).alias("needs")))
    uses = F.create_map(*(x for g, terms in sorted(wanted.items()) for x in (F.lit(g), F.array(*terms))))
    asked = index.select("file", "block", "bits", F.explode(F.element_at(uses, F.col("gram"))).alias("use")).select("file", "block", "bits", "use.*")
    # A block lacks the documents of an alternative when one of its lists has no entry there.
    whole = asked.groupBy("kind", "term", "needs", "file", "block").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("lists")).filter("lists = needs")
    united = whole.groupBy("kind", "file", "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    by_kind = F.map_from_entries(F.collect_list(F.struct("kind", "bits")))
    return stage(united.groupBy("file", "block").agg(by_kind.alias("bits")), "secret-candidates")


def _long_enough(rule: Rule):
    return lambda s: F.length(s["group"] if rule.group else s["text"]) >= rule.least


def _keyed(place: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"), s["text"].alias("text"))


def find_secrets(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, base spans and all spans (array of kind, start, end, text), sorted by start, then kind as listed.

    keep: the rows keep docs' own columns in place of doc_id, as own.0, own.1, ... in their order.
    """
    rules = [*BASE, *MORE] if rules is None else rules
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not True}
    grams = sorted({g for q in queries.values() for c in conjunctions(q) for g in c})
    file, row = fresh_name(docs, "_file"), fresh_name(docs, "_row")
    whole = located(docs, file, row)
    found = candidates(build_index(whole, grams, file, row, text_col), queries)
    own = docs.columns if keep else []
    rows = whole.select(
        *(F.col(f"`{c}`").alias(f"own.{i}") for i, c in enumerate(own)),
        F.expr(f"cast(`{id_col}` as long)").alias("sid"),
        F.expr(f"cast(`{text_col}` as string)").alias("stext"),
        F.col(file).alias("file"),
        F.bitmap_bucket_number(F.col(row)).alias("block"),
        F.bitmap_bit_position(F.col(row)).alias("place"),
    )
    # No hint: the candidates are staged, so Spark broadcasts them only while they are small.
    rows = rows.join(found, ["file", "block"], "left")
    text = F.col("stext")
    for rule in rules:
        gate = None
        if rule.kind in queries:
            gate = bit(F.col("bits")[rule.kind], F.col("place"))
        spans = S.matches(text, rule.kind, rule.pattern, rule.group, when=gate)
        if rule.least:
            spans = F.filter(spans, _long_enough(rule))
        rows = rows.withColumn(f"_{rule.kind}", spans)
    place = {r.kind: k for k, r in enumerate(rules)}

    def sort(kinds: list[str]) -> Column:
        keyed = F.concat(*(F.transform(F.col(f"_{k}"), _keyed(place[k])) for k in kinds))
        return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))

    base = [r.kind for r in rules if r in BASE]
    return rows.select(
        *(F.col(f"`own.{i}`") for i in range(len(own))),
        *([] if keep else [F.col("sid").alias("doc_id")]),
        (sort(base) if base else F.array().cast("array<struct<kind:string,start:int,end:int,text:string>>")).alias("base"),
        sort([r.kind for r in rules]).alias("spans"),
    )


def with_body(text: Column):
    """A span, for a private key up to the end of what the key's first line announces."""

    def whole(s: Column) -> Column:
        body = F.when(s["kind"] == "private_key", F.length(F.regexp_extract(F.substr(text, s["end"] + 1), KEY_BODY, 0))).otherwise(0)
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), (s["end"] + body).alias("end"))

    return whole


def redact_secrets(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with every secret replaced by its kind in brackets, private keys with their bodies; a length column follows the text."""
    found = find_secrets(docs, rules, id_col, text_col, keep=True)
    own = {c: F.col(f"`own.{i}`") for i, c in enumerate(docs.columns)}
    text = own[text_col].cast("string")
    found = found.withColumn("clean", S.redact(text, F.transform("spans", with_body(text))))

    def column(name: str) -> Column:
        if name == text_col:
            return F.col("clean").alias(name)
        if name == length_col:
            # Only where the text changed: a length that disagreed before is left as it is.
            return F.when(F.size("spans") > 0, F.length("clean").cast(docs.schema[name].dataType)).otherwise(own[name]).alias(name)
        return own[name].alias(name)

    return found.select(*map(column, docs.columns))
