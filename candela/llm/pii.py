"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score.

Everything is a DataFrame expression.  Kinds:

* email, ip, card, phone: the base kinds.  A match that fails its check (an
  address part over 255, Luhn, a digit count) is dropped and not retried.
* iban: two letters, two digits and 11 to 30 letters or digits whose ISO 7064
  mod-97 remainder is 1; in one piece or in groups of four after single blanks, of
  which all but the first group have a digit (so that words after it aren't taken in).
* ssn: ddd-dd-dddd; there is no checksum, so it needs a context word.

Each span has a score: what its check is worth plus a bonus when one of the
kind's context words stands in the `nearby` characters before it or after it, whatever
else has matched there.  Kinds beside the base ones are kept from `threshold` on; base spans
stay whatever their score is.

Defined results: null and empty texts have no spans (empty strings); repeated rows
give repeated results; an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S

_LOCAL = "A-Za-z0-9._%+-"
#: What follows an IBAN's country and check digits: one piece, or groups of four and a shorter last one.
_FOUR = "(?:[0-9][A-Z0-9]{3}|[A-Z][0-9][A-Z0-9]{2}|[A-Z]{2}[0-9][A-Z0-9]|[A-Z]{3}[0-9])"
IBAN_REST = rf"(?:[A-Z0-9]{{11,30}}|\x20[A-Z0-9]{{4}}(?:\x20{_FOUR}){{1,6}}(?:\x20(?:[0-9][A-Z0-9]{{0,2}}|[A-Z][0-9][A-Z0-9]?|[A-Z]{{2}}[0-9]))?)"
#: A match can only start where a run of its first class starts or where the last
#: match ended (\G): this keeps long runs from being scanned anew from each of their
#: characters. Possessive loops never give back what the rest could use here.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])[A-Z]{{2}}[0-9]{{2}}{IBAN_REST}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Cheap tests that a text with a match must pass.
GATES = {"email": "@", "phone": "+", "ip": ".", "ssn": "-"}
BASE = ["email", "ip", "card", "phone"]
EXTRA = ["iban", "ssn"]
CONTEXT = {
    "email": ["mail", "contact", "write to"],
    "ip": ["ip", "host", "server", "address"],
    "card": ["card", "visa", "credit", "payment"],
    "phone": ["phone", "tel", "call", "fax", "mobile"],
    "iban": ["iban", "account", "bank"],
    "ssn": ["ssn", "social security", "social-security"],
}
#: What a confirmed match is worth without context.
WORTH = {"email": 0.8, "ip": 0.6, "card": 0.9, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
#: What a context word adds.
BONUS = 0.4


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    figures = F.transform(F.reverse(F.split(number, "")), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(figures, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def mod97(code: Column) -> Column:
    """Remainder of an IBAN: its first four characters moved to the end, letters as 10 to 35."""
    chars = F.split(F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4)), "")
    return F.aggregate(
        chars,
        F.lit(0),
        lambda a, c: F.when(F.ascii(c) < 58, (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )


def small_parts(address: Column) -> Column:
    """Whether each part of a dotted address is at most 255 (leading zeros count for nothing)."""
    return F.forall(
        F.split(address, r"\."),
        lambda p: (F.length(F.ltrim(p, F.lit("0"))) < 4) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255),
    )


def confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return small_parts(match)
    if kind == "card":
        n = F.length(digits(match))
        return F.when((n >= 16) & (n <= 19), luhn(digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(digits(match)).between(8, 15)
    if kind == "iban":
        code = F.replace(match, F.lit(" "), F.lit(""))
        return F.length(code).between(15, 34) & (mod97(code) == 1)
    return F.lit(True)


def _confirm(kind: str):
    return lambda s: confirmed(kind, s["text"])


def _score(kind: str):
    return lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), score(kind, s["gap"], s["group"]).alias("score"))


def score(kind: str, before: Column, after: Column) -> Column:
    # Asked apart: a word doesn't stand on both sides at once.
    near = [F.lower(before), F.lower(after)]
    hit = F.lit(False)
    for word in CONTEXT[kind]:
        hit = hit | near[0].contains(word) | near[1].contains(word)
    return F.lit(WORTH[kind]) + F.when(hit, BONUS).otherwise(0.0)


def points(spans: Column) -> Column:
    """The spans' scores in hundredths, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")


def find_pii(docs: DataFrame, threshold: float = 0.6, nearby: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base spans and all spans (array of kind, start, end, text, score), sorted by kind as listed, then start."""
    text = F.col("text")
    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    for kind in [*BASE, *EXTRA]:
        gate = text.contains(GATES[kind]) if kind in GATES else None
        # A look-ahead has what stands after the match.
        found = S.matches(text, kind, rf"{PATTERNS[kind]}(?=([\s\S]{{0,{nearby}}}))", group=1, gap=nearby, when=gate)
        # A first filter before scoring; repeated fields are computed once per match.
        good = F.filter(found, _confirm(kind))
        scored = F.transform(good, _score(kind))
        rows = rows.withColumn(f"_{kind}", scored if kind in BASE else F.filter(scored, lambda s: s["score"] >= threshold))
    return rows.select(
        "doc_id",
        F.concat(*(F.col(f"_{k}") for k in BASE)).alias("base"),
        F.concat(*(F.col(f"_{k}") for k in [*BASE, *EXTRA])).alias("spans"),
    )
