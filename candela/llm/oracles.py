"""DuckDB SQL for the queries that SQL can express, on whole tables and texts."""

from __future__ import annotations

import re

from . import chat, pii, secrets

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"
_ESCAPED = r"\\|<</SYS>>|<<SYS>>|\[/INST\]|\[INST\]|</s>|<s>|<\|"
assert len(chat.CONTROL) == _ESCAPED.count("|") - 1  # the bar inside <\| isn't an alternative


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP2 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
u AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '{_ESCAPED}')) AS body,
         length(role) + len(regexp_extract_all(role, '{_ESCAPED}')) + len(regexp_extract_all(role, '\n')) AS head
  FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' THEN 18 + body ELSE 24 + head + body END)::BIGINT AS formatted_chars
FROM u GROUP BY conv_id
"""

OP5 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d WHERE len(w) >= 5),
h AS (SELECT doc_id, w AS w0, lead(w, 1) OVER v AS w1, lead(w, 2) OVER v AS w2, lead(w, 3) OVER v AS w3, lead(w, 4) OVER v AS w4 FROM t WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT DISTINCT doc_id, hash(w0, w1, w2, w3, w4) AS g FROM h WHERE w4 IS NOT NULL
      UNION ALL SELECT doc_id, hash(array_to_string(w, ' ')) FROM d WHERE len(w) BETWEEN 1 AND 4),
k AS (SELECT doc_id, g FROM p SEMI JOIN (SELECT g FROM p GROUP BY g HAVING count(*) > 1) USING (g)),
n AS (SELECT d.doc_id, count(p.g) AS n FROM d LEFT JOIN p USING (doc_id) GROUP BY d.doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM k a JOIN k b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT n.doc_id, n.n AS n_shingles, min(r.root) AS component_id, n.doc_id = min(r.root) AS kept
FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""

OP10 = rf"""
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""


OP11 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][no % 3 + 1] AS w, 2 * ss AS cap FROM s),
f AS (
  SELECT *, 1.5::DOUBLE * (sum(ss) OVER ())::DOUBLE - coalesce(sum(cap) OVER o, 0)::DOUBLE AS rest, (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::DOUBLE AS over_, row_number() OVER (ORDER BY cap / w, no) AS r
  FROM w WINDOW o AS (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT rest, over_ FROM f WHERE w * rest / over_ <= cap ORDER BY r LIMIT 1),
t AS (SELECT no, source, ss, least(cap::DOUBLE, w * rest / over_) AS target FROM w, v),
u AS (SELECT *, floor(target)::BIGINT AS take, ss // 1024 AS full_, (ss + 1023) // 1024 AS blocks FROM t),
x AS (SELECT *, take // greatest(ss, 1) AS passes, take % greatest(ss, 1) AS rest FROM u),
k AS (SELECT *, rank // blocks AS pass, rank % blocks AS nth FROM (SELECT *, unnest(range(passes * blocks + (rest + 1023) // 1024)) AS rank FROM x)),
b AS (
  SELECT no, CASE WHEN nth < full_ THEN ((nth::HUGEINT * (2305843009213693951 % full_) + pass) % full_)::BIGINT ELSE nth END AS block,
         least(CASE WHEN nth < full_ THEN 1024 ELSE ss - full_ * 1024 END, (CASE WHEN pass < passes THEN ss ELSE rest END) - nth * 1024) AS words FROM k),
p AS (
  SELECT row_number() OVER () AS i, doc_id, size, no, ss, target, sum(size) OVER (PARTITION BY no ORDER BY h, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT i, no, start, size, unnest(range((start // 1024)::BIGINT, ((start + size - 1) // 1024)::BIGINT + 1)) AS block FROM p WHERE size > 0),
g AS (SELECT i, sum(greatest(0, least(start + size, block * 1024 + words) - greatest(start, block * 1024)))::BIGINT AS taken FROM q JOIN b USING (no, block) GROUP BY i)
SELECT doc_id, size, ss AS source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM p LEFT JOIN g USING (i)
"""

OP13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
f AS (
  SELECT d.doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), min(doc_id) OVER (PARTITION BY t) IS NOT NULL) AS e,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d LEFT JOIN l USING (doc_id)),
m AS (SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x, i: [a, b, c, d, e][i]) AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
s AS (SELECT * FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x)),
o AS (
  SELECT p.x || q.x || r.x || t.x || u.x AS filter_order FROM s p, s q, s r, s t, s u
  WHERE p.x NOT IN (q.x, r.x, t.x, u.x) AND q.x NOT IN (r.x, t.x, u.x) AND r.x NOT IN (t.x, u.x) AND t.x <> u.x),
k AS (SELECT filter_order, step, filter_order[step] AS x, string_split(filter_order[1:step - 1], '') AS before FROM o, range(1, 6) v(step)),
g AS (
  SELECT part, filter_order, step, x,
         coalesce(sum(n) FILTER (NOT list_has_any(fails, list_append(before, x))), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (list_contains(fails, x) AND NOT list_has_any(fails, before)), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (list_contains(fails, x) AND list_has_any(fails, before)), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails = [x]), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (list_contains(fails, x) AND NOT list_has_any(fails, before)), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (list_contains(fails, x) AND NOT list_has_any(fails, before)), 0)::BIGINT AS toxic_lost
  FROM m, k GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM g
"""


def _spans(kind: str, place: int, pattern: str, group: int, test: str, points: str = "0") -> str:
    """Rows doc_id, place, kind, lo, hi, points of the matches that pass; gaps and matches add up to the places."""
    p = _literal(pattern)
    return f"""
  SELECT doc_id, {place} AS place, '{kind}' AS kind, lo, lo + length(m) AS hi, {points} AS points FROM (
    SELECT doc_id, t, ms[i] AS m, gs[i] AS g, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS lo
    FROM (SELECT doc_id, t, ms, gaps, gs, unnest(range(1, len(ms) + 1)) AS i
          FROM (SELECT doc_id, t, regexp_extract_all(t, {p}) AS ms, regexp_extract_all(t, {p}, {group}) AS gs, string_split_regex(t, {p}) AS gaps FROM d) WHERE len(ms) > 0)) WHERE {test}"""


def _report(parts: list[str], counts: list[str], base: list[str], order: str, points: bool = False) -> str:
    text = "kind || ':' || lo || ':' || hi"
    inside = ", ".join(_literal(k) for k in base)
    ns = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in counts)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(parts)})
SELECT d.doc_id, {ns}, sha256(coalesce(string_agg({text}, ',' ORDER BY {order}) FILTER (kind IN ({inside})), '')) AS base_sha256,
       coalesce(string_agg({text}, ',' ORDER BY {order}) FILTER (kind IS NOT NULL), '') AS spans{f", coalesce(string_agg(points::VARCHAR, ',' ORDER BY {order}) FILTER (kind IS NOT NULL), '') AS scores" if points else ""}
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
"""


def _either_case(pattern: str) -> str:
    """(?i:...) with a class for each letter: this engine would also fold the long s and the Kelvin sign."""
    return re.sub(r"\(\?i:(.*?)\)", lambda m: "(?:" + re.sub("[a-z]", lambda c: f"[{c[0]}{c[0].upper()}]", m[1]) + ")", pattern)


#: This engine has neither look-behind nor possessive loops: the character before the token is matched along and left out of the span.
_JWT = r"(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"


def op3() -> str:
    rules = [*secrets.BASE, *secrets.MORE]
    parts = [
        _spans("jwt", k, _JWT, 1, "TRUE").replace("lo, lo + length(m) AS hi", "lo + length(m) - length(g) AS lo, lo + length(m) AS hi") if r.kind == "jwt"
        else _spans(r.kind, k, _either_case(r.pattern), r.group, f"length({'g' if r.group else 'm'}) >= {r.least}")
        for k, r in enumerate(rules)
    ]
    kinds = [r.kind for r in secrets.BASE]
    return _report(parts, kinds, kinds, "lo, place")


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN (reverse({_DIGITS})[j])::INT
  ELSE (2 * (reverse({_DIGITS})[j])::INT) // 10 + (2 * (reverse({_DIGITS})[j])::INT) % 10 END)) % 10 = 0"""
_IBAN = "replace(m, ' ', '')"
_MOD97 = f"""list_reduce(list_prepend(0::BIGINT, list_transform(string_split({_IBAN}[5:] || {_IBAN}[1:4], ''), lambda c: CASE WHEN c >= '0' AND c <= '9' THEN c::BIGINT ELSE 1000 + ascii(c) - 55 END)),
  lambda a, x: CASE WHEN x >= 1000 THEN (a * 100 + x - 1000) % 97 ELSE (a * 10 + x) % 97 END) = 1"""


def _points(kind: str) -> str:
    """Hundredths: what the check is worth, and more with a context word within 40 characters before or after."""
    sides = ("lower(right(t[1:lo], 40))", "lower(t[lo + length(m) + 1:lo + length(m) + 40])")
    near = " OR ".join(f"contains({side}, {_literal(w)})" for side in sides for w in pii.CONTEXT[kind])
    return f"({round(100 * pii.WORTH[kind])} + CASE WHEN {near} THEN {round(100 * pii.BONUS)} ELSE 0 END)"


def op9() -> str:
    """The patterns of the contract itself, which the operator's guarded ones must equal."""
    # \b is the operator's look-around once underscores are hyphens.
    apart = lambda sql: sql.replace("regexp_extract_all(t,", "regexp_extract_all(translate(t, '_', '-'),").replace("string_split_regex(t,", "string_split_regex(translate(t, '_', '-'),")
    parts = [
        _spans("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0, "TRUE", _points("email")),
        _spans("ip", 1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0, "list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) < 4 AND coalesce(try_cast(x AS HUGEINT), 999) <= 255))", _points("ip")),
        _spans("card", 2, r"[0-9]([\x20-]?[0-9])+", 0, f"CASE WHEN length({_DIGITS}) BETWEEN 16 AND 19 THEN {_LUHN} ELSE FALSE END", _points("card")),
        _spans("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", 0, f"length({_DIGITS}) BETWEEN 8 AND 15", _points("phone")),
        apart(_spans("iban", 4, rf"\b[A-Z]{{2}}[0-9]{{2}}{pii.IBAN_REST}\b", 0, f"CASE WHEN length({_IBAN}) BETWEEN 15 AND 34 THEN {_MOD97} ELSE FALSE END", _points("iban"))),
        # A whole run of figures and hyphens, with a context word near it.
        _spans("ssn", 5, r"[0-9-]+", 0, f"regexp_full_match(m, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') AND {_points('ssn')} >= 60", _points("ssn")),
    ]
    return _report(parts, pii.BASE, pii.BASE, "place, lo", points=True)


ORACLES = {"op2_chat_formatting": OP2, "op3_secret_scans": op3(), "op5_minhash_near_dedup": OP5, "op9_pii": op9(), "op10_exact_dedup": OP10, "op11_source_mix": OP11, "op13_filter_audit": OP13}
