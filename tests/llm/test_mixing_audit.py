"""Operators 11 and 13 against plain Python."""

import math
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from candela.llm import filter_audit, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- operator 11 ---------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 100, 997, 65_536, 1_000_003])
def test_golden_points_visit_every_slot_evenly(n):
    a = mixing.golden_step(n)
    assert math.gcd(a, n) == 1
    points = [j * a % n for j in range(n)]
    assert len(set(points)) == n
    if n < 500:
        return
    # Any prefix of the schedule has its share of any interval, up to a few slots.
    for lo, hi in ((0, n // 3), (n // 2, n // 2 + n // 50)):
        inside = 0
        for j, p in enumerate(points[: min(n, 100_000)]):
            inside += lo <= p < hi
            assert abs(inside - (j + 1) * (hi - lo) / n) < 12


def water(sizes, weights, share, most):
    """Targets by resharing the excess until none is above."""
    full, todo = {}, set(range(len(sizes)))
    while True:
        left = share * sum(sizes) - sum(full.values())
        total = sum(weights[i] for i in todo)
        above = [i for i in todo if left * weights[i] / total > most * sizes[i]]
        if not above:
            return [float(full[i]) if i in full else left * weights[i] / total for i in range(len(sizes))]
        for i in above:
            full[i] = most * sizes[i]
            todo.discard(i)


@pytest.fixture(scope="module")
def rows():
    """A hot source, one of a single word, one without words, the null one, long documents and repeated rows."""
    text = lambda n, w="w": " ".join([w] * n)
    out = [(d, text(5 + d % 90), "hot") for d in range(150)]
    out += [(200, text(7000), "long"), (201, text(30), "long"), (202, "one", "tiny"), (203, "", "void"), (204, None, "void"), (None, text(40), None), (205, text(400), None)]
    out += [(206, "a\x85b \x1cc", "Ünder"), (207, text(60), "zz"), (207, text(60), "zz"), (207, text(61, "v"), "zz"), (None, text(12), "zz")]
    return out


@pytest.mark.parametrize("block", [16, 1024])
def test_mix_meets_the_targets(spark, rows, block):
    df = spark.createDataFrame([(*r, 0, 0.5) for r in rows], "doc_id long, text string, source string, size int, target double").repartition(3)
    out, pieces = mixing.mix(df, block_words=block)
    got, pieces = out.collect(), pieces.collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = dict(zip(names, water([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2)))
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((d or -1, len(WORD.findall(t or ""))) for d, t, _ in rows)
    assert all(r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 for r in got)
    of = {tuple(r.row): r for r in got}
    assert len(of) == len(rows)
    taken, seen = Counter(), defaultdict(Counter)
    for p in pieces:
        assert 0 <= p.from_word < p.to_word <= of[tuple(p.row)].size
        for w in range(p.from_word, p.to_word):
            seen[tuple(p.row)][w] += 1
        taken[of[tuple(p.row)].source] += p.to_word - p.from_word
    assert all(abs(taken[s] - want[s]) < 1.001 for s in names)  # each source's words, to the word
    assert all(max(c.values()) <= 2 for c in seen.values())
    # A slot is one block of one source: all slots are there, none holds more than a block.
    slots = defaultdict(list)
    for p in pieces:
        slots[p.slot].append(p)
    assert sorted(slots) == list(range(len(slots)))
    assert all(len({q.row.source_no for q in ps}) == 1 and sum(q.to_word - q.from_word for q in ps) <= block for ps in slots.values())
    per_doc = {(r.doc_id, r.size): r.taken for r in mixing.mixed_documents(df, block_words=block).filter("doc_id < 200").collect()}
    again = {(r.doc_id, r.size): r.taken for r in mixing.mixed_documents(df.repartition(5), block_words=block).filter("doc_id < 200").collect()}
    assert per_doc == again and all(t <= 2 * n for (_, n), t in per_doc.items())


def test_mixed_texts_hold_the_pieces(spark):
    df = spark.createDataFrame([(1, "a b  c d e", "x"), (2, "f\ng", "y")], "doc_id long, text string, source string")
    _, pieces = mixing.mix(df, block_words=2)
    got = mixing.mixed_texts(df, pieces).collect()
    words = {1: "abcde", 2: "fg"}
    assert all("".join(r["words"]) == words[r.doc_id][r.from_word : r.from_word + len(r["words"])] for r in got)
    assert sum(len(r["words"]) for r in got) == 10  # 1.5 times 7 words, to the word of each source


def test_schedule_spreads_a_source(spark):
    df = spark.createDataFrame([(d, "w " * 50, "ab"[d % 4 == 0]) for d in range(400)], "doc_id long, text string, source string")
    out, pieces = mixing.mix(df, block_words=50)
    source = {tuple(r.row): r.source for r in out.collect()}
    slots = [s for _, s in sorted({(p.slot, source[tuple(p.row)]) for p in pieces.collect()})]
    share = slots.count("b") / len(slots)
    for n in range(1, len(slots)):
        assert abs(slots[:n].count("b") - n * share) < 4


# --- operator 13 ---------------------------------------------------------------


def fails(text, copy):
    words = WORD.findall(text)
    return "".join(
        f for f, bad in zip("ABCDE", (
            len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), bool(re.search("[#$%&*|]", text)), copy,
        )) if bad
    )


def brute(rows, labels):
    good, toxic = ({d for d, q, t in labels if (q, t)[k] == 1} for k in (0, 1))
    docs, out = [], {}
    for d, t, s in rows:
        same = [e for e, u, _ in rows if (u or "") == (t or "") and e is not None]
        docs.append((s or "", fails(t or "", bool(same) and (d is None or min(same) < d)), d in good and d is not None, d in toxic and d is not None))
    for part in {p for p, *_ in docs}:
        own = [x[1:] for x in docs if x[0] == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                before = order[:k]
                gone = [x for x in own if f in x[0] and not set(before) & set(x[0])]
                shapley[f] += len(gone)
                out[part, order, k + 1] = (sum(not set(before + f) & set(x[0]) for x in own), len(gone), sum(f in x[0] and bool(set(before) & set(x[0])) for x in own), sum(x[0] == f for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone))
        for (p, order, k), v in list(out.items()):
            if p == part:
                out[p, order, k] = (*v[:6], shapley[order[k - 1]])
    return out


def test_audit_equals_brute_force(spark, docs):
    rows = [(d, t, None if d % 7 == 0 else f"s{d % 3}" if d % 5 else "") for d, t in docs]
    long = " ".join(f"w{i}" for i in range(60))
    rows += [(900, long, "s0"), (901, long, "s1"), (901, long, "s1"), (901, long + " #", "s1"), (None, long, "s2"), (None, "only here", "s2"), (None, "only here", "s2"), (902, long + " ABCDEFGHIJKLMNOPQRSTUVWXYZ", "s2")]
    labels = [(d, d % 2, d % 3) for d, *_ in rows if d is not None and d % 4] + [(900, 0, 1), (900, 1, 0), (None, 1, 1), (10_000, 1, 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, good int, part string").repartition(3)
    got = filter_audit.filter_interactions(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    have = {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in got.collect()}
    assert got.count() == len(have) and have == brute(rows, labels)


def test_audit_of_a_part_that_passes_all(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)), None)], "doc_id long, text string, source string")
    got = filter_audit.filter_interactions(df, spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int"))
    assert got.count() == 600 and got.filter("part = '' and kept = 1 and removed = 0 and shapley = 0 and good_lost = 0").count() == 600
    assert got.select("filter_order").distinct().count() == 120 and got.agg(F.sum("step")).first()[0] == 1800
