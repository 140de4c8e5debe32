"""Plain single-process versions of the ten queries, written from their contracts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def op1(docs, tokenizer):
    out = {}
    for d, t in docs:
        t = t or ""
        n = len(tokenizer.encode(t, add_special_tokens=False).ids)
        out[d] = (len(t.encode()), n, n > 512)
    return out


def op2(turns):
    by = defaultdict(list)
    for c, n, r, t in turns:
        by[c].append((n, r or "", t or ""))
    out = {}
    for c, rows in by.items():
        rows.sort()
        loss = "".join(t for _, r, t in rows if r == "assistant")
        out[c] = (len(rows), sha("".join(f"{r}\n{t}\n" for _, r, t in rows)), len(loss), sha(loss))
    return out


def op3(text):
    """(counts of the base kinds, base spans)"""
    text = text or ""
    words = "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = re.compile(rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    found.sort()
    counts = Counter(k for _, k, _ in found)
    return tuple(counts[k] for k in range(3)), ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found)


def op4(text, encoding):
    ids = encoding.encode_ordinary(text or "")
    return len(ids), sha(",".join(map(str, ids))), sha(encoding.decode_bytes(ids))


def shingle_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or ""))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def op5(docs, percent=85):
    sets = {d: shingle_set(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    post = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            post[x].append(d)
    both = Counter()
    for ds in post.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                both[a, b] += 1
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def op6(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit), failed


def op6_scores(docs, good, order=2, buckets=16_384):
    """doc_id -> mean log-likelihood ratio of the hashed n-grams, and the threshold, one gram at a time in plain integers."""
    low = 2**64 - 1

    def grams(text):
        codes = [xxhash.xxh3_64_intdigest(w.lower().encode()) for w in WORD.findall(text or "")]
        out = []
        for n in range(1, order + 1):
            for at in range(len(codes) - n + 1):
                h = 0
                for k in range(n):
                    h = ((h + k + 1) * 0x9E3779B97F4A7C15 & low) ^ codes[at + k]
                h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & low
                out.append((h >> 32) % buckets)
        return out

    by = {d: grams(t) for d, t in docs}
    raw = Counter(g for gs in by.values() for g in gs)
    target = Counter(g for d in good for g in by.get(d, ()))
    p, q = sum(target.values()) + buckets, sum(raw.values()) + buckets
    ratio = lambda g: math.log((target[g] + 1) / p) - math.log((raw[g] + 1) / q)
    scores = {d: math.fsum(map(ratio, gs)) / len(gs) if gs else 0.0 for d, gs in by.items()}
    # The threshold: 0.05 below the lower end of the 1/256-wide bin that more than 0.5 % of the sound target's scores reach.
    sound = sorted(math.floor(scores[d] * 256) for d, t in docs if d in good and t is not None and not op6(t)[5])
    return scores, sound[math.floor(0.005 * len(sound))] / 256 - 0.05


def luhn(s):
    total = 0
    for k, c in enumerate(reversed(s)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def op9(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    spans = [[(k, m.start(), m.end()) for m in re.finditer(p, text) if ok(m[0])] for k, p, ok in kinds]
    return tuple(map(len, spans)), ",".join(f"{k}:{a}:{b}" for s in spans for k, a, b in s)


def op10(docs):
    by = defaultdict(list)
    for d, t in docs:
        by[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d))
    out = {}
    for norm, rows in by.items():
        keep = min(rows)[1]
        for _, d in rows:
            out[d] = (keep, len(rows), d == keep, sha(norm))
    return out


def ids_of(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def op8(docs, tokenizer, end=2):
    out, at = {}, 0
    for d, t in sorted(docs):
        ids = ids_of(tokenizer, t, end)
        out[d] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    return out


def check_op7(docs, pieces, tokenizer, end=0, sequence=1024):
    """pieces: rows of doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    by, rows = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p[0]].append(p)
        rows[p[5]].append((p[6], p[2]))
    assert set(by) == {d for d, _ in docs}
    for d, t in docs:
        ids, at = ids_of(tokenizer, t, end), 0
        for p in sorted(by[d], key=lambda p: p[1]):
            assert p[1] == at and p[2] > 0 and p[4] == len(ids)
            assert p[3] == zlib.crc32(ids[at : at + p[2]].tobytes())
            at += p[2]
        assert at == len(ids)
    fill = []
    for s in rows.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= sequence
        fill.append(at)
    assert sum(f < sequence for f in fill) <= 1
