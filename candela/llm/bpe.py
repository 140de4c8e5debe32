"""Byte-level BPE encoding and decoding by ranked merges.

The merges are folded by Spark's higher-order functions over the byte arrays of
distinct words, with the rank table as a literal map.  Tokens are named by their
ranks; the map leads from a pair of tokens to the rank of the two joined.  It is one
array: each left token has a displacement, the right token is added to it, and the
entry there tells its owner, so a lookup compares one number.  Decoding concatenates
the ids' binary pieces, which come from a second literal, id to piece.

A whole table goes through one pass without a shuffle:

1. Words, the matches of the split pattern, are found per batch of documents; a
   batch is one row: its documents as arrays of word numbers and the words that
   this task has not seen before, as byte arrays (each byte with its left neighbour).
2. The fold turns each new word's bytes into ids; these ids are decoded.
3. The next step of the same task keeps the words' ids and decoded bytes and
   concatenates them per document.

Both ends of step 2 run in one task over the same stream of rows, in order, so a
word is folded once per task.  When a task has seen `keep` words, both ends drop
what they know at the same row; memory stays bounded.  Small splits of a table's files are put together, as a longer task folds
fewer words anew.

Defined results: null and empty texts have no ids; repeated rows give repeated
results; an empty table gives an empty table; extra columns are ignored.  A single
byte without a rank, or an id without a piece, is an error.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ensure_importable, file_bytes, small_batches, text_slices


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank file: base64 of a token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


# A neighbouring pair is one long: "joins to no token" (17 bits, 0 where it joins), rank of the two joined (17), place (12),
# right token (17). The left token is the right one of the pair before. The smallest long is the pair to merge next: the
# lowest rank, then the leftmost.
_ID, _PLACE = 17, 12
_RANK, _OWNER = _ID + _PLACE, 2 * _ID + _PLACE
_IDS, _PLACES = (1 << _ID) - 1, ((1 << _PLACE) - 1) << _ID
_NONE = 1 << _OWNER  # pairs from here on make no token
#: Bytes of a word that is folded in one array, and pairs in a block of a longer one.
FLAT, BLOCK = 128, 256
#: Bytes of files for a task: the more documents it has, the fewer words are folded again by another.
TASK_BYTES = 32_000_000


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(displacement of each token, entries): entry [displacement of a + b] names a as its owner and the rank of a + b.

    Rows of entries are laid where all their places are free, the fullest first.
    The token `size` stands for a word's ends; it owns nothing.
    """
    size = max(ranks.values()) + 1
    if size >= _IDS:
        raise ValueError(f"ranks must be below {_IDS - 1}")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a rank: {missing}")
    rows: dict[int, list[tuple[int, int]]] = {}
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                rows.setdefault(a, []).append((b, rank))
    rng, room = np.random.default_rng(0), 64 + 4 * sum(map(len, rows.values()))
    free = np.ones(room + size + 1, bool)
    at, entries = np.zeros(size + 1, np.int64), np.full(len(free), _IDS << _OWNER, np.int64)
    for a, row in sorted(rows.items(), key=lambda r: (-len(r[1]), r[0])):
        right, joined = np.array(row).T
        while not (fits := free[(tries := rng.integers(0, room, 32))[:, None] + right].all(1)).any():
            pass
        at[a] = tries[fits.argmax()]
        free[at[a] + right] = False
        entries[at[a] + right] = a << _OWNER | joined << _RANK
    return at, entries


def sure_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """(3, 257 * 257) ranks by two neighbouring bytes, _IDS for none: of the two joined, and the bounds that tell which pairs of bytes are sure.

    A pair whose rank is below the left bound of the two bytes one place before it and below the right bound of the two one place after it is merged
    before either of its bytes meets another: the bounds are the lowest ranks by which the pair's first byte ever joins a token that ends in the byte
    before, and by which its last joins one that begins with the byte after. A rank is left out where a token made with the joined pair has a lower one;
    so what comes of it waits its turn, and all sure pairs can be merged at once.
    """
    joined, left, right = bounds = np.full((3, 257, 257), _IDS)
    later = dict.fromkeys(ranks, _IDS)
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            a, b = token[:k], token[k:]
            if a in ranks and b in ranks:
                at = a[-1], b[0]
                later[a], later[b] = min(later[a], rank), min(later[b], rank)
                if len(b) == 1:
                    left[at] = min(left[at], rank)
                if len(a) == 1:
                    right[at] = min(right[at], rank)
    for token, rank in ranks.items():
        if len(token) == 2 and rank < later[token]:
            joined[token[0], token[1]] = rank
    return bounds.reshape(3, -1)


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The rank map as a literal: struct of at, entries, first (the pair that each code of _codes begins as), end (the token of a word's ends) and sure_pairs."""
    at, entries = pair_table(ranks)
    tokens = np.array([*(ranks[bytes([b])] for b in range(256)), len(at) - 1])
    first = entries[at[tokens][:, None] + tokens] ^ (tokens << _OWNER)[:, None] | tokens
    whole = {"at": at.tolist(), "entries": entries.tolist(), "first": [*first.ravel().tolist(), _NONE | len(at) - 1], "end": len(at) - 1}
    whole |= {name: [*bounds.tolist(), _IDS] for name, bounds in zip(("joined", "left", "right"), sure_pairs(ranks))}
    fields = "at:array<bigint>,entries:array<bigint>,first:array<bigint>,end:bigint,joined:array<bigint>,left:array<bigint>,right:array<bigint>"
    return F.from_json(F.lit(json.dumps(whole)), f"struct<{fields}>")


def piece_literal(ranks: dict[bytes, int]) -> Column:
    """Piece of each id, in hexadecimal figures."""
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    return F.split(F.lit(",".join(pieces)), ",")


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once: the finish of a fold over nothing."""
    # An element of a transformed array would do, but finding it works out the type of the whole body each time.
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)


def _right(pair: Column) -> Column:
    return pair.bitwiseAND(F.lit(_IDS).cast("long"))


def _pair(table: Column, a: Column, b: Column, rest: Column) -> Column:
    """a, b: tokens; rest: the place and b in their bits."""
    # The owner's bits become 0 if the entry is a's own.
    return table["entries"][table["at"][a] + b].bitwiseXOR(F.shiftleft(a, _OWNER)).bitwiseOR(rest)


def _joined(table: Column, pairs: Column, best: Column, k: Column) -> tuple[Column, Column]:
    """The pairs before and after the token that the pair `best`, which joins, becomes. k: its index; two pairs are before it and one after."""
    joined, after = F.shiftright(best, _RANK), _right(pairs[k + 1])
    left = _pair(table, _right(pairs[k - 2]), joined, pairs[k - 1].bitwiseAND(F.lit(_PLACES)).bitwiseOR(joined))
    return left, _pair(table, joined, after, best.bitwiseAND(F.lit(_PLACES)).bitwiseOR(after))


def _merge(table: Column, pairs: Column, best: Column, at: Column) -> Column:
    """The pairs once the pair `best`, whose index is `at`, has become one token."""
    return _let(at, lambda k: F.concat(F.slice(pairs, F.lit(1), k - 1), F.array(*_joined(table, pairs, best, k)), F.slice(pairs, k + 3, F.size(pairs))))


def _first_pairs(table: Column, codes: Column, place) -> Column:
    """The pairs that a word's codes begin as; place: their places by their positions."""
    return F.transform(codes, lambda c, i: table["first"][c].bitwiseOR(F.shiftleft(place(i).cast("long"), _ID)))


def _tokens(pairs: Column, end: Column) -> Column:
    """array<bigint>: the pairs' right tokens but for the ends."""
    return F.filter(F.transform(pairs, _right), lambda t: t < end)


def _sure_tokens(table: Column, codes: Column) -> Column:
    """array<bigint>: a word's tokens, an end before and after them, once all sure pairs of its bytes are merged (see sure_pairs)."""

    def sure(c: Column, i: Column) -> Column:
        rank = table["joined"][c]
        return F.when((rank < F.get(table["right"], F.get(codes, i + 1))) & (rank < F.get(table["left"], F.get(codes, i - 1))), rank)

    def token(merged: Column):
        # A byte that the pair after it has taken is left out.
        return lambda c, i: F.coalesce(merged[i], F.when(F.get(merged, i + 1).isNull(), _right(table["first"][c])))

    return _let(F.transform(codes, sure), lambda merged: F.filter(F.transform(codes, token(merged)), lambda t: t.isNotNull()))


def _fold_flat(table: Column, codes: Column) -> Column:
    """State: the array of pairs, whose places are their indices. A step merges the smallest; the array keeps its length, with ends behind the word's."""

    def pairs_of(tokens: Column) -> Column:
        return F.transform(tokens, lambda t, i: _pair(table, tokens[F.greatest(i - 1, F.lit(0))], t, F.shiftleft(i.cast("long"), _ID).bitwiseOR(t)))

    def step(pairs: Column, _: Column) -> Column:
        def merged(k: Column, best: Column) -> Column:
            left, right = _joined(table, pairs, best, k)
            moved = lambda e, i: F.coalesce(F.get(pairs, i + 1), e) - F.lit(1 << _ID)
            return F.transform(pairs, lambda e, i: F.when(i > k, moved(e, i)).when(i == k, right).when(i == k - 1, left).otherwise(e))

        at = lambda best: F.shiftright(best.bitwiseAND(F.lit(_PLACES)), _ID).cast("int")
        return _let(F.array_min(pairs), lambda best: F.when(best < F.lit(_NONE), _let(at(best), lambda k: merged(k, best))).otherwise(pairs))

    def folded(pairs: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(4), F.size(pairs)), pairs, step, lambda p: _tokens(p, table["end"]))

    return _let(_let(_sure_tokens(table, codes), pairs_of), folded)


def _fold_blocks(table: Column, codes: Column, size: int) -> Column:
    """The same over a long word, whose pairs are held in blocks: a step looks at the blocks' lowest ranks and rewrites three blocks.

    Each block but the last has two pairs or more, so what a merge touches is in the block, the one before and the one after it.
    """

    def low(block: Column) -> Column:
        return F.shiftright(F.array_min(block), _RANK)

    def dealt(pairs: Column) -> Column:
        """Even blocks of `size` pairs at most, places anew."""
        n = F.size(pairs)
        count = F.ceil(n / size).cast("int")
        begin = lambda c: F.floor(c * n / count).cast("int")
        block = lambda c: F.slice(pairs, begin(c) + 1, begin(c + 1) - begin(c))
        return F.transform(F.sequence(F.lit(0), count - 1), lambda c: F.transform(block(c), lambda e, i: e.bitwiseAND(~_PLACES).bitwiseOR(F.shiftleft(i.cast("long"), _ID))))

    def rewrite(state: Column, b: Column) -> Column:
        """b: number of the leftmost block with the lowest rank, from 1."""
        blocks = state["blocks"]
        first = F.greatest(b - 1, F.lit(1))
        count = F.least(b + 1, F.size(blocks)) - first + 1
        local = F.flatten(F.slice(blocks, first, count))
        begin = F.when(first < b, F.size(F.get(blocks, first - 1))).otherwise(0)
        at = lambda best: begin + F.shiftright(best.bitwiseAND(F.lit(_PLACES)), _ID).cast("int")
        merged = _let(local, lambda pairs: _let(F.array_min(F.get(blocks, b - 1)), lambda best: _merge(table, pairs, best, at(best))))

        def spliced(old: Column, new: Column) -> Column:
            return F.concat(F.slice(old, F.lit(1), first - 1), new, F.slice(old, first + count, F.size(old)))

        return _let(_let(merged, dealt), lambda new: F.struct(spliced(blocks, new).alias("blocks"), spliced(state["lows"], F.transform(new, low)).alias("lows")))

    def step(state: Column, _: Column) -> Column:
        found = F.array_min(state["lows"])
        at = F.when(found < F.lit(1 << _ID), F.array_position(state["lows"], found)).cast("int")
        return _let(at, lambda b: F.when(b.isNull(), state).otherwise(rewrite(state, b)))

    start = _let(_let(_first_pairs(table, codes, lambda i: F.lit(0)), dealt), lambda blocks: F.struct(blocks.alias("blocks"), F.transform(blocks, low).alias("lows")))
    return F.aggregate(F.sequence(F.lit(4), F.size(codes)), start, step, lambda s: _tokens(F.flatten(s["blocks"]), table["end"]))


def fold(word: Column, table: Column, flat: int = FLAT, block: int = BLOCK) -> Column:
    """array<bigint>: the ids of a word (a byte string: characters U+0000 to U+00FF) when no ranked merge is left."""
    ends = F.array(F.lit(256))
    values = F.concat(ends, F.transform(F.split(word, ""), F.ascii), ends)
    codes = _let(values, lambda v: F.transform(v, lambda b, i: F.when(i == 0, 257 * 257).otherwise(F.get(v, i - 1) * 257 + b)))
    return fold_codes(codes, table, flat, block)


def fold_codes(codes: Column, table: Column, flat: int = FLAT, block: int = BLOCK) -> Column:
    """The same of a word's codes (see _codes)."""

    def ids(t: Column) -> Column:
        n, single = F.size(codes) - 2, _tokens(_first_pairs(t, codes, lambda i: i), t["end"])
        return F.when(n < 2, single).when(n <= flat, _fold_flat(t, codes)).otherwise(_fold_blocks(t, codes, block))

    return _let(table, ids)


def with_ids(words: DataFrame, ranks: dict[bytes, int], column: str) -> DataFrame:
    """words: a column of arrays of words' codes; it becomes arrays of (ids; bytes: the ids decoded)."""
    table = rank_literal(ranks)
    decoder = piece_literal(ranks)
    encoded = F.transform(F.col(column), lambda w: _let(fold_codes(w, table), lambda ids: F.struct(ids.alias("ids"), decode(ids, decoder).alias("bytes"))))
    return words.withColumn(column, encoded)


def decode(ids: Column, pieces: Column) -> Column:
    """binary: the ids' pieces, concatenated; null if an id is unknown. pieces: see piece_literal."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i.cast("int"))), "", "?"))


class _Numbers(dict):
    """Word -> number, in order of appearance; `fresh` lists the words that are new."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


#: A sign of each class that a split pattern tells apart, none of them named by a pattern itself; the last for what is in no class.
STAND_INS = {r"\p{L}": "\u0416", r"\p{N}": "\u0663", r"\s": "\u2003", "": "\u00a7"}


@lru_cache(1)
def reclassified() -> dict[str, str]:
    """Stand-in -> the characters whose class `tiktoken` has otherwise than `regex`, whose Unicode tables are of another version."""
    import regex
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    moved: dict[str, str] = {}
    for name, stand_in in STAND_INS.items():
        if name:
            # Text between matches has no ids, so the ids are the bytes of the class.
            own = bytes(tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()
            theirs = set(regex.findall(name, every))
            moved |= dict.fromkeys(theirs.difference(own), STAND_INS[""]) | dict.fromkeys(set(own) - theirs, stand_in)
    return {s: "".join(sorted(c for c, to in moved.items() if to == s)) for s in STAND_INS.values()}


class Splitter:
    """Texts as word numbers (bytes of u32). The words of each space-led unit are remembered: the pattern never matches across a space before a word.

    Once `keep_units` units have come, those not met since the last such time are forgotten; words keep their numbers.
    classes: see reclassified; where a text has such a character, the words are found in a copy with its stand-in.
    """

    def __init__(self, pattern: str, classes: dict[str, str] | None = None, keep_units: int = 240_000):
        import re

        import regex

        whole = regex.compile(pattern)
        self.findall, self.finditer = whole.findall, whole.finditer
        self.moved = {c: s for s, chars in (classes or {}).items() for c in chars}
        self.stand_ins = str.maketrans(self.moved)
        self.keep_units = keep_units
        self.irregular = re.compile(r" (?=\s|\Z)").search
        self.clear()

    def clear(self) -> None:
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.known = _Numbers()

    def find(self, text: str) -> list[str]:
        if text.isascii() or self.moved.keys().isdisjoint(text):
            return self.findall(text)
        return [text[m.start() : m.end()] for m in self.finditer(text.translate(self.stand_ins))]

    def numbers(self, words: list[str]) -> bytes:
        from array import array

        return array("I", map(self.known.__getitem__, words)).tobytes()

    def learn(self, new: list[str]) -> None:
        """The words of new units, found in one text of them all; each unit's first word starts with its space."""
        words = self.find(" " + " ".join(new)) if new else []
        begins = [i for i, w in enumerate(words) if w[0] == " "]
        if len(begins) != len(new):
            for u in new:
                self.units[u] = self.numbers(self.find(" " + u))
            return
        raw, begins = self.numbers(words), [*begins, len(words)]
        self.units.update((u, raw[4 * a : 4 * b]) for u, a, b in zip(new, begins, begins[1:]))

    def split(self, texts: list) -> tuple[list[bytes], list[bytes]]:
        """(word numbers of each text, the words that are new)."""
        bodies = [None if not t or self.irregular(t) else t.split(" ") for t in texts]
        seen: set[str] = set()
        for b in bodies:
            if b:
                seen.update(b[1:])
        if len(self.units) > self.keep_units:
            self.older, self.units = self.units, {}
        need = seen.difference(self.units)
        again = {u: self.older[u] for u in need if u in self.older}
        self.units.update(again)
        self.learn(list(need.difference(again)))
        out = []
        for text, body in zip(texts, bodies):
            if not text:
                out.append(b"")
            elif body is None:
                out.append(self.numbers(self.find(text)))
            else:
                first = self.numbers(self.find(body[0]))
                out.append(first + b"".join(map(self.units.__getitem__, body[1:])))
        fresh, self.known.fresh = self.known.fresh, []
        for u in [u for u in seen if len(u) > 64]:
            del self.units[u]
        return out, [w.encode() for w in fresh]


def _codes(words: list[bytes]) -> pa.Array:
    """One row: an array of each word's byte array with both neighbours in one number: 257 * left + right, 256 for an end; before them 257 * 257."""
    raw = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([0, *map(len, words)])
    starts = np.zeros(len(raw) + 1, bool)
    starts[ends] = True  # where a word begins or the last one ends
    # Each word takes two places more than it has bytes: the number before it and its last pair.
    at = np.arange(len(raw)) + 2 * (np.cumsum(starts[:-1]) - 1) + 1
    right, left = np.full((2, len(raw) + 2 * len(words)), 256, np.int32)
    right[at], left[at + 1] = raw, raw
    codes = 257 * left + right
    ends = ends + 2 * np.arange(len(ends))
    codes[ends[:-1]] = 257 * 257
    return pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(codes, pa.int32())))


def _joined_values(known: pa.Array, words: np.ndarray, ends: np.ndarray) -> list[memoryview]:
    """The words' values, concatenated between every two of the ends."""
    _, offsets, data = known.take(pa.array(words)).buffers()
    at = np.frombuffer(offsets, np.int64)[ends].tolist() if len(words) else [0] * len(ends)
    whole = memoryview(data) if data else memoryview(b"")
    return [whole[a:b] for a, b in zip(at, at[1:])]


def tasks(docs: DataFrame) -> int | None:
    """How many tasks a plain table's files are worth: TASK_BYTES each, but two for each core at least; None for other plans, which stay as they are."""
    size = file_bytes(docs)
    return None if size is None else max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: int = 640_000, id_col: str = "doc_id", text_col: str = "text", digests_only: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>), bytes (the decoded ids); digests_only: their SHA-256 in place of the last two."""
    ensure_importable(docs.sparkSession)
    classes, size = reclassified(), max(ranks.values()) + 1

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(pattern, classes)
        for batch in small_batches(batches, 1024):
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in text_slices(texts, 1_000_000):
                drop = len(splitter.known) > keep
                if drop:
                    splitter.clear()
                numbers, words = splitter.split(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([pa.array([keys[lo:hi]], pa.list_(pa.int64())), pa.array([numbers], pa.list_(pa.binary())), _codes(words), pa.array([drop])], names=["doc_ids", "numbers", "words", "drop"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty, figures = pa.array([], pa.large_binary()), pa.array([b"%d," % i for i in range(size)], pa.large_binary())
        ids_of = bytes_of = empty
        counts = np.zeros(0, np.int32)
        for batch in batches:
            for r in range(batch.num_rows):
                if batch.column(3)[r].as_py():
                    ids_of, bytes_of, counts = empty, empty, counts[:0]
                new = batch.column(2)[r].values  # flat: the fields' values without a Python object per struct
                if new.field("bytes").null_count:
                    raise ValueError("an id without a piece")
                ids = new.field("ids")
                ends = ids.offsets.to_numpy()
                text = figures.take(ids.flatten()).buffers()
                starts = np.frombuffer(text[1], np.int64)[ends - ends[0]] if len(ids) else np.zeros(1, np.int64)
                fresh = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(starts), text[2]])
                ids_of, bytes_of = pa.concat_arrays([ids_of, fresh]), pa.concat_arrays([bytes_of, new.field("bytes").cast(pa.large_binary())])
                counts = np.concatenate((counts, np.diff(ends)))
                keys, numbers = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                words = np.frombuffer(b"".join(numbers), "<u4")
                ends = np.cumsum([0, *(len(n) // 4 for n in numbers)])
                totals = np.diff(np.concatenate(([0], np.cumsum(counts[words], dtype=np.int64)))[ends])
                ids, wholes = (_joined_values(known, words, ends) for known in (ids_of, bytes_of))
                ids = [x[:-1] for x in ids]  # without the last comma
                if digests_only:
                    ids_out, bytes_out = ([hashlib.sha256(x).hexdigest() for x in out] for out in (ids, wholes))
                else:
                    ids_out, bytes_out = [list(map(int, bytes(x).split(b","))) if x else [] for x in ids], list(map(bytes, wholes))
                kinds = (pa.string(), pa.string()) if digests_only else (pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(totals, pa.int64()), pa.array(ids_out, kinds[0]), pa.array(bytes_out, kinds[1])], names=names)

    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests_only else ("ids", "bytes"))]
    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    if count := tasks(docs):
        rows = rows.coalesce(count)
    blocks = rows.mapInArrow(split, "doc_ids array<long>, numbers array<binary>, words array<array<int>>, drop boolean")
    kind = "ids_sha256 string, decoded_sha256 string" if digests_only else "ids array<int>, bytes binary"
    return with_ids(blocks, ranks, "words").mapInArrow(join, f"doc_id long, n_tokens long, {kind}")
