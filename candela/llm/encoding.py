"""Whole-text encoding with the `tokenizers` library, memoised on space-led units.

A byte-level BPE vocabulary whose pre-tokeniser is the usual ` ?word` pattern
never lets a token cross the point before a single space that is followed by a
non-space character.  Texts are therefore cut there and each distinct unit is
encoded by the library once per worker; the units' ids are concatenated.  Texts
that contain a special token's string go to the library whole, because special
tokens are split off before the pattern applies.

Units are encoded from the vocabulary's own merge table by `tiktoken`, which does
the same ranked merges several times faster, if the table qualifies (see
`_ranks`); otherwise, and for texts with special tokens, by `tokenizers`.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: A space that does not start a unit: another white-space character or the end follows.
_IRREGULAR = re.compile(r" (?=\s|\Z)")
_UNIT_START = re.compile(r" (?=\S)")
_LONGEST_MEMO = 48


def read_spec(path: str) -> str:
    """The vocabulary file's text; shipped to executors in the task closure (about 1.5 MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


#: The split pattern that the byte-level pre-tokeniser applies.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """token -> id, if merging by lowest id is what the vocabulary's merge list says: ids grow along the list and every merge yields its own token."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    vocab, last, of = model["vocab"], -1, _byte_of()
    merged = set()
    for m in model["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        if (k := vocab.get(a + b, -1)) <= last:
            return None
        last = k
        merged.add(a + b)
    extra = {t["content"] for t in spec.get("added_tokens", [])}
    if any(len(t) > 1 and t not in merged for t in vocab if t not in extra):
        return None
    return {bytes(of[c] for c in t): k for t, k in vocab.items() if t not in extra}


class UnitEncoder:
    """ids of whole texts as the library gives them without added special tokens."""

    def __init__(self, spec: str, keep: int = 120_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.specials = [t["content"] for t in json.loads(spec).get("added_tokens", [])]
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.keep, self.memo, self.older = keep, {}, {}
        self.core = None
        if ranks := _ranks(json.loads(spec)):
            import tiktoken

            self.core = tiktoken.Encoding("own", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.lengths = np.zeros(size, np.int64)
            self.lengths[list(ranks.values())] = [len(t) for t in ranks]

    def direct(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def units(self, units: list[str]) -> list[bytes]:
        """Ids of texts that each start with a space before a non-space, without special tokens.

        They are encoded as one text, which has a token boundary at each of them,
        and told apart by their tokens' byte lengths.
        """
        if self.core is None or not units:
            return self.direct(units)
        out, width = [], self.dtype.itemsize
        for lo in range(0, len(units), 20_000):
            part = units[lo : lo + 20_000]
            ids = np.asarray(self.core("".join(part)), np.int64)
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(u.encode()) for u in part])) + 1
            raw = ids.astype(self.dtype).tobytes()
            at = 0
            for end in (ends * width).tolist():
                out.append(raw[at:end])
                at = end
        return out

    def heads(self, texts: list[str]) -> list[bytes]:
        """Ids of the texts' first units, which may start with anything."""
        if self.core is None:
            return self.direct(texts)
        return [np.array(self.core(t), self.dtype).tobytes() for t in texts]

    def encode(self, texts: list) -> list[bytes]:
        """Ids of each text as little-endian integers of self.dtype; null gives none."""
        if len(self.memo) > self.keep:  # what was used since the last turn-over stays within reach
            self.older, self.memo = self.memo, {}
        whole, heads, bodies, need = [], [], {}, set()
        for i, text in enumerate(texts):
            if not text:
                continue
            if any(s in text for s in self.specials):
                whole.append((i, text))
                continue
            units = _UNIT_START.split(text) if _IRREGULAR.search(text) else text.split(" ")
            head, body = units[0], units[1:]
            if head:
                heads.append((i, head))
            bodies[i] = body
            need.update(body)
        memo, older = self.memo, self.older
        need = need.difference(memo)
        again = {u: older[u] for u in need if u in older}
        memo.update(again)
        new = list(need.difference(again))
        memo.update(zip(new, self.units([" " + u for u in new])))
        out = [b""] * len(texts)
        for group, ids in ((whole, self.direct([t for _, t in whole]) if whole else []), (heads, self.heads([t for _, t in heads]))):
            for (i, _), x in zip(group, ids):
                out[i] = x
        for i, body in bodies.items():
            if body:
                out[i] += b"".join(map(memo.__getitem__, body))
        for u in new:
            if len(u) > _LONGEST_MEMO:
                del memo[u]
        return out

    def arrays(self, texts: list) -> list[np.ndarray]:
        return [np.frombuffer(b, self.dtype) for b in self.encode(texts)]


_encoders: dict = {}


def encoder(spec: str) -> UnitEncoder:
    """One encoder per Python worker and vocabulary."""
    key = hash(spec)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = UnitEncoder(spec)
    return _encoders[key]


def forget_encoders() -> None:
    """Free this worker's encoders and what they remember."""
    _encoders.clear()
