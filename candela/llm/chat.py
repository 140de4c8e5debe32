"""Chat formatting: typed content parts, a turn-marking template, a loss mask.

A message's content is a text or an array of typed parts.  A visitor flattens the
parts into one string: texts are escaped, an image, audio or document part becomes
an ordered placeholder, and the visitor records the part's attachment reference and
how many tokens the placeholder expands to.  Placeholders are numbered through the
conversation and their attachments go along with it, so the parts can be read back;
a text that looks like a placeholder is escaped and stays a text.

The template marks turns with control strings.  A control string (or the escape
character) inside a text gets the escape character in front, which makes the
formatted conversation parse back to exactly its turns.

Formatting is row by row.  A conversation's turns are then joined in order, in
chunks: rows are range-partitioned by (conversation, turn), so a conversation with
a third of all turns is spread over many tasks, and each task joins neighbours
into chunks of about `chunk_chars`.  Reading back streams the chunks of a
conversation in order with running hashes; no task holds a whole conversation.

Defined results: a null text is empty, a null role is the empty role; turns of one
number are ordered by role, then text; null turn numbers come first; a null
conversation id is a conversation of its own; repeated rows are repeated turns;
unknown part types become documents without reference; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_importable, shuffle_parts, stage

#: Control strings of the template and of its placeholders; also those of related templates, so that none passes unescaped.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|"]
_ESCAPE = re.compile("|".join(["\\\\", *map(re.escape, sorted(CONTROL, key=len, reverse=True))]))
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


@dataclass
class PartVisitor:
    """Flattens typed parts in order; one visitor per message. first: the number of its first placeholder."""

    first: int = 0
    image_patch: int = 28
    audio_tokens_per_second: float = 25.0
    document_page_tokens: int = 512
    attachments: list = field(default_factory=list)

    def visit(self, part: dict) -> str:
        return getattr(self, f"visit_{part.get('type')}", self.visit_document)(part)

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict) -> str:
        w, h = part.get("width") or 0, part.get("height") or 0
        return self._place("image", part, max(1, ceil(w / self.image_patch) * ceil(h / self.image_patch)))

    def visit_audio(self, part: dict) -> str:
        return self._place("audio", part, max(1, ceil((part.get("seconds") or 0) * self.audio_tokens_per_second)))

    def visit_document(self, part: dict) -> str:
        return self._place("document", part, max(1, part.get("pages") or 0) * self.document_page_tokens)

    def _place(self, kind: str, part: dict, tokens: int) -> str:
        n = self.first + len(self.attachments)
        self.attachments.append({"position": n, "type": kind, "ref": part.get("ref"), "tokens": tokens})
        return f"<|{kind}:{n}|>"


PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "array<struct<position:int,type:string,ref:string,tokens:int>>"


def format_turn(role: str | None, content: str) -> tuple[str, int, int]:
    """(formatted turn, where its loss mask starts and ends); content is already escaped."""
    role = escape(role or "").replace("\n", "\\n")
    if role == "assistant":
        return f"<s>{role}\n{content}</s>\n", len(role) + 4, len(role) + 4 + len(content)
    return f"<s>[INST] {role}\n{content} [/INST]</s>\n", 0, 0


def parse_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn; raises if the string isn't whole turns. Placeholders stay in the text: see parse_parts."""
    for role, raw in raw_turns(formatted):
        yield role, unescape(raw)


def raw_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, raw content) of each turn."""
    at = 0
    while at < len(formatted):
        inst = formatted.startswith("<s>[INST] ", at)
        lo = at + (10 if inst else 3)
        if not formatted.startswith("<s>", at):
            raise ValueError("not a formatted conversation")
        head = _scan(formatted, lo, "\n")
        close = " [/INST]</s>\n" if inst else "</s>\n"
        end = _scan(formatted, head + 1, close)
        yield unescape(formatted[lo:head]), formatted[head + 1 : end]
        at = end + len(close)


def _scan(text: str, at: int, mark: str) -> int:
    """Where the first unescaped mark stands, from `at` on."""
    end = -1
    while True:
        if end < at:
            end = text.find(mark, at)
            if end < 0:
                raise ValueError("a turn isn't closed")
        k = text.find("\\", at, end)
        if k < 0:
            return end
        # Jump over the escaped character; a mark that starts with it isn't one.
        at = k + 2


_MARK = re.compile(r"\\.|<\|(image|audio|document):(\d+)\|>", re.DOTALL)


def parse_parts(raw: str) -> Iterator[tuple[str, str | int]]:
    """("text", text) and (type, placeholder's number) of a turn's raw content; no empty texts."""
    at = 0
    for m in _MARK.finditer(raw):
        if m[1]:
            if m.start() > at:
                yield "text", unescape(raw[at : m.start()])
            yield m[1], int(m[2])
            at = m.end()
    if at < len(raw):
        yield "text", unescape(raw[at:])


def renumber(formatted: str, loss: list[dict], by: int) -> tuple[str, list[dict]]:
    """Placeholders' numbers raised by `by`, and the loss spans where they stand then."""
    out, at, shifts = [], 0, [(0, 0)]
    for m in _MARK.finditer(formatted):
        if m[1]:
            out += [formatted[at : m.start(2)], str(int(m[2]) + by)]
            at = m.end(2)
            shifts.append((at, shifts[-1][1] + len(out[-1]) - len(m[2])))
    places = [p for p, _ in shifts]

    def moved(p: int) -> int:
        return p + shifts[bisect.bisect_right(places, p) - 1][1]

    return "".join(out) + formatted[at:], [{"start": moved(s["start"]), "end": moved(s["end"])} for s in loss]


def format_turns(messages: DataFrame, text_col: str = "text", parts_col: str | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", visitor: type[PartVisitor] = PartVisitor) -> DataFrame:
    """One row per message: conv_id, turn, role, formatted, loss_start, loss_end, attachments, expanded_tokens.

    parts_col: a column of arrays of PART; where it is null the text column counts.
    """
    ensure_importable(messages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            convs, turns, roles, texts, lists = (batch.column(k).to_pylist() for k in range(5))
            out = [[] for _ in range(5)]
            for role, text, parts in zip(roles, texts, lists):
                v = visitor()
                content = "".join(map(v.visit, parts)) if parts is not None else v.visit({"type": "text", "text": text})
                for c, x in zip(out, (*format_turn(role, content), v.attachments, sum(a["tokens"] for a in v.attachments))):
                    c.append(x)
            kinds = [pa.string(), pa.int64(), pa.int64(), ATTACHMENT_ARROW, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(turns, pa.int64()), pa.array(roles, pa.string()), *(pa.array(c, t) for c, t in zip(out, kinds))], names=TURN_NAMES)

    rows = messages.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"),
        (F.col(parts_col) if parts_col else F.lit(None)).cast(f"array<{PART}>").alias("parts"),
    )
    return rows.mapInArrow(run, f"conv_id long, turn long, role string, formatted string, loss_start long, loss_end long, attachments {ATTACHMENT}, expanded_tokens long")


TURN_NAMES = ["conv_id", "turn", "role", "formatted", "loss_start", "loss_end", "attachments", "expanded_tokens"]
ATTACHMENT_ARROW = pa.list_(pa.struct([("position", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())]))


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
CHUNK_NAMES = ["conv_id", "part", "seq", "formatted", "loss", "attachments", "expanded_tokens"]
CHUNK = f"conv_id long, part int, seq long, formatted string, loss array<struct<start:long,end:long>>, attachments {ATTACHMENT}, expanded_tokens long"


def join_turns(messages: DataFrame, chunk_chars: int = 1 << 16, **columns) -> DataFrame:
    """conv_id, part, seq, formatted, loss (array of start, end), attachments, expanded_tokens: chunks of whole turns; (part, seq) is their order in the conversation."""
    conv, turn, role, text = (columns.get(k, d) for k, d in (("conv_col", "conv_id"), ("turn_col", "turn"), ("role_col", "role"), ("text_col", "text")))
    keys = [F.col(conv).cast("long"), F.col(turn).cast("long"), F.col(role).cast("string"), F.col(text).cast("string")]
    # The ranges' bounds go through the driver: short keys. Turns that share them all meet in one task and are sorted there.
    ordered = messages.repartitionByRange(shuffle_parts(messages.sparkSession), *keys[:2], F.left(keys[2], F.lit(32))).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, conv_now, texts, loss, attached, size, placed, tokens = TaskContext.get().partitionId(), 0, None, [], [], [], 0, 0, 0

        def chunk():
            return _chunks([conv_now], [part], [seq], ["".join(texts)], [[{"start": a, "end": b} for a, b in loss]], [attached], [tokens])

        for batch in batches:
            for c, f, a, b, found, expanded in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4, 5, 6, 7))):
                if texts and (c != conv_now or size >= chunk_chars):
                    yield chunk()
                    seq, texts, loss, attached, size, tokens = seq + 1, [], [], [], 0, 0
                if c != conv_now:
                    conv_now, placed = c, 0
                span = [{"start": a, "end": b}] if b > a or f.startswith("<s>assistant\n") else []
                if found and placed:
                    f, span = renumber(f, span, placed)
                    found = [x | {"position": x["position"] + placed} for x in found]
                placed += len(found)
                loss += [(size + x["start"], size + x["end"]) for x in span]
                attached += found
                tokens += expanded
                texts.append(f)
                size += len(f)
        if texts:
            yield chunk()

    chunks = format_turns(ordered, **columns).mapInArrow(run, CHUNK)
    if not columns.get("parts_col"):
        return chunks
    # A conversation that goes over several tasks was numbered anew in each: one small row for each of them tells by how much to raise.
    chunks = stage(chunks, "chat-chunks")
    sums = chunks.groupBy("conv_id", "part").agg(F.sum(F.size("attachments")).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    later = sums.select(F.col("conv_id").alias("conv"), F.col("part").alias("task"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("by")).filter("by > 0")
    same = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("part") == F.col("task"))
    moved = chunks.join(later, same, "left").select(*CHUNK_NAMES, F.coalesce("by", F.lit(0)).alias("by"))

    def raise_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *rows, by = (batch.column(k).to_pylist() for k in range(8))
            for i, n in enumerate(by):
                if n:
                    rows[3][i], rows[4][i] = renumber(rows[3][i], rows[4][i], n)
                    rows[5][i] = [x | {"position": x["position"] + n} for x in rows[5][i]]
            yield _chunks(*rows)

    return moved.mapInArrow(raise_numbers, CHUNK)


def _chunks(*columns: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), SPANS, ATTACHMENT_ARROW, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=CHUNK_NAMES)


TURN_PARTS = "conv_id long, part int, seq long, number long, role string, parts array<struct<type:string,text:string,position:int,ref:string,tokens:int>>"


def read_turns(chunks: DataFrame) -> DataFrame:
    """One row per turn, read back from the chunks: conv_id, its place (part, seq, number in the chunk), role and typed parts.

    Neighbouring text parts come back as one, empty ones not at all; a placeholder brings its attachment's reference and tokens.
    """
    ensure_importable(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("type", pa.string()), ("text", pa.string()), ("position", pa.int32()), ("ref", pa.string()), ("tokens", pa.int32())]))
        for batch in batches:
            for conv, part, seq, text, attached in zip(*(batch.column(k).to_pylist() for k in range(5))):
                of = {a["position"]: a for a in attached}
                found = [(role, [{"type": t, "text": x} if t == "text" else {"type": t} | {k: of[x][k] for k in ("position", "ref", "tokens")} for t, x in parse_parts(raw)]) for role, raw in raw_turns(text)]
                n = len(found)
                yield pa.RecordBatch.from_arrays([
                    pa.array([conv] * n, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int64()), pa.array(range(n), pa.int64()),
                    pa.array([r for r, _ in found], pa.string()), pa.array([p for _, p in found], kind),
                ], names=["conv_id", "part", "seq", "number", "role", "parts"])

    return chunks.select("conv_id", "part", "seq", "formatted", "attachments").mapInArrow(run, TURN_PARTS)


def read_back(chunks: DataFrame) -> DataFrame:
    """One row per conversation, parsed from its formatted chunks: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_ = None, False
        turns = chars = lost = 0
        all_, mask = hashlib.sha256(), hashlib.sha256()

        def row():
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((now, turns, all_.hexdigest(), lost, mask.hexdigest(), chars), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for conv, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if open_ and conv != now:
                    yield row()
                if not open_ or conv != now:
                    now, open_, turns, chars, lost, all_, mask = conv, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, content in parse_turns(text):
                    all_.update(f"{role}\n{content}\n".encode())
                    turns += 1
                for s in spans:
                    piece = unescape(text[s["start"] : s["end"]])
                    mask.update(piece.encode())
                    lost += len(piece)
                chars += len(text)
        if open_:
            yield row()

    parts = chunks.repartition(shuffle_parts(chunks.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return parts.select("conv_id", "formatted", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
