"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents' ids.  The packed stream is filled window
by window; in each window every queue gets credit for its target share of the
window's tokens, sends what whole tokens its credit covers, and carries the rest
(its deficit) to the next window.  Room that credits leave is lent in round-robin
order, from a queue that moves on with each window, and a loan is a negative
deficit.  Documents are cut wherever a window or a sequence ends, so every
sequence is full except the last one of the whole corpus.

How it is distributed.  The stream is divided into spans of many windows.  What
each queue has sent when a span begins is a closed form of the queues' totals
(the fluid schedule, rounded down), and so is its deficit then; a span's windows
are simulated from these alone.  Hence any task can place any document once it
knows the document's offset in its queue, and no document's ids are shuffled:

1. one pass encodes every document and writes ids with the offset inside
   (task, queue) to the shared folder;
2. sums per (task, queue) and per queue, small tables, give each pair its base;
3. one pass over the staged ids cuts the pieces.

A queue's order is that of the staged table.  At most `max_queues` queues are
kept apart, those with the most tokens; the other sources share one queue, so the
totals that the driver holds are bounded by that parameter.  Inside that queue they
are dealt in proportion to their tokens, in rounds of what it sends in a window.
The sources form groups, and groups of groups where there are many; each group is a
queue of the next level.  A group's rounds are a closed form of its members' totals,
which come to the tasks with the bases, so no place holds all sources' totals.

Defined results: null and empty texts hold just the end id; a null source is the
queue of the empty string; without a source column there is one queue; repeated
rows are all packed; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_importable, stage, text_slices
from .encoding import encoder

REST = "\x00rest"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


class Schedule:
    """What each queue has sent after so many tokens of the stream.

    totals: tokens of each queue. weights: integer target weights; a queue that is
    exhausted leaves and the others share its part, so there are at most as many
    phases as queues.
    """

    def __init__(self, totals: list[int], weights: list[int] | None = None, window: int = 65_536, span_windows: int = 256):
        self.totals = totals
        self.window, self.span = window, window * span_windows
        weights = [max(1, w) for w in weights] if weights else [max(1, t) for t in totals]
        sent, at, self.phases = [0] * len(totals), 0, []
        while any(s < t for s, t in zip(sent, totals)):
            rates = [w if s < t else 0 for w, s, t in zip(weights, sent, totals)]
            whole = sum(rates)
            # Ends when the first of its queues is empty.
            took = min(-(-(t - s) * whole // r) for s, t, r in zip(sent, totals, rates) if r)
            self.phases.append((at, sent, rates, whole))
            sent = [min(t, s + took * r // whole) for s, t, r in zip(sent, totals, rates)]
            at += took
        self.end = at
        # Spans start anew with each phase, so that the rates inside a span are constant.
        lengths = [b[0] - a[0] for a, b in zip(self.phases, self.phases[1:] + [(self.end,)])]
        self.first = [0]
        for n in lengths:
            self.first.append(self.first[-1] - (-n // self.span))
        self.spans = self.first[-1]
        self._edge = lru_cache(4096)(self._edge)
        self._plan = lru_cache(64)(self._plan)

    def _edge(self, span: int) -> tuple[list[int], list[tuple[int, int]]]:
        """(sent by each queue when the span begins, its deficit then as a fraction)."""
        if span >= self.spans:
            return list(self.totals), [(0, 1)] * len(self.totals)
        phase = bisect.bisect_right(self.first, span) - 1
        at, sent, rates, whole = self.phases[phase]
        v = at + (span - self.first[phase]) * self.span
        gone = [divmod((v - at) * r, whole) for r in rates]
        now = [min(t, s + g) for s, t, (g, _) in zip(sent, self.totals, gone)]
        return now, [(f, whole) if n < t else (0, 1) for n, t, (_, f) in zip(now, self.totals, gone)]

    def span_of(self, queue: int, offset: int) -> int:
        """The span that sends the queue's token number `offset`."""
        lo, hi = 0, self.spans
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self._edge(mid)[0][queue] <= offset else (lo, mid)
        return lo

    def _plan(self, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(windows + 1) x queues: the queue offset when each window begins; windows x queues: where its run stands in the stream."""
        sent, carry = self._edge(span)
        budget = np.array([b - a for a, b in zip(sent, self._edge(span + 1)[0])], np.int64)
        total, queues = int(budget.sum()), len(budget)
        windows = max(1, -(-total // self.window))
        deficit = np.array([f * total // w for f, w in carry], object)
        left, begin = budget.copy(), sum(sent)
        offsets, places = np.zeros((windows + 1, queues), np.int64), np.zeros((windows, queues), np.int64)
        for w in range(windows):
            room = min(self.window, total - w * self.window)
            order = np.roll(np.arange(queues), -(w % queues))
            deficit = deficit + budget.astype(object) * room
            give = np.minimum(np.array([max(0, int(d // total)) if total else 0 for d in deficit], np.int64), left)[order]
            give = np.diff(np.minimum(np.cumsum(give), room), prepend=0)
            spare = room - int(give.sum())
            while spare:  # lend the rest, one token a queue and round
                able = np.flatnonzero(left[order] > give)
                each = max(1, min(spare // len(able), int((left[order] - give)[able].min())))
                able = able[: spare // each]
                give[able] += each
                spare -= each * len(able)
            now = np.empty(queues, np.int64)
            now[order] = give
            places[w, order] = begin + w * self.window + np.cumsum(give) - give
            offsets[w + 1] = offsets[w] + now
            left -= now
            deficit = deficit - now.astype(object) * total
        return offsets + np.array(sent, np.int64), places

    def rounds(self, queue: int) -> int:
        """In how many windows the queue sends its tokens, at the lowest rate it has."""
        total = self.totals[queue]
        return max(1, min(total, 2**31 - 1, max((-(-total * whole // (self.window * rates[queue])) for _, _, rates, whole in self.phases if rates[queue]), default=1)))

    def runs(self, queue: int, offset: int, length: int) -> Iterator[tuple[int, int]]:
        """(place in the stream, tokens) of the runs that send the queue's tokens from offset on."""
        end, span = offset + length, self.span_of(queue, offset) if length else 0
        while offset < end:
            edges, places = self._plan(span)
            column = edges[:, queue]
            w = int(np.searchsorted(column, offset, "right")) - 1
            while w < len(places) and offset < end:
                n = min(end, int(column[w + 1])) - offset
                if n > 0:
                    yield int(places[w, queue]) + offset - int(column[w]), n
                    offset += n
                w += 1
            span += 1


class Rounds:
    """What each member of a group has sent: by the end of round r, r / rounds of its tokens, rounded down."""

    def __init__(self, totals: np.ndarray, rounds: int):
        self.totals, self.rounds = totals, rounds
        # Split, so that no product exceeds a long.
        self.whole, self.part = np.divmod(totals, rounds)
        self._round = lru_cache(32)(self._round)

    def _sent(self, r: int) -> np.ndarray:
        return self.whole * r + self.part * r // self.rounds

    def _round(self, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sent by each member before the round, by its end, where its run stands in the group's stream)."""
        now, then = self._sent(r), self._sent(r + 1)
        order = np.roll(np.arange(len(now)), -(r % len(now)))
        give, places = (then - now)[order], np.empty_like(now)
        places[order] = int(now.sum()) + np.cumsum(give) - give
        return now, then, places

    def runs(self, member: int, offset: int, length: int) -> Iterator[tuple[int, int]]:
        """(place in the group's stream, tokens) of the runs that send the member's tokens from offset on."""
        end, total = offset + length, int(self.totals[member])
        while offset < end:
            now, then, places = self._round(-(-(offset + 1) * self.rounds // total) - 1)
            n = min(end, int(then[member])) - offset
            yield int(places[member]) + offset - int(now[member]), n
            offset += n


def rest_paths(rest: DataFrame, sources: int, group: int) -> DataFrame:
    """queue and its path: from its own group up to the rest queue, (node, totals of the node's members, the member's place there).

    rest: queue, n. A group has about `group` members; a group of groups as many at most.
    """
    group = max(2, group)
    buckets = -(-sources // group)
    level = rest.select("queue", "n", F.col("queue").alias("member"), F.pmod(F.xxhash64("queue"), F.lit(buckets)).alias("node"))
    paths, steps = level.select("queue", F.col("node").alias("node0")), 0
    while True:
        groups = stage(level.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("member", "n"))).alias("members")), "packing-groups")
        totals = F.transform("members", lambda m: m["n"]).alias("totals")
        places = groups.select("node", totals, F.posexplode("members").alias("place", "m")).select(F.col("m.member").alias("member"), F.struct("node", "totals", "place").alias(f"step{steps}"))
        paths = paths.join(places.withColumnRenamed("member", "queue" if not steps else f"node{steps - 1}"), "queue" if not steps else f"node{steps - 1}")
        if buckets == 1:
            return paths.select("queue", F.array(*(f"step{k}" for k in range(steps + 1))).alias("path"))
        buckets, steps = -(-buckets // group), steps + 1
        level = groups.select(F.col("node").alias("member"), F.aggregate(F.col("members"), F.lit(0).cast("long"), lambda a, m: a + m["n"]).alias("n"), F.floor(F.col("node") / group).alias("node"))
        paths = paths.withColumn(f"node{steps}", F.floor(F.col(f"node{steps - 1}") / group))


def encode_queues(docs: DataFrame, spec: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source") -> DataFrame:
    """Stage doc_id, queue, task, offset inside (task, queue), tokens and ids of every document."""
    ensure_importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, held = encoder(spec), TaskContext.get().partitionId(), {}
        end = np.array([end_id], enc.dtype).tobytes()
        width = enc.dtype.itemsize
        for batch in batches:
            keys, texts, queues = (batch.column(k).to_pylist() for k in range(3))
            for lo, hi in text_slices(texts):
                ids = [b + end for b in enc.encode(texts[lo:hi])]
                sizes, offsets = [len(b) // width for b in ids], []
                for q, n in zip(queues[lo:hi], sizes):
                    offsets.append(held.get(q, 0))
                    held[q] = offsets[-1] + n
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys[lo:hi], pa.int64()), pa.array(queues[lo:hi], pa.string()), pa.array([task] * len(ids), pa.int32()),
                    pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()),
                ], names=["doc_id", "queue", "task", "within", "n", "ids"])

    queue = f"coalesce(cast(`{source_col}` as string), '')" if source_col and source_col in docs.columns else "''"
    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text", f"{queue} queue")
    return stage(rows.mapInArrow(run, "doc_id long, queue string, task int, within long, n long, ids binary"), "packing-ids")


def pack(docs: DataFrame, spec: str, end_id: int = 0, sequence: int = 1024, targets: dict[str, float] | None = None, window: int = 65_536, span_windows: int = 256, max_queues: int = 256, with_ids: bool = False, group: int = 128, **columns) -> DataFrame:
    """One row per piece. targets: share of each source; None: each source's share of the corpus' tokens.

    Sources that `targets` doesn't name form one queue of weight `targets.get("", 0)`. group: members that share a group inside that queue.
    """
    spark = docs.sparkSession
    spec_width = 2 if _vocabulary(spec) <= 1 << 16 else 4
    rows = encode_queues(docs, spec, end_id, **columns)
    sums = stage(rows.groupBy("queue", "task").agg(F.sum("n").alias("n")), "packing-sums")
    totals = sums.groupBy("queue").agg(F.sum("n").alias("n"))
    if targets:
        names = sorted(q for q in targets if q)
        kept = {r.queue: r.n for r in totals.filter(F.col("queue").isin(names)).collect()}
        weights = {q: max(1, round(targets[q] * 10**9)) for q in names} | {REST: max(1, round(targets.get("", 0) * 10**9))}
    else:
        kept = {r.queue: r.n for r in totals.orderBy(F.desc("n"), "queue").limit(max_queues).collect()}
        weights = None
    sizes = totals.agg(F.sum("n").alias("n"), F.count("*").alias("sources")).first()
    whole, others = sizes.n or 0, sizes.sources - len(kept)
    names = sorted(kept)
    queue_totals = [*(kept[q] for q in names), whole - sum(kept.values())]
    names.append(REST)
    number = {q: k for k, q in enumerate(names)}
    schedule_args = (queue_totals, [weights[q] for q in names] if weights else None, window, span_windows)

    order = Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    based = sums.select("queue", "task", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    if others:
        paths = stage(rest_paths(totals.filter(~F.col("queue").isin(names[:-1])), others, group), "packing-paths")
        based = based.join(paths, "queue", "left")
    else:
        based = based.withColumn("path", F.lit(None).cast("array<struct<node:bigint,totals:array<bigint>,place:int>>"))
    bases = stage(based, "packing-bases")
    # No hint: Spark broadcasts the staged table only while its files are below the threshold.
    placed = rows.join(bases, ["queue", "task"]).select("doc_id", "queue", "path", (F.col("base") + F.col("within")).alias("at"), "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule, groups = Schedule(*schedule_args), {}
        rounds = schedule.rounds(len(names) - 1)

        def steps(path: pa.StructArray) -> Iterator[tuple[Rounds, int]]:
            for level, (node, place) in enumerate(zip(path.field("node").to_pylist(), path.field("place").to_pylist())):
                if (level, node) not in groups:
                    if len(groups) >= 256:
                        groups.clear()
                    groups[level, node] = Rounds(path.field("totals")[level].values.to_numpy(zero_copy_only=False).copy(), rounds)
                yield groups[level, node], place

        for batch in batches:
            keys, queues, ats, sizes = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
            paths, raw, out = batch.column(2), batch.column(5), [[] for _ in range(9)]
            for i, (key, queue, at, n) in enumerate(zip(keys, queues, ats, sizes)):
                runs = [(at, n)]
                if paths[i].is_valid:
                    for members, at_member in steps(paths[i].values):
                        runs = [x for offset, length in runs for x in members.runs(at_member, offset, length)]
                ids = memoryview(np.frombuffer(raw[i].as_buffer(), f"<u{spec_width}").astype("<u4").tobytes())
                start = 0
                for place, length in (x for offset, m in runs for x in schedule.runs(number.get(queue, len(names) - 1), offset, m)):
                    while length:
                        m = min(length, sequence - place % sequence)
                        piece = bytes(ids[4 * start : 4 * (start + m)])
                        for c, v in zip(out, (key, start, m, zlib.crc32(piece), n, place // sequence, place % sequence, queue, piece)):
                            c.append(v)
                        start, place, length = start + m, place + m, length - m
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:7]), pa.array(out[7], pa.string()), *([pa.array(out[8], pa.binary())] if with_ids else [])], names=NAMES[: 8 + with_ids])

    return placed.mapInArrow(run, PIECES + ", ids binary" * with_ids)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "ids"]


def _vocabulary(spec: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec).get_vocab_size()


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids (little-endian u32 bytes) and pieces of each packed sequence; a group holds one sequence's tokens at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "start", "length")))
    grouped = pieces.groupBy("sequence_id").agg(parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return grouped.select("sequence_id", joined.alias("ids"), F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["length"].alias("length"))).alias("pieces"))
