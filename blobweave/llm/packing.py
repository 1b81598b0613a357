"""Packing documents into sequences whose token proportions are those of a target mix.

Each source is a queue of tokens: its documents one after another.  Windows of tokens
are filled by deficit round-robin: a window credits every queue with its share of
the window, a queue sends as many whole tokens as its credit holds, what rounding leaves
of the window goes to the queues with the largest deficits, and what a queue was
credited and did not send, or sent beyond its credit, is carried to the next window.
Documents are cut where a queue's turn or a sequence ends, so all sequences are full.
A window is one sequence by default; wider windows cut documents less often.

The plan of all turns depends on the queues' sizes alone, so no task waits for another
and token ids are never shuffled.  The time line of windows is cut into blocks.  In block k of K a
queue of n tokens sends those from floor(k n / K) to floor((k + 1) n / K): the fractions
are the deficits carried over the seam.  A seam may lie within a window, which the
next block goes on filling.  Within a block the windows are filled one after another.  A task that holds
documents of some queue plans the blocks in which these are sent, and reads off where their
tokens go.

Targets are the sources' own shares of all tokens, or given weights; since every document is
packed, the latter hold until a queue runs dry, and then among those that are left.
Sources that get less than a token a window share one queue, so there are never
more queues than a window has tokens, and one; their table is what is broadcast.

Tokens that do not fill a last sequence are packed in sequences whose lengths are the powers of
two of their number, which need no padding: nothing is ever padded.

Defined results: a null text counts as empty and is packed as its end token; a null source is a
source of its own; repeated rows and rows without id are packed each; an empty table
gives no rows.  Order within a queue is that of the scanned files.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import Automaton, Encoder, load
from .common import slices_of, staged

LENGTH, END = 2048, 1
#: Bytes of text that are encoded together; tasks here do nothing else.
ENCODED_BYTES = 2_000_000
#: Tokens that are planned together, in windows.
BLOCK_WINDOWS = 256
#: Rows of the table of offsets that are broadcast at most.
OFFSET_ROWS = 200_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded(docs: DataFrame, automaton: Automaton, end: int, kind: str) -> DataFrame:
    """A row a document: doc_id, source, tokens, ids (numbers of ``kind``, ``end`` last), its task's number ``part``, and
    ``before``: the tokens of its source earlier in that task."""
    told = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, seen, part = Encoder(told.value), {}, TaskContext.get().partitionId()
        for batch in slices_of(batches, ENCODED_BYTES):
            ids = [np.append(np.frombuffer(x, "<u4"), np.uint32(end)).astype(kind) for x in e.encode([t or "" for t in batch["text"].to_pylist()])]
            before = []
            for source, x in zip(batch["source"].to_pylist(), ids, strict=True):
                before.append(seen.get(source, 0))
                seen[source] = before[-1] + len(x)
            columns = [batch["doc_id"], batch["source"], pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(ids), pa.int64()), pa.array(before, pa.int64())], ["doc_id", "source", "tokens", "ids", "part", "before"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return rows.mapInArrow(run, "doc_id long, source string, tokens long, ids binary, part long, before long")


def turns(n: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Tokens that each queue sends in each window, by deficit round-robin over ``n`` tokens of each queue; the sizes sum to those of ``n``."""
    total = int(n.sum())
    deficit = np.zeros(len(n), np.int64)  # in parts of a token, ``total`` to one
    sent = np.zeros((len(sizes), len(n)), np.int64)
    for w, size in enumerate(sizes):
        deficit += size * n
        turn = np.maximum(deficit, 0) // total
        rest = deficit - turn * total
        short = size - int(turn.sum())
        if short > 0:
            turn[np.argsort(-rest, kind="stable")[:short]] += 1
        elif short < 0:  # others sent ahead: those with the least left to claim wait
            able = np.flatnonzero(turn)
            for q in able[np.argsort(rest[able], kind="stable")].tolist():
                back = min(int(turn[q]), -short)
                turn[q] -= back
                short += back
                if not short:
                    break
        deficit -= turn * total
        sent[w] = turn
    return sent


@dataclass(frozen=True)
class Block:
    """Where the tokens of a block go: of each window and queue, ``sent`` before it within the block and the place ``at`` in the packed stream."""

    first: list[int]
    sent: np.ndarray
    at: np.ndarray


class Plan:
    """All turns of queues of ``sizes`` tokens with ``weights``, in windows of ``sequences`` sequences of ``length`` tokens."""

    def __init__(self, sizes: list[int], weights: list[int], length: int = LENGTH, sequences: int = 1):
        self.length, self.window, self.total = length, length * sequences, sum(sizes)
        self.full = self.total // length
        rest, self.tails = self.total % length, []  # (first token, length) of the sequences after the full ones
        at = self.full * length
        for bit in range(rest.bit_length() - 1, -1, -1):
            if rest >> bit & 1:
                self.tails.append((at, 1 << bit))
                at += 1 << bit
        # a phase ends when a queue runs dry; sent: tokens of each queue up to each phase
        sent = [[0] * len(sizes)]
        for t in sorted({Fraction(n, w) for n, w in zip(sizes, weights, strict=True) if n}):
            sent.append([n if n <= w * t else int(w * t) for n, w in zip(sizes, weights, strict=True)])
        self.sent = [list(q) for q in zip(*sent, strict=True)]  # by queue
        self.tokens = [sum(b) - sum(a) for a, b in zip(sent, sent[1:])]  # by phase
        self.blocks = [max(1, -(-t // (BLOCK_WINDOWS * self.window))) for t in self.tokens]
        self.block = lru_cache(64)(self._block)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "block"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.block = lru_cache(64)(self._block)

    def cut(self, at: int) -> int:
        """The end of the window, or the short sequence after the full ones, that holds the packed token ``at``."""
        whole = self.full * self.length
        if at < whole:
            return min((at // self.window + 1) * self.window, whole)
        return next(a + n for a, n in self.tails if at < a + n)

    def sequence(self, at: int) -> tuple[int, int, int]:
        """The sequence of the packed token ``at``, its offset there, and the tokens from it to the sequence's end."""
        if at < self.full * self.length:
            s, offset = divmod(at, self.length)
            return s, offset, self.length - offset
        k = next(k for k, (a, n) in enumerate(self.tails) if at < a + n)
        return self.full + k, at - self.tails[k][0], sum(self.tails[k]) - at

    def share(self, queue: int, phase: int, k: int) -> int:
        """Tokens of ``queue`` sent before block ``k`` of ``phase``."""
        a, b = self.sent[queue][phase : phase + 2]
        return a + k * (b - a) // self.blocks[phase]

    def _block(self, phase: int, k: int) -> Block:
        first = [self.share(q, phase, k) for q in range(len(self.sent))]
        n = np.array([self.share(q, phase, k + 1) for q in range(len(self.sent))], np.int64) - np.array(first, np.int64)
        at = sum(first)
        end, sizes = at + int(n.sum()), []
        while at < end:
            sizes.append(min(self.cut(at), end) - at)
            at += sizes[-1]
        each = turns(n, sizes)
        sent = np.concatenate([np.zeros((1, len(n)), np.int64), np.cumsum(each, axis=0)])
        place = sum(first) + np.cumsum(each.ravel()) - each.ravel()  # windows in order, in each the queues in order
        return Block(first, sent, place.reshape(each.shape))

    def pieces(self, queue: int, begin: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the pieces of ``n`` tokens of ``queue`` from its token ``begin`` on."""
        x, stop = begin, begin + n
        own = self.sent[queue]
        while x < stop:
            phase = bisect_right(own, x) - 1
            size = own[phase + 1] - own[phase]
            k = ((x - own[phase] + 1) * self.blocks[phase] - 1) // size  # the last block that begins at x or before
            block = self.block(phase, k)
            sent = block.sent[:, queue]
            last = min(stop, block.first[queue] + int(sent[-1]))
            w = int(np.searchsorted(sent, x - block.first[queue], "right")) - 1
            while x < last:
                y = x - block.first[queue]
                take = min(int(sent[w + 1]) - y, last - x)
                at = int(block.at[w, queue]) + y - int(sent[w])
                while take:
                    s, offset, room = self.sequence(at)
                    size = min(take, room)
                    yield x - begin, size, s, offset
                    x, at, take = x + size, at + size, take - size
                w += 1


def queues(totals: DataFrame, total: int, window: int, weights: dict[str | None, int] | None) -> list[tuple[str | None, int, int]]:
    """(source, tokens, weight) of the sources that get a token a window or more, in code-point order, null last.

    At most ``window`` sources do; with ``weights``, those named (others weigh 1).
    """
    if weights is None:
        rows = totals.where(F.col("tokens").cast("decimal(38,0)") * window >= total).collect()
    else:
        rows = totals.join(F.broadcast(totals.sparkSession.createDataFrame([(s,) for s in weights], "named string")), F.col("source").eqNullSafe(F.col("named"))).collect()
    found = [(r["source"], r["tokens"], r["tokens"] if weights is None else weights[r["source"]]) for r in rows]
    return sorted(found, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-32-be", "surrogatepass")))


def pack(docs: DataFrame, *, length: int = LENGTH, sequences: int = 1, weights: dict[str | None, int] | None = None, vocabulary: str | None = None, end: int = END, ids: bool = False) -> DataFrame:
    """The pieces (PIECES) of all ``docs`` (doc_id, source, text); ``ids`` adds each piece's token ids as little-endian unsigned 32-bit integers.

    ``weights``: positive whole numbers by source.
    """
    if weights is not None and any(w < 1 for w in weights.values()):
        raise ValueError("weights are positive whole numbers")
    spark = docs.sparkSession
    automaton = load(vocabulary)
    kind = "<u2" if max(automaton.start, end + 1) <= 1 << 16 else "<u4"
    rows = staged(encoded(docs, automaton, end, kind), "pack-ids", "zstd")
    parts = staged(rows.groupBy("source", "part").agg(F.sum("tokens").alias("tokens")), "pack-parts")
    totals = parts.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    total = parts.agg(F.sum("tokens")).first()[0] or 0
    own = queues(totals, total, length * sequences, weights)
    shared = total - sum(n for _, n, _ in own)
    sizes = [n for _, n, _ in own] + [shared] * (shared > 0)
    told = spark.sparkContext.broadcast(Plan(sizes, [w for _, _, w in own] + [1 if weights else shared] * (shared > 0), length, sequences))
    # a queue's tasks follow each other; within a task its sources do
    named = spark.createDataFrame([(s, i) for i, (s, _, _) in enumerate(own)], "named string, queue int")
    placed = parts.join(F.broadcast(named), parts["source"].eqNullSafe(named["named"]), "left").drop("named").withColumn("queue", F.coalesce("queue", F.lit(len(own))))
    tasks = placed.groupBy("queue", "part").agg(F.sum("tokens").alias("_tokens"))
    tasks = tasks.withColumn("_from", F.coalesce(F.sum("_tokens").over(W.partitionBy("queue").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("tokens").over(W.partitionBy("queue", "part").orderBy("source").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = placed.withColumn("_inside", inside).join(tasks.drop("_tokens"), ["queue", "part"])
    offsets = staged(offsets.select(F.col("source").alias("_source"), F.col("part").alias("_part"), "queue", (F.col("_from") + F.col("_inside")).alias("_begin")), "pack-offsets")
    near = F.broadcast(offsets) if offsets.count() <= OFFSET_ROWS else offsets
    met = rows.join(near, (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, names = told.value, [x.split()[0] for x in PIECES.split(", ")]
        kinds = [pa.int64()] * len(names) + [pa.binary()] * ids

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names + ["ids"] * ids)

        found: list[tuple] = []
        for batch in batches:
            for doc, n, raw, queue, begin in zip(*(batch[c].to_pylist() for c in ("doc_id", "tokens", "ids", "queue", "begin")), strict=True):
                whole = np.frombuffer(raw, kind).astype("<u4").tobytes()
                for start, size, s, offset in plan.pieces(queue, begin, n):
                    own = whole[4 * start : 4 * (start + size)]
                    found.append((doc, start, size, zlib.crc32(own), n, s, offset, own) if ids else (doc, start, size, zlib.crc32(own), n, s, offset))
                    if len(found) >= 10_000:
                        yield out(found)
                        found = []
        if found:
            yield out(found)

    return met.select("doc_id", "tokens", "ids", "queue", (F.col("_begin") + F.col("before")).alias("begin")).mapInArrow(run, PIECES + ", ids binary" * ids)


def op12_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
