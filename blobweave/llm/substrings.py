"""Substring dedup by relative Lempel-Ziv parsing against all documents of smaller id.

A text is factored greedily: from left to right, each factor is the longest run of
windows of WINDOW words that one reference document holds, and what no reference holds
is literal.  The reference is every document of smaller id, indexed in blocks cut at
places that the content picks, so that equal passages are cut alike wherever they
stand: each window is given the smallest hash among its GRAM-word grams as its anchor,
and a block is a longest run of windows with one anchor.

1. Index.  Each task indexes its documents' blocks by anchor and content.  A block
   that a document of smaller id has too is part of a factor of that document; that is
   often known within the task already.  What remains, one entry per anchor and task,
   meets by anchor.  No text is shuffled.
2. Factor boundaries.  Where an anchor is shared but the blocks differ, a factor
   begins or ends inside the block.  There each window is looked up by its own hash.
3. Parsing.  A text meets the references of its blocks and boundary windows and is
   factored.  Factors have WINDOW words or more, so each is a duplicate span; their
   words are removed.

Every window is decided on the input, so what is removed does not depend on the order
of removal; of several references of a window any may be named.  Both rounds combine
before they shuffle: of one anchor, block or window a task sends one entry, so a passage
that a third of all documents hold stays small.  Block and window identities have 128
bits.

Defined results: a null text has no words; texts of fewer than WINDOW words lose
nothing; of rows with one doc_id none is smaller than another, so repeated rows keep
their words; a null doc_id has no order, so its text neither loses words nor serves
as reference.  Columns that are kept may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW_IDS, mixed, partitions, slices_of, staged, texts_of, word_hashes

WINDOW, GRAM = 50, 25
#: Bytes of text that are parsed together; a longer text is parsed alone.
SLICE_BYTES = 2_000_000
#: Entries that a task holds before it combines and sends them.
HELD = 2_000_000
#: Bases of the two polynomial hashes; odd, so they have inverses modulo 2 ** 64.
BASES = (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)


class Ranges:
    """Hashes of any ranges of a sequence of 64-bit numbers."""

    def __init__(self, words: np.ndarray, base: int):
        with np.errstate(over="ignore"):
            powers = np.full(len(words) + 1, base, np.uint64)
            inverse = np.full(len(words) + 1, pow(base, -1, 1 << 64), np.uint64)
            powers[0] = inverse[0] = 1
            powers, self.inverse = np.cumprod(powers), np.cumprod(inverse)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[:-1])])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive entries."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Blocks:
    """The blocks of a batch of texts: of which text, first window, last window, anchor and content."""

    def __init__(self, texts: list[bytes], window: int = WINDOW, gram: int = GRAM):
        self.window = window
        words, self.starts = word_hashes(texts)
        counts = np.diff(self.starts)
        self.first, self.second = Ranges(words, BASES[0]), Ranges(words, BASES[1])
        n = max(len(words) - window + 1, 0)
        grams = np.arange(max(len(words) - gram + 1, 0))
        least = sliding_min(self.first.hash(grams, grams + gram), window - gram + 1)[:n]
        owner = np.repeat(np.arange(len(texts)), counts)[:n]
        inside = np.arange(n) + window <= self.starts[1:][owner]
        begins = inside.copy()
        begins[1:] &= ~(inside[:-1] & (least[1:] == least[:-1]) & (owner[1:] == owner[:-1]))
        goes_on = np.zeros(n, bool)
        goes_on[:-1] = inside[1:] & ~begins[1:]
        self.begin, self.end = np.flatnonzero(begins), np.flatnonzero(inside & ~goes_on)
        self.owner, self.anchor = owner[self.begin], least[self.begin]
        # never 0, which marks an anchor of several blocks
        self.content = self.second.hash(self.begin, self.end + window) | np.uint64(1)

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows of the ``chosen`` blocks, and the text of each."""
        sizes = (self.end - self.begin + 1)[chosen]
        before = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) - np.repeat(before, sizes) + np.repeat(self.begin[chosen], sizes)
        return at, np.repeat(self.owner[chosen], sizes)

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The 128-bit identity of windows, in two halves."""
        return self.first.hash(at, at + self.window), self.second.hash(at, at + self.window)


def sorted_rows(*columns: np.ndarray) -> list[np.ndarray]:
    order = np.lexsort(columns[::-1])
    return [c[order] for c in columns]


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def settle(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Entries sorted by (a, b, doc), which of them come after a smaller doc of the same (a, b), and the smallest one."""
    a, b, doc = sorted_rows(a, b, doc)
    new = changes(a, b)
    least = doc[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(doc) else doc
    return [a, b, doc], doc > least, least


def several(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For sorted entries, whether their ``a`` has more than one ``b``."""
    new_a = changes(a)
    group = np.cumsum(new_a) - 1
    kinds = np.bincount(group[changes(a, b)], minlength=int(new_a.sum())) if len(a) else np.zeros(0, np.int64)
    return kinds[group] > 1


ENTRIES = "slice int, a binary, b binary, doc binary, ref binary"
#: slice of decisions, which stay where they are
DUPLICATE, BOUNDARY = -1, -2


def _row(where: int, a: np.ndarray, b: np.ndarray, doc: np.ndarray, ref: np.ndarray | None = None) -> tuple:
    return where, a.tobytes(), b.tobytes(), doc.tobytes(), None if ref is None else ref.tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["slice", "a", "b", "doc", "ref"])


def _sliced(a: np.ndarray, b: np.ndarray, doc: np.ndarray, slices: int) -> list[tuple]:
    """Entries as one row per slice; anchors are minima, so they are mixed before they are dealt."""
    where = ((mixed(a) >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    where, a, b, doc = where[order], a[order], b[order], doc[order]
    cuts = [0, *(np.flatnonzero(np.diff(where)) + 1).tolist(), len(a)]
    return [_row(int(where[i]), a[i:j], b[i:j], doc[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j > i]


def _gather(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], combine) -> Iterator[pa.RecordBatch]:
    """``combine`` the entries of ``parts`` whenever HELD of them have come."""
    held: list[tuple] = []
    for part in parts:
        held.append(part)
        if sum(len(p[0]) for p in held) >= HELD:
            yield _batch(combine(*map(np.concatenate, zip(*held, strict=True))))
            held = []
    if held:
        yield _batch(combine(*map(np.concatenate, zip(*held, strict=True))))


def index_blocks(docs: DataFrame) -> DataFrame:
    """What each task knows of its blocks (ENTRIES): duplicates, boundaries, and what other tasks must see."""
    slices = 8 * partitions(docs.sparkSession)

    def combine(anchor: np.ndarray, content: np.ndarray, doc: np.ndarray) -> list[tuple]:
        (anchor, content, doc), later, ref = settle(anchor, content, doc)
        many, first = several(anchor, content), changes(anchor, content)
        rows = [_row(DUPLICATE, anchor[later], content[later], doc[later], ref[later]), _row(BOUNDARY, anchor[many & first], content[many & first], doc[many & first])]
        # of an anchor with several blocks, others need only know that; of one with one block, its smallest document
        sent = first & (~many | changes(anchor))
        return rows + _sliced(anchor[sent], np.where(many, np.uint64(0), content)[sent], doc[sent], slices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in slices_of(batches, SLICE_BYTES):
                found = Blocks(texts_of(batch["text"]))
                yield found.anchor, found.content, np.array(batch["doc_id"], np.int64)[found.owner]

        yield from _gather(parts(), combine)

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, ENTRIES)


def index_windows(docs: DataFrame) -> DataFrame:
    """As index_blocks, for the windows of the blocks in ``boundaries`` of ``docs``."""
    slices = 8 * partitions(docs.sparkSession)

    def combine(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> list[tuple]:
        (a, b, doc), later, ref = settle(a, b, doc)
        first = changes(a, b)
        return [_row(DUPLICATE, a[later], b[later], doc[later], ref[later]), *_sliced(a[first], b[first], doc[first], slices)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in slices_of(batches, SLICE_BYTES):
                found = Blocks(texts_of(batch["text"]))
                chosen = np.concatenate([np.zeros(0, bool), *(np.isin(found.content[found.owner == i], _numbers(x)) for i, x in enumerate(batch["boundaries"]))])
                at, owner = found.windows(np.flatnonzero(chosen))
                yield *found.ids(at), np.array(batch["doc_id"], np.int64)[owner]

        yield from _gather(parts(), combine)

    return docs.select("doc_id", "text", "boundaries").mapInArrow(run, ENTRIES)


def _numbers(column: pa.Scalar) -> np.ndarray:
    return np.array(column.as_py() or [], np.int64).view(np.uint64)


def meet(entries: DataFrame, anchors: bool) -> DataFrame:
    """(doc_id, id, ref: the smaller doc_id of a duplicate) from the entries that tasks sent; with ``anchors`` also boundaries (ref is null)."""

    def batch_of(doc: np.ndarray, ids: np.ndarray, ref: np.ndarray, plain: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(ids.view(np.int64)), pa.array(ref, mask=plain)], ["doc_id", "id", "ref"])

    def decided(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        (a, b, doc), later, ref = settle(a, b, doc)
        told = later & (b != 0) if anchors else later
        edge = several(a, b) & ~later & (b != 0) if anchors else np.zeros(len(a), bool)
        some = told | edge
        return batch_of(doc[some], (b if anchors else a)[some], ref[some], edge[some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                yield decided(*(np.concatenate([np.frombuffer(r[k], t) for r in held]) for k, t in ((0, np.uint64), (1, np.uint64), (2, np.int64))))
                held.clear()

        for batch in batches:
            for where, a, b, doc in zip(batch["slice"].to_pylist(), batch["a"], batch["b"], batch["doc"], strict=True):
                if where != now:
                    yield from out()
                    now = where
                held.append((a.as_py(), b.as_py(), doc.as_py()))
        yield from out()

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, key, doc, ref in zip(batch["slice"].to_pylist(), batch["b" if anchors else "a"], batch["doc"], batch["ref"], strict=True):
                ids, docs = np.frombuffer(key.as_py(), np.uint64), np.frombuffer(doc.as_py(), np.int64)
                plain = np.full(len(ids), where != DUPLICATE)
                yield batch_of(docs, ids, docs if ref.as_py() is None else np.frombuffer(ref.as_py(), np.int64), plain)

    schema = "doc_id long, id long, ref long"
    sent = entries.where("slice >= 0").repartition(partitions(entries.sparkSession), "slice").sortWithinPartitions("slice")
    return sent.mapInArrow(run, schema).unionByName(entries.where("slice < 0").mapInArrow(told, schema))


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """doc_id, blocks and windows (arrays of id and ref): what documents of smaller id hold of each document."""
    blocks = staged(meet(staged(index_blocks(docs), "block-entries"), True), "blocks")
    edges = blocks.where("ref IS NULL").select("doc_id", "id").distinct()
    lists = staged(edges.groupBy("doc_id").agg(F.collect_list("id").alias("boundaries")), "boundaries")
    items = lists.agg(F.sum(F.size("boundaries"))).first()[0] or 0
    edged = docs.select("doc_id", "text").join(F.broadcast(lists) if items <= FEW_IDS else lists, "doc_id")
    windows = meet(staged(index_windows(edged), "window-entries"), False)
    whole = blocks.where("ref IS NOT NULL").select("doc_id", "id", "ref", F.lit(True).alias("is_block"))
    spans = whole.unionByName(windows.withColumn("is_block", F.lit(False))).groupBy("doc_id", "id", "is_block").agg(F.min("ref").alias("ref"))
    one = F.struct("id", "ref")
    return spans.groupBy("doc_id").agg(F.collect_list(F.when(F.col("is_block"), one)).alias("blocks"), F.collect_list(F.when(~F.col("is_block"), one)).alias("windows"))


def _referred(ids: np.ndarray, found: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``ids`` are in ``found`` (id, ref), and their ref."""
    known = np.array(found.values.field("id"), np.int64).view(np.uint64)
    order = np.argsort(known)
    if not len(known):
        return np.zeros(len(ids), bool), np.zeros(len(ids), np.int64)
    at = order[np.minimum(np.searchsorted(known[order], ids), len(known) - 1)]
    return known[at] == ids, np.array(found.values.field("ref"), np.int64)[at]


def factors(held: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """The greedy parse of one text: first word, last word and reference of each factor.

    ``held`` and ``ref``: whether a reference holds the window that begins at a word, and which.
    """
    at = np.flatnonzero(held)
    if not len(at):
        return np.zeros((0, 3), np.int64)
    new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(ref[at]) != 0)])
    first, last = at[new], at[np.concatenate([new[1:], [True]])]
    return np.column_stack([first, last + WINDOW - 1, ref[first]])


def without_duplicates(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), text: bool = True) -> DataFrame:
    """``keep`` columns of ``docs`` with n_words, n_removed, kept_sha256 and, if ``text``, ``kept``, ``spans`` (first and last word) and
    ``factors`` (first and last word, reference)."""
    found = staged(duplicate_spans(docs), "spans")
    names = [f"_k{i}" for i in range(len(keep))]
    met = docs.select("doc_id", "text", *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)]).join(found, "doc_id", "left")
    more = ", kept string, spans array<struct<first:long,last:long>>, factors array<struct<first:long,last:long,reference:long>>" if text else ""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", n_words long, n_removed long, kept_sha256 string" + more
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    factor = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("reference", pa.int64())]))

    def parsed(batch: pa.RecordBatch, texts: list[bytes]) -> dict[int, np.ndarray]:
        """The factors of the texts that have some."""
        blocks, windows = batch["blocks"], batch["windows"]
        touched = [i for i in range(len(texts)) if blocks[i].is_valid and (len(blocks[i]) or len(windows[i]))]
        if not touched:
            return {}
        cut = Blocks([texts[i] for i in touched])
        held, ref = np.zeros(cut.starts[-1], bool), np.zeros(cut.starts[-1], np.int64)
        for k, i in enumerate(touched):
            own = np.arange(*np.searchsorted(cut.owner, [k, k + 1]))
            whole, whose = _referred(cut.content[own], blocks[i])
            if len(windows[i]):
                at, _ = cut.windows(own[~whole])
                there, of = _referred(cut.ids(at)[0], windows[i])
                held[at[there]], ref[at[there]] = True, of[there]
            at, _ = cut.windows(own[whole])
            held[at], ref[at] = True, np.repeat(whose[whole], (cut.end - cut.begin + 1)[own[whole]])
        return {i: factors(held[cut.starts[k] : cut.starts[k + 1]], ref[cut.starts[k] : cut.starts[k + 1]]) for k, i in enumerate(touched)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches, SLICE_BYTES):
            texts = texts_of(batch["text"])
            told = parsed(batch, texts)
            rows = []
            for i, t in enumerate(texts):
                words, own = t.split(), told.get(i, np.zeros((0, 3), np.int64))
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, own[:, 0], 1)
                np.add.at(edge, own[:, 1] + 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = b" ".join(compress(words, ~gone) if len(own) else words)
                row = (len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest())
                if text:
                    sides = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2)
                    row += (kept.decode(), [{"first": a, "last": b - 1} for a, b in sides.tolist()], [dict(zip(("first", "last", "reference"), f, strict=True)) for f in own.tolist()])
                rows.append(row)
            columns = list(zip(*rows, strict=True)) if rows else [()] * (6 if text else 3)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), span, factor]
            out = [batch[c] for c in names] + [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays(out, [*keep, "n_words", "n_removed", "kept_sha256", *(["kept", "spans", "factors"] if text else [])])

    return met.select(*names, "text", "blocks", "windows").mapInArrow(run, schema)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return without_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), text=False)
