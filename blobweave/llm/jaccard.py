"""N-gram Jaccard join by a blocked sparse product of documents and n-grams.

The incidence matrix has a row per distinct set of n-grams (equal sets are one
class) and a column per n-gram.  The product with its transpose holds the overlap
of every two sets.  Only blocks of it are computed that can hold a link:

* Size bounds.  With s of 100 as the least similarity, two linked sets of sizes a
  <= b have b <= 100 a / s and differ in at most H = (100 - s) a / s n-grams.
* Blocks.  A set is dealt into m buckets by n-gram hash.  Since m exceeds H by
  some slack, two linked sets agree in a whole non-empty bucket, so they share a
  key (size level, bucket, content).  A passage that many documents share fills no
  bucket in most sets.  Sets with so few filled buckets that the argument fails have
  their first H + 1 n-grams as keys too, of which two linked sets share one.
* Spare buckets.  Linked sets agree in more buckets than they need to meet: m - H, of
  which some may be empty.  So a set leaves the blocks of more than BLOCK_ROWS rows, if
  fewer of its keys than that lie in such blocks: it meets its links by another key.
  One that lies in fewer blocks of any size than that has no link and leaves all.
* The smallest set of a key leads its block: each other set becomes a row of the
  leader's block.  Blocks that share sets are merged while they are small, so that
  most sets are sent once.  In a block the product with the leader comes first; then that
  of all rows with those rows that do not link with the leader, as any two that do
  are connected already.  Large blocks are split; rows that do not link with the
  leader then visit the other parts too, BLOCK_ROWS of them at a time.

Overlaps below the size bound are dropped and the rest are links, of which a block
returns a spanning forest.  Nothing is approximate but the 64-bit n-gram hashes.

Defined results: a null text, or one without words, has an empty set and links with
nothing; a text of fewer words than n is one n-gram; rows that share a doc_id are
one document; a null doc_id takes the component of its class, or null if it alone
has that set.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, look_up, mixed, only, partitions, slices_of, staged, texts_of, window_hashes, without, word_hashes
from .graph import Forest, components

N, LEAST_PERCENT = 4, 85
#: Rows of a block that are multiplied in one task.
BLOCK_ROWS = 400
#: Tiles of a part are numbered below this.
MOST_TILES = 1 << 31
#: Bytes of text that are cut to n-grams together, and keys that a task holds before it sends them.
SLICE_BYTES, KEYS_HELD = 1_000_000, 1_500_000
#: Bytes of a key that are sent beside its share; keys that agree in these by chance only cost a product.
KEY_BYTES = 5
#: Keys that are sorted together.
SLICE_KEYS = 1_000_000


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct ``n``-word shingles, sorted, all texts in a row; and where each text's begin."""
    words, starts = word_hashes(texts, lower=True)
    counts = np.diff(starts)
    owner = np.repeat(np.arange(len(texts)), np.maximum(counts - n + 1, 0))
    first = np.concatenate([np.arange(a, b - n + 1) for a, b in zip(starts[:-1], starts[1:], strict=True)]) if len(texts) else np.zeros(0, np.int64)
    hashes = window_hashes(words, n)[first] if len(first) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    whole = [mixed(window_hashes(words[starts[i] : starts[i + 1]], int(counts[i])) + np.uint64(counts[i])) for i in short]
    owner = np.concatenate([owner, short])
    hashes = np.concatenate([hashes, *whole]) if whole else hashes
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    owner, hashes = owner[new], hashes[new]
    return hashes, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int64)


def set_ids(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set, 0 for empty ones."""
    sizes = np.diff(starts)
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(mixed(hashes), starts[full])
            out[full] = mixed(sums ^ mixed(sizes[full].astype(np.uint64)))
    return out


def levels(most: int, percent: int) -> np.ndarray:
    """Lower ends of the size levels up to ``most``, each about 1.3 times the one before."""
    ends = [1]
    while ends[-1] <= most * 100 // percent + 1:
        ends.append(max(ends[-1] + 1, ends[-1] * 13 // 10))
    return np.array(ends, np.int64)


def block_keys(hashes: np.ndarray, starts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, index of the set) for all sets: linked sets share a key; and for each set how many keys it shares with any it is linked with."""
    sizes = np.diff(starts)
    spare = np.full(len(sizes), np.iinfo(np.int16).max, np.int64)
    ends = levels(int(sizes.max(initial=1)), percent)
    own = np.searchsorted(ends, sizes, "right") - 1
    keys, owners = [], []
    with np.errstate(over="ignore"):
        back = 0
        while True:
            # the level of a smaller set that this one may link with
            level = own - back
            top = ends[np.clip(level + 1, 0, len(ends) - 1)] - 1
            here = np.flatnonzero((sizes > 0) & (level >= 0) & (sizes * percent <= top * 100))
            if not len(here):
                break
            differ = (100 - percent) * top // percent
            buckets = differ + 1 + differ // 12 + 4
            buckets = np.where(differ == 0, 1, buckets)
            offset = np.concatenate([[0], np.cumsum(buckets[here])])
            rows = np.repeat(np.arange(len(here)), sizes[here])
            items = hashes[np.concatenate([np.arange(starts[i], starts[i + 1]) for i in here])]
            m = buckets[here][rows].astype(np.uint64)
            bucket = offset[rows] + ((items >> np.uint64(20)) % m).astype(np.int64)
            content = np.zeros(offset[-1], np.uint64)
            np.add.at(content, bucket, mixed(items))
            filled = np.bincount(bucket, minlength=int(offset[-1])) > 0
            owner = np.repeat(here, buckets[here])
            number = np.arange(offset[-1]) - np.repeat(offset[:-1], buckets[here])
            tag = mixed(mixed(level[owner].astype(np.uint64)) + number.astype(np.uint64))
            keys.append(mixed(content ^ tag)[filled])
            owners.append(owner[filled])
            shared = np.add.reduceat(filled, offset[:-1], dtype=np.int64) - differ[here]
            spare[here] = np.minimum(spare[here], np.maximum(shared, 0))
            for i in here[shared <= 0].tolist():
                first = hashes[starts[i] : starts[i] + min(differ[i] + 1, sizes[i])]
                keys.append(mixed(first ^ mixed(level[i : i + 1].astype(np.uint64) + np.uint64(1 << 40))))
                owners.append(np.full(len(first), i))
            back += 1
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), spare
    return np.concatenate(keys), np.concatenate(owners), spare


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def classes_of(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles and class (null if empty) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches, SLICE_BYTES):
            hashes, starts = shingle_sets(texts_of(batch["text"]), n)
            sizes = np.diff(starts)
            ids = pa.array(set_ids(hashes, starts).view(np.int64), pa.int64(), mask=sizes == 0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), ids], ["doc_id", "n_shingles", "class"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, class long")


def block_rows(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(leader, class, keys: how many tie them, spare of the class): the classes of each block but its leader.

    Keys travel packed: a task's (key, class) pairs go out as one binary row per
    share of the key range, a class once with the low bytes of all its keys there.
    A share is one partition; it is unpacked and sorted SLICE_KEYS or so at a time.
    """
    shares = partitions(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        spares: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            key, member = np.concatenate(held).T if held else np.zeros((2, 0), np.uint64)
            classes, place, index = np.unique(member, return_index=True, return_inverse=True)
            spare = np.concatenate(spares)[place] if spares else np.zeros(0, np.int64)
            held.clear()
            spares.clear()
            where = (key >> np.uint64(32)) * np.uint64(shares) >> np.uint64(32)
            order = np.lexsort((key, index, where))
            key, index, where = key[order], index[order], where[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (index[1:] != index[:-1])
            key, index, where = key[new], index[new], where[new]
            low = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
            cuts = [0, *(np.flatnonzero(np.diff(where)) + 1).tolist(), len(key)]
            rows = []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if j > i:
                    first = np.flatnonzero(np.diff(index[i:j], prepend=-1))
                    own, counts = index[i:j][first], np.diff(np.append(first, j - i))
                    rows.append((int(where[i]), low[i:j].tobytes(), counts.astype(f"<u{1 if counts.max() < 256 else 4}").tobytes(), classes[own].tobytes(), spare[own].astype("<i2").tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["share", "keys", "counts", "classes", "spares"])

        total = 0
        for batch in slices_of(batches, SLICE_BYTES):
            hashes, starts = shingle_sets(texts_of(batch["text"]), n)
            keys, owner, spare = block_keys(hashes, starts, percent)
            held.append(np.column_stack([keys, set_ids(hashes, starts)[owner]]))
            spares.append(spare[owner])
            total += len(keys)
            if total > KEYS_HELD:
                yield flush()
                total = 0
        yield flush()

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # all pairs of a key are in one task, and in one of its slices
        held = [row for batch in batches for row in zip(*(batch[c].to_pylist() for c in ("keys", "counts", "classes", "spares")), strict=True)]
        bits = min(8, (sum(len(row[0]) for row in held) // KEY_BYTES // SLICE_KEYS).bit_length())

        def unpacked(at: int, keys: bytes, counts: bytes, classes: bytes, spares: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            low = np.frombuffer(keys, np.uint8).reshape(-1, KEY_BYTES)
            own = np.flatnonzero(low[:, -1].astype(np.int64) >> (8 - bits) == at)
            wide = np.zeros((len(own), 8), np.uint8)
            wide[:, :KEY_BYTES] = low[own]
            number = np.frombuffer(counts, f"<u{8 * len(counts) // len(classes)}")
            of = np.repeat(np.arange(len(number)), number)[own]
            return wide.view("<u8").ravel(), np.frombuffer(classes, np.uint64)[of], np.frombuffer(spares, "<i2")[of]

        for at in range(1 << bits if held else 0):
            key, member, spare = (np.concatenate(c) for c in zip(*(unpacked(at, *row) for row in held), strict=True))
            order = np.lexsort((member, key))
            key, member, spare = key[order], member[order], spare[order]
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            again = np.zeros(len(key), bool)
            again[1:] = ~first[1:] & (member[1:] == member[:-1])
            leader = member[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(key) else member
            own = ~first & ~again & (member != leader)
            leader, member, spare = leader[own], member[own], spare[own]
            order = np.lexsort((member, leader))
            leader, member, spare = leader[order], member[order], spare[order]
            new = np.ones(len(leader), bool)
            new[1:] = (leader[1:] != leader[:-1]) | (member[1:] != member[:-1])
            start = np.flatnonzero(new)
            ties = np.diff(np.append(start, len(leader)))
            yield pa.RecordBatch.from_arrays([_signed(leader[start]), _signed(member[start]), pa.array(ties), pa.array(spare[start].astype(np.int64))], ["leader", "class", "keys", "spare"])

    packed = docs.select("text").mapInArrow(pack, "share int, keys binary, counts binary, classes binary, spares binary")
    dealt = packed.repartitionById(shares, "share")
    tied = dealt.mapInArrow(lead, "leader long, class long, keys long, spare long")
    return tied.groupBy("leader", "class").agg(F.sum("keys").alias("keys"), F.min("spare").alias("spare"))


def without_spare(rows: DataFrame) -> DataFrame:
    """(leader, class) of the staged ``rows`` (block_rows), less those of classes that have no links, and those of large blocks whose classes meet their links by other keys; ``rows`` is dropped."""
    # a set that shares fewer keys than with any it is linked with, those that it leads counted once for each row, has no link
    tied = rows.groupBy("class").agg(F.sum("keys").alias("ties"), F.min("spare").alias("least"))
    led = rows.groupBy(F.col("leader").alias("class")).agg(F.sum("keys").alias("led"))
    alone = staged(tied.join(led, "class", "left").where("ties + coalesce(led, 0) < least").select("class"), "unlinked")
    every, rows = rows, staged(without(rows, alone, "class"), "linked-rows")
    dropped(every, alone)
    counts = rows.groupBy("leader").agg(F.count("*").alias("_n"))
    hot = staged(counts.where(F.col("_n") > BLOCK_ROWS), "hot-leaders")
    crowded = staged(look_up(rows, hot.withColumn("is_hot", F.lit(True)), "leader", "_n"), "crowded-rows")
    plain = crowded.where("is_hot IS NULL").select("leader", "class")
    tied = crowded.where("is_hot").groupBy("class").agg(F.sum("keys").alias("ties"), F.min("spare").alias("least"))
    stuck = crowded.where("is_hot").join(tied.where("ties >= least").select("class"), "class")
    out = staged(plain.unionByName(stuck.select("leader", "class")), "block-rows")
    dropped(rows, hot, crowded)
    return out


def product(columns: np.ndarray, offsets: np.ndarray, row: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Overlap of ``row`` with each row of the block (columns in use, by row)."""
    marks[row] = 1
    out = np.add.reduceat(marks[columns], offsets[:-1], dtype=np.int64)
    marks[row] = 0
    return out


def _multiply(percent: int):
    """The links in each block of a sorted stream of rows (leader, part, role, node, grams); roles: 0 leader, 1 own, 2 visitor.

    Returns u, v, apart: a forest of the links, and with u = leader the rows that do not link with it.
    """

    def block(leader: int, part: int, rows: list[tuple[int, int, bytes]]) -> tuple[list, list, list, list]:
        sets = [np.frombuffer(g, np.uint64) for _, _, g in rows]
        nodes, roles = [r[1] for r in rows], np.array([r[0] for r in rows])
        sizes = np.array([len(s) for s in sets])
        distinct, columns = np.unique(np.concatenate(sets), return_inverse=True)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        marks = np.zeros(len(distinct), np.uint8)

        def linked(i: int) -> np.ndarray:
            shared = product(columns, offsets, columns[offsets[i] : offsets[i + 1]], marks)
            return 100 * shared >= percent * (sizes + sizes[i] - shared)

        forest, visits = Forest(), bool((roles == 2).any())
        index = np.arange(len(rows))
        if visits:
            multiplied = index[roles == 2]
            apart: list[int] = []
        else:
            to_leader = linked(0) | (index == 0)
            for j in index[to_leader][1:]:
                forest.join(nodes[0], nodes[j])
            multiplied = index[~to_leader]
            apart = [nodes[i] for i in multiplied]
        for i in multiplied:
            for j in index[linked(i) & (roles == 1)]:
                if nodes[i] != nodes[j]:
                    forest.join(nodes[i], nodes[j])
        pairs = forest.edges()
        us = [a for a, _ in pairs] + [leader] * len(apart)
        return us, [b for _, b in pairs] + apart, [False] * len(pairs) + [True] * len(apart), [part] * len(us)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def out() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                u, v, apart, part = block(*now, rows)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(apart, pa.bool_()), pa.array(part, pa.int64())], ["u", "v", "apart", "part"])
            rows.clear()

        for batch in batches:
            for leader, part, role, node, grams in zip(*(batch[c] for c in ("leader", "part", "role", "node", "grams")), strict=True):
                key = (leader.as_py(), part.as_py())
                if key != now:
                    yield from out()
                    now = key
                row = (role.as_py(), node.as_py(), grams.as_py())
                if not rows or rows[-1][:2] != row[:2]:  # rows of a document may be repeated, and lie side by side
                    rows.append(row)
        yield from out()

    return run


def links(docs: DataFrame, table: DataFrame, n: int, percent: int) -> DataFrame:
    """(u, v): links between class representatives, enough to connect all that are connected.

    ``table``: class, its representative ``rep`` and its number of rows.
    """
    spark = docs.sparkSession
    found = without_spare(staged(block_rows(docs, n, percent), "tied-rows"))
    reps = table.where("rep IS NOT NULL").select("class", "rep")

    # blocks that share classes are one, with each class once, unless that gets too large
    merged = staged(components(found.select(F.col("class").alias("u"), F.col("leader").alias("v"))), "merged")
    counts = staged(merged.groupBy("component").agg(F.count("*").alias("_n")), "merged-sizes")
    few = counts.where(F.col("_n") < BLOCK_ROWS).select("component")
    small = merged.join(few, "component").select(F.col("component").alias("leader"), F.lit(0).cast("long").alias("part"), F.lit(1).alias("role"), F.col("node").alias("class"))
    small_heads = few.select(F.col("component").alias("leader"), F.lit(0).cast("long").alias("part"), F.lit(0).alias("role"), F.col("component").alias("class"))
    large = counts.where(F.col("_n") >= BLOCK_ROWS).select("component")
    members = large.select(F.col("component").alias("class")).unionByName(merged.join(large, "component").select(F.col("node").alias("class")))
    members = staged(members, "large-members")
    every, found = found, staged(found.join(members, "class"), "large-rows")
    dropped(every, members)

    sizes = staged(found.groupBy("leader").agg(F.count("*").alias("_n")).withColumn("parts", F.ceil(F.col("_n") / BLOCK_ROWS)), "block-sizes")
    dealt = look_up(found, sizes, "leader", "_n").withColumn("part", F.pmod(F.xxhash64("class"), "parts"))
    own = dealt.select("leader", "part", F.lit(1).alias("role"), "class")
    heads = sizes.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("leader").alias("class"))
    placed = staged(small.unionByName(small_heads).unionByName(own).unionByName(heads), "placed")
    dropped(merged, counts, found)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches, SLICE_BYTES):
            hashes, starts = shingle_sets(texts_of(batch["text"]), n)
            got = [hashes[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
            right = pa.array(set_ids(hashes, starts).view(np.int64) == np.array(batch["class"]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["places"], pa.array(got, pa.binary())], ["node", "places", "grams"]).filter(right)

    def multiplied(rows: DataFrame) -> DataFrame:
        """The product of the blocks in ``rows``, staged; texts go from the scan to their places, without a join of sets."""
        places = rows.groupBy("class").agg(F.collect_list(F.struct("leader", "part", "role")).alias("places"))
        wanted = staged(places.join(reps, "class").select(F.col("rep").alias("doc_id"), "class", "places"), "places")
        texts = only(docs.select("doc_id", "text"), wanted, "doc_id", "places").select("doc_id", "class", "places", "text")
        sets = texts.mapInArrow(grams, f"node long, places {wanted.schema['places'].dataType.simpleString()}, grams binary")
        met = sets.select("node", "grams", F.explode("places").alias("p")).select("p.leader", "p.part", "p.role", "node", "grams")
        blocks = met.repartition(partitions(spark), "leader", "part").sortWithinPartitions("leader", "part", "role", "node")
        out = staged(blocks.mapInArrow(_multiply(percent), "u long, v long, apart boolean, part long"), "links")
        dropped(wanted)
        return out

    first = multiplied(placed)
    edges = first.where("NOT apart").select("u", "v")
    # rows that don't link with the leader of a block of several parts visit the other parts
    alone = first.where("apart").select(F.col("u").alias("leader"), F.col("v").alias("rep"), F.col("part").alias("own"))
    many = sizes.where("parts > 1").select("leader", "parts")
    visits = alone.join(many, "leader").join(reps, "rep")
    visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("part <> own")
    # BLOCK_ROWS or so visitors at a time: a tile is a part of a block and a share of its visitors
    waiting = visits.groupBy("leader", "part").agg(F.count("*").alias("_n")).withColumn("tiles", F.ceil(F.col("_n") / BLOCK_ROWS))
    tiles = staged(waiting.select("leader", "part", "tiles"), "visit-tiles")
    tile = F.col("part") * MOST_TILES + F.col("tile")
    visits = visits.join(tiles, ["leader", "part"]).withColumn("tile", F.pmod(F.xxhash64("class"), "tiles"))
    visits = staged(visits.select("leader", tile.alias("part"), F.lit(2).alias("role"), "class"), "visits")
    if visits.isEmpty():
        return edges
    hosts = placed.where("role = 1").join(tiles, ["leader", "part"]).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    second = multiplied(hosts.select("leader", tile.alias("part"), "role", "class").unionByName(visits))
    return edges.unionByName(second.where("NOT apart").select("u", "v"))


def near_duplicates(docs: DataFrame, *, n: int = N, percent: int = LEAST_PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id that links reach, the document's own included.
    """
    rows = staged(classes_of(docs, n), "classes")
    table = staged(rows.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("rep"), F.count("*").alias("_n")), "class-table")
    found = components(links(docs, table, n, percent)).withColumnRenamed("node", "rep")
    placed = table.join(found, "rep", "left").select("class", "_n", F.coalesce("component", "rep").alias("component_id"))
    named = look_up(rows, staged(placed, "class-components"), "class", "_n")
    return named.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op7_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one(docs: DataFrame, *, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each near-duplicate component of ``docs``, with all its columns: that of smallest doc_id; null ids stay.

    Of rows that repeat the smallest doc_id, the first in the order of their other columns stays.
    """
    gone = staged(near_duplicates(docs, n=n, percent=percent).where("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    many = staged(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"), "repeated-ids")
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns) if c != "doc_id"}  # other columns may have any name
    inner = docs.select("doc_id", *[F.col(c).alias(x) for c, x in names.items()])
    # texts stay where they are unless more than FEW_IDS documents go
    once = without(inner, staged(gone.unionByName(many).distinct(), "not-once"), "doc_id")
    again = staged(many.join(gone, "doc_id", "left_anti"), "again")
    out = once
    if not again.isEmpty():
        sortable = [F.to_json(F.struct(x)) if "map<" in docs.schema[c].dataType.simpleString() else F.col(x) for c, x in names.items()]
        least = F.min_by(F.struct(*names.values()), F.struct(*sortable)).alias("row")
        out = once.unionByName(only(inner, again, "doc_id").groupBy("doc_id").agg(least).select("doc_id", "row.*"))
    return out.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])
