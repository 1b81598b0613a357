"""Embedding near-dedup by counting collisions of one-dimensional projections.

Vectors are scaled to length one and projected on many random lines.  Two of them
collide on a line if one lies in the window of half-width ``width`` about the other.  A
pair's collisions on LINES lines are counted; if they reach a count that a pair of
exactly the least cosine reaches with the chance COUNTED, its cosine is verified in
double precision.

A window on one line holds a third of all vectors, so counts are only taken of pairs
that meet.  Vectors meet in tables: in each, those that share the cells of some further
lines are sorted by another, and meet if they collide on it.  ``plan`` adds cells with
the logarithm of the number of vectors, so that a window holds about WINDOW_ROWS
unrelated vectors at any size, and takes the fewest tables in one of which a pair of
the least cosine meets with the chance MET.  The first table in which a pair meets
counts and reports it, so each link counts once.  Closer pairs are found more surely.

Projections are sums of whole numbers, so they don't depend on how rows are batched.

Copies of a vector are one class with a number of rows.  A bucket of more than
BUCKET_ROWS classes is split into tiles, each a pair of its parts.  A tile returns
for each vector the number of its links and a spanning forest of them, no pairs.

Defined results: a vector that is null, empty, zero, or holds a null or non-finite
component links with nothing, nor do vectors of different dimension; rows that
share a vec_id and a class are one vector; rows that share a vec_id but not a class
are vectors with links of their own, in one component; a null vec_id is in the
component of its class, null if the class has no other.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import look_up, mixed, partitions, staged
from .graph import Forest, components

LEAST_COSINE = 0.95
CELL, LINES, WINDOW_ROWS, SEED = 1.2, 24, 100, 5
#: Chances that a pair of exactly the least cosine meets, and that its count suffices.
MET, COUNTED = 0.98, 0.99
#: Whole numbers to one in vectors and lines; sums of their products stay below 2 ** 53.
VECTOR_SCALE, LINE_SCALE = 1 << 20, 1 << 12
BUCKET_ROWS = 1000
PAIRS_AT_ONCE = 100_000


@dataclass(frozen=True)
class Plan:
    cells: int
    tables: int
    width: float
    least: int

    def lines(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Directions (those of each table's cells and its sorted line, then those counted on) and cell offsets [table, cell]."""
        rng = np.random.default_rng((SEED, dim))
        many = self.tables * (self.cells + 1) + LINES
        return np.rint(rng.standard_normal((many, dim)) * LINE_SCALE), rng.random((self.tables, self.cells))

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row of ``x`` the bucket key and the place in each table, and the places on the lines that are counted on."""
        lines, offsets = self.lines(x.shape[1])
        at = (np.rint(x * VECTOR_SCALE) @ lines.T) / (VECTOR_SCALE * LINE_SCALE)
        met = at[:, : -LINES].reshape(len(x), self.tables, self.cells + 1)
        cells = np.floor(met[:, :, :-1] / CELL + offsets).astype(np.int64).view(np.uint64)
        key = mixed(np.arange(self.tables, dtype=np.uint64) + np.uint64(x.shape[1] << 32)) + np.zeros((len(x), 1), np.uint64)
        for line in range(self.cells):
            key = mixed(key ^ cells[:, :, line])
        return key.view(np.int64), met[:, :, -1], at[:, -LINES:]


def plan(n: int, least_cosine: float = LEAST_COSINE) -> Plan:
    """Cells, tables, window and count for ``n`` vectors."""
    spread = math.sqrt(2 - 2 * least_cosine)  # the standard deviation of the difference of two projections
    width = 2 * spread
    apart = CELL / (math.sqrt(2 * math.pi) * math.sqrt(2))  # about the chance that unrelated vectors share a cell
    cells = max(1, round(math.log(max(n, 1) / WINDOW_ROWS) / -math.log(apart))) if n > WINDOW_ROWS else 1
    share = math.erf(CELL / spread / math.sqrt(2)) - spread / CELL * math.sqrt(2 / math.pi) * (1 - math.exp(-((CELL / spread) ** 2) / 2))
    collide = math.erf(width / spread / math.sqrt(2))
    tables = math.ceil(math.log(1 - MET) / math.log(1 - share**cells * collide))
    least, chance = LINES, collide**LINES
    while chance < COUNTED:
        least -= 1
        chance += math.comb(LINES, least) * collide**least * (1 - collide) ** (LINES - least)
    return Plan(cells, tables, width, least)


def unit_rows(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector scaled to length one, in double precision; None if it can link with nothing."""
    out = []
    for value in column.to_pylist():
        x = np.array([np.nan if v is None else v for v in value], np.float64) if value else None
        top = np.abs(x).max() if x is not None and np.isfinite(x).all() else 0.0
        out.append(None if top == 0 else (y := x / top) / math.sqrt(float(y @ y)))
    return out


def class_id(x: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True)


def classes_of(vectors: DataFrame) -> DataFrame:
    """vec_id, class (null if it can link with nothing) and embedding of each row."""
    kind = vectors.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [None if x is None else class_id(x) for x in unit_rows(batch["embedding"])]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(ids, pa.int64()), batch["embedding"]], ["vec_id", "class", "embedding"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id long, class long, embedding {kind}")


def bucket_rows(reps: DataFrame, p: Plan) -> DataFrame:
    """(class, key, at: the table) for each class and table; ``reps`` has a row a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = unit_rows(batch["embedding"]), batch["class"].to_pylist()
            for dim in {len(x) for x in rows}:
                own = [i for i, x in enumerate(rows) if len(x) == dim]
                keys, _, _ = p.project(np.array([rows[i] for i in own]))
                who = np.repeat(np.array([ids[i] for i in own], np.int64), p.tables)
                table = np.tile(np.arange(p.tables, dtype=np.int32), len(own))
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(keys.ravel()), pa.array(table)], ["class", "key", "at"])

    return reps.select("class", "embedding").mapInArrow(run, "class long, key long, at int")


def tile_links(p: Plan, least_cosine: float):
    """Kernel over rows (at, key, low, high, own, node, copies, embedding) sorted by tile: (u, v, n).

    A row with n says that u has n linked rows; one with v is a link of the forest.
    """

    def tile(table: int, _: int, low: int, high: int, rows: list[tuple]) -> tuple[list, list, list]:
        x = np.array([r[3] for r in rows])
        own, node, copies = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        keys, places, counted = p.project(x)
        order = np.argsort(places[:, table], kind="stable")
        x, own, node, copies, keys, places, counted = (a[order] for a in (x, own, node, copies, keys, places, counted))
        at = places[:, table]
        last = np.searchsorted(at, at + p.width, "right")
        found = np.zeros(len(rows), np.int64)
        forest = Forest()
        first = 0
        while first < len(rows):
            sizes = last[first:] - np.arange(first + 1, len(rows) + 1)
            take = max(1, int(np.searchsorted(np.cumsum(sizes), PAIRS_AT_ONCE, "right")))
            sizes = sizes[:take]
            i = np.repeat(np.arange(first, first + take), sizes)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            first += take
            if low != high:
                across = own[i] != own[j]
                i, j = i[across], j[across]
            chosen = (np.abs(counted[i] - counted[j]) <= p.width).sum(1) >= p.least
            i, j = i[chosen], j[chosen]
            here = ((keys[i] == keys[j]) & (np.abs(places[i] - places[j]) <= p.width)).argmax(1) == table
            i, j = i[here], j[here]
            true = np.einsum("nd,nd->n", x[i], x[j]) >= least_cosine
            i, j = i[true], j[true]
            np.add.at(found, i, copies[j])
            np.add.at(found, j, copies[i])
            for a, b in zip(node[i].tolist(), node[j].tolist(), strict=True):
                forest.join(a, b)
        edges = forest.edges()
        some = np.flatnonzero(found)
        return [*node[some].tolist(), *(a for a, _ in edges)], [*[None] * len(some), *(b for _, b in edges)], [*found[some].tolist(), *[None] * len(edges)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def out() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                u, v, n = tile(*now, rows)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], ["u", "v", "n"])
            rows.clear()

        for batch in batches:
            unit = unit_rows(batch["embedding"])
            for x, key, low, high, own, node, copies, at in zip(unit, *(batch[c].to_pylist() for c in ("key", "low", "high", "own", "node", "copies", "at")), strict=True):
                if (at, key, low, high) != now:
                    yield from out()
                    now = (at, key, low, high)
                rows.append((own, node, copies, x))
        yield from out()

    return run


def near_vectors(vectors: DataFrame, *, least_cosine: float = LEAST_COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    known = classes_of(vectors)
    rows = staged(known.select("vec_id", "class"), "vector-classes")
    ids = staged(rows.where("class IS NOT NULL").groupBy("class", "vec_id").agg(F.count("*").alias("n")), "vector-ids")
    # rows that repeat vec_id and class are one vector; those without a vec_id are one each
    copies = F.sum(F.when(F.col("vec_id").isNull(), F.col("n")).otherwise(1)).alias("copies")
    table = staged(ids.groupBy("class").agg(F.min("vec_id").alias("rep"), copies, F.sum("n").alias("_n")), "vector-table")
    p = plan(table.count(), least_cosine)
    # a vector of each class; all tables and tiles are joined by class, never by vec_id
    one = known.where("class IS NOT NULL").groupBy("class").agg(F.first("embedding").alias("embedding"))
    reps = staged(one.join(table.where("rep IS NOT NULL").select("class", "copies"), "class"), "vector-reps")
    keyed = staged(bucket_rows(reps, p), "vector-keys")
    sizes = staged(keyed.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").withColumn("parts", F.ceil(F.col("_n") / BUCKET_ROWS)), "bucket-sizes")
    # a row of part a of a bucket visits the tiles (a, j) and (j, a) for each other part j, and (a, a)
    placed = keyed.join(sizes.select("key", "parts"), "key").withColumn("own", F.pmod(F.xxhash64("class"), "parts"))
    placed = placed.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    tiles = placed.select("class", F.struct("at", "key", F.least("own", "j").alias("low"), F.greatest("own", "j").alias("high"), "own").alias("tile"))
    by_class = tiles.groupBy("class").agg(F.collect_list("tile").alias("tiles"))
    met = reps.join(by_class, "class").select(F.explode("tiles").alias("t"), F.col("class").alias("node"), "copies", "embedding")
    met = met.select("t.at", "t.key", "t.low", "t.high", "t.own", "node", "copies", "embedding")
    dealt = met.repartition(partitions(spark), "key", "low", "high").sortWithinPartitions("at", "key", "low", "high", "node")
    found = staged(dealt.mapInArrow(tile_links(p, least_cosine), "u long, v long, n long"), "vector-links")
    counts = staged(found.where("n IS NOT NULL").groupBy(F.col("u").alias("class")).agg(F.sum("n").alias("links")), "link-counts")
    # classes that share a vec_id are one component
    several = ids.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("class").alias("v"), F.count("*").alias("_n")).where("_n > 1")
    shared = look_up(ids, staged(several, "vector-shared"), "vec_id", "_n").where("v <> class").select(F.col("class").alias("u"), "v")
    named = components(found.where("v IS NOT NULL").select("u", "v").unionByName(shared)).withColumnRenamed("node", "class")
    linked = table.join(counts, "class", "left").join(named, "class", "left")
    linked = staged(linked.withColumn("component", F.coalesce("component", "class")), "vector-linked")
    least = staged(linked.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("_of")), "vector-least")
    told = look_up(linked, least, "component", "_of")
    told = told.select("class", "_n", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    done = look_up(rows, staged(told, "vector-components"), "class", "_n")
    component = F.coalesce("component_id", "vec_id")
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op6_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
