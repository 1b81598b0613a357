"""Audit of how filters interact: what each removes, in every order in which they can be applied.

Every document gets a mask of the filters that it fails; all counts follow from the
number of documents of each mask.

One filter is whether a document is an exact copy of one with a smaller id.  Copies
are found by refining a partition of the documents: they are split by code-point
length and the hash of a first block, which needs no more than counts that combine
before the shuffle.  Documents that are alone in their class go at once.  The texts of
the others are split by further blocks, each GROWTH times as long as the one
before, until the blocks cover the texts; after each split those alone go.  What
survives is compared text by text with the document of smallest id in its class, and
all but that one are marked.  Texts that differ although all their hashes agree form a
class of their own and are compared again, so the result is exact.

A class may hold any share of the rows: classes are counted before the shuffle, joins
on classes send hot ones by broadcast, and in the comparison a large class is split into
parts, each of which gets a copy of the one text that all are compared with.

Defined results: a null text counts as empty, a null lang as the empty string; a null
doc_id is neither smaller nor larger than others, so such a row is never marked; rows
that share doc_id and text don't mark each other; each row counts; a document has a label
if any row of ``labels`` with its id has it; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import CHAR_START, FEW_IDS, class_sums, look_up, only, slices_of, staged, texts_of

FILTERS = "ABCDE"
#: Filter conditions: fewest words; least share of distinct words and largest share of capitals, in percent.
FEWEST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 100, 80, 10
SYMBOLS = rb"[#$%&*|]"
#: Code points of the first block, and how much longer each next one is.
FIRST_BLOCK, GROWTH = 64, 8
#: Rows of a class that are compared with one copy of its text.
PART_ROWS = 1000
SLICE_BYTES = 4_000_000
ORDERS = ["".join(p) for p in permutations(FILTERS)]

_CAPITALS = np.array([ord("A") <= b <= ord("Z") for b in range(256)], np.uint8)


def text_mask(texts: list[bytes]) -> list[int]:
    """Bits 1 to 8 for filters A to D, which each look at one text."""
    has_symbol = re.compile(SYMBOLS).search
    points, capitals = class_sums(texts, CHAR_START, _CAPITALS)
    out = []
    for text, n, big in zip(texts, points.tolist(), capitals.tolist(), strict=True):
        words = text.split()  # at the white space of ASCII
        few = len(words) < FEWEST_WORDS
        same = 100 * len(set(words)) < DISTINCT_PERCENT * len(words)
        out.append(few | same << 1 | (100 * big > CAPITALS_PERCENT * n) << 2 | (has_symbol(text) is not None) << 3)
    return out


def masked(rows: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, part and ``extra`` columns of ``rows`` (with text) and the ``mask`` of filters A to D."""
    kept = ["doc_id", "part", *extra]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches, SLICE_BYTES):
            masks = pa.array(text_mask(texts_of(batch["text"])), pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), masks], [*kept, "mask"])

    return rows.select(*kept, "text").mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in kept) + ", mask int")


def block(k: int):
    """Hash of the block number ``k`` of ``text``."""
    size = FIRST_BLOCK * GROWTH**k
    begin = FIRST_BLOCK * (GROWTH**k - 1) // (GROWTH - 1)
    return F.xxhash64(F.substring("text", begin + 1, size))


def refined(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``rows`` (doc_id, part, text, key: by length and first block): those that share all blocks with another, with
    _row and _class, and the masks of the others, with doc_id and part."""
    first = staged(rows.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key"), "audit-keys")
    if first.count() <= FEW_IDS:
        alone = masked(rows.join(F.broadcast(first), "key", "left_anti"))
    else:  # texts stay where they are
        alone = masked(rows, ("key",)).join(first, "key", "left_anti").drop("key")
    longest = rows.agg(F.max(F.length("text"))).first()[0] or 0
    blocks, covered = [], FIRST_BLOCK
    while covered < longest:
        blocks.append(block(len(blocks) + 1))
        covered += FIRST_BLOCK * GROWTH ** len(blocks)
    alive = only(rows, first, "key").withColumn("_row", F.monotonically_increasing_id())
    for k, b in enumerate(blocks):  # _k: the class after split k
        alive = alive.withColumn(f"_{k}", F.xxhash64(f"_{k - 1}" if k else "key", b))
    names = ["key", *(f"_{k}" for k in range(len(blocks)))]
    alive = staged(alive, "audit-texts")
    # rows alike in all blocks are counted once, then each split drops the classes of one row
    signs = staged(alive.groupBy(*names).agg(F.count("*").alias("_of")), "audit-signs")
    for name in names:
        several = signs.groupBy(name).agg(F.sum("_of").alias("_rows"), F.count("*").alias("_n")).where("_rows > 1").select(name, "_n", F.lit(True).alias("_more"))
        signs = staged(look_up(signs, staged(several, "audit-classes"), name, "_n").where("_more").drop("_more"), "audit-signs")
    left = signs.select(F.col(names[-1]).alias("_class"), F.col("_of").alias("_n"), F.lit(True).alias("_more"))
    told = look_up(alive.withColumn("_class", F.col(names[-1])).drop(*names), left, "_class", "_n")
    return told.where("_more").drop("_more"), alone.unionByName(masked(told.where("_more IS NULL")))


def copies(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, _row, _class, text, ...) with ``copy``: whether a row with a smaller id has the same text."""
    done = None
    while True:
        classes = rows.groupBy("_class").agg(F.count("*").alias("_n"), F.min("doc_id").alias("_least")).withColumn("_parts", F.ceil(F.col("_n") / PART_ROWS))
        led = look_up(rows, staged(classes, "audit-least"), "_class", "_n")
        texts = led.where("doc_id = _least OR _least IS NULL").groupBy("_class", "_parts").agg(F.min("text").alias("_text"))
        texts = texts.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
        dealt = led.withColumn("_part", F.pmod(F.xxhash64("_row"), F.col("_parts")))
        met = dealt.join(texts, ["_class", "_part"]).withColumn("_same", F.col("text") == F.col("_text"))
        met = staged(met.withColumn("copy", F.coalesce(F.col("doc_id") > F.col("_least"), F.lit(False))).drop("_text", "_part", "_parts", "_least"), "audit-compared")
        same = met.where("_same").drop("_same")
        done = same if done is None else done.unionByName(same)
        rows = met.where("NOT _same").drop("_same", "copy")
        if rows.isEmpty():
            return done


def tally(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each mask, and how many of them are labelled good and toxic."""
    rows = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64(F.length("text"), block(0)))
    found, others = refined(rows)
    marked = masked(copies(found), ("copy",)).withColumn("mask", F.col("mask") + F.when(F.col("copy"), 1 << FILTERS.index("E")).otherwise(0)).drop("copy")
    # an id of many rows is few rows before it meets its labels
    each = marked.unionByName(others).groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    if labels is None:
        return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    known = labels.groupBy(F.col("doc_id").alias("_id")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(f"_{c}") for c in ("quality", "toxic")])
    return each.join(known, F.col("doc_id") == F.col("_id"), "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("_quality", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("_toxic", F.lit(0))).alias("toxic")
    )


def interactions(counts: DataFrame) -> DataFrame:
    """A row for each part, filter order and step of ``counts`` (``tally``; at most 32 rows a part), zeros included."""
    table = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))
    orders = F.array(*[F.lit(o) for o in ORDERS])
    # bit: of this step's filter; before: of those applied earlier
    rows = table.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))

    rows = rows.withColumn("bit", F.expr(f"shiftleft(1, locate(substring(filter_order, step, 1), '{FILTERS}') - 1)"))
    rows = rows.withColumn("before", F.expr(f"aggregate(sequence(1, 5), 0, (a, i) -> a + if(i < step, shiftleft(1, locate(substring(filter_order, i, 1), '{FILTERS}') - 1), 0))"))

    def total(what: str, where: str):
        return F.expr(f"aggregate(m, 0L, (a, x) -> a + if({where}, x.{what}, 0L))")

    here = "(x.mask & bit) != 0 AND (x.mask & before) = 0"
    rows = rows.select(
        "part", "filter_order", "step", "bit", total("n", "(x.mask & (before | bit)) = 0").alias("kept"), total("n", here).alias("removed"),
        total("n", "(x.mask & bit) != 0 AND (x.mask & before) != 0").alias("redundant"), total("n", "x.mask = bit").alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
    )
    return rows.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "bit"))).drop("bit")


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return interactions(tally(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))


_WORDS = "regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')"
#: The same counts from plain masks, copies by the smallest id of each text.
OP13_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, part, t, {_WORDS} AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM texts),
masks AS (
  SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask FROM words),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
counts AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM masks LEFT JOIN known USING (doc_id) GROUP BY 1, 2),
orders AS (SELECT unnest([{", ".join(f"'{o}'" for o in ORDERS)}]) AS filter_order),
steps AS (
  SELECT filter_order, step, 1 << (instr('ABCDE', filter_order[step]) - 1) AS bit, list_sum(list_transform(range(1, step), lambda i: 1 << (instr('ABCDE', filter_order[i]) - 1))) AS earlier
  FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders)),
told AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, bit,
    coalesce(sum(n) FILTER (mask & (coalesce(earlier, 0)::BIGINT | bit) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & coalesce(earlier, 0)::BIGINT = 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & coalesce(earlier, 0)::BIGINT <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & coalesce(earlier, 0)::BIGINT = 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & coalesce(earlier, 0)::BIGINT = 0), 0) AS toxic_lost
  FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM told
"""
