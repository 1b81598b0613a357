"""Mixing sources to target weights: capped water-filling and seeded repetitions.

``water_fill`` shares a word budget over sources by weight; a source is clamped
at ``max_epochs`` times its size and what it cannot take goes to the others in
proportion to their weights, until none is above its clamp.  ``repetitions``
gives every document of a source the whole epochs of its target and spends the
fraction on the first documents in a seeded order.

Native: DataFrame functions only.  The seeded cut is found in two levels.  Each
source is dealt by hash into BUCKETS buckets whose sizes are summed before any
shuffle; a running sum over a source's buckets finds the one in which the
fraction is used up, and only that bucket's documents are put in order.  A
source that holds a third of all rows thus never meets in one task.

Defined results: a null or empty text has size 0 and is taken as often as its
source's whole epochs say, with no words; a null source is a source of its own,
last in order; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE_PERCENT, MAX_EPOCHS, SEED = 150, 2, 17
#: Hexadecimal digits of the hash that name a bucket: 16 ** 3 buckets a source.
BUCKET_DIGITS = 3
#: Bytes of the bucket table that are broadcast at most, and of a row but its source.
BROADCAST_BYTES, BUCKET_BYTES = 32_000_000, 100


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``weight`` and ``target`` to ``sources`` (source, source_size), one row per source.

    Sources in order of size per weight are clamped one after another; with the
    first k clamped, the others get ``level`` words per weight.  Clamping a source
    that is above its clamp raises the level of the others, clamping one that is
    not lowers it, so the rounds of redistribution end at the highest level: one
    running sum.  The windows run over one row per source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long"))
    weighed = weighed.withColumn("_cap", F.col("source_size") * max_epochs)
    whole = W.partitionBy()
    before = W.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    budget = (F.sum("source_size").over(whole) * share_percent).cast("double") / 100
    left = budget - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    level = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    filled = weighed.withColumn("_level", level).withColumn("_level", F.max("_level").over(whole))
    target = F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("weight"))
    return filled.select("source", "source_size", "weight", target.alias("target"))


def repetitions(docs: DataFrame, *, seed: int = SEED, **fill) -> DataFrame:
    """``docs`` (doc_id, source, size and any others) with _source_size, _target and _copies, a row per row.

    Within a source the documents stand in the order of a seeded hash.  All get
    the whole epochs; those whose middle comes before the fraction is used up get
    one more.  So the words taken differ from the target by at most half of the
    document at which the fraction ends.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = docs.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
    buckets = staged(rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_in")), "mix-buckets")
    filled = water_fill(buckets.groupBy("source").agg(F.sum("_in").alias("source_size")), **fill)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    filled = filled.withColumn("_whole", whole).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    filled = filled.select(F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "_whole", "_rest")
    upto = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    table = buckets.withColumn("_from", F.coalesce(F.sum("_in").over(upto), F.lit(0)))
    table = table.join(filled, table["source"].eqNullSafe(filled["_s"])).drop("_s")
    table = table.withColumn("_cut", (F.col("_from") < F.col("_rest")) & (F.col("_from") + F.col("_in") >= F.col("_rest")))
    table = staged(table.withColumnsRenamed({"source": "_s", "_bucket": "_b"}).drop("_in"), "mix-table")
    # a source is up to 16 ** BUCKET_DIGITS keys, so it is split if the table is too large to broadcast
    size = table.agg(F.coalesce(F.sum(BUCKET_BYTES + F.coalesce(F.octet_length("_s"), F.lit(0))), F.lit(0))).first()[0]
    near = F.broadcast(table) if size <= BROADCAST_BYTES else table
    placed = rows.join(near, rows["source"].eqNullSafe(near["_s"]) & (rows["_bucket"] == near["_b"])).drop("_s", "_b")
    plain = placed.where("NOT _cut").withColumn("_copies", F.col("_whole") + F.when(F.col("_from") < F.col("_rest"), 1).otherwise(0))
    inside = W.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size", *[c for c in docs.columns if c not in ("doc_id", "source", "size")]).rowsBetween(W.unboundedPreceding, -1)
    start = F.col("_from") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    cut = placed.where("_cut").withColumn("_copies", F.col("_whole") + F.when(start + F.col("size") / 2.0 <= F.col("_rest"), 1).otherwise(0))
    return plain.unionByName(cut).select(*docs.columns, "_source_size", "_target", "_copies")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = repetitions(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return mixed.select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source, ...) repeated as the mix takes them, whole."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}  # other columns may have any name
    inner = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *[F.col(c).alias(n) for c, n in names.items()])
    dealt = repetitions(inner).where("_copies > 0")
    dealt = dealt.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return dealt.select(*[F.col(n).alias(c) for c, n in names.items()])


_FILL_SQL = """
sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM {docs}),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2 AS cap FROM per_source),
levels AS (SELECT *, (CAST(CAST(sum(source_size) OVER () AS BIGINT) * 150 AS DOUBLE) / 100 - coalesce(CAST(sum(cap) OVER before AS BIGINT), 0))
    / (CAST(sum(weight) OVER () AS BIGINT) - coalesce(CAST(sum(weight) OVER before AS BIGINT), 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), max(level) OVER () * weight) AS target FROM levels),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM filled),
placed AS (SELECT s.doc_id, s.source, s.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
    coalesce(CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('17:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), s.doc_id NULLS FIRST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
"""
#: The same mix by one plain running sum per source.
OP3_SQL = "WITH " + _FILL_SQL.format(docs="documents").strip() + """
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN start + size / 2.0 <= rest AND start < rest THEN 1 ELSE 0 END) AS taken FROM placed
"""
