"""Operators and stages on tables with further columns, named as the operators name theirs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from blobweave.llm import bpe, jaccard, licenses, lines, mixing, mixture, quality, substrings, vectors, warc

NAMES = [
    "_n", "_id", "_d", "_t", "_l", "_s", "_b", "_kept", "_recurring", "_mask", "_copy", "_copies", "_target", "_source_size", "_key", "_bucket", "_cut", "_whole", "_rest", "_from", "_first", "_hot", "_c0", "_k0", "_digest", "_bytes",
    "kept", "copy", "recurring", "lines", "line", "blocks", "windows", "spans", "class", "component_id", "key", "keys", "slice", "grams", "size", "rep", "leader", "part", "parts", "node", "n_tokens", "n_words", "ids", "ids_sha256",
    "anomaly", "base_failed", "held_out", "chunk", "trail", "text_id", "template", "leaf", "words", "masked", "score", "labels", "quality", "first", "origin_id", "value", "record_type", "at", "own", "copies", "links", "ref", "id",
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    own = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(70)) for _ in range(12)]
    rows = [(i, f"{t}\nthis very line is in all of them", "en", f"s{i % 2}") for i, t in enumerate(own)] + [(20, own[0] + " x", "en", "s0"), (None, own[3], None, None)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    return made.select("*", *[F.lit(n).alias(n) for n in NAMES]).persist()


def untouched(df, columns):
    assert df.columns == columns
    for r in df.collect():
        assert all(r[n] == n for n in NAMES)


def test_stages(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    good = quality.keep_good(docs, labels)
    untouched(good, docs.columns)
    assert good.count() >= 10
    dropped = lines.drop_recurring(docs)
    untouched(dropped, docs.columns)
    assert dropped.where("text LIKE '%all of them'").count() == 1
    one = jaccard.keep_one(docs)
    untouched(one, docs.columns)
    assert sorted(r["doc_id"] for r in one.collect() if r["doc_id"] is not None) == list(range(12))
    untouched(mixing.mix(docs), docs.columns)
    kept = ("doc_id", "lang", "source")
    assert bpe.encode_documents(docs, keep=kept).count() == docs.count()


def test_operators(spark, docs, tmp_path):
    n = docs.count()
    assert mixture.score_documents(docs).count() == n
    assert licenses.scan_documents(docs, keep=("doc_id", "_n", "key")).where("_n = '_n' AND key = 'key'").count() == n
    assert substrings.without_duplicates(docs, keep=("doc_id", "blocks", "windows", "ref"), text=False).where("ref = 'ref'").count() == n
    assert jaccard.near_duplicates(docs).count() == n
    assert quality.judge(docs, None, ["doc_id", "slice"]).where("slice = 'slice'").count() == n
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), *NAMES)
    warc.write_warc(pages, str(tmp_path / "w"))
    assert warc.resolve_revisits(warc.read_warc(spark, str(tmp_path / "w"))).count() == n
    points = spark.range(6).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id") * 5.0).alias("embedding"), *[F.lit(x).alias(x) for x in NAMES if x != "id"])
    assert vectors.near_vectors(points).count() == 6
