"""Every stage of the pipeline against brute force on its own input, and run() against the stages."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from blobweave.llm import bpe, lines, quality
from blobweave.llm.common import staged

from .test_corpus_operators import WORD, fill_truth, jaccard_truth

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(staged(stage(spark, docs[-1], SF), name))
    return [d.toPandas() for d in docs]


def test_stages_keep_the_columns(results):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "source_mixing", "encoding"]
    assert all(list(d.columns) == list(results[0].columns) for d in results[1:5])


def test_quality_stage(spark, results):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    forest = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = set()
    for r in results[0].itertuples():  # one text at a time
        s = quality.batch_statistics([r.text.encode()])
        failed = s["n_words"][0] < 50 or 100 * s["n_repeat_words"][0] > 50 * s["n_words"][0]
        if not failed and forest.path_lengths(quality.features(s))[0] >= forest.cut:
            kept.add(r.doc_id)
    assert set(results[1].doc_id) == kept and 0 < len(kept) < len(results[0])


def test_line_stage(results):
    con = duckdb.connect()
    con.register("documents", results[1])
    want = dict(con.sql(f"SELECT doc_id, kept_sha256 FROM ({lines.OP8_SQL})").fetchall())
    assert want == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in results[2].itertuples()}
    assert all(r.n_chars == len(r.text) for r in results[2].itertuples())


def test_near_duplicate_stage(results):
    _, comps = jaccard_truth(list(zip(results[2].doc_id, results[2].text, strict=True)), 5, 80)
    assert sorted(results[3].doc_id) == sorted(i for i, c in comps.items() if i == c)


def test_mixing_stage(results):
    by = defaultdict(list)
    for r in results[3].itertuples():
        key = hashlib.md5(f"17:{r.doc_id}".encode()).hexdigest()
        by[r.source].append((key, r.doc_id, len(WORD.findall(r.text))))
    names = sorted(by)
    sizes = [sum(n for _, _, n in by[s]) for s in names]
    want = Counter()
    for s, size, target in zip(names, sizes, fill_truth(sizes), strict=True):
        whole = int(target // size)
        rest, start = target - whole * size, 0
        for _, doc, n in sorted(by[s]):
            want[doc] = whole + (start < rest and start + n / 2 <= rest)
            start += n
    assert Counter(results[4].doc_id) == +want


def test_encoding_stage(results):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    texts = dict(zip(results[4].doc_id, results[4].text, strict=True))
    assert Counter(results[5].doc_id) == Counter(results[4].doc_id)
    for r in results[5].itertuples():
        raw = np.array(t.encode(texts[r.doc_id], add_special_tokens=False).ids, "<u4").tobytes()
        assert (r.n_tokens, r.ids, r.decoded_sha256) == (len(raw) // 4, raw, hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_run(spark, results):
    got = corpus_pipeline.run(spark, SF).toPandas()
    columns = ["doc_id", "source", "n_tokens", "ids_sha256"]
    assert sorted(got[columns].itertuples(index=False, name=None)) == sorted(results[5][columns].itertuples(index=False, name=None))


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), "empty")
        assert docs.count() == 0
