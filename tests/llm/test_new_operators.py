"""Whitening, packing and the filter audit, against brute force and SQL."""

from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from blobweave.llm import audit, bpe, packing, queries, whitening

SF = "/root/testdata/sf0.001"


# --- whitening


def test_primes_and_remainders():
    primes = whitening.primes_for(10**30)
    assert len(set(primes)) == len(primes) and math.prod(primes) > 10**30 and all(p < 1 << whitening.PRIME_BITS for p in primes)
    assert all(all(p % q for q in range(2, math.isqrt(p) + 1)) for p in primes)
    for x in (0, 1, -1, 5 * 10**29, -5 * 10**29 + 7, 123456789):
        assert whitening.remaindered([x % p for p in primes], primes) == x


def exact_moments(x: list[list[int]]):
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    cov = [[Fraction(n * sum(r[i] * r[j] for r in x) - sums[i] * sums[j], n * n) for j in range(d)] for i in range(d)]
    return sums, cov


@pytest.mark.parametrize(("scale", "shift"), [(0.2, 0.0), (30.0, -1e4), (1e9, 4e11)])
def test_whitening_is_exact(spark, scale, shift):
    rng = np.random.default_rng(3)
    c = rng.normal(size=(300, 11)) @ rng.normal(size=(11, 11)) * scale + shift
    rows = [(i, v.tolist()) for i, v in enumerate(c)] + [(7, c[7].tolist()), (None, c[9].tolist())]
    bad = [(900, None), (901, [1.0] * 10 + [None]), (902, [float("nan")] + [0.0] * 10), (903, [0.0] * 10 + [float("-inf")]), (904, [1e300] * 11), (905, [])]
    got = whitening.whiten(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").repartition(5)).toPandas()
    x = [[math.floor(1024 * v) + 100000 for v in e] for _, e in rows]
    sums, cov = exact_moments(x)
    n = len(x)
    want = Counter((i, sum((n * v - s) ** 2 for v, s in zip(r, sums, strict=True))) for (i, _), r in zip(rows, x, strict=True))
    one = got[got.component == 1]
    assert Counter((None if np.isnan(i) else int(i), int(d)) for i, d in zip(one.vec_id, one.deviation, strict=True)) == want
    assert set(got.n) == {n} and sorted(set(got.component)) == list(range(1, 9)) and len(got) == 8 * n
    v = np.array([[float(y) for y in r] for r in cov])
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:8]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(r, sums, strict=True)] for r in x])
    truth = centred @ vectors[:, order] / np.sqrt(values[order])
    by = {i: k for k, (i, _) in enumerate(rows[:300])}
    for k in range(8):
        part = got[(got.component == k + 1) & got.vec_id.notna()]
        mine, own = part.whitened.to_numpy(), truth[[by[int(i)] for i in part.vec_id], k]
        assert min(abs(mine - own).max(), abs(mine + own).max()) < 1e-8
        assert part.explained.to_numpy() == pytest.approx(values[order[k]] / np.trace(v), rel=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_whitening_without_variance(spark):
    flat = spark.createDataFrame([(i, [1.0, float(i % 2), 2.0]) for i in range(4)] + [(9, [5.0, 5.0])], "vec_id long, embedding array<float>")
    got = whitening.whiten(flat).toPandas().sort_values(["vec_id", "component"])
    three = got[got.vec_id < 9]
    assert three[three.component == 1].whitened.abs().tolist() == pytest.approx([1.0] * 4) and three[three.component > 1].whitened.isna().all()
    assert three.explained.tolist() == pytest.approx([1.0, 0.0, 0.0] * 4) and (three.identity_error < 1e-9).all()
    alone = got[got.vec_id == 9]
    assert len(alone) == 2 and alone.whitened.isna().all() and alone.explained.isna().all() and alone.identity_error.isna().all() and (alone.deviation == 0).all()
    assert whitening.whiten(flat.limit(0)).count() == 0 and whitening.whiten(flat.where("vec_id > 50")).count() == 0


def test_whitening_query(spark):
    got = queries.QUERIES["op11_whitening"](spark, SF)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert got.count() == 8 * vectors.count()
    told = whitening.fit(vectors)
    (dim,) = told
    x = [[math.floor(1024 * v) + 100000 for v in r["embedding"]] for r in vectors.collect()]
    sums, cov = exact_moments(x)
    assert told[dim].sums == sums
    values = np.linalg.eigvalsh(np.array([[float(y) for y in r] for r in cov]))[::-1]
    assert told[dim].values == pytest.approx(values[:8], rel=1e-10)
    huge = spark.createDataFrame([(i, [float(i) * 1e12]) for i in range(3)], "vec_id long, embedding array<double>")
    assert [d > 1 << 63 for d in whitening.whiten(huge).orderBy("vec_id").toPandas().deviation] == [True, False, True]


# --- packing


def test_turns():
    rng = random.Random(4)
    for _ in range(200):
        n = np.array([rng.choice([0, 1, 2, rng.randint(1, 300), rng.randint(1, 5000)]) for _ in range(rng.randint(1, 12))])
        if not n.sum():
            continue
        window = rng.choice([1, 7, 64])
        sizes = [min(window, int(n.sum()) - at) for at in range(0, int(n.sum()), window)]
        sent = packing.turns(n, sizes)
        assert (sent >= 0).all() and sent.sum(1).tolist() == sizes and sent.sum(0).tolist() == n.tolist()
        quota = np.outer(np.cumsum(sizes), n) / n.sum()
        assert abs(np.cumsum(sent, 0) - quota).max() < 2  # no deficit of two tokens is ever carried


@pytest.mark.parametrize("weights", [None, [3, 1, 2, 50]])
@pytest.mark.parametrize("sequences", [1, 3])
def test_plan(monkeypatch, weights, sequences):
    monkeypatch.setattr(packing, "BLOCK_WINDOWS", 4)
    sizes = [700, 41, 999, 3]
    plan = packing.Plan(sizes, weights or sizes, 16, sequences)
    place = {}
    for q, n in enumerate(sizes):
        for begin, step in ((0, 29), (29, n - 29)) if n > 29 else ((0, n),):
            for start, size, s, offset in plan.pieces(q, begin, step):
                for i in range(size):
                    assert place.setdefault((s, offset + i), (q, begin + start + i)) == (q, begin + start + i)
    assert Counter(place.values()) == Counter((q, i) for q, n in enumerate(sizes) for i in range(n))
    lengths = Counter(s for s, _ in place)
    total = sum(sizes)
    assert set(place) == {(s, i) for s, n in lengths.items() for i in range(n)} and sorted(lengths) == list(range(len(lengths)))
    assert [lengths[s] for s in range(total // 16)] == [16] * (total // 16) and all(n & (n - 1) == 0 for n in lengths.values())
    if weights is None:  # every window holds the target proportions but for the deficits
        for w in range(total // (16 * sequences)):
            n = Counter(q for (s, _), (q, _) in place.items() if s // sequences == w)
            assert all(abs(n[q] - 16 * sequences * x / total) < 3 for q, x in enumerate(sizes))
    else:  # until a queue runs dry, which is the last one here
        n = Counter(q for (s, _), (q, _) in place.items() if s < 1 * sequences)
        assert n[3] == 3 and n[0] >= n[2] >= n[1]


def reassembled(rows, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in texts}
    at, sequences = Counter(), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["length"] > 0 and r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        at[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert at == {i: len(x) for i, x in ids.items()}
    lengths = {}
    for s, found in sequences.items():
        end = 0
        for offset, n in sorted(found):
            assert offset == end
            end += n
        lengths[s] = end
    return lengths, ids


def test_packing_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.QUERIES["op12_packing"](spark, SF).collect()
    lengths, ids = reassembled(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    total = sum(map(len, ids.values()))
    assert sum(lengths.values()) == total and all(n <= 2048 and (n == 2048 or n & (n - 1) == 0) for n in lengths.values())
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    share = Counter()
    for i, x in ids.items():
        share[source[i]] += len(x)
    for s in range(total // 2048):
        mix = Counter()
        for r in rows:
            if r["sequence_id"] == s:
                mix[source[r["doc_id"]]] += r["length"]
        assert all(abs(mix[k] - 2048 * n / total) < 3 for k, n in share.items())


@pytest.mark.parametrize("few", [0, 10**6])
def test_packing_odd_rows(spark, monkeypatch, few):
    monkeypatch.setattr(packing, "OFFSET_ROWS", few)
    rng = random.Random(1)
    words = "alpha beta gamma delta naïve 漢字 🎉 x".split()
    rows = [(i, rng.choice([None, "a", "a", "a", f"own{i}"]), " ".join(rng.choices(words, k=rng.choice([0, 1, 40, 900])))) for i in range(60)]
    rows += [(100, "a", None), (101, None, ""), (102, "b", "word " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("part", F.lit(1)).withColumn("queue", F.lit("q")).repartition(5)
    got = packing.pack(docs, length=32, ids=True)
    found = got.collect()
    lengths, _ = reassembled(found, [(i, t) for i, _, t in rows])
    assert all(n == 32 or (n < 32 and n & (n - 1) == 0) for n in lengths.values())
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in found)
    weighed, _ = reassembled(packing.pack(docs, length=32, sequences=2, weights={"b": 1, "a": 3, None: 1}).collect(), [(i, t) for i, _, t in rows])
    assert sorted(weighed.values()) == sorted(lengths.values())
    assert packing.pack(docs.limit(0)).count() == 0
    twice = docs.where("doc_id = 102").union(docs.where("doc_id = 102")).withColumn("doc_id", F.lit(None).cast("long"))
    assert packing.pack(twice).agg(F.sum("length")).first()[0] == 2 * next(r["doc_tokens"] for r in found if r["doc_id"] == 102)
    with pytest.raises(ValueError):
        packing.pack(docs, weights={"a": 0})


# --- filter audit


def audit_truth(rows, labels):
    words = [(t or "").encode().split() for _, _, t in rows]
    first: dict[str, int] = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    failed = []
    for (i, _, t), w in zip(rows, words, strict=True):
        t = t or ""
        checks = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= x <= "Z" for x in t) > 10 * len(t), any(x in "#$%&*|" for x in t), i is not None and first[t] < i]
        failed.append({f for f, c in zip("ABCDE", checks, strict=True) if c})
    out = set()
    for part in {p or "" for _, p, _ in rows}:
        own = [(i, f) for (i, p, _), f in zip(rows, failed, strict=True) if (p or "") == part]
        table, sums = [], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                good, toxic = (sum(any(b[k] == 1 for b in labels if b[0] == i and i is not None) for i, _ in gone) for k in (1, 2))
                sums[f] += len(gone)
                table.append((f, part, order, step, len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), good, toxic))
        out |= {(*row[1:], sums[row[0]]) for row in table}
    return out


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audited(docs, labels):
    return {tuple(r) for r in audit.interactions(audit.tally(docs, labels)).select(*COLUMNS).collect()}


@pytest.mark.parametrize(("collide", "few"), [(False, 0), (True, 10**6)])
def test_audit(spark, monkeypatch, collide, few):
    monkeypatch.setattr(audit, "FEW_IDS", few)
    monkeypatch.setattr(audit, "PART_ROWS", 7)
    if collide:  # all hashes agree, so texts alone decide
        monkeypatch.setattr(audit, "block", lambda k: F.lit(k).cast("long"))
    rng = random.Random(6)
    pool = ["", "One", "SHOUT " * 200, "a # b", " ".join(f"w{i}" for i in range(130)), "é" * 700, "é" * 699 + "e", " ".join(f"w{i}" for i in range(5000)), " ".join(f"w{i}" for i in range(4999)) + " w499X"]
    rows = [(rng.randrange(60), rng.choice(["en", "de", None, ""]), rng.choice([None, *pool])) for _ in range(90)]
    rows += [(None, "en", "One"), (None, None, "twins"), (None, None, "twins"), (500, "fr", "twins"), *[(600 + i, "en", "copied " * 150) for i in range(40)]]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 60, 2)] + [(4, 1, 0), (None, 1, 1), (9, None, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("key", F.lit("x")).withColumn("part", F.lit(3)).withColumn("_class", F.lit(1.0)).repartition(4)
    got = audited(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got == audit_truth(rows, labels)
    if not collide:
        assert {r[:7] for r in audited(docs, None)} == {r[:7] for r in got}
        assert audit.interactions(audit.tally(docs.limit(0))).count() == 0


def test_audit_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES["op13_filter_audit"](spark, SF)
    assert dict(got.dtypes)["step"] == "int" and all(t == "bigint" for c, t in got.dtypes if c in COLUMNS[3:])
    found = con.sql(queries.SQL["op13_filter_audit"])
    assert sorted(found.columns) == sorted(got.columns)
    assert {tuple(r) for r in got.select(*COLUMNS).collect()} == set(found.select(", ".join(COLUMNS)).fetchall())
