"""Operators that relate texts or vectors to each other, against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from blobweave.llm import graph, jaccard, lines, mixing, queries, substrings, vectors

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def corpus(seed: int, n: int, size: int = 60, edit: float = 0.04) -> list[str]:
    """Texts of which many are edited copies of others, some share passages."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out: list[str] = []
    passage = " ".join(rng.choices(words, k=55))
    for _ in range(n):
        if out and rng.random() < 0.6:
            t = [w if rng.random() > edit else rng.choice(words) for w in rng.choice(out).split()]
        else:
            t = rng.choices(words, k=rng.randint(1, size * 2))
            if rng.random() < 0.5:
                t[len(t) // 2 : len(t) // 2] = passage.split()
        out.append(" ".join(t))
    return out


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1020)] + [(5000, 5001 + i) for i in range(200)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    want = roots({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in want.items() if n != c}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def jaccard_truth(rows, n, percent):
    sets = {}
    for i, t in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()
    edges = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, roots(sets, edges)


@pytest.mark.parametrize(("block", "n", "percent"), [(400, 4, 85), (3, 5, 80)])
def test_jaccard_join(spark, monkeypatch, block, n, percent):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)  # 3: most blocks have several parts
    texts = corpus(4, 150, edit=0.008) + [None, "", "one", "ONE", "two three", " Two  Three ", "a b c d", "a b c d e"]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string").repartition(3)
    sizes, comps = jaccard_truth(rows, n, percent)
    got = jaccard.near_duplicates(docs, n=n, percent=percent).collect()
    assert len(got) == len(rows) + 1
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(i, sizes[i], comps[i]) for i, _ in rows}
    assert len(set(comps.values())) < len(comps) - 20


def test_jaccard_join_with_a_popular_passage(spark, monkeypatch):
    """Half of each text is the same passage; blocks are small, so that the passage's are crowded."""
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 10)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    passage = rng.choices(words, k=120)
    rows = []
    for i in range(90):
        own = rng.choices(words, k=120)
        rows += [(3 * i, " ".join(own + passage)), (3 * i + 1, " ".join([*own[:60], "x", *own[61:], *passage]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sizes, comps = jaccard_truth(rows, 4, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect()}
    assert got == {i: (sizes[i], comps[i]) for i, _ in rows} and len(set(comps.values())) == 90


def test_set_ids_do_not_depend_on_place():
    texts = [b"a b c d e", b"", b"x", b"a b c d e", b"", b"x"]
    for order in itertools.permutations(range(6)):
        ids = jaccard.set_ids(*jaccard.shingle_sets([texts[i] for i in order], 4))
        by = {texts[i]: set() for i in order}
        for i, x in zip(order, ids.tolist(), strict=True):
            by[texts[i]].add(x)
        assert by[b""] == {0} and all(len(v) == 1 for v in by.values())


def test_block_keys_reach_every_link():
    rng = np.random.default_rng(0)
    for size in [1, 2, 3, 5, 8, 13, 30, 77, 200]:
        for percent in (80, 85):
            for _ in range(12):
                a = rng.integers(0, 2**63, size).astype(np.uint64)
                swap = int((100 - percent) * size / (100 + percent))  # as many as a link allows
                b = np.concatenate([a[swap:], rng.integers(0, 2**63, swap).astype(np.uint64)])
                sets = [np.unique(a), np.unique(b)]
                keys, owner, spare = jaccard.block_keys(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]), percent)
                assert len(set(keys[owner == 0]) & set(keys[owner == 1])) >= max(1, *spare)


def test_keep_one_of_repeated_rows(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(500)], k=60)) for _ in range(4)]
    # id 1: three rows, one of them null in a column; 2 and 3 are copies of each other, each twice; 4 is a copy of 1; ids may be null
    rows = [(1, texts[0], "b", {"x": 2}), (1, texts[0], "a", {"x": 1}), (1, texts[0], None, None), (2, texts[1], "q", {}), (2, texts[1], "p", {}), (3, texts[1], "o", {}), (3, texts[1], "o", {}), (4, texts[0], "z", None), (None, texts[2], "n", None), (None, texts[2], "n", None), (5, texts[3], "e", {"k": 7})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, more map<string,int>")
    got = jaccard.keep_one(docs.repartition(3))
    assert got.columns == docs.columns
    want = [rows[2], rows[4], rows[8], rows[9], rows[10]]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_a_representative_whose_row_is_repeated(spark, monkeypatch):
    """A block holds one row of it, however often the document's row is repeated."""
    rng = random.Random(10)
    base = [f"w{k}" for k in range(200)]
    near = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(8)]
    rows = near + [near[0]] * 400 + [(50, " ".join(rng.choices(base, k=200)))]
    most = []
    plain = jaccard.product
    monkeypatch.setattr(jaccard, "product", lambda columns, offsets, row, marks: most.append(len(offsets)) or plain(columns, offsets, row, marks))
    blocks = [(1, 0, int(i > 0), i, jaccard.shingle_sets([t.encode()], 4)[0].tobytes()) for i, t in near for _ in range(300 if i == 3 else 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*blocks, strict=True)], ["leader", "part", "role", "node", "grams"])
    (out,) = jaccard._multiply(85)(iter([batch]))
    assert max(most) == len(near) + 1 and out.num_rows == len(near) - 1
    _, comps = jaccard_truth(rows[:8] + rows[-1:], 4, 85)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == comps


def test_keep_one(spark):
    rows = [(4, "a b c d e f g", "x", 1), (2, "a b c d e f g", "y", 2), (2, "a b c d e f g", "z", 3), (9, None, "x", 4), (None, "a b c d e f g", "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, class int").selectExpr("*", "class AS _n", "map('a', class) AS m")
    got = jaccard.keep_one(docs)
    assert all(r["_n"] == r["class"] == r["m"]["a"] for r in got.collect())
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["class"]) for r in got.collect()) == [(-1, 5), (2, 2), (9, 4)]
    assert jaccard.keep_one(docs.limit(0)).count() == 0


def substring_truth(rows):
    seen: dict[tuple, int] = {}
    windows = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        windows[i] = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        for x in windows[i]:
            seen[x] = min(seen.get(x, i), i)
    out = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = {k + j for k, x in enumerate(windows[i]) if seen[x] < i for j in range(50)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_dedup(spark):
    rng = random.Random(8)
    pool = corpus(5, 120, 150, 0.01)
    texts = pool + [" ".join(rng.choice(pool).split()[rng.randrange(40) :][:140] + rng.choice(pool).split()) for _ in range(60)]
    texts += [None, "", "x " * 500, "x " * 70, "x y " * 120, "y x " * 60, " ".join(f"q{i}" for i in range(50)), "é\x85z " + " ".join(f"q{i}" for i in range(50))]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    docs = spark.createDataFrame([*rows, (None, pool[0])], "doc_id long, text string").withColumnsRenamed({})
    for parts in (1, 7):
        got = {r["doc_id"]: r for r in substrings.without_duplicates(docs.repartition(parts)).collect()}
        want = substring_truth(rows)
        assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items() if i is not None} == want
        assert got[None]["n_removed"] == 0 and sum(w[1] for w in want.values()) > 1000
        assert all(sum(s["last"] - s["first"] + 1 for s in r["spans"]) == r["n_removed"] for r in got.values())
        words = {i: WORD.findall(t or "") for i, t in rows}
        windows = {i: {tuple(w[k : k + 50]) for k in range(len(w) - 49)} for i, w in words.items()}
        for i, r in got.items():
            for f in r["factors"]:  # the named reference, of smaller id, holds each window of the factor
                assert f["reference"] < i and f["last"] - f["first"] >= 49
                assert all(tuple(words[i][k : k + 50]) in windows[f["reference"]] for k in range(f["first"], f["last"] - 48))
            covered = {k for f in r["factors"] for k in range(f["first"], f["last"] + 1)}
            assert len(covered) == r["n_removed"]
    names = ["blocks", "windows", "kept", "id", "ref", "_k0", "spans", "factors", "boundaries"]
    extra = docs.selectExpr("*", *[f"'{n}' AS {n}" for n in names])
    got = substrings.without_duplicates(extra, keep=("doc_id", *names[:2], *names[3:6]), text=False).collect()
    assert len(got) == docs.count() and all(r["blocks"] == "blocks" and r["_k0"] == "_k0" for r in got)
    twice = spark.createDataFrame([(1, pool[0] + " " + pool[1])] * 2, "doc_id long, text string")
    assert all(r["n_removed"] == 0 for r in substrings.without_duplicates(twice).collect())
    assert substrings.without_duplicates(docs.limit(0)).count() == 0


def vector_truth(x):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    return link.sum(1), roots(range(len(x)), [(int(a), int(b)) for a, b in np.argwhere(link)])


@pytest.mark.parametrize("bucket", [1000, 7])
def test_near_vectors(spark, monkeypatch, bucket):
    monkeypatch.setattr(vectors, "BUCKET_ROWS", bucket)  # 7: most buckets are split
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 16))
    x = np.concatenate([c + rng.standard_normal((rng.integers(1, 25), 16)) * s for c, s in zip(centres, rng.uniform(0.02, 0.25, 40), strict=True)])
    x = np.concatenate([x, x[:30], 3 * x[5:9]]).astype(np.float32)
    rows = [(i, [float(v) for v in row], 1) for i, row in enumerate(x)]
    n, comps = vector_truth(x.astype(float))
    odd = [(9000, None, 1), (9001, [], 1), (9002, [0.0] * 16, 1), (9003, [1.0, None], 1), (9004, [float("nan"), 1.0], 1), (9005, [float("inf")] * 16, 1), (9006, [1e-30] * 3, 1), (9007, [2e-30] * 3, 1)]
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, class int").repartition(4)).collect()}
    assert len(got) == len(rows) + len(odd)
    found, links = sum(got[i]["n_links"] for i in range(len(x))), int(n.sum())
    assert all(got[i]["n_links"] <= n[i] for i in range(len(x))) and found >= 0.95 * links
    assert np.mean([got[i]["component_id"] == comps[i] for i in range(len(x))]) > 0.95
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(9000, 9006))
    assert got[9006]["n_links"] == got[9007]["n_links"] == 1 and got[9007]["component_id"] == 9006
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_near_vectors_repeated_ids(spark):
    a, near, b, c = [1.0, 0.0, 0.0], [1.0, 0.001, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    run = lambda rows: sorted(tuple(r) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    # equal vectors: rows of one id are one vector
    assert run([(1, a), (1, a), (2, near)]) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    # different vectors: links of their own, one component
    assert run([(1, a), (1, b), (2, near), (3, b), (4, c)]) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]
    assert run([(5, a), (5, b), (2, near), (3, b)]) == [(2, 1, 2, True), (3, 1, 2, False), (5, 1, 2, False), (5, 1, 2, False)]


def test_plan_reaches_its_recall():
    rng = np.random.default_rng(3)
    for n in (50, 5_000, 10**6):
        p = vectors.plan(n)
        a = rng.standard_normal((400, 24))
        a /= np.linalg.norm(a, axis=1)[:, None]
        b = rng.standard_normal((400, 24))
        b -= (a * b).sum(1)[:, None] * a
        b /= np.linalg.norm(b, axis=1)[:, None]
        b = 0.95 * a + math.sqrt(1 - 0.95**2) * b
        (ka, pa, la), (kb, pb, lb) = p.project(a), p.project(b)
        met = ((ka == kb) & (abs(pa - pb) <= p.width)).any(1)
        counted = (abs(la - lb) <= p.width).sum(1) >= p.least
        assert (met & counted).mean() >= 0.93 and counted.mean() >= 0.97
        far = (abs(la - la[::-1]) <= p.width).sum(1) >= p.least  # unrelated pairs
        assert far.mean() < 0.02
        assert all((np.concatenate([x, y]) == z).all() for x, y, z in zip(p.project(a[:7]), p.project(a[7:]), p.project(a), strict=True))


def fill_truth(sizes: list[int]) -> list[float]:
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    left, open_, out = 1.5 * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        above = {i for i in open_ if left * weights[i] / total > 2 * sizes[i]}
        if not above:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in above:
            out[i] = 2.0 * sizes[i]
        left -= sum(out[i] for i in above)
        open_ -= above
    return out


def test_mixing(spark):
    rng = random.Random(6)
    names = ["a", "b", "", "é", "Z", "empty", None]
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)) if s != "empty" else rng.choice([None, " "]), s) for i, s in enumerate(rng.choices(names, [30, 300, 5, 20, 60, 5, 10], k=900))]
    rows += [(3, "w w w", "a")] * 3 + [(None, "w", "b")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    run = lambda d: mixing.repetitions(d.select("doc_id", "source", mixing.word_count(d["text"]).alias("size"))).collect()
    got = run(docs.repartition(5))
    assert sorted(map(repr, got)) == sorted(map(repr, run(docs.repartition(2))))
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(r["size"] for r in by[s]) for s in order]
    for s, size, target in zip(order, sizes, fill_truth(sizes), strict=True):
        assert all(r["_source_size"] == size and r["_target"] == pytest.approx(target) and r["_copies"] in (0, 1, 2) for r in by[s])
        assert abs(sum(r["_copies"] * r["size"] for r in by[s]) - target) <= max((r["size"] for r in by[s]), default=0)
    mixed = mixing.mix(docs.withColumnsRenamed({}))
    assert mixed.columns == docs.columns and mixed.count() == sum(r["_copies"] for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


NAMES = ["Ann", "Bob", "Cy", "Di", "Ed", "Flo"]


def own_prose(seed: int, n: int = 26) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))


def test_lines(spark):
    texts = [f"own line number {i} alpha {own_prose(i, 40)}\nCookie notice id {i} please accept now\nthis page was seen by {n} people\n  spaced   out\tboilerplate line here now" for i, n in enumerate(NAMES[:4])]
    rows = list(enumerate(texts)) + [(10, texts[0]), (11, texts[0]), (20, None), (21, ""), (22, "short line\n" * 3), (None, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'l' AS lines", "'m' AS _mask", "'k' AS kept", "1 AS copy", "'i' AS _id", "length(text) AS n_chars")
    out = lines.drop_recurring(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[0]["text"] == texts[0] and got[20]["text"] is None and got[22]["text"] == rows[8][1]
    assert all(got[i]["text"] == texts[i].split("\n")[0] and got[i]["n_chars"] == len(got[i]["text"]) and got[i]["kept"] == "k" for i in (1, 2, 3))
    assert got[10]["text"] == got[11]["text"] == texts[0]  # copies are left whole
    assert lines.drop_recurring(docs.limit(0)).count() == 0


def test_boilerplate_goes_however_much_it_is(spark):
    """Two families of lines with one beginning, a name in each, make up most of every page."""
    shared = ["you are reading a very long page on trains that {n} wrote", "you are reading what {n} has told some of us about cats"]
    wide = "the cookies of this site are needed for all that it does and we ask you to accept every one of them before reading on "
    rows = [(i, "\n".join([own_prose(i, 12), shared[i % 2].format(n=n), wide * 2])) for i, n in enumerate(NAMES)]
    got = {r["doc_id"]: r["text"].split("\n") for r in lines.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [len(got[i]) for i in range(6)] == [3, 2, 1, 1, 1, 1]


def test_numbers_are_no_template(spark):
    rows = [(i, f"{own_prose(i)}\n{i} {i + 7} {i * 3} {i + 50} 1\n1 2 3 4 5") for i in range(6)]
    got = {r["doc_id"]: r["text"].split("\n") for r in lines.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got[0]) == 3 and all(got[i] == rows[i][1].split("\n")[:2] for i in range(1, 6))


def test_long_text_of_many_lines(spark):
    """A text of 1 MB loses every other of its lines in time that grows with its length."""
    short = "\n".join(f"{chr(97 + i)}{chr(98 + i)} is a line that all the others have" for i in range(20))
    others = [(i, f"{own_prose(i, 200)}\n{short}") for i in range(3)]
    long = "\n".join(f"{own_prose(k, 3)} {own_prose(k + 1, 2)} x\n{short.split(chr(10))[k % 20]}" for k in range(100, 14_100))
    began = time.monotonic()
    got = lines.drop_recurring(spark.createDataFrame([*others, (9, long)], "doc_id long, text string")).where("doc_id = 9").first()
    assert got["text"] == "\n".join(long.split("\n")[::2]) and len(long) > 900_000
    assert time.monotonic() - began < 60


@pytest.mark.parametrize("seed", range(3))
def test_lines_equal_sql(spark, seed):
    rng = random.Random(seed)
    words = ["the", "page", "of", "was", "7", "x9", "12:30", *NAMES]
    kinds = ["this page was seen by {0} people {1}", "this page was made of {0} and some {1}", "{0} {1} {0} 5 the", "all of the {1} that {0} has", "7 {0} of the page", "short {0}"]
    rows = []
    for i in range(120):
        some = [rng.choice(kinds).format(rng.choice(words), rng.choice(words)) for _ in range(rng.randint(0, 6))]
        rows.append((rng.choice([i, i, i, 5, None]), rng.choice(["\n".join(some), "\n".join(some), None, f" {'  '.join(some)}\t\n"])))
    rows = list(dict.fromkeys(rows)) + rows[:3]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lines.without_recurring(docs.repartition(3))
    got = sorted(((r["doc_id"], len(r["recurring"] or []), hashlib.sha256((r["kept"] or "").encode()).hexdigest()) for r in got.collect()), key=repr)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    want = sorted(con.sql(f"SELECT doc_id, n_recurring, kept_sha256 FROM ({lines.OP8_SQL})").fetchall(), key=repr)
    assert got == want and sum(w[1] for w in want) > 30


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.SQL[name])
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    a, b = got.select(columns).toPandas(), want.df()[columns]
    assert sorted(map(repr, a.round(6).itertuples(index=False, name=None))) == sorted(map(repr, b.round(6).itertuples(index=False, name=None)))
