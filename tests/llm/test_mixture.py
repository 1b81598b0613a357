"""Language-model scores against a plain model of whole tokens, without hashes, chunks or arrays."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from blobweave.llm import mixture as lm
from blobweave.llm.common import word_hashes

SF = "/root/testdata/sf0.001"


def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), b"\n"]


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % 5 == 1


def grams(tokens: list[bytes]) -> list[tuple]:
    """For each token its class, pair and triple."""
    order = dict(zip(tokens, word_hashes([b" ".join(tokens)])[0].tolist(), strict=False))
    order[b"\n"] = 1
    out = []
    for i, w in enumerate(tokens):
        at = max((k for k in lm.CLASS_AT if k <= i), default=0)
        counts = Counter(tokens[:at])
        kind = min(counts, key=lambda t: (-counts[t], order[t])) if at else None
        before = (["", "", *tokens])[i : i + 2]
        out.append((kind, (before[1], w), (*before, w)))
    return out


def truth(rows: list[tuple]) -> list[tuple[float, float]]:
    """Bits of the symbols and the log2 probability of the decisions of each row."""
    every = [tokens_of(t) for _, t in rows]
    taught = [not held_out(i) for i, _ in rows]
    counts: Counter = Counter()
    tables = []
    for tokens, own in zip(every, taught, strict=True):
        mine: Counter = Counter()
        for w, (kind, pair, triple) in zip(tokens, grams(tokens), strict=True):
            mine.update([("w", w), ("c", kind, w), ("k", kind), ("2", *pair), ("3", *triple), "n"])
        mine["texts"] += 1
        tables.append(mine if own else Counter())
        counts.update(tables[-1])
    letters: Counter = Counter()
    for tokens, own in zip(every, taught, strict=True):
        for w in tokens if own else []:
            whole = b"\0\0" + w + (b" " if w != b"\n" else b"")
            letters.update(whole[k : k + 3] for k in range(len(whole) - 2))

    def spelling(w: bytes) -> float:
        whole, bits = b"\0\0" + w + (b" " if w != b"\n" else b""), 0.0
        for k in range(len(whole) - 2):
            a, b, c = whole[k : k + 3]
            one = {x: sum(n for key, n in letters.items() if key[1] == b and key[2] == x) + 0.5 for x in range(256)}
            n = sum(m for key, m in letters.items() if key[:2] == bytes([a, b]))
            bits -= math.log2((letters[bytes([a, b, c])] + lm.SPELL_PRIOR * one[c] / sum(one.values())) / (n + lm.SPELL_PRIOR))
        return bits

    decided = []
    symbols = []
    for tokens, mine in zip(every, tables, strict=True):
        left = lambda key: counts[key] - mine[key]  # noqa: E731, B023
        bits, trail = 0.0, []
        for i, (w, (kind, pair, triple)) in enumerate(zip(tokens, grams(tokens), strict=True)):
            before = tokens[i - 1] if i else None
            n_two = left(("2", *triple[:2])) if i else left("texts")
            n_one = left(("w", before)) if i else left("texts")
            total = left("n")
            base = left(("c", kind, w)) / left(("k", kind)) if left(("c", kind, w)) else left(("w", w)) / total if total else 0.0
            tries = [(left(("3", *triple)), n_two), (left(("2", *pair)), n_one), (tokens[:i].count(w), i), (left(("c", kind, w)), left(("k", kind))), (left(("w", w)), total)]
            level = next((k for k, (c, n) in enumerate(tries) if c > 0 and c / n >= base * (1 - 1e-12)), 5)
            bits += spelling(w) if level == 5 else -math.log2(tries[level][0] / tries[level][1])
            trail.append((level, [n for _, n in tries]))
        symbols.append(bits)
        decided.append(trail)
    # the bits, each with its contexts
    def asked(trail: list[tuple]) -> list[tuple[int, bool]]:
        out = []
        for i, (level, met) in enumerate(trail):
            past = [trail[i - k][0] if i >= k else 5 for k in range(1, 7)]
            recent = [t[0] == 0 for t in trail[max(0, i - lm.RATE_TOKENS) : i]]
            rate = sum(recent) * 8 // max(len(recent), 1)
            for k in range(min(level, 4) + 1):
                own = min(1 + int(math.log2(met[k])) // 2, 7) if met[k] > 0 else 0
                if own:
                    own = 1 if k == 4 else own
                    six = sum((p == 0) << j for j, p in enumerate(past))
                    out.append(((((k * 8 + own) * 36 + past[0] * 6 + past[1]) * 64 + six) * 9 + rate, level == k))
        return out

    met: Counter = Counter()
    for trail, own in zip(decided, taught, strict=True):
        if own:
            met.update(asked(trail))
    joint = sorted({j for j, _ in met})
    model = lm.fit(np.array(joint, np.int64), np.array([float(met[j, False]) for j in joint]), np.array([float(met[j, True]) for j in joint]))
    logs = []
    for trail in decided:
        share, total, gradient = [1.0] * 4, 0.0, [0.0] * 4
        for k, (j, bit) in enumerate(asked(trail)):
            if k and k % lm.BLOCK == 0:
                share, gradient = [s + lm.RATE * g for s, g in zip(share, gradient, strict=True)], [0.0] * 4
            parts = [float(table[int(slot[0])]) for table, slot in zip(model.says, lm.contexts(np.array([j])), strict=True)]
            z = sum(s * p for s, p in zip(share, parts, strict=True))
            p = 1 / (1 + math.exp(-max(-14, min(14, z))))
            total += math.log2(p if bit else 1 - p)
            gradient = [g + x * (bit - p) for g, x in zip(gradient, parts, strict=True)]
        logs.append(total)
    return list(zip(symbols, logs, strict=True))


def some_rows() -> list[tuple]:
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["The", "été", "of"]
    rows = [(i, " ".join(rng.choices(words, range(len(words), 0, -1), k=rng.randint(0, 60)))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(8)]
    return rows + [(201, None), (202, ""), (203, " Été\x85 x"), (203, " Été\x85 x"), (None, "the the"), (204, "of the " * 400)]


@pytest.mark.parametrize("held", [1_000_000, 50])
def test_scores_equal_a_plain_model(spark, monkeypatch, held):
    monkeypatch.setattr(lm, "TOKENS_HELD", held)  # 50: a chunk a text or so
    rows = some_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    got = {}
    for r in lm.score_documents(docs.repartition(3)).collect():
        got.setdefault((r["doc_id"], r["n_tokens"]), r)
    counts = Counter(w for i, t in rows if not held_out(i) for w in tokens_of(t))
    n, v = sum(counts.values()), len(counts)
    for (i, t), (bits, log) in zip(rows, truth(rows), strict=True):
        tokens = tokens_of(t)
        r = got[i, len(tokens)]
        assert (r["held_out"], r["n_known"], r["train_tokens"]) == (held_out(i), sum(w in counts for w in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens))
        assert r["score"] == pytest.approx((log - bits) * math.log10(2), rel=1e-3, abs=1e-3)
        assert r["bits_per_byte"] == pytest.approx(-r["score"] * math.log2(10) / len(b" ".join(tokens)))


def test_partitions_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = ({r["doc_id"]: r["score"] for r in lm.score_documents(docs.repartition(n)).collect()} for n in (1, 5))
    assert a == pytest.approx(b, rel=1e-5)
    assert lm.score_documents(docs.limit(0)).count() == 0


def test_chunks_of_several_slices_hold_the_words_of_plain_splitting(monkeypatch):
    monkeypatch.setattr(lm, "SLICE_BYTES", 300)
    monkeypatch.setattr(lm, "TOKENS_HELD", 150)
    texts = [t for _, t in some_rows()] + [" \tA b\x0b\x1cC ", "\u2003x\u00a0Y É "]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts, "held_out": [False] * len(texts)})
    got = list(lm.chunks(iter([batch])))
    assert len(got) > 3 and [i for c in got for i in c.ids] == list(range(len(texts)))
    told = [[c.spells[p] for p in c.place[a:b]] for c in got for a, b in zip(c.starts[:-1], c.starts[1:], strict=True)]
    assert told == [tokens_of(t) for t in texts]
    assert all((np.diff(c.words) > 0).all() and c.words.tolist() == [1 if w == b"\n" else int(word_hashes([w])[0][0]) for w in c.spells] for c in got)


def test_numbers_are_packed_and_unpacked():
    rng = np.random.default_rng(3)
    for top in (1, 200, 1 << 20, 1 << 47):
        for size in (0, 1, 2, 900):
            x = rng.integers(0, top, size)
            keys = np.unique(rng.integers(0, top, size + 1).astype(np.uint64))
            assert (lm.unpacked(lm.packed(x)) == x).all() and len(lm.unpacked(lm.packed(x))) == size
            assert (lm.unpacked_keys(lm.packed_keys(keys)) == keys).all()


def test_texts_are_shuffled_once(spark):
    """Texts and n-grams leave their tasks in one shuffle, which both the counting and the join with the counts read; texts are in no other."""
    docs = lm.fold(spark.read.parquet(f"{SF}/documents.parquet"))
    made = lm.joined(lm.gathered(docs, lm.survey(docs)))
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1 and plan.count("- Exchange hashpartitioning(") == 2 and "places" not in plan.split("hashpartitioning(asked")[1].split("MapInArrow")[0]


def test_no_training_text(spark):
    only = [(i, "a b a") for i in range(40) if held_out(i)]
    got = lm.score_documents(spark.createDataFrame(only, "doc_id long, text string")).collect()
    assert len(got) == len(only) and all(r["n_known"] == r["train_tokens"] == 0 and r["score"] < 0 and r["base_score"] == pytest.approx(4 * math.log10(0.5 / 0.5)) for r in got)


def test_decisions_are_a_distribution():
    """Of all trails that differ in one decision only, the probabilities add up."""
    rng = np.random.default_rng(1)
    model = lm.Model([rng.normal(0, 1, m) for m in lm.SLOTS])
    met = sum(3 << s for s in (3, 6, 9, 12)) | 1 << 15
    start = np.array([0 | met, 4 | met, 2 | met], "<u2")
    whole = model.log2(start, np.array([0, 3]))[0]
    ends = [model.log2(np.append(start, np.uint16(k | met)).astype("<u2"), np.array([0, 4]))[0] for k in range(6)]
    assert sum(2.0 ** np.array(ends)) == pytest.approx(2.0**whole, rel=1e-3)


def test_held_out_texts_cost_less_than_by_the_base(spark):
    got = lm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").toPandas()
    assert got.score.sum() > 0.9 * got.base_score.sum()


def test_keys_are_ordered_with_their_places():
    """Keys that differ below the bits that are sorted with their places, and those of any width, come out as by stable sorting."""
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3000):
        narrow, wide = rng.integers(0, 50, n).astype(np.uint64), rng.integers(0, 1 << 64, n, np.uint64, endpoint=False)
        for keys in (narrow, wide, narrow << np.uint64(58) | rng.integers(0, 9, n).astype(np.uint64), np.full(n, (1 << 64) - 1, np.uint64)):
            order, got = lm.ordered(keys)
            assert (order == np.argsort(keys, kind="stable")).all() and (got == keys[order]).all()
            for a, b in zip(lm.placed(keys), np.unique(keys, return_index=True, return_inverse=True), strict=True):
                assert (a == b).all()


def test_a_class_stands_once_for_its_stretch():
    """N-gram keys are those of plain triples, pairs and classes; the class of tokens, which changes at CLASS_AT only, is no key of every token."""
    texts = [tokens_of(t) for _, t in some_rows()]
    words, place = np.unique(word_hashes([b" ".join(w for t in texts for w in t[:-1])])[0], return_inverse=True)
    words, at = np.insert(words, 0, lm.END), iter(place + 1)  # the end token's hash is the smallest
    place = np.array([0 if w == b"\n" else next(at) for t in texts for w in t])
    starts = np.cumsum([0, *map(len, texts)])
    tokens = lm.Tokens(words, place, starts)
    plain = [g for t in texts for g in grams(t)]
    n = len(plain)
    assert len(tokens.keys) == 3 * n + sum(sum(at < len(t) for at in (0, *lm.CLASS_AT)) for t in texts) < 3.5 * n
    of_class = np.repeat(tokens.keys[3 * n :], tokens.stretch)
    for keys, told in zip((*np.split(tokens.keys[: 3 * n], 3), of_class), ([(k, pair[1]) for k, pair, _ in plain], [pair for _, pair, _ in plain], [three for _, _, three in plain], [k for k, _, _ in plain]), strict=True):
        same: dict = {}
        assert [same.setdefault(t, k) for t, k in zip(told, keys.tolist(), strict=True)] == keys.tolist() and len(set(same.values())) == len(same)
