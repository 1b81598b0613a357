"""Operators on single texts: quality rules, license scan, byte-pair encoding, WARC."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import time

import numpy as np
import pytest

from blobweave.llm import bpe, licenses, quality, warc

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t ", "x", "a b c " * 300, "éä漢 😀\x85\xa0 ", "word " * 20_000]


def brute_statistics(text: str | None) -> tuple:
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_rule_statistics():
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(["a ", "b ", "a\n", "#é ", "\n", "dd\t"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    got = quality.batch_statistics([(t or "").encode() for t in texts])
    for i, t in enumerate(texts):
        assert tuple(int(got[c][i]) for c in quality.STATS) == brute_statistics(t), t


def test_repeats_with_a_large_vocabulary():
    ids = np.array([7, 2_000_001, 5, 9, 7, 2_000_001, 5])
    assert quality.repeated_words(ids, 2_000_002) == 6 == quality.repeated_words(np.array([0, 1, 2, 3, 0, 1, 2]), 4)


def test_quality_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = quality.op10_quality_rules(spark, SF).toPandas().set_index("doc_id")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == len(texts)
    for i, r in got.iterrows():
        assert tuple(r[c] for c in quality.STATS) == brute_statistics(texts[i])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    judged = labels[labels.doc_id.map(lambda i: not got.base_failed[i])]
    kept = got.kept[judged.doc_id].to_numpy()
    assert kept[judged.quality == 1].mean() > 0.97


def test_held_out_junk_is_caught(spark):
    """Trained on even ids, the forest tells junk from clean documents among odd ones."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    forest = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    got = quality.judge(docs, forest, ["doc_id"]).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed").toPandas()
    assert got.kept[got.quality == 1].mean() >= 0.97
    assert len(got[got.quality == 0]) == 0 or (~got.kept[got.quality == 0]).mean() >= 0.6


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in enumerate(ODD)] + [(None, "x", "b", 2), (3, "x", "b", 2)], "doc_id long, text string, kept string, n_words int")
    labels = spark.createDataFrame([(3, 0, None), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 0
    long = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(80)), "a", 5)] * 2, docs.schema)
    assert quality.keep_good(docs.union(long), labels).collect() == long.collect()
    assert quality.keep_good(docs.limit(0), labels.limit(0)).count() == 0


def brute_places(text: str | None) -> tuple[int, list[int], list[str]]:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(i for i, _ in hits), sorted({label for _, label in hits})


def test_license_scan():
    rng = random.Random(1)
    parts = ["cc", "BY", "by.", "all", "rights", "Reserved", "general", "public", "license,", "é", "\n", "4.0", "nc", "GNU", "v2"]
    texts = ODD + ["CC-BY-SA 4.0, all rights reserved. All Rights Reserved"] + [" ".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(500)]
    for t in texts:
        got = licenses.scan((t or "").encode())
        assert (got.n_words, sorted(got.places), got.base_labels) == brute_places(t)
        assert set(got.base_labels) <= set(got.labels) and 0 <= got.score <= 1 and bool(got.labels) == (got.score > 0)
        spans = [d[:2] for d in got.detections]
        assert not any(a != b and a[0] <= b[0] and b[1] <= a[1] for a in spans for b in spans)


def test_suppression_and_priority():
    def labels(text):
        return licenses.scan(text.encode()).labels

    assert len(licenses.RULES) > 300
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache", "apache-2.0"]
    assert sum(len(f[3]) for f in licenses.FAMILIES) > 250  # written by hand
    assert labels("CC BY-NC 4.0") == ["cc-by", "cc-by-nc-4.0"]
    assert labels("GNU Lesser General Public License version 3") == ["gpl", "lgpl", "lgpl-3"]
    assert licenses.suppress([(1, 0, 9, 0, "low"), (5, 0, 9, 1, "high"), (9, 2, 4, 2, "inner"), (1, 8, 12, 3, "next")]) == [(0, 9, "high", 5), (2, 4, "inner", 9), (8, 12, "next", 1)]


def test_suppression_equals_all_pairs():
    rng = random.Random(7)
    for _ in range(500):
        found = [(rng.randint(1, 5), a, a + rng.randint(1, 10), k, f"x{k}") for k, a in enumerate(rng.choices(range(20), k=rng.randint(0, 25)))]
        kept: list[tuple] = []
        for p, a, b, _, label in sorted(found, key=lambda d: (-d[0], d[1] - d[2], d[1], d[3])):
            if not any(x <= a and b <= y for x, y, _, _ in kept):
                kept.append((a, b, label, p))
        assert licenses.suppress(found) == sorted(kept)


def test_long_license_text():
    began = time.monotonic()
    got = licenses.scan(b"cc by 1 all rights reserved " * 40_000)
    assert len(got.places) == 80_000 and len(got.detections) >= 40_000 and time.monotonic() - began < 30


def test_license_query(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*ODD, "all rights reserved"] * 2)] + [(None, None, "y")], "doc_id long, text string, labels string")
    got = licenses.scan_documents(docs).toPandas()
    assert len(got) == docs.count() and (got.n_base > 0).sum() == 2
    assert got[got.n_base == 0].first_word.isna().all()
    assert licenses.scan_documents(docs.limit(0)).count() == 0
    out = licenses.op2_license_scan(spark, SF)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in out.collect():
        n, places, base = brute_places(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, len(places), min(places, default=None), max(places, default=None), ",".join(base))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def coder():
    return bpe.Encoder(bpe.load())


def test_encoding_equals_the_library(tokenizer, coder, monkeypatch):
    rng = random.Random(0)
    parts = ["a", "aa", "A", "  ", "\n", "\x1c", "\x85", "　", "é", "漢", "😀", "1", "²", "!", "...", "'s", "'ll", "<|endoftext|>", "<|endo", "the", " the", "ing", "\t", "\r\n", "​", "=", "--", "zz", "0", "00", " a"]
    texts = [t or "" for t in ODD] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 300), rng.randint(0, 0xD7FF), rng.randint(97, 122)])) for _ in range(10)) for _ in range(3000)] + ["a" * 3000 + "ab" * 999, "zq" * 70_000]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for step in (bpe.STEP_BYTES, 3):  # 3: most words are walked alone
        monkeypatch.setattr(bpe, "STEP_BYTES", step)
        for t, got, ids in zip(texts, coder.encode(texts), want, strict=True):
            assert np.frombuffer(got, "<u4").tolist() == ids, repr(t)
            assert coder.decode(got) == tokenizer.decode(ids, skip_special_tokens=False) == t


def test_automaton_accepts_what_the_merges_produce(tokenizer, coder):
    """There is an arc from the state after one token to another exactly if the two come from their joined labels."""
    rng = random.Random(5)
    plain = [i for i in range(256, 40_000) if coder.automaton.label[i].isalpha()]
    pairs = [(rng.choice(plain), rng.choice(plain)) for _ in range(3000)]
    arcs = coder.automaton.has_arc(*np.array(pairs, np.int64).T)
    for (a, b), arc in zip(pairs, arcs, strict=True):
        text = (coder.automaton.label[a] + coder.automaton.label[b]).decode()
        assert arc == (tokenizer.encode(text, add_special_tokens=False).ids == [a, b]), text
    assert 0 < arcs.sum() < len(arcs)


def test_encoding_query(spark, tokenizer):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(None, "x", 2), (1, "x", 3), (1, "x", 3)], "doc_id long, text string, n_tokens int")
    got = bpe.encode_documents(docs, decoded=True).collect()
    for r, d in zip(got, docs.collect(), strict=True):
        ids = tokenizer.encode(d["text"] or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"], bytes(r["ids"]), r["decoded"]) == (len(ids), hashlib.sha256(raw).hexdigest(), raw, d["text"] or "")
    assert bpe.encode_documents(docs.limit(0)).count() == 0


def warc_truth(rows: list[tuple]) -> list[tuple]:
    first: dict[str, object] = {}
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(html or "", i)
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        own = first[html or ""] == i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if own else "revisit", None if own else first[html or ""]))
    return sorted(out, key=repr)


def test_warc(spark, tmp_path):
    tricky = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
    rows = [(5, "http://a b/\r\nX: y", "same"), (3, None, "same"), (9, "u", "same"), (1, "u", None), (2, "u", ""), (4, "u", tricky), (6, "u", tricky), (7, "é", "é" * 100_000), (None, "u", "same"), (3, None, "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("x", "x")
    warc.write_warc(pages, str(tmp_path / "w"), file_bytes=1500)
    records = warc.read_warc(spark, str(tmp_path / "w")).persist()
    got = sorted((tuple(r) for r in warc.resolve_revisits(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)
    assert got == warc_truth(rows)
    kept = {r["page_id"]: r["payload"] for r in records.collect() if r["record_type"] == "response"}
    assert kept == {3: "same", 1: "", 4: tricky, 7: "é" * 100_000}
    warc.write_warc(pages, str(tmp_path / "v"), least_bytes=10**7, compression="none")
    assert warc.read_warc(spark, str(tmp_path / "v")).where("record_type = 'revisit'").count() == 0
    warc.write_warc(pages.limit(0), str(tmp_path / "e"))
    assert warc.resolve_revisits(warc.read_warc(spark, str(tmp_path / "e"))).count() == 0


def test_warc_with_a_popular_payload(spark, tmp_path):
    rows = [(i, "u", "popular" if i % 2 else f"p{i}") for i in range(600)]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = warc.resolve_revisits(warc.read_warc(spark, str(tmp_path / "w")))
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == warc_truth(rows)


def strings_of(pattern: str) -> list[str]:
    """A short and a long text that a rule's pattern matches: the first choices without what is optional, the last ones with it."""
    out = []
    for least in (True, False):
        text = pattern.replace("\\w+", "word").replace("\\d", "9").replace("[cs]", "c" if least else "s").replace("[123]?", "" if least else "3")
        while "(?:" in text:
            text = re.sub(r"\(\?:([^()]*)\)(\??)", lambda m: "" if m[2] and least else m[1].split("|")[0 if least else -1], text, count=1)
        text = re.sub(r"(.)\?", lambda m: "" if least else m[1], text)
        out.append(" ".join(text.split()))
    return out


@pytest.mark.parametrize("number", range(len(licenses.RULES)))
def test_every_license_rule_can_fire(number):
    rule = licenses.RULES[number]
    pattern = rule.pattern.pattern.decode().removeprefix("(?<= )").removesuffix("(?= )")
    for text in strings_of(pattern):
        joined = f" {text} ".encode()
        spans = [m.span() for m in rule.pattern.finditer(joined)]
        assert spans and rule.keyword in joined, (pattern, text, rule.keyword)
        # found, or suppressed by one of at least its priority that contains it
        got = licenses.scan(text.encode()).detections
        assert any(a <= spans[0][0] and b >= spans[0][1] and p >= rule.priority for a, b, _, p in got), (text, got)


def test_gate_changes_nothing(monkeypatch):
    rng = random.Random(5)
    made = [t for r in licenses.RULES for t in strings_of(r.pattern.pattern.decode().removeprefix("(?<= )").removesuffix("(?= )"))]
    texts = [" ".join(x for _ in range(12) for x in (rng.choice(made), rng.choice(["and", "the", "license", "2 0", ""]))).encode() for _ in range(150)]
    gated = [licenses.scan(t).detections for t in texts]
    monkeypatch.setattr(licenses, "RULES", [licenses.Rule(r.label, b"", r.priority, r.pattern) for r in licenses.RULES])
    monkeypatch.setattr(licenses, "KEYWORDS", [b""])
    assert [licenses.scan(t).detections for t in texts] == gated


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Gemma Community License Agreement", "community-license"), ("Llama 3 Community License Agreement", "llama"), ("Unicode terms of use", "unicode"), ("the ICU License", "icu"), ("an open data license", "open-data"),
        ("CeCILL-C version 1", "cecill-c-1"), ("CeCILL-B 1.0", "cecill-b-1.0"), ("CeCILL v2.1", "cecill-2.1"), ("LaTeX Project Public License", "lppl"), ("GUST Font License", "gust"), ("open content licence", "open-content"),
        ("SSPL v1", "sspl"), ("BUSL-1.1", "busl"), ("ASL 2.0", "apache"), ("Etalab 2.0", "etalab"), ("Licence Art Libre", "fal"), ("may not be reproduced", "no-copying"), ("for educational purposes only", "academic"),
        ("the eclipse of the moon, an apache helicopter, a mozilla browser, unicode text and creative commoners under a patent roof", ""),
    ],
)
def test_license_labels(text, labels):
    assert ",".join(licenses.scan(text.encode()).labels) == labels
