"""Quality rules: rule statistics of a text and an isolation forest over them.

``statistics`` computes per-document rule statistics in one pass over the text.
``fit`` grows an isolation forest on a bounded sample of labelled documents and
calibrates its cut on their labels; ``judge`` scores every document in the same
pass that computes its statistics, so no text is shuffled.

Defined results: a null text counts as empty; an empty text has zero words and
fails the base rule; repeated rows are judged alike; without usable labels the
forest rejects nothing and only the base rule decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHAR_START, SPACE, class_sums, slices_of, texts_of

#: Most labelled documents that the forest is fitted and calibrated on.
LABELLED_ROWS = 20_000
#: Bytes of text that are measured together; a longer text is measured alone.
SLICE_BYTES = 2_000_000
TREES, TREE_ROWS = 100, 256
#: Rows drawn evenly from the range of all labelled rows, for each good row that the trees may draw.
#: They make the trees split the empty space around the good rows, so that far rows have short paths.
BACKGROUND = 0.3
#: Most of the good labelled documents that the calibrated cut may reject.
GOOD_LOST = 0.002
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_SYMBOL = np.array([chr(b) in "#*$%&|<>" for b in range(256)], np.uint8)
_UPPER = np.array([0x41 <= b <= 0x5A for b in range(256)], np.uint8)
_PUNCTUATION = np.array([0x21 <= b <= 0x7E and not chr(b).isalnum() for b in range(256)], np.uint8)


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """How many words lie in a 3-word window that the text has twice or more.

    ``ids`` numbers the words of one text from 0 to ``distinct`` - 1.
    """
    n = len(ids)
    if n < 4:
        return 0
    pair = ids[:-1] * distinct + ids[1:]
    if distinct >= 2_000_000:  # a product of three would not fit in 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * distinct + ids[2:]
    in_order = np.sort(key)
    if not (in_order[1:] == in_order[:-1]).any():
        return 0
    order = np.argsort(key)
    sorted_key = key[order]
    same = sorted_key[1:] == sorted_key[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def batch_statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The rule statistics of each text, as int64 arrays."""
    chars, symbols, upper, punctuation = class_sums(texts, CHAR_START * (1 - SPACE), _SYMBOL, _UPPER, _PUNCTUATION)
    rows = []
    for text in texts:
        words = text.split()
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        rows.append((len(words), len(lines) - len(set(lines)), repeated_words(ids, len(number)), len(lines), len(number)))
    table = np.array(rows, np.int64).reshape(len(texts), 5)
    return {"n_words": table[:, 0], "word_chars": chars, "n_symbols": symbols, "n_dup_lines": table[:, 1], "n_repeat_words": table[:, 2], "n_lines": table[:, 3], "n_upper": upper, "n_punctuation": punctuation, "n_distinct": table[:, 4]}


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Size-free rates of the statistics, a column each."""
    words = np.maximum(s["n_words"], 1)
    chars = np.maximum(s["word_chars"], 1)
    return np.column_stack([
        s["word_chars"] / words,
        s["n_symbols"] / chars,
        s["n_dup_lines"] / np.maximum(s["n_lines"], 1),
        s["n_repeat_words"] / words,
        s["n_upper"] / chars,
        s["n_punctuation"] / chars,
        np.log1p(words) - np.log1p(s["n_distinct"]),
    ])


@dataclass
class Forest:
    """Trees as arrays [tree, node]; a leaf points to itself.  ``cut`` is the least mean path length kept."""

    feature: np.ndarray
    split: np.ndarray
    child: np.ndarray
    path: np.ndarray
    depth: int
    cut: float

    def path_lengths(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, split, child, path in zip(self.feature, self.split, self.child, self.path, strict=True):
            at = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                at = child[at, (x[rows, feature[at]] >= split[at]).astype(np.int8)]
            total += path[at]
        return total / max(len(self.feature), 1)


def unsuccessful(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary search tree of n nodes."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow(x: np.ndarray, trees: int, rows: int, seed: int) -> Forest:
    rng = np.random.default_rng(seed)
    depth = int(np.ceil(np.log2(max(rows, 2))))
    size = 2 ** (depth + 1)
    feature, split = np.zeros((trees, size), np.int16), np.zeros((trees, size))
    child, path = np.zeros((trees, size, 2), np.int32), np.zeros((trees, size))
    for t in range(trees):
        nodes = 0

        def build(part: np.ndarray, level: int, t: int = t) -> int:
            nonlocal nodes
            me, nodes = nodes, nodes + 1
            low, high = part.min(0), part.max(0)
            open_features = np.flatnonzero(high > low)
            if level == depth or len(part) < 2 or not len(open_features):
                child[t, me] = me
                path[t, me] = level + unsuccessful(len(part))
                return me
            f = rng.choice(open_features)
            at = rng.uniform(low[f], high[f])
            feature[t, me], split[t, me] = f, at
            right = part[:, f] >= at
            child[t, me] = build(part[~right], level + 1), build(part[right], level + 1)
            return me

        build(x[rng.choice(len(x), min(rows, len(x)), replace=False)], 0)
    return Forest(feature, split, child, path, depth, -np.inf)


def calibrated_cut(paths: np.ndarray, good: np.ndarray, lost: float) -> float:
    """The cut with the best balanced accuracy among those that reject at most a share ``lost`` of the good rows."""
    if good.all() or not good.any():
        return -np.inf
    order = np.argsort(paths, kind="stable")
    p, g = paths[order], good[order]
    lost_share = np.concatenate([[0], np.cumsum(g)]) / g.sum()
    caught = np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
    cuts = np.concatenate([[-np.inf], (p[1:] + p[:-1]) / 2, [np.inf]])
    allowed = (lost_share <= lost) & np.concatenate([[True], p[1:] > p[:-1], [True]])
    return float(cuts[np.argmax(np.where(allowed, caught - lost_share, -1))])


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = LABELLED_ROWS, seed: int = 7) -> Forest | None:
    """The forest for ``docs`` (doc_id, text) from ``labels`` (doc_id, quality); None without usable labels.

    The sample is the ``rows`` labelled ids of smallest hash; only their texts are read into rule statistics.  Of several
    texts with one id the one of least statistics counts.
    """
    sample = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(rows)
    )
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch_statistics(texts_of(batch["text"]))
            columns = [batch["doc_id"], batch["quality"].cast(pa.int64()), pa.array(s["n_words"]), pa.array(list(features(s)), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "quality", "n_words", "x"])

    got = known.mapInArrow(measure, "doc_id long, quality long, n_words long, x array<double>")
    got = got.groupBy("doc_id", "quality").agg(F.min(F.struct("n_words", "x")).alias("s")).select("doc_id", "quality", "s.n_words", "s.x").toPandas().sort_values("doc_id")
    got = got[got.n_words >= MIN_WORDS]
    good = got.quality.to_numpy() > 0
    if not len(got) or not good.any():
        return None
    x = np.vstack(got.x)
    rng = np.random.default_rng(seed)
    low, high = x.min(0), x.max(0)
    background = low + (high - low) * rng.random((max(1, int(BACKGROUND * good.sum())), x.shape[1]))
    forest = grow(np.vstack([x[good], background]), TREES, TREE_ROWS, seed)
    forest.cut = calibrated_cut(forest.path_lengths(x), good, GOOD_LOST)
    return forest


def judge(docs: DataFrame, forest: Forest | None, keep: list[str], *, text: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` with the statistics of ``text``, ``anomaly`` (mean path length), ``base_failed`` and ``kept``."""
    added = T.StructType([T.StructField(c, T.LongType()) for c in STATS] + [T.StructField("anomaly", T.DoubleType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])
    names = {f.name for f in added}
    schema = T.StructType([docs.schema[c] for c in keep if c not in names] + list(added))
    kept_columns = [c for c in keep if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches, SLICE_BYTES, text):
            s = batch_statistics(texts_of(batch[text]))
            paths = forest.path_lengths(features(s)) if forest else np.full(batch.num_rows, np.inf)
            failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEATED_PERCENT * s["n_words"])
            kept = ~failed & (paths >= forest.cut if forest else True)
            out = [batch[c] for c in kept_columns] + [pa.array(s[c], pa.int64()) for c in STATS]
            out += [pa.array(paths, pa.float64(), mask=~np.isfinite(paths)), pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(out, [f.name for f in schema])

    return docs.select(*dict.fromkeys([*kept_columns, text])).mapInArrow(run, schema)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, fit(docs, labels), ["doc_id"])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}  # other columns may have any name
    inner = docs.select(*[F.col(c).alias(n) for c, n in names.items()])
    kept = judge(inner, fit(docs, labels), list(names.values()), text=names["text"]).where("kept")
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
