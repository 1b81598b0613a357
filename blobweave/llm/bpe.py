"""Byte-pair encoding and decoding by a deterministic automaton over tokens.

``Automaton`` is compiled from the merge list by one merge gadget after another.
It starts as a single state in which every byte may follow every byte.  The
gadget of merge number m, (a, b) -> ab,

* gives each state that has an ``a`` arc an arc ``ab`` to a new state, which copies
  the arcs that the state after ``b`` has now;
* takes the ``b`` arc from the state after ``a``, as a ``b`` after an ``a`` would
  have been merged.  All arcs that later merges derive from ``b`` go with it.

So there is a state after each token and one to start in, and an arc leads to the
state of its token.  A state's row of the transition table is kept as runs of
missing arcs: tokens stand in an order in which what one gadget takes is one run.
The automaton accepts a sequence of tokens exactly if the merges produce it, and
for each word one accepted sequence spells it.

Encoding.  Texts are split into words; the distinct words of a slice of texts are
encoded together, byte by byte.  A second table (the goto table of a trie of all
tokens) tells which tokens end at a byte, the longest first; the one that has an
arc from the state before it is the last token of that prefix, and there is exactly
one.  Read backwards from a word's end, these tokens are its encoding.  Decoding
emits the labels of the arcs.  Work grows with the bytes of distinct words, and
memory is bounded by the slice.

Defined results: a null text counts as empty and has no tokens; the text of an
added token is that token, as the tokenizers library has it; repeated rows are
encoded alike; texts are taken whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices_of

#: Fixed values of byte-level BPE files: the pattern that splits a text into words (white space as in Unicode's property).
_S = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"



def _latin(kind: str) -> str:
    return "".join(re.escape(chr(i)) for i in range(256) if unicodedata.category(chr(i))[0] == kind)


#: The same for texts without letters beyond U+00FF, which ``re`` splits faster.
LATIN_WORDS = rf" ?[{_latin('L')}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_latin('N')}]+| ?[^\t-\r \x85\xA0{_latin('L')}{_latin('N')}]+|[\t-\r \x85\xA0]+(?![^\t-\r \x85\xA0])|[\t-\r \x85\xA0]+"

#: Bytes of text whose words are encoded together; a longer text is a slice of its own.
SLICE_BYTES = 1_000_000
#: Words of more bytes are encoded one at a time.
STEP_BYTES = 64


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level BPE files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """States are numbered by the token before them; the last is the one to start in."""

    def __init__(self, description: str):
        """``description``: the text of a tokenizer file in JSON."""
        told = json.loads(description)
        letters = byte_letters()
        vocabulary = told["model"]["vocab"]
        label = {i: bytes(letters[c] for c in token) for token, i in vocabulary.items()}
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        merges = []
        for pair in told["model"]["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            merges.append((vocabulary[left], vocabulary[right], vocabulary[left + right]))
        self.start = max([*label, *self.added.values()]) + 1
        self.label = [label.get(i, b"") for i in range(self.start)]
        for content, i in self.added.items():
            self.label[i] = content.encode()
        self._compile(merges)
        self._index(label)

    def _compile(self, merges: list[tuple[int, int, int]]) -> None:
        """``column`` of each token, and the runs of missing arcs (``lost_from`` to ``lost_to``) as state * width + column."""
        width = self.width = self.start + 1
        derived: list[list[tuple[int, int]]] = [[] for _ in range(width)]  # (merge, token) that begin with a token
        whole = set(range(self.start))
        for m, (a, _, ab) in enumerate(merges):
            derived[a].append((m, ab))
            whole.discard(ab)
        # a token stands behind all that derive from it, those derived last nearest to it
        column, begin, taken = [0] * width, [0] * width, 0
        stack = [(t, 0) for t in sorted(whole, reverse=True)]
        while stack:
            token, done = stack.pop()
            if not done:
                begin[token] = taken
            if done < len(derived[token]):
                stack += [(token, done + 1), (derived[token][done][1], 0)]
            else:
                column[token], taken = taken, taken + 1
        # gadgets: a state's row is what it copied and the runs it lost since
        rows: list[list[int]] = [[] for _ in range(width)]
        runs, seen = [], [0] * width
        for m, (a, b, ab) in enumerate(merges):
            rows[ab] = [*rows[b], *rows[ab]]
            while seen[b] < len(derived[b]) and derived[b][seen[b]][0] < m:
                seen[b] += 1
            runs.append((begin[derived[b][seen[b]][1]] if seen[b] < len(derived[b]) else column[b], column[b] + 1))
            rows[a].append(m)
        owner = np.repeat(np.arange(width), [len(r) for r in rows])
        run = np.array(runs, np.int64).reshape(-1, 2)[np.array([m for r in rows for m in r], np.int64)] + (owner * width)[:, None]
        run = run[np.argsort(run[:, 0], kind="stable")]
        reach = np.maximum.accumulate(run[:, 1])
        new = np.ones(len(run), bool)
        new[1:] = run[1:, 0] > reach[:-1]
        first = np.flatnonzero(new)
        self.lost_from, self.lost_to = run[first, 0], reach[np.append(first[1:], len(run)) - 1] if len(run) else reach
        self.column = np.array(column, np.int64)

    def _index(self, label: dict[int, bytes]) -> None:
        """A trie of the labels, level by level, and which token is the longest that ends at each node."""
        child: dict[int, int] = {}
        end = {}
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        level: list[list[tuple[int, int, int]]] = []
        for token, text in label.items():
            node = 0
            for depth, byte in enumerate(text):
                key = node << 8 | byte
                if key not in child:
                    child[key] = len(child) + 1
                    if depth == len(level):
                        level.append([])
                    level[depth].append((node, byte, child[key]))
                node = child[key]
            end[node] = token
        self.levels = [tuple(np.array(x).T) for x in level]
        self.own = np.full(len(child) + 1, -1, np.int32)
        self.own[list(end)] = list(end.values())

    @cached_property
    def goto(self) -> np.ndarray:
        """Next node by ``row`` of a node and byte; and with it ``longest`` (by node) and ``shorter`` (by token)."""
        inner = np.zeros(len(self.own), bool)
        for node, _, _ in self.levels:
            inner[node] = True
        # a leaf goes where the longest suffix of its label goes
        self.row = (np.cumsum(inner) - 1).astype(np.int32)
        goto = np.zeros((int(inner.sum()), 256), np.int32)
        fail = np.zeros(len(self.own), np.int32)
        self.longest = self.own.copy()
        self.shorter = np.full(self.start, -1, np.int32)
        for depth, (node, byte, child) in enumerate(self.levels):
            if depth:
                fail[child] = goto[self.row[fail[node]], byte]
            goto[self.row[node], byte] = child
            ends = self.own[child] >= 0
            self.shorter[self.own[child[ends]]] = self.longest[fail[child[ends]]]
            self.longest[child[~ends]] = self.longest[fail[child[~ends]]]
            deep, leaf = child[inner[child]], child[~inner[child]]
            self.row[leaf] = self.row[fail[leaf]]
            goto[self.row[deep]] = goto[self.row[fail[deep]]]
        return goto

    @cached_property
    def size(self) -> np.ndarray:
        return np.array([len(x) for x in self.label], np.int64)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("goto", "row", "longest", "shorter", "size")}

    def has_arc(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        key = state * self.width + self.column[token]
        run = np.searchsorted(self.lost_from, key, "right") - 1
        return (run < 0) | (key >= self.lost_to[run])

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words in a row, and how many each word has."""
        goto, sizes = self.goto, self.size
        length = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(length) - length
        # last[base + i]: the token before byte i of a word
        base = begin + np.arange(len(words))
        last = np.full(len(data) + len(words), self.start, np.int64)
        for k in np.flatnonzero(length > STEP_BYTES).tolist():
            last[base[k] + 1 : base[k] + length[k] + 1] = self._walk(words[k])
        order = np.argsort(-length, kind="stable")
        order = order[length[order] <= STEP_BYTES]
        own, from_, to = length[order], begin[order], base[order]
        node = np.zeros(len(order), np.int64)
        for i in range(int(own[0]) if len(own) else 0):
            open_ = int(np.searchsorted(-own, -i))  # those longer than i
            node = goto[self.row[node[:open_]], data[from_[:open_] + i]].astype(np.int64)
            token, at = self.longest[node].astype(np.int64), to[:open_] + i + 1
            while len(at):
                if token.min() < 0:
                    raise ValueError("the vocabulary lacks a byte of the word")
                fits = self.has_arc(last[at - sizes[token]], token)
                last[at[fits]] = token[fits]
                at, token = at[~fits], self.shorter[token[~fits]].astype(np.int64)
        # read backwards from the ends
        at, alive, steps = base + length, np.flatnonzero(length), []
        count = np.zeros(len(words), np.int64)
        while len(alive):
            token = last[at[alive]]
            steps.append((alive, token))
            count[alive] += 1
            at[alive] -= sizes[token]
            alive = alive[at[alive] > base[alive]]
        out = np.zeros(count.sum(), np.uint32)
        end = np.cumsum(count)
        for k, (who, token) in enumerate(steps):
            out[end[who] - 1 - k] = token
        return out, count

    def _walk(self, word: bytes) -> list[int]:
        """The last token of each prefix of one long word."""
        node, found, known = 0, [], {}
        for i, byte in enumerate(word):
            node = int(self.goto[self.row[node], byte])
            token = int(self.longest[node])
            while True:
                if token < 0:
                    raise ValueError("the vocabulary lacks a byte of the word")
                before = i - len(self.label[token])
                key = (found[before] if before >= 0 else self.start, token)
                if key not in known:
                    known[key] = bool(self.has_arc(*(np.array([x]) for x in key))[0])
                if known[key]:
                    break
                token = int(self.shorter[token])
            found.append(token)
        return found


class Encoder:
    """Encodes texts to token ids as little-endian unsigned 32-bit integers, and decodes them."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        added = sorted(automaton.added, key=len, reverse=True)
        self.any, self.latin = regex.compile(WORDS).findall, re.compile(LATIN_WORDS).findall
        self.cut = regex.compile("|".join(map(regex.escape, added))) if added else None

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any(text)
        return self.latin(text)

    def words(self, text: str, found: list[str], marks: list[tuple[int, int]]) -> None:
        """Adds the words of ``text`` to ``found``, an empty one for an added token; ``marks``: where, and which token."""
        start = 0
        if self.cut and self.cut.search(text):
            for m in self.cut.finditer(text):
                found += self.split(text[start : m.start()])
                marks.append((len(found), self.automaton.added[m[0]]))
                found.append("")
                start = m.end()
        found += self.split(text[start:])

    def encode(self, texts: list[str]) -> list[bytes]:
        words: list[str] = []
        marks: list[tuple[int, int]] = []
        ends = [0]
        for text in texts:
            self.words(text, words, marks)
            ends.append(len(words))
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        place = coded.indices.to_numpy()
        ids, count = self.automaton.encode_words([w.encode() for w in coded.dictionary.to_pylist()])
        each, first = count[place], (np.cumsum(count) - count)[place]
        where, added = np.array(marks, np.int64).reshape(-1, 2).T
        each[where], first[where] = 1, len(ids) + np.arange(len(where))
        total = np.concatenate([[0], np.cumsum(each)])
        flat = np.append(ids, added)[np.repeat(first - total[:-1], each) + np.arange(total[-1])].astype("<u4")
        cuts = total[ends]
        return [flat[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.automaton.label.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load(vocabulary: str | None = None) -> Automaton:
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        return Automaton(f.read())


def encode_documents(docs: DataFrame, vocabulary: str | None = None, *, keep: tuple[str, ...] = ("doc_id",), ids: bool = True, decoded: bool = False) -> DataFrame:
    """``keep`` columns with n_tokens, ids_sha256 and decoded_sha256; ``ids`` and ``decoded`` add those themselves.

    ``vocabulary`` is the path of a tokenizer file on the driver, which compiles it and
    broadcasts the automaton (its size is the vocabulary's).  Columns that ``keep``
    names come first, under their names; other columns of ``docs`` are not read.
    """
    told = docs.sparkSession.sparkContext.broadcast(load(vocabulary))
    fields = [docs.schema[c] for c in keep]
    fields += [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField("ids", T.BinaryType())] * ids + [T.StructField("decoded", T.StringType())] * decoded
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(told.value)
        for batch in slices_of(batches, SLICE_BYTES):
            got = e.encode([t or "" for t in batch["text"].to_pylist()])
            back = [e.decode(x) for x in got]
            out = [batch[c] for c in keep] + [pa.array([len(x) // 4 for x in got], pa.int64())]
            out += [pa.array([hashlib.sha256(x).hexdigest() for x in got], pa.string()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string())]
            out += [pa.array(got, pa.binary())] * ids + [pa.array(back, pa.string())] * decoded
            yield pa.RecordBatch.from_arrays(out, schema.names)

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), ids=False)
