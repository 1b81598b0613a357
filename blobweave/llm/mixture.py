"""Language-model scoring by online logistic context mixing.

A text is its lower-cased words and an end token.  Each token is coded by binary
decisions and a symbol.  The decisions go down a ladder: may the two tokens before
it (level 0), the one before it (1), the text so far (2), the text's class (3) or
the whole training corpus (4) tell the token?  A context tells a token if it has been
followed by it and gives it at least the probability that class or corpus do.  The
first level that tells it says yes and codes it by its share of what followed there;
a token that none tells is spelled by bytes, each given the two before.

Each decision is a bit that PREDICTORS hashed contexts predict: the level and how often
its context was met; the levels that told the last two tokens; which of the last six
the two before them told; and how often those did lately.  Their stretched predictions
are added with weights gated by level and by how often a predictor's slot was seen.
Within a text each predictor's share is refined online, by the gradient of every
BLOCK bits, so each bit is predicted from earlier ones only.  The score is the log10
probability of the whole text, and with it come its bits per byte.

The class of a text so far is the most frequent token among its first 8, 32, 128 or
512 (none before that): languages and kinds of text differ in that.

What is learnt: counts of tokens, pairs, triples and class members over all training
texts, as hashed n-grams that texts meet by shuffle; slots grow with the input (an
n-gram's hash has the bits of the corpus size and HASH_SPARE more, so that an n-gram
that was never met gets another's count in a few of a million lookups at any size).  A chunk of a task
sends each of its distinct n-grams once, packed by slice of the hash range, and gets
the counts back.  Its texts, as places in its distinct tokens, are dealt out by the same shuffle, which
is read twice: for the counts, and for the texts that these are joined to.  A training text is scored as if it were held out: its own counts
are taken off, those of its copies stay.  The predictors' slots (at most JOINT joint
contexts at any size) and the weights are fitted to the decisions of all training texts.

Defined results: a null text is empty and has the end token only; a null doc_id
hashes as the empty text; repeated rows count each and score alike; with no training
text all counts are 0 and every token is spelled.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _MIX, partitions, slices_of, staged, texts_of

FOLDS, HELD_OUT = 5, 1
#: Stand for the hashes of the end token, of what precedes a text, and of any token.
END, START, ANY = np.uint64(1), np.uint64(2), np.uint64(3)
PAIR, TRIPLE, CLASS = np.uint64(11), np.uint64(12), np.uint64(13)
#: Bits of an n-gram's hash beyond those of the number of training tokens.
HASH_SPARE = 20
SLICE_BYTES, TRAIL_BYTES, TOKENS_HELD = 4_000_000, 2_000_000, 1_000_000
#: Numbers that are mixed at a time, to stay in the cache.
MIXED_AT_ONCE = 1 << 14
#: Positions from which the class is the most frequent of that many first tokens.
CLASS_AT = (8, 32, 128, 512)
LEVELS, SPELLED = 5, 5
#: How often a pair of bytes counts as met beforehand, as what follows the second alone.
SPELL_PRIOR = 4.0
#: Parts of a bit that the cost of spelling is rounded to.
SPELL_SCALE = 256
BUCKETS, LAST_TWO, LAST_SIX, RATES = 8, 36, 64, 9
JOINT = LEVELS * BUCKETS * LAST_TWO * LAST_SIX * RATES
RATE_TOKENS = 32
PREDICTORS, CONFIDENCES, TOP = 4, 8, 9.0
BLOCK, RATE = 16, 0.02


def mix(x: np.ndarray) -> np.ndarray:
    """``common.mixed`` in place."""
    for at in range(0, len(x), MIXED_AT_ONCE):
        v = x[at : at + MIXED_AT_ONCE]
        v += _MIX[2]
        v ^= v >> np.uint64(30)
        v *= _MIX[0]
        v ^= v >> np.uint64(27)
        v *= _MIX[1]
        v ^= v >> np.uint64(31)
    return x


def ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of unsigned ``keys``, and the keys in it: plain sorting, many times as fast as that of indices, of their upper bits with their places below."""
    n = len(keys)
    low = np.uint64(max(n - 1, 0).bit_length())
    least = keys.min(initial=np.iinfo(np.uint64).max)
    spare = max(int(keys.max(initial=0) - least).bit_length() + int(low) - 64, 0) if n else 0
    both = keys - least
    both >>= np.uint64(spare)
    both <<= low
    both |= np.arange(n, dtype=np.uint64)
    both.sort()
    both &= np.uint64((1 << int(low)) - 1)
    order = both.view(np.int64)
    out = keys[order]
    if spare and len(bad := np.flatnonzero(out[1:] < out[:-1])):  # equal in the upper bits only
        upper = out - least >> np.uint64(spare)
        mine = np.flatnonzero(np.isin(upper, upper[bad]))
        again = np.argsort(out[mine], kind="stable")
        order[mine], out[mine] = order[mine][again], out[mine][again]
    return order, out


def placed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct ``keys``, the first place of each, and for each key its place in them."""
    order, keys = ordered(keys)
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    place = np.empty(len(keys), np.int64)
    rank = np.cumsum(new)
    rank -= 1
    place[order] = rank
    return keys[new], order[new], place


def packed(x: np.ndarray, most: int = 8) -> bytes:
    """Unsigned numbers as their byte planes, of which the ``most`` upper ones are compressed and the others, too even for that, left as they are."""
    wide = x.astype("<u8", copy=False)
    width = max(1, (int(wide.max(initial=0)).bit_length() + 7) // 8)
    planes = wide.view(np.uint8).reshape(-1, 8)[:, :width].T if width > 1 else wide.astype(np.uint8)[None]
    even = max(width - most, 0)
    made = zlib.compressobj(1, zlib.DEFLATED, zlib.MAX_WBITS, zlib.DEF_MEM_LEVEL, zlib.Z_RLE)  # planes hold runs at most; longer matches are dear to look for
    return bytes([width]) + made.compress(planes[even:].tobytes()) + made.flush() + planes[:even].tobytes()


def unpacked(data: bytes, most: int = 8) -> np.ndarray:
    width, made = data[0], zlib.decompressobj()
    even = max(width - most, 0)
    upper = np.frombuffer(made.decompress(memoryview(data)[1:]), np.uint8).reshape(width - even, -1)
    if width == 1:
        return upper[0].astype(np.int64)
    out = np.zeros((upper.shape[1], 8), np.uint8)
    out[:, even:width] = upper.T
    out[:, :even] = np.frombuffer(made.unused_data, np.uint8).reshape(even, upper.shape[1]).T
    return out.view("<u8").ravel().astype(np.int64)


def fold(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``held_out``."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select("doc_id", "text", (F.pmod(crc, F.lit(FOLDS)) == HELD_OUT).alias("held_out"))


def spelled(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of all texts in a row (words lower-cased and closed by a space, texts by a line feed) itself and the two before it
    in its word, 0 where there is none; and the first place of each token."""
    return codes_of(b"".join(b" ".join([*t.lower().split(), b"\n"]) for t in texts))


def codes_of(closed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``spelled`` of texts whose words are ``closed`` already."""
    data = np.frombuffer(closed, np.uint8)
    # a line feed can only be a text's end, and spaces only close words
    first = np.concatenate([[True], (data[:-1] == 0x20) | (data[:-1] == 0x0A)]) if len(data) else np.zeros(0, bool)
    one, two = np.zeros(len(data), np.int32), np.zeros(len(data), np.int32)
    one[1:] = np.where(first[1:], 0, data[:-1])
    two[1:] = np.where(first[1:], 0, one[:-1])
    return two << 16 | one << 8 | data, np.flatnonzero(first)


@dataclass
class Corpus:
    """What is known of the training texts before n-grams are counted: how often each byte comes after two others (sorted codes), tokens, texts."""

    codes: np.ndarray
    counts: np.ndarray
    tokens: int
    texts: int

    def __post_init__(self) -> None:
        pairs = np.bincount(self.codes & 0xFFFF, self.counts, minlength=1 << 16).reshape(256, 256) + 0.5
        self.after_one = pairs / pairs.sum(1, keepdims=True)
        self.met = np.bincount(self.codes >> 8, self.counts, minlength=1 << 16)
        #: of an n-gram's hash
        self.bits = min(63, self.tokens.bit_length() + HASH_SPARE)

    def cost(self, codes: np.ndarray) -> np.ndarray:
        """Bits of each byte after the two before it; what was seldom met is filled up by that after one."""
        at = np.minimum(np.searchsorted(self.codes, codes), max(len(self.codes) - 1, 0))
        seen = np.where(self.codes[at] == codes, self.counts[at], 0) if len(self.codes) else np.zeros(len(codes))
        plain = self.after_one[codes >> 8 & 0xFF, codes & 0xFF]
        return -np.log2((seen + SPELL_PRIOR * plain) / (self.met[codes >> 8] + SPELL_PRIOR))


def survey(docs: DataFrame) -> Corpus:
    """The Corpus of the training texts: sums of at most 2 ** 24 codes, of which text uses a small part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, tokens, texts = np.zeros(1 << 24, np.int64), 0, 0
        for batch in slices_of(batches, 4 * SLICE_BYTES):
            codes, first = spelled(texts_of(batch["text"]))
            met += np.bincount(codes, minlength=1 << 24)
            tokens, texts = tokens + len(first), texts + batch.num_rows
        full = np.flatnonzero(met)
        keys, counts = np.append(full, [-1, -2]), np.append(met[full], [tokens, texts])
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(counts)], ["key", "n"])

    got = docs.where("NOT held_out").select("text").mapInArrow(run, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas().sort_values("key")
    keys, n = got.key.to_numpy(np.int64), got.n.to_numpy(np.int64)
    sums = dict(zip(keys[:2].tolist(), n[:2].tolist(), strict=True))
    return Corpus(keys[keys >= 0], n[keys >= 0], sums.get(-1, 0), sums.get(-2, 0))


class Tokens:
    """The tokens of a chunk of texts: hashes in a row, where each text starts, the stretches of one class, and the n-gram keys.

    ``place``: of each token in the sorted distinct ``words``.
    """

    def __init__(self, words: np.ndarray, place: np.ndarray, starts: np.ndarray):
        self.starts = starts
        self.hashes = hashes = words[place]
        self.text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        self.place = np.arange(len(place)) - starts[self.text]
        kind = self._stretches(words, place)
        #: class member, pair and triple at each token, class of each stretch
        self.keys = np.empty(3 * len(place) + len(kind), np.uint64)
        member, pair, triple, of_class = np.split(self.keys, np.arange(1, 4) * len(place))
        mix(np.add(np.repeat(kind, self.stretch), hashes, out=member))
        self._after(pair, mix(words ^ PAIR)[place], PAIR)
        mix(np.add(pair, hashes, out=pair))
        self._after(triple, mix(pair ^ TRIPLE), TRIPLE)
        mix(np.add(triple, hashes, out=triple))
        mix(np.add(kind, ANY, out=of_class))

    def _after(self, out: np.ndarray, x: np.ndarray, what: np.uint64) -> None:
        """``out``: ``x`` of the token before."""
        out[1:] = x[:-1]
        out[self.starts[:-1]] = mix(np.array([START ^ what]))

    def _stretches(self, words: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The mixed class of each stretch of tokens of one text and class; sets their ``stretch`` (length) and ``of`` (text)."""
        size, ats = np.diff(self.starts), np.array([0, *CLASS_AT])
        kind = np.full((len(size), len(ats)), START, np.uint64)
        for k, at in enumerate(CLASS_AT, 1):
            long = np.flatnonzero(size > at)
            if not len(long):
                break
            met = np.sort(place[self.starts[long, None] + np.arange(at)], axis=1)
            new = np.ones(met.shape, bool)
            np.not_equal(met[:, 1:], met[:, :-1], out=new[:, 1:])
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, new.size))
            # most frequent, then smallest hash
            best = np.maximum.reduceat(count * len(words) + (len(words) - 1 - met.ravel()[first]), np.searchsorted(first, np.arange(len(long)) * at))
            kind[long, k] = words[len(words) - 1 - best % len(words)]
        here = size[:, None] > ats
        begins = (self.starts[:-1, None] + ats)[here]
        self.stretch, self.of = np.diff(np.append(begins, len(place))), np.nonzero(here)[0]
        return mix(kind[here] ^ CLASS)


@dataclass
class Chunk:
    """Texts of about TOKENS_HELD tokens: their rows, where each starts, and for each token its place in the sorted distinct ``words``, whose bytes are ``spells``."""

    ids: list
    held: np.ndarray
    starts: np.ndarray
    place: np.ndarray
    words: np.ndarray
    spells: list[bytes]


def laid_out(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of all rows of a text column (null: none) in a row, and where each begins (one entry more than rows)."""
    if not len(column):
        return b"", np.zeros(1, np.int64)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    begins = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return column.buffers()[2].slice(begins[0], begins[-1] - begins[0]).to_pybytes() if begins[-1] > begins[0] else b"", begins - begins[0]


def split_words(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of texts, lower-cased, the place of each word in them, and where each text begins (one entry more than texts)."""
    data, begins = laid_out(column)
    data = data.lower()  # knows A-Z only; pc.ascii_lower() fails on slices
    texts = pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(begins), pa.py_buffer(data)])
    split = pc.ascii_split_whitespace(texts)  # knows the white space of bytes.split()
    coded = pc.dictionary_encode(split.flatten())
    place, upto = coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy() - split.offsets[0].as_py()
    data, begins = laid_out(coded.dictionary)
    begins = begins.tolist()
    words = [data[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)]  # to_pylist() takes ten times as long
    if b"" in words:  # next to white space at either end
        empty = words.index(b"")
        full = place != empty
        upto = np.concatenate([[0], np.cumsum(full)])[upto]
        place = place[full]
        place -= place > empty
        del words[empty]
    return words, place, upto.astype(np.int64)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Chunks of about TOKENS_HELD tokens each; a longer text is a chunk of its own."""
    from xxhash import xxh3_64_intdigest

    held: list[tuple] = []
    for batch in slices_of(batches, SLICE_BYTES):
        words, place, starts = split_words(batch["text"])
        place, starts = np.insert(place, starts[1:], len(words)), starts + np.arange(len(starts))
        words.append(b"\n")
        hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
        hashes[-1] = END
        rows, at = (batch["doc_id"].to_pylist(), batch["held_out"].to_pylist()), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + TOKENS_HELD, "right")) - 1)
            a, b = starts[at], starts[to]
            held.append((rows[0][at:to], rows[1][at:to], starts[at : to + 1] - a, place[a:b], hashes, words))
            at = to
            if sum(len(h[3]) for h in held) >= TOKENS_HELD:
                yield _joined(held)
                held = []
    if held:
        yield _joined(held)


def _joined(held: list[tuple]) -> Chunk:
    ids, kept = [i for h in held for i in h[0]], [x for h in held for x in h[1]]
    tokens = np.cumsum([0, *(len(h[3]) for h in held)])
    starts = np.concatenate([*(h[2][:-1] + t for h, t in zip(held, tokens, strict=False)), tokens[-1:]])
    known = np.cumsum([0, *(len(h[4]) for h in held)])
    place = np.concatenate([h[3] + k for h, k in zip(held, known, strict=False)])
    used = np.flatnonzero(np.bincount(place, minlength=known[-1]))  # a part of a slice has not all of its words
    words, at, new = placed(np.concatenate([h[4] for h in held])[used])
    moved = np.zeros(known[-1], np.int64)
    moved[used] = new
    every = [w for h in held for w in h[5]]
    return Chunk(ids, np.array(kept, bool), starts, moved[place], words, [every[i] for i in used[at].tolist()])


ROWS = "part long NOT NULL, slice int, chunk long, tokens binary, grams binary, token_counts binary, gram_counts binary, doc_id array<long>, held_out array<boolean>, sizes array<long>, bytes array<long>, places binary, spelling binary"
_TYPES = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 2]
_SCHEMA = pa.schema([pa.field(x.split()[0], t, "NOT NULL" not in x) for x, t in zip(ROWS.split(", "), _TYPES, strict=True)])


def _cuts(keys: np.ndarray, bits: int, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """Slices that sorted ``keys`` of ``bits`` bits fall in, and where each begins (one entry more)."""
    where = ((keys << np.uint64(64 - bits) >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(where) else np.zeros(0, np.int64)
    return where[first], np.append(first, len(where))


#: Upper bytes of the steps between hashes that are compressed.
STEP_BYTES = 2


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as the first one and the steps between them."""
    return keys[:1].tobytes() + packed(np.diff(keys), STEP_BYTES)


def unpacked_keys(data: bytes) -> np.ndarray:
    steps = unpacked(data[8:], STEP_BYTES).view(np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(data[:8], np.uint64), steps]), dtype=np.uint64)


def gathered(docs: DataFrame, corpus: Corpus) -> DataFrame:
    """ROWS: for each chunk a row of its texts (slice -1) and, for each slice of the hash range, one of its distinct tokens and n-grams with their training counts; dealt out by ``part``."""
    slices, bits = 8 * partitions(docs.sparkSession), corpus.bits
    told = docs.sparkSession.sparkContext.broadcast(corpus)

    def rows(number: int, chunk: Chunk) -> pa.RecordBatch:
        tokens, words = Tokens(chunk.words, chunk.place, chunk.starts), chunk.words
        held = chunk.held[tokens.text]
        taught = np.bincount(chunk.place, ~held, minlength=len(words)).astype(np.int64)
        end = int(np.searchsorted(words, END))
        codes, first = codes_of(b" ".join([*chunk.spells[:end], *chunk.spells[end + 1 :], b"\n"]))
        spelling, size = np.add.reduceat(told.value.cost(codes), first), np.diff(np.append(first, len(codes)))
        spelling, size = (np.insert(x[:-1], end, x[-1]) for x in (spelling, size))
        # whether it is held out is the lowest bit of an n-gram
        tokens.keys >>= np.uint64(64 - bits)
        classes = tokens.keys[3 * len(held) :].copy()
        grams = tokens.keys << np.uint64(1) | np.concatenate([held, held, held, chunk.held[tokens.of]])
        grams.sort()
        begin = np.flatnonzero(np.concatenate([[True], (grams[1:] ^ grams[:-1]) > 1]))
        seen = np.add.reduceat(~grams & np.uint64(1), begin).astype(np.int64)
        grams = grams[begin] >> np.uint64(1)
        # a class stands once for all tokens of its stretch
        np.add.at(seen, np.searchsorted(grams, classes), np.where(chunk.held[tokens.of], 0, tokens.stretch - 1))
        out: dict[int, list] = {}
        for column, keys, counts, width in ((3, words, taught, 64), (4, grams, seen, bits)):
            which, cuts = _cuts(keys, width, slices)
            for s, i, j in zip(which.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                row = out.setdefault(s, [-1 - s, s, number, *[None] * 10])
                row[column], row[column + 2] = packed_keys(keys[i:j]), packed(counts[i:j])
        texts = [number, -1, number, packed_keys(words), None, None, None, chunk.ids, chunk.held.tolist(), np.diff(chunk.starts).tolist(), np.add.reduceat(size[chunk.place], chunk.starts[:-1]).tolist(), packed(chunk.place), packed(np.rint(spelling * SPELL_SCALE))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(texts, *out.values(), strict=True), _TYPES, strict=True)], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for chunk in chunks(batches):
            yield rows(number, chunk)
            number += 1

    return docs.mapInArrow(run, ROWS).repartition(partitions(docs.sparkSession), "part")


ANSWERS = "asked long NOT NULL, slice int, token_counts binary, gram_counts binary, distinct long"
_ANSWER_SCHEMA = pa.schema([pa.field("asked", pa.int64(), False), ("slice", pa.int32()), ("token_counts", pa.binary()), ("gram_counts", pa.binary()), ("distinct", pa.int64())])


def answered(rows: DataFrame) -> DataFrame:
    """For each chunk's row of a slice the counts over all training texts; one row of each slice holds its number of distinct training tokens."""

    def totals(data: list[tuple[bytes | None, bytes | None]]) -> tuple[list[bytes | None], int]:
        full = [i for i, (k, _) in enumerate(data) if k is not None]
        if not full:
            return [None] * len(data), 0
        keys = [unpacked_keys(data[i][0]) for i in full]
        every, _, place = placed(np.concatenate(keys))
        counts = np.zeros(len(every), np.int64)
        np.add.at(counts, place, np.concatenate([unpacked(data[i][1]) for i in full]))
        out: list[bytes | None] = [None] * len(data)
        for i, got in zip(full, np.split(counts[place], np.cumsum([len(k) for k in keys])[:-1]), strict=True):
            out[i] = packed(got)
        return out, int((counts > 0).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            words, distinct = totals([(r[1], r[3]) for r in held])
            grams, _ = totals([(r[2], r[4]) for r in held])
            columns = [[r[0] for r in held], [now] * len(held), words, grams, [distinct] + [0] * (len(held) - 1)]
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ANSWER_SCHEMA, strict=True)], schema=_ANSWER_SCHEMA)

        for batch in batches:
            where = np.array(batch["slice"])
            for i in np.flatnonzero(where >= 0).tolist():
                if where[i] != now:
                    yield from out()
                    now = int(where[i])
                held.append(tuple(batch[c][i].as_py() for c in ("chunk", "tokens", "grams", "token_counts", "gram_counts")))
        yield from out()

    return rows.sortWithinPartitions("slice").mapInArrow(run, ANSWERS)


def joined(rows: DataFrame) -> DataFrame:
    """Each chunk's row of texts with the answers to it.

    Both sides read the one shuffle of ``rows``: nothing may be selected from them before, as Spark would then make it twice.
    """
    answers = answered(rows).groupBy("asked").agg(F.collect_list(F.struct("slice", "token_counts", "gram_counts", "distinct")).alias("answers"))
    return rows.join(answers.hint("shuffle_hash"), F.col("part") == F.col("asked"))


def bucket(n: np.ndarray) -> np.ndarray:
    """0 for 0, then by the logarithm."""
    return _BUCKETS[np.minimum(n, len(_BUCKETS) - 1)]


_BUCKETS = np.minimum([0, *(1 + (k.bit_length() - 1) // 2 for k in range(1, 4 ** (BUCKETS - 2) + 1))], BUCKETS - 1).astype(np.uint16)


def own_counts(text: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each entry's ``key`` (below ``n``) occurs in its text, and how often before it."""
    order, group = ordered((text * n + key).astype(np.uint64))
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])[: len(group)])
    size = np.diff(np.append(first, len(group)))
    total, before = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
    total[order] = np.repeat(size, size)
    before[order] = np.arange(len(group)) - np.repeat(first, size)
    return total, before


def trails(tokens: Tokens, held: np.ndarray, corpus: Corpus, words: tuple[np.ndarray, np.ndarray], grams: tuple[np.ndarray, np.ndarray], spelling: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token how it is coded: level and buckets of what the contexts were met (a trail), and the bits of its symbol.

    ``words`` and ``grams``: place of each token (n-gram key) in the chunk's distinct ones, and their training counts.
    """
    n, taught = len(tokens.hashes), ~held[tokens.text]

    def less_own(place: np.ndarray, counts: np.ndarray) -> np.ndarray:
        met = counts[place]
        several = np.flatnonzero(taught & (met > 1))  # what was met once was met here
        left = np.where(taught, 0, met)
        left[several] = met[several] - own_counts(tokens.text[several], place[several], len(counts))[0]
        return left

    own, before = own_counts(tokens.text, words[0], len(words[1]))
    known = words[1][words[0]] - np.where(taught, own, 0)
    of_class, pair, triple = (less_own(p, grams[1]) for p in np.split(grams[0][: 3 * n], 3))
    classes = grams[0][3 * n :]
    _, same = np.unique(tokens.of * len(grams[1]) + classes, return_inverse=True)  # a text may have a class twice
    in_class = np.repeat(grams[1][classes] - np.where(held[tokens.of], 0, np.bincount(same, tokens.stretch).astype(np.int64)[same]), tokens.stretch)
    starts = tokens.place == 0
    texts = corpus.texts - taught
    shift = lambda x: np.where(starts, texts, np.concatenate([[0], x[:-1]]))
    n_one, n_two = shift(known), shift(pair)
    # the class counts of a class that nothing follows are 0; those of texts are taken off with the tokens
    total = corpus.tokens - np.where(taught, np.diff(tokens.starts)[tokens.text], 0)
    share = lambda c, m: c / np.maximum(m, 1)
    plain = np.where(of_class > 0, share(of_class, in_class), share(known, total))
    place = tokens.place
    levels = [(triple, n_two), (pair, n_one), (before, place)]
    level, p = np.full(n, SPELLED), np.ones(n)
    for at, (c, m) in list(enumerate(levels))[::-1]:
        tells = (c > 0) & (share(c, m) >= plain)
        level, p = np.where(tells, at, level), np.where(tells, share(c, m), p)
    rest = level == SPELLED
    by_class, by_all = rest & (of_class > 0), rest & (of_class <= 0) & (known > 0)
    level = np.where(by_class, 3, np.where(by_all, 4, level))
    p = np.where(by_class | by_all, plain, p)
    bits = np.where(level == SPELLED, spelling[words[0]], -np.log2(p))
    trail = level.astype(np.uint16) | bucket(n_two) << 3 | bucket(n_one) << 6 | bucket(place) << 9 | bucket(in_class) << 12 | (total > 0).astype(np.uint16) << 15
    return trail.astype("<u2"), bits


TRAILS = "doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, log_counts double, bits double, trail binary, distinct long"


def trailed(rows: DataFrame, corpus: Corpus) -> DataFrame:
    """TRAILS of every text; ``distinct`` adds up to the number of distinct training tokens."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *[(c, pa.int64()) for c in ("n_tokens", "n_known", "n_bytes")], ("log_counts", pa.float64()), ("bits", pa.float64()), ("trail", pa.binary()), ("distinct", pa.int64())])

    def made(row: dict) -> pa.RecordBatch:
        sizes = np.array(row["sizes"], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        place, words = unpacked(row["places"]), unpacked_keys(row["tokens"])
        tokens, held = Tokens(words, place, starts), np.array(row["held_out"], bool)
        answers = sorted(row["answers"], key=lambda x: x["slice"])
        counts, grams = (np.concatenate([unpacked(x[c]) for x in answers if x[c] is not None]) for c in ("token_counts", "gram_counts"))
        tokens.keys >>= np.uint64(64 - corpus.bits)
        every, _, where = placed(tokens.keys)
        if (len(words), len(every)) != (len(counts), len(grams)):
            raise ValueError("counts don't fit their texts: the documents differ each time they are read")
        trail, bits = trails(tokens, held, corpus, (place, counts), (where, grams), unpacked(row["spelling"]) / SPELL_SCALE)
        sums = [np.add.reduceat(x, starts[:-1]) for x in ((counts > 0).astype(np.int64)[place], np.log10(counts + 0.5)[place], bits)]
        parts = [trail[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
        distinct = [sum(x["distinct"] for x in answers)] + [0] * (len(parts) - 1)
        columns = [row["doc_id"], row["held_out"], row["sizes"], sums[0], row["bytes"], sums[1], sums[2], parts, distinct]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield made(batch.slice(i, 1).to_pylist()[0])

    return rows.mapInArrow(run, TRAILS)


class Decisions:
    """The bits of trails in a row: where each text's begin, the slots and outcome of each."""

    def __init__(self, trail: np.ndarray, starts: np.ndarray):
        n, first = len(trail), starts[:-1]
        size = np.diff(starts)
        level = (trail & 7).astype(np.uint8)

        def ago(x: np.ndarray, k: int, none: int) -> np.ndarray:
            out = np.full(n, none, np.uint8)
            out[k:] = x[: max(n - k, 0)]
            for j in range(k):
                out[first[size > j] + j] = none
            return out

        two = (level == 0).astype(np.uint8)
        last_two = ago(level, 1, SPELLED) * np.uint8(6) + ago(level, 2, SPELLED)
        last_six = np.zeros(n, np.uint8)
        for k in range(1, 7):
            last_six |= ago(two, k, 0) << np.uint8(k - 1)
        upto = np.concatenate([[0], np.cumsum(two, dtype=np.int64)])
        told, back = upto[:n] - upto[np.maximum(np.arange(n) - RATE_TOKENS, 0)], np.full(n, RATE_TOKENS)
        for text, tokens in zip(first.tolist(), np.minimum(size, RATE_TOKENS).tolist(), strict=True):
            told[text : text + tokens] = upto[text : text + tokens] - upto[text]
            back[text : text + tokens] = _COUNT[:tokens]
        rate = _RATE[back, told]
        # a level asks if none before told the token and its context was met
        met = np.empty((n, LEVELS), np.uint8)
        for k in range(LEVELS):
            met[:, k] = trail >> 3 * (k + 1) & 7
        asks = (met > 0) & (level[:, None] >= np.arange(LEVELS, dtype=np.uint8))
        asked = np.flatnonzero(asks)
        token = asked // LEVELS
        at = (asked - token * LEVELS).astype(np.uint16)
        self.bit = level[token] == at
        cell = at * np.uint16(BUCKETS) + met.ravel()[asked]
        last_two, last_six, rate = last_two[token], last_six[token], rate[token]
        #: of each predictor
        self.slots = [cell, at * np.uint16(LAST_TWO) + last_two, at * np.uint16(LAST_SIX) + last_six, cell * np.uint16(RATES) + rate]
        self._parts = cell, last_two, last_six, rate
        self.begins = np.searchsorted(token, starts)

    @property
    def joint(self) -> np.ndarray:
        """The joint context of each bit."""
        cell, last_two, last_six, rate = self._parts
        return ((cell.astype(np.int64) * LAST_TWO + last_two) * LAST_SIX + last_six) * RATES + rate


_COUNT = np.arange(RATE_TOKENS)
#: by tokens looked back at and how many of them the two before told
_RATE = (np.arange(RATE_TOKENS + 1) * (RATES - 1) // np.maximum(np.arange(RATE_TOKENS + 1), 1)[:, None]).clip(0, RATES - 1).astype(np.uint8)


def contexts(joint: np.ndarray) -> list[np.ndarray]:
    """The slot of each predictor in a joint context; levels never share one."""
    rest, rate = np.divmod(joint, RATES)
    rest, six = np.divmod(rest, LAST_SIX)
    rest, two = np.divmod(rest, LAST_TWO)
    at = rest // BUCKETS
    return [rest, at * LAST_TWO + two, at * LAST_SIX + six, rest * RATES + rate]


SLOTS = [LEVELS * BUCKETS, LEVELS * LAST_TWO, LEVELS * LAST_SIX, LEVELS * BUCKETS * RATES]


def stretched(ones: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.clip(np.log((ones + 0.4) / (n - ones + 0.4)), -TOP, TOP)


def confidence(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(n + 1).astype(np.int64) // 3, CONFIDENCES - 1)


@dataclass
class Model:
    """What each predictor says in each of its slots, times its weight."""

    says: list[np.ndarray]

    def log2(self, trail: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The log2 probability of the decisions of each text; ``trail`` holds those of all in a row."""
        d = Decisions(trail, starts)
        size = np.diff(d.begins)
        order = np.argsort(-size, kind="stable")
        first, length = d.begins[:-1][order], size[order]
        # blocks of BLOCK bits, the first ones of all texts, then the second ones: those of a text with bits left are side by side
        steps = np.arange(0, int(length.max(initial=0)), BLOCK)
        lanes = np.searchsorted(-length, -steps)
        upto = np.concatenate([[0], np.cumsum(lanes)])
        lane = np.arange(upto[-1]) - np.repeat(upto[:-1], lanes)
        bits = np.repeat(steps, lanes)[:, None] + np.arange(BLOCK)
        toward = (bits < length[lane, None]).astype(np.float32)
        bits = np.minimum(bits, length[lane, None] - 1)
        bits += first[lane, None]
        toward *= np.where(d.bit, np.float32(1), np.float32(-1))[bits]
        says = [table.astype(np.float32)[slot[bits]] for table, slot in zip(self.says, d.slots, strict=True)]
        share = np.ones((PREDICTORS, len(first), 1), np.float32)
        total = np.zeros(len(first))
        for a, b, n in zip(upto[:-1].tolist(), upto[1:].tolist(), lanes.tolist(), strict=True):
            parts, t = [p[a:b] for p in says], toward[a:b]
            z = sum(p * share[k, :n] for k, p in enumerate(parts)) * t  # positive towards the bit that came; 0 beyond the end
            e = np.exp(-np.minimum(np.maximum(z, -14), 14))
            total[:n] -= np.log(1 + e).sum(1)
            t *= e / (1 + e)
            for k in range(PREDICTORS):
                share[k, :n, 0] += RATE * np.einsum("lb,lb->l", parts[k], t)
        total += (-length % BLOCK) * np.log(2)  # bits beyond the end have counted as coin flips
        out = np.zeros(len(size))
        out[order] = total / np.log(2)
        return out


def fit(joint: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> Model:
    """Slots and weights from how often each joint context was met with either outcome; logistic regression by adaptive gradient steps."""
    slots = contexts(joint)
    n = [np.bincount(s, zeros + ones, minlength=m) for s, m in zip(slots, SLOTS, strict=True)]
    says = [stretched(np.bincount(s, ones, minlength=m), k) for s, k, m in zip(slots, n, SLOTS, strict=True)]
    per_level = [m // LEVELS for m in SLOTS]
    cell = [np.arange(m) // w * CONFIDENCES + confidence(k) for m, w, k in zip(SLOTS, per_level, n, strict=True)]
    weights = np.full((PREDICTORS, LEVELS * CONFIDENCES), 0.3)
    seen = np.zeros_like(weights)
    x, where = [s[slot] for s, slot in zip(says, slots, strict=True)], [c[slot] for c, slot in zip(cell, slots, strict=True)]
    total = max(float((zeros + ones).sum()), 1.0)
    for _ in range(300 if len(joint) else 0):
        z = sum(weights[k][where[k]] * x[k] for k in range(PREDICTORS))
        error = (ones - (zeros + ones) / (1 + np.exp(-np.clip(z, -30, 30)))) / total
        g = np.array([np.bincount(where[k], error * x[k], minlength=LEVELS * CONFIDENCES) for k in range(PREDICTORS)])
        seen += g * g
        weights += 0.1 * g / np.sqrt(seen + 1e-16)
    return Model([says[k] * weights[k][cell[k]] for k in range(PREDICTORS)])


def _trails_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    parts = batch["trail"].to_pylist()
    return np.frombuffer(b"".join(parts), "<u2"), np.concatenate([[0], np.cumsum([len(p) // 2 for p in parts])]).astype(np.int64)


def learn(told: DataFrame) -> Model:
    """The model of the training texts' decisions: at most JOINT sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(2 * JOINT, np.int64)
        for batch in slices_of(batches, TRAIL_BYTES, "trail"):
            d = Decisions(*_trails_of(batch))
            met += np.bincount(2 * d.joint + d.bit, minlength=2 * JOINT)
        met = met.reshape(JOINT, 2).T
        full = np.flatnonzero(met.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(met[0][full]), pa.array(met[1][full])], ["joint", "zeros", "ones"])

    met = told.where("NOT held_out").select("trail").mapInArrow(run, "joint long, zeros long, ones long")
    got = met.groupBy("joint").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toPandas().sort_values("joint")
    return fit(got.joint.to_numpy(np.int64), got.zeros.to_numpy(np.float64), got.ones.to_numpy(np.float64))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score_documents(docs: DataFrame) -> DataFrame:
    """SCORES of every row of ``docs`` (doc_id, text); base_score is the add-half unigram model's log10 probability."""
    folded = fold(docs)
    corpus = survey(folded)
    told = staged(trailed(joined(gathered(folded, corpus)), corpus), "trails", "zstd")
    distinct = told.agg(F.sum("distinct")).first()[0] or 0
    model = told.sparkSession.sparkContext.broadcast(learn(told))
    below = float(np.log10(corpus.tokens + 0.5 * (distinct + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches, TRAIL_BYTES, "trail"):
            bits = np.array(batch["bits"]) - model.value.log2(*_trails_of(batch))
            n, size = np.array(batch["n_tokens"]), np.array(batch["n_bytes"])
            columns = [batch["doc_id"], batch["held_out"], batch["n_tokens"], batch["n_known"], pa.array(np.full(len(n), corpus.tokens)), pa.array(np.array(batch["log_counts"]) - n * below), pa.array(-bits * np.log10(2)), pa.array(bits / size)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    return told.drop("distinct").mapInArrow(run, SCORES)


def op1_context_mixing(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
