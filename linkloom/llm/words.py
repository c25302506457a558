"""Word perplexity: an interpolated modified Kneser-Ney trigram model over an open vocabulary of hashed words.

Triples of words are dealt over shards by their middle word, those of a very frequent middle word over several shards by the
first word too. A shard then holds all that the probabilities of its triples need, but for what it asks of others: how many
words each last word follows, and, for its frequent middle words, the pairs that other shards hold. These answers are dealt
by last word, one entry for each (word, shard). Documents send their triples to the same shards, where the model of a shard is
built and used at once; it is stored nowhere. The log probability of a text is that of its words, by their shards, plus what
its triples' shards add to it. All this is done in rounds over fixed parts of the shards, and what a round shuffles is deleted
behind it, so that the disk never holds all triples; each round reads the whole text again.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batched, drop_scratch, materialise, shuffles_dropped
from .quality import _unvarint, _varint, discounts

#: Parts of the shards that are scored, or counted, one after the other; the first where documents name the trusted texts among
#: them, the second where those are a table of their own, which takes disk too.
ROUNDS, ROUNDS_APART, COUNT_ROUNDS = 6, 8, 2
#: Trusted triples that one shard holds, about; words in the middle of half as many are dealt over several shards.
SHARD_TRIPLES = 2_000_000
HOT_TRIPLES = SHARD_TRIPLES // 2
#: One trusted text in so many, by content hash, is not counted: thresholds of word perplexity come from these.
HELD_BACK = 5
START, END, WORD_BITS = 1, 2, 48
#: Kinds of rows. Answers come first in a shard, then trusted text, then documents.
WORDS, HOT_PAIRS, KNOWN_WORDS, TRUSTED, DOC_WORDS, DOC_TRIPLES, HIGH, LOW, FOLLOWS = range(9)
ROW = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("packed", pa.binary()), ("told", pa.list_(pa.int64()))])
ROW_DDL = "shard int, kind int, packed binary, told array<long>"
SUMS = pa.schema([("ident", pa.int64()), ("logp", pa.float64()), ("n", pa.int64())])
SUMS_DDL = "ident long, logp double, n long"


def held_back(content):
    return F.pmod(content, F.lit(HELD_BACK)) == 0


def key_of(*words: np.ndarray) -> np.ndarray:
    """64-bit keys of words, pairs or triples of word hashes."""
    h = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        h ^= w
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


class Laid(NamedTuple):
    """Words of texts, one text after another, each with two starts before and an end behind."""

    words: np.ndarray
    middle: np.ndarray  # whether a word is the middle of a triple: all but the first start and the end
    ends: np.ndarray  # where each text ends

    def triples(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.words[at - 1], self.words[at], self.words[at + 1]

    def texts(self, at: np.ndarray) -> np.ndarray:
        """Which text each word belongs to."""
        return np.searchsorted(self.ends, at, side="right")


class Deal(NamedTuple):
    """Which shard a triple or a word belongs to. rounds: in how many parts the shards are scored; hot: words that are dealt over several, in order; parts: over how many."""

    shards: int
    rounds: int
    hot: np.ndarray
    parts: np.ndarray

    def is_hot(self, b: np.ndarray) -> np.ndarray:
        return self.hot[np.searchsorted(self.hot[:-1], b)] == b

    def word(self, c: np.ndarray) -> np.ndarray:
        return (key_of(c) % np.uint64(self.shards)).astype(np.uint32)

    def triple(self, laid: Laid, words: np.ndarray) -> np.ndarray:
        """Of each triple of laid texts, at its middle word; words: the shards of the words."""
        if len(self.hot) == 1:
            return words
        out, at = words.copy(), np.flatnonzero(laid.middle & self.is_hot(laid.words))
        a, b = laid.words[at - 1], laid.words[at]
        out[at] = key_of(b, key_of(a) % self.parts[np.searchsorted(self.hot[:-1], b)]) % np.uint64(self.shards)
        return out

    def shards_of(self, b: int) -> list[int]:
        """All shards of a hot word."""
        n = int(self.parts[np.searchsorted(self.hot[:-1], np.uint64(b))])
        return np.unique(key_of(np.full(n, b, np.uint64), np.arange(n, dtype=np.uint64)) % np.uint64(self.shards)).tolist()


#: Masks of the first 0 to 8 bytes of a word of 64 bits.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words are hashed 8 bytes at a time up to this length, together; what longer ones have behind it is hashed one by one.
LONG_WORD = 256
#: Texts are taken apart in groups of about so many bytes, whose arrays fit a processor's cache.
GROUP_BYTES = 1 << 18


class Words:
    """Hashes of the words of texts."""

    def hashes(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """48-bit hashes of the words between white space, as they stand, and where they start."""
        raw = np.frombuffer(data + bytes(8), np.uint8)
        edge = np.ones(len(data) + 2, bool)
        edge[1:-1] = (raw[:-8] == 0x20) | (raw[:-8] - np.uint8(0x09) < 5)  # white space
        edges = np.flatnonzero(edge[1:] != edge[:-1])
        first, last = edges[::2], edges[1::2]
        size = last - first
        eight = np.ndarray(len(data) + 1, "<u8", raw, strides=(1,))  # the 8 bytes from each byte on
        h = key_of(eight[first] & FIRST_BYTES[np.minimum(size, 8)], size.astype(np.uint64))
        more = np.flatnonzero(size > 8)
        for k in range(8, LONG_WORD, 8):
            if not len(more):
                break
            h[more] = key_of(h[more], eight[first[more] + k] & FIRST_BYTES[np.minimum(size[more] - k, 8)])
            more = more[size[more] > k + 8]
        if len(more):
            rest = [xxhash.xxh64_intdigest(data[i + LONG_WORD : j]) for i, j in zip(first[more].tolist(), last[more].tolist(), strict=True)]
            h[more] = key_of(h[more], np.array(rest, np.uint64))
        return h >> np.uint64(64 - WORD_BITS), first

    def _counted(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts, one after another, and how many each has."""
        found, sizes, start, held = [], [], 0, 0
        for k, t in enumerate(texts, 1):
            held += len(t) + 1
            if held >= GROUP_BYTES or k == len(texts):
                words, first = self.hashes(b"\n".join(texts[start:k]))
                found.append(words)
                sizes.append(np.diff(np.searchsorted(first, np.cumsum([len(x) + 1 for x in texts[start:k]])), prepend=0))
                start, held = k, 0
        return np.concatenate(found), np.concatenate(sizes)

    def laid(self, texts: list[bytes]) -> Laid:
        words, sizes = self._counted(texts)
        p = np.full(len(words) + 3 * len(texts), START, np.uint64)
        ends = np.cumsum(sizes + 3)
        middle = np.ones(len(p), bool)
        middle[ends - 1] = middle[ends - sizes - 2] = middle[ends - sizes - 3] = False
        p[middle] = words
        p[ends - 1] = END
        middle[ends - sizes - 2] = True
        return Laid(p, middle, ends)


def pack(columns: list[np.ndarray], numbers: list[np.ndarray] = ()) -> bytes:
    """Columns of 48-bit words and small numbers, all of one length."""
    wide = [np.ascontiguousarray(c, np.uint64).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for c in columns]
    return b"".join([struct.pack("<I", len(columns[0])), *wide, _varint(np.concatenate(numbers)) if len(numbers) and len(columns[0]) else b""])


def unpack(data: bytes, columns: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    (n,) = struct.unpack_from("<I", data)
    x = np.zeros((columns * n, 8), np.uint8)
    x[:, :6] = np.frombuffer(data, np.uint8, 6 * n * columns, 4).reshape(-1, 6)
    words, rest = x.view(np.uint64).ravel(), data[4 + 6 * n * columns :]
    v = _unvarint(rest).astype(np.int64) if rest else np.zeros(0, np.int64)
    return [words[k * n : (k + 1) * n] for k in range(columns)], [v[k : k + n] for k in range(0, len(v), n)]


def _chunks(b: pa.RecordBatch, texts: int, most: int = 3_200_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, of about so many bytes of text or one row; never over 60,000 rows."""
    sizes = pc.fill_null(pc.binary_length(b.column(texts)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > start and (held + size > most or k - start >= 60_000):
            yield b.slice(start, k - start)
            start, held = k, 0
        held += size
    if len(sizes):
        yield b.slice(start)


def _cuts(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the one before, and the end."""
    n = len(columns[0])
    new = np.ones(n + 1, bool)
    if n:
        new[1:n] = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new) if n else np.zeros(1, np.int64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where one of each distinct key stands, in order of keys; which of them each key is; and how often each occurs."""
    order = np.argsort(keys)
    cuts = _cuts(keys[order])
    n = np.diff(cuts)
    of = np.empty(len(keys), np.int64)
    of[order] = np.repeat(np.arange(len(n)), n)
    return order[cuts[:-1]], of, n


def _by_shard(shard: np.ndarray) -> np.ndarray:
    return np.argsort(shard.astype(np.uint16) if not len(shard) or shard.max() < 1 << 16 else shard, kind="stable")


def _slices(shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Of shard numbers in order: each, and where it stands."""
    cuts = _cuts(shard).tolist()
    for i, j in zip(cuts, cuts[1:], strict=False):
        yield int(shard[i]), slice(i, j)


def _dealer(trusted: DataFrame, rounds: int = ROUNDS) -> Deal | None:
    """How to deal the trusted text; None if it has no text. Words in the middle of many triples are told by those that make
    up a thousandth of a chunk: a word that is missed so is dealt like any other, and the result is the same."""

    def run(batches):
        words = Words()
        for whole in batches:
            for x in _chunks(whole, 0):
                texts = [t for t in as_bytes(x.column(0)) if t]
                if texts:
                    laid = words.laid(texts)
                    b, n = np.unique(laid.words[laid.middle], return_counts=True)
                    much = n * 1000 >= n.sum()
                    yield pa.RecordBatch.from_arrays([pa.array(np.append(b[much].astype(np.int64), -1)), pa.array(np.append(n[much], n.sum()))], ["word", "n"])

    told = trusted.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r[0]: r[1] for r in told.where((F.col("word") < 0) | (F.col("n") >= HOT_TRIPLES)).collect()}  # by HOT_TRIPLES at least of the text each
    total = found.pop(-1, 0)
    if not total:
        return None
    hot = sorted(found)
    each = max(2 * trusted.sparkSession.sparkContext.defaultParallelism, -(-total // (rounds * SHARD_TRIPLES)))
    return Deal(rounds * each, rounds, np.array([*hot, 1 << 63], np.uint64), np.array([*(-(-found[w] // HOT_TRIPLES) + 1 for w in hot), 1], np.uint64))


def _packed_triples(a: np.ndarray, b: np.ndarray, c: np.ndarray, g: np.ndarray) -> Iterator[tuple[int, int, bytes, None]]:
    """Of the trusted triples of a chunk one row for each shard: distinct triples and their counts."""
    order = np.argsort(g.astype(np.uint64) << np.uint64(40) | key_of(a, b, c) >> np.uint64(24))
    a, b, c, g = a[order], b[order], c[order], g[order]
    cuts = _cuts(g, a, b, c)
    first, n = cuts[:-1], np.diff(cuts)
    a, b, c, g = a[first], b[first], c[first], g[first]
    for k, at in _slices(g):
        yield k, TRUSTED, pack([a[at], b[at], c[at]], [n[at]]), None


def _sent_triples(trusted: DataFrame, deal: Deal, rounds: int, r: int) -> DataFrame:
    """For each chunk of trusted texts and shard of the round one row: distinct triples and their counts."""

    def run(batches):
        words = Words()

        def rows():
            for whole in batches:
                for x in _chunks(whole, 0):
                    texts = [t for t in as_bytes(x.column(0)) if t]
                    if not texts:
                        continue
                    laid = words.laid(texts)
                    g = deal.triple(laid, deal.word(laid.words))
                    at = np.flatnonzero(laid.middle & (g % rounds == r))
                    yield from _packed_triples(*laid.triples(at), g[at])

        yield from batched(rows(), ROW, weigh=2)

    return trusted.mapInArrow(run, ROW_DDL)


def _sent_docs(docs: DataFrame, deal: Deal, rounds: int, r: int) -> DataFrame:
    """For each chunk of documents and shard of the round one row with their triples, and one with their distinct words; also
    what _sent_triples() sends of those that a third column names trusted."""

    def run(batches):
        words = Words()

        def packed(ident, g, doc, columns, numbers):
            order = _by_shard(g)
            g, doc, columns, numbers = g[order], doc[order], [c[order] for c in columns], [n[order] for n in numbers]
            for k, at in _slices(g):
                cuts = _cuts(doc[at])
                yield k, struct.pack("<I", len(cuts) - 1) + ident[doc[at][cuts[:-1]]].tobytes() + np.diff(cuts).astype(np.uint32).tobytes() + pack([c[at] for c in columns], [n[at] for n in numbers])

        def rows():
            for whole in batches:
                for x in _chunks(whole, 1):
                    texts = as_bytes(x.column(1))
                    full = [k for k, t in enumerate(texts) if t]
                    if not full:
                        continue
                    ident = x.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[full]
                    laid = words.laid([texts[k] for k in full])
                    shards = deal.word(laid.words)
                    at = np.flatnonzero(laid.middle[:-1] & (shards[1:] % rounds == r))
                    own, n = np.unique(laid.texts(at).astype(np.uint64) << np.uint64(WORD_BITS) | laid.words[at + 1], return_counts=True)
                    of, own = (own >> np.uint64(WORD_BITS)).astype(np.int64), own & np.uint64((1 << WORD_BITS) - 1)
                    for k, data in packed(ident, deal.word(own), of, [own], [n]):
                        yield k, DOC_WORDS, data, None
                    g = deal.triple(laid, shards)
                    at = np.flatnonzero(laid.middle & (g % rounds == r))
                    (a, b, c), g, of = laid.triples(at), g[at], laid.texts(at)
                    for k, data in packed(ident, g, of, [a, b, c], []):
                        yield k, DOC_TRIPLES, data, None
                    if x.num_columns > 2:
                        t = np.array(x.column(2).to_pylist(), bool)[full][of]
                        if t.any():
                            yield from _packed_triples(a[t], b[t], c[t], g[t])

        yield from batched(rows(), ROW, weigh=2)

    return docs.mapInArrow(run, ROW_DDL)


def _grouped(batches) -> Iterator[tuple[int, Iterator[tuple[int, bytes]]]]:
    """Of rows in order of their shards: each shard with an iterator over its (kind, packed), to be used up before the next."""
    rows = (row for x in batches for row in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(2).to_pylist(), strict=True))
    for shard, its in groupby(rows, key=lambda row: row[0]):
        yield shard, ((kind, data) for _, kind, data in its)


def _at_shards(rows: DataFrame, deal: Deal) -> DataFrame:
    """Shards whole and in order; a partition may hold several."""
    return rows.repartition(2 * deal.shards // deal.rounds, "shard").sortWithinPartitions("shard", "kind")


class Counted(NamedTuple):
    """Distinct triples of a shard with their counts, their distinct pairs (b, c), and which pair each triple has."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    n: np.ndarray
    first: np.ndarray
    pair: np.ndarray
    kinds: np.ndarray

    @classmethod
    def of(cls, packed: list[bytes]) -> Counted:
        told = [unpack(data, 3) for data in packed]
        a, b, c = (np.concatenate([np.zeros(0, np.uint64), *(x[0][k] for x in told)]) for k in range(3))
        n = np.concatenate([np.zeros(0, np.int64), *(x[1][0] for x in told)])
        first, of, _ = _distinct(key_of(a, b, c))
        n = np.bincount(of, n, len(first)).astype(np.int64)
        a, b, c = a[first], b[first], c[first]
        first, pair, kinds = _distinct(key_of(b, c))
        return cls(a, b, c, n, first, pair, kinds)


def _times(n: np.ndarray) -> list[int]:
    """How many of n are 1, 2, 3, 4."""
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def _asked(trusted: DataFrame, deal: Deal, r: int) -> DataFrame:
    """What the shards of a counting round tell: for each shard of words the last words of their pairs, and how many words
    of this shard alone those follow; for hot middle words, the pairs. And the numbers of triples and pairs by count."""

    def run(batches):
        def rows():
            for shard, its in _grouped(batches):
                t = Counted.of([data for _, data in its])
                b, c, kinds = t.b[t.first], t.c[t.first], t.kinds
                yield shard, HIGH, None, _times(t.n)
                hot = deal.is_hot(b)
                yield shard, LOW, None, _times(kinds[~hot])
                words, n = np.unique(c[~hot], return_counts=True)
                g = deal.word(words)
                order = _by_shard(g)
                words, n, g = words[order], n[order], g[order]
                for k, at in _slices(g):
                    yield k, WORDS, struct.pack("<I", shard) + pack([words[at]], [n[at]]), None
                b, c, kinds = b[hot], c[hot], kinds[hot]
                g = deal.word(c)
                order = _by_shard(g)
                b, c, kinds, g = b[order], c[order], kinds[order], g[order]
                for k, at in _slices(g):
                    yield k, HOT_PAIRS, pack([b[at], c[at]], [kinds[at]]), None

        yield from batched(((k, kind, data or b"", told) for k, kind, data, told in rows()), ROW, weigh=2)

    return _at_shards(_sent_triples(trusted, deal, COUNT_ROUNDS, r), deal).mapInArrow(run, ROW_DDL)


def _answered(asked: DataFrame, deal: Deal) -> DataFrame:
    """Answers to the shards that asked: of words, how many words they follow; of hot pairs, that and how many words the pair
    follows. Also the shards' own words, and numbers of hot pairs by count and by first word."""

    def run(batches):
        def rows():
            for shard, its in _grouped(batches):
                told: dict[int, list[bytes]] = {WORDS: [], HOT_PAIRS: []}
                for kind, data in its:
                    told[kind].append(data)
                asks = [(*struct.unpack_from("<I", data), *unpack(data[4:], 1)) for data in told[WORDS]]
                hot = [unpack(data, 2) for data in told[HOT_PAIRS]]
                b, c = (np.concatenate([np.zeros(0, np.uint64), *(x[k] for x, _ in hot)]) for k in (0, 1))
                kinds = np.concatenate([np.zeros(0, np.int64), *(n[0] for _, n in hot)])
                first, of, _ = _distinct(key_of(b, c))
                b, c, kinds = b[first], c[first], np.bincount(of, kinds, len(first)).astype(np.int64)
                words = np.unique(np.concatenate([c, *(w[0] for _, w, _ in asks)]))
                n = np.bincount(np.searchsorted(words, c), minlength=len(words)).astype(np.int64)
                for _, (w,), (k,) in asks:
                    n[np.searchsorted(words, w)] += k
                yield shard, KNOWN_WORDS, pack([words], [n]), [len(words), int(n.sum())]
                for to, (w,), _ in asks:
                    yield to, WORDS, pack([w], [n[np.searchsorted(words, w)]]), None
                yield shard, LOW, b"", _times(kinds)
                order = np.argsort(b)
                b, c, kinds = b[order], c[order], kinds[order]
                cuts = _cuts(b).tolist()
                for i, j in zip(cuts, cuts[1:], strict=False):
                    data = pack([b[i:j], c[i:j]], [kinds[i:j], n[np.searchsorted(words, c[i:j])]])
                    for to in deal.shards_of(int(b[i])):
                        yield to, HOT_PAIRS, data, None
                    yield shard, FOLLOWS, b"", [int(b[i]), int(kinds[i:j].sum()), *(int((np.minimum(kinds[i:j], 3) == k).sum()) for k in (1, 2, 3))]

        yield from batched(rows(), ROW, weigh=2)

    return _at_shards(asked.where(F.col("kind").isin(WORDS, HOT_PAIRS)), deal).mapInArrow(run, ROW_DDL)


class Model(NamedTuple):
    """What all shards need to know: discounts of triples and pairs, the number of distinct pairs, an unknown word's probability,
    and of hot middle words (in order of deal.hot) the total and the share that backs off."""

    deal: Deal
    answers: DataFrame
    high: np.ndarray
    low: np.ndarray
    pairs: float
    unknown: float
    totals: np.ndarray
    rests: np.ndarray


def _discount(d: np.ndarray, n: np.ndarray) -> np.ndarray:
    return d[np.minimum(n, 3) - 1]


def _trained(trusted: DataFrame, rounds: int = ROUNDS) -> Model | None:
    deal = _dealer(trusted, rounds)
    if deal is None:
        return None
    spark = trusted.sparkSession
    with shuffles_dropped(spark):
        asked = [materialise(_asked(trusted, deal, r), "asked") for r in range(COUNT_ROUNDS)]
        every = reduce(DataFrame.union, asked)
        answers = materialise(_answered(every, deal), "answers")

    def summed(df: DataFrame, kind: int, size: int) -> list[int]:
        got = df.where(F.col("kind") == kind).agg(*(F.sum(F.col("told")[k]) for k in range(size))).first()
        return [x or 0 for x in got]

    high = discounts(summed(every, HIGH, 4))
    low = discounts([x + y for x, y in zip(summed(every, LOW, 4), summed(answers, LOW, 4), strict=True)])
    kinds, pairs = summed(answers, KNOWN_WORDS, 2)
    drop_scratch(*asked)
    told = F.col("told")
    hot = answers.where(F.col("kind") == FOLLOWS).groupBy(told[0].alias("b")).agg(*(F.sum(told[k]).alias(f"n{k}") for k in range(1, 5)))
    found = {r[0]: r[1:] for r in hot.collect()}  # one row for each hot word
    sums = [found.get(int(b), (1, 0, 0, 0)) for b in deal.hot]
    rests = [sum(x * d for x, d in zip(s[1:], low, strict=True)) / s[0] for s in sums]
    return Model(deal, answers, np.array(high), np.array(low), float(pairs), 0.5 * kinds / pairs / (kinds + 1), np.array([s[0] for s in sums], float), np.array(rests, float))


def word_model(trusted: DataFrame) -> tuple[DataFrame | None, Model | None]:
    """Of the trusted texts (column text): a table of their words (hash) and how many different words each follows, and the
    rest of the model; None without trusted text."""
    model = _trained(trusted)
    if model is None:
        return None, None

    def run(batches):
        for _, its in _grouped(batches):
            for _, data in its:
                (words,), (n,) = unpack(data, 1)
                for k in range(0, len(words), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(words[k : k + 20_000].view(np.int64)), pa.array(n[k : k + 20_000])], ["word", "n"])

    return model.answers.where(F.col("kind") == KNOWN_WORDS).mapInArrow(run, "word long, n long"), model


class Lookup:
    """Numbers by key, 0 for others. Keys are asked in order, as a search that jumps about in a large table is slow."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and their numbers."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0)
        order = np.argsort(keys)
        keys = keys[order]
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        hit = np.flatnonzero(self.keys[at] == keys)
        return order[hit], self.values[at[hit]]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        at, values = self.found(keys)
        out[at] = values
        return out


class Shard:
    """The model of one shard: what a triple adds to the log probability of its last word as a single word."""

    def __init__(self, m, told: dict[int, list[bytes]]):
        t = Counted.of(told[TRUSTED])
        words = [unpack(data, 1) for data in told[WORDS]]
        follows = Lookup(np.concatenate([np.zeros(0, np.uint64), *(w[0] for w, _ in words)]), np.concatenate([np.zeros(0), *(n[0] for _, n in words)]))
        b, c, kinds = t.b[t.first], t.c[t.first], t.kinds
        cold = ~m.deal.is_hot(b)
        b, c, kinds = b[cold], c[cold], kinds[cold]
        first, of, _ = _distinct(b)
        first = b[first]
        total = np.bincount(of, kinds, len(first))
        rest = np.bincount(of, _discount(m.low, kinds), len(first)) / np.maximum(total, 1)
        n1, total, rests = follows(c), total[of], rest[of]
        hot = [unpack(data, 2) for data in told[HOT_PAIRS]]
        hb, hc = (np.concatenate([np.zeros(0, np.uint64), *(x[k] for x, _ in hot)]) for k in (0, 1))
        hn, h1 = (np.concatenate([np.zeros(0, np.int64), *(n[k] for _, n in hot)]) for k in (0, 1))
        at = np.searchsorted(m.deal.hot[:-1], hb)
        b, c, kinds, n1 = np.concatenate([b, hb]), np.concatenate([c, hc]), np.concatenate([kinds, hn]), np.concatenate([n1, h1])
        total, rests = np.concatenate([total, m.totals[at]]), np.concatenate([rests, m.rests[at]])
        p1 = (n1 - 0.5) / m.pairs + m.unknown
        under = rests * p1
        p2 = (kinds - _discount(m.low, kinds)) / total + under
        keys = key_of(b, c)
        seconds = Lookup(keys, p2)
        self.pair = Lookup(keys, np.log(p2 / under))
        self.middle = Lookup(np.concatenate([first, m.deal.hot[:-1]]), np.log(np.concatenate([rest, m.rests[:-1]])))
        keys = key_of(t.a, t.b)
        first, of, _ = _distinct(keys)
        keys = keys[first]
        less, total = np.bincount(of, _discount(m.high, t.n), len(keys)), np.bincount(of, t.n, len(keys))
        self.context = Lookup(keys, np.log(less / np.maximum(total, 1)))
        self.triple = Lookup(key_of(t.a, t.b, t.c), np.log1p((t.n - _discount(m.high, t.n)) / less[of] / seconds(key_of(t.b, t.c))))

    def __call__(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = self.middle(b)
        at, values = self.pair.found(key_of(b, c))
        out[at] += values
        seen = np.zeros(len(b), bool)
        seen[at] = True
        at, values = self.context.found(key_of(a, b))
        out[at] += values
        at = at[seen[at]]  # a triple stands only where its pair and its context do
        out[at] += self.triple(key_of(a[at], b[at], c[at]))
        return out


def _together(rows: Iterator[bytes], most: int = 150_000) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Packed documents taken together, about so many triples or words at a time: their idents, to which of these each triple
    or word belongs, and what is packed."""
    idents, sizes, packed, held = [], [], [], 0
    for data in rows:
        (n,) = struct.unpack_from("<I", data)
        idents.append(np.frombuffer(data, np.int64, n, 4))
        sizes.append(np.frombuffer(data, np.uint32, n, 4 + 8 * n))
        packed.append(data[4 + 12 * n :])
        held += int(sizes[-1].sum())
        if held >= most:
            yield np.concatenate(idents), np.repeat(np.arange(sum(map(len, sizes))), np.concatenate(sizes)), packed
            idents, sizes, packed, held = [], [], [], 0
    if packed:
        yield np.concatenate(idents), np.repeat(np.arange(sum(map(len, sizes))), np.concatenate(sizes)), packed


def _round(docs: DataFrame, trusted: DataFrame | None, model: Model, r: int) -> DataFrame:
    """ident, logp, n: what the shards of a round add to the log probability of documents, in n predicted words."""
    m = model._replace(answers=None)
    rows = model.answers.where((F.pmod("shard", F.lit(m.deal.rounds)) == r) & F.col("kind").isin(WORDS, HOT_PAIRS, KNOWN_WORDS))
    if trusted is not None:
        rows = rows.union(_sent_triples(trusted, m.deal, m.deal.rounds, r))
    rows = rows.union(_sent_docs(docs, m.deal, m.deal.rounds, r)).drop("told")

    def run(batches):
        for _, its in _grouped(batches):
            told: dict[int, list[bytes]] = {WORDS: [], HOT_PAIRS: [], TRUSTED: [], KNOWN_WORDS: []}
            single = shard = None
            for kind, rows in groupby(its, key=lambda it: it[0]):
                if kind in told:
                    told[kind] += [data for _, data in rows]
                    continue
                for ident, of, packed in _together(data for _, data in rows):
                    if kind == DOC_WORDS:
                        if single is None:
                            known = [unpack(x, 1) for x in told[KNOWN_WORDS]]
                            n1 = np.concatenate([np.zeros(0), *(n[0] for _, n in known)])
                            single = Lookup(np.concatenate([np.zeros(0, np.uint64), *(w[0] for w, _ in known)]), np.log1p((n1 - 0.5) / m.pairs / m.unknown))
                            told[KNOWN_WORDS], known, n1 = [], None, None  # a task holds a shard once
                        c, n = (np.concatenate(x) for x in zip(*((w[0], k[0]) for w, k in (unpack(x, 1) for x in packed)), strict=True))
                        value = (single(c) + np.log(m.unknown)) * n
                        counted = np.bincount(of, n, len(ident)).astype(np.int64)
                    else:
                        if shard is None:
                            single, shard = None, Shard(m, told)
                            told[TRUSTED], told[WORDS], told[HOT_PAIRS] = [], [], []
                        value = shard(*(np.concatenate(x) for x in zip(*(unpack(x, 3)[0] for x in packed), strict=True)))
                        counted = np.zeros(len(ident), np.int64)
                    sums = np.bincount(of, value, len(ident))
                    for k in range(0, len(ident), 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in (ident, sums, counted)], schema=SUMS)

    sums = _at_shards(rows, m.deal).mapInArrow(run, SUMS_DDL)
    return sums.groupBy("ident").agg(F.sum("logp").alias("logp"), F.sum("n").alias("n"))


def word_perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame | None:
    """ident, word_perplexity for every (ident, text) of docs by the model of the trusted texts (text); rows of one ident must
    have one text. A third column of docs (boolean) may name the rows that are the trusted texts, which are then read once a
    round and not twice. No row where the text is empty; None without trusted text."""
    apart = len(docs.columns) < 3
    model = _trained(trusted, ROUNDS_APART if apart else ROUNDS)
    if model is None:
        return None
    with shuffles_dropped(docs.sparkSession):
        parts = [materialise(_round(docs, trusted if apart else None, model, r), "word-sums") for r in range(model.deal.rounds)]
        drop_scratch(model.answers)
        sums = reduce(DataFrame.union, parts).groupBy("ident").agg(F.sum("logp").alias("logp"), F.sum("n").alias("n"))
        out = materialise(sums.select("ident", F.exp(-F.col("logp") / F.col("n")).alias("word_perplexity")), "word-perplexities")
        drop_scratch(*parts)
    return out
