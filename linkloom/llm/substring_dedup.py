"""Substring dedup: windows of a fixed number of words that an earlier document has as well.

A window's Rabin-Karp hash is the polynomial of its words' hashes, taken from prefix sums: modulo 2 ** 64 with an odd base,
which has an inverse, and a second polynomial of which 32 bits are kept, 96 bits in all. Spark counts windows: for each
hash, the smallest document that starts it.

Windows that cannot repeat are told apart before they are shuffled. Every window names its minimiser: of its sub-windows of
`seed_words` words, the one with the least hash (the leftmost of equals). Equal windows have equal minimisers, so a window
whose minimiser stands in one document only is in that document only. Pass 1 counts minimisers (about one for each tenth
window) and sets a bit of a fixed-size bitmap for those that stand in two documents or more. Pass 2 counts the windows whose
minimiser's bit is set. A bit set by chance costs a row and changes no result.

Pass 2 sends the consecutive windows of one minimiser as one row (a run), dealt by minimiser; where the windows meet, Spark
takes the smallest document of each hash. A minimiser of more runs than a share of an average task, be it of many documents or
of one that repeats a line, is dealt over several groups by document and position, so many that each keeps to that share; there
are never more such minimisers than a multiple of the tasks. The first windows of their groups meet once more, by hash.

Repeated windows are kept as bitmaps of 64 places each and merge into maximal intervals of words to remove.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, batched, lean, materialise, signed

U = np.uint64
BASE_1, BASE_2 = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, U), np.cumprod(np.full(max(n - 1, 0), base & MASK, U))])[:n]


class Rolling:
    """Polynomial hashes of all windows of a sequence of 64-bit values. Powers are kept and grow with the longest text."""

    def __init__(self, base: int):
        self.base, self.inverse = base & MASK, pow(base, -1, 1 << 64)
        self.up, self.down = _powers(self.base, 1024), _powers(self.inverse, 1024)

    def __call__(self, values: np.ndarray, size: int) -> np.ndarray:
        n = len(values)
        if n < size:
            return np.zeros(0, U)
        if n > len(self.up):
            self.up, self.down = _powers(self.base, 2 * n), _powers(self.inverse, 2 * n)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(values * self.up[:n])])
        h = (sums[size:] - sums[:-size]) * self.down[: n - size + 1]
        h ^= h >> U(32)  # the low bits of a sum modulo 2 ** 64 depend on low bits only
        h *= U(0xD6E8FEB86659FD93)
        return h ^ (h >> U(32))


def words_of(text: bytes) -> list[bytes]:
    return text.split()  # bytes: splits at 20 and 09-0D only


def word_values(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), U, len(words))


def minimisers(seeds: np.ndarray, span: int) -> np.ndarray:
    """For each run of `span` seeds, the index of its least, the leftmost of equals (sparse doubling)."""
    index, reach = np.arange(len(seeds)), 1
    while reach * 2 <= span:
        a, b = index[:-reach], index[reach:]
        index, reach = np.where(seeds[b] < seeds[a], b, a), reach * 2
    if reach < span:
        a, b = index[: len(index) - (span - reach)], index[span - reach :]
        index = np.where(seeds[b] < seeds[a], b, a)
    return index


SEEDS = pa.schema([("seed", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("n", pa.int64())])
RUNS_DDL = "seed long, salt int, doc_id long, content long, at int, h array<long>, c array<int>"


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return lean(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def shared_seeds(source: DataFrame, window: int, seed_words: int) -> DataFrame:
    """seed, n: the minimisers that stand in two documents or more, and how many runs of windows name them."""

    def run(batches):
        roll = Rolling(BASE_1)
        for b in batches:
            ids, seeds, times = [], [], []
            for i, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                words = words_of(text)
                if i is None or len(words) < window:
                    continue
                h = roll(word_values(words), seed_words)
                mine, n = np.unique(h[np.unique(minimisers(h, window - seed_words + 1))], return_counts=True)
                seeds.append(mine)
                times.append(n)
                ids.append(np.full(len(mine), i, np.int64))
            if seeds:
                h, i, n = np.concatenate(seeds), np.concatenate(ids), np.concatenate(times)
                order = np.lexsort((i, h))
                h, i, n = h[order], i[order], np.concatenate([[0], np.cumsum(n[order])])
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                last = np.concatenate([first[1:], [len(h)]])
                for k in range(0, len(first), 10_000):
                    f, z = first[k : k + 10_000], last[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(h[f].view(np.int64)), pa.array(i[f]), pa.array(i[z - 1]), pa.array(n[z] - n[f])], schema=SEEDS)

    found = source.mapInArrow(run, "seed long, low long, high long, n long")
    return found.groupBy("seed").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).where("low < high").select("seed", "n")


def bitmap(seeds: DataFrame, bits: int) -> np.ndarray:
    """2 ** bits bits, set where seeds fall. Spark's aggregate sets them; what reaches the driver is at most the bitmap."""
    rows = seeds.select(F.shiftrightunsigned("seed", 70 - bits).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - bits}) & 63 as int))").alias("bit"))
    table = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[np.asarray(table.column("word")).astype(np.int64)] = np.asarray(table.column("bits"))
    return out.view(U)


def hot_seeds(seeds: DataFrame, hot_share: float) -> tuple[np.ndarray, np.ndarray]:
    """Minimisers (sorted) that get more runs than hot_share of an average task, and the groups over which each is dealt. At
    most tasks / hot_share of them can exist."""
    tasks = int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(1.0, (seeds.agg(F.sum("n")).first()[0] or 0) * hot_share / tasks)
    table = seeds.where(F.col("n") > most).select("seed", F.ceil(F.col("n") / F.lit(most)).alias("groups")).toArrow()
    hot, groups = np.asarray(table.column(0)).astype(np.int64).view(U), np.asarray(table.column(1)).astype(np.int64)
    order = np.argsort(hot)
    return hot[order], groups[order]


def _marked(marks: np.ndarray, seeds: np.ndarray, bits: int) -> np.ndarray:
    place = seeds >> U(64 - bits)
    return (marks[(place >> U(6)).astype(np.int64)] >> (place & U(63)) & U(1)).astype(bool)


def _salts(seeds: np.ndarray, i: int, at: np.ndarray, hot: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Groups of runs, by a hash of document and position; -1 where the minimiser is not hot."""
    if not len(hot):
        return np.full(len(seeds), -1, np.int32)
    place = np.minimum(np.searchsorted(hot, seeds), len(hot) - 1)
    x = (at.astype(U) + U(i & MASK) * U(BASE_1)) * U(BASE_2)
    return np.where(hot[place] == seeds, ((x >> U(32)) % groups[place].astype(U)).astype(np.int32), -1).astype(np.int32)


def _runs(source: DataFrame, marks, window: int, seed_words: int, bits: int) -> DataFrame:
    """The windows of marked minimisers, those that follow each other under one minimiser as one row."""

    def out(parts):
        seeds, salts, ids, contents, at, sizes, h, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (h.view(np.int64), c.view(np.int32))]
        return pa.RecordBatch.from_arrays([*map(pa.array, (seeds.view(np.int64), salts, ids, contents, at)), *lists], ["seed", "salt", "doc_id", "content", "at", "h", "c"])

    def run(batches):
        one, two, (shared, hot, groups) = Rolling(BASE_1), Rolling(BASE_2), marks.value
        parts, held = [], 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                words = words_of(text)
                if i is None or len(words) < window:
                    continue
                values = word_values(words)
                seeds = one(values, seed_words)
                least = minimisers(seeds, window - seed_words + 1)
                at = np.flatnonzero(_marked(shared, seeds, bits)[least])
                if not len(at):
                    continue
                starts = np.flatnonzero(np.concatenate([[True], (np.diff(least[at]) != 0) | (np.diff(at) != 1)]))
                first, mine = at[starts], seeds[least[at[starts]]]
                alike = lambda x, n=len(starts): np.full(n, x, np.int64)
                h, c = one(values, window)[at], (two(values, window)[at] >> U(32)).astype(np.uint32)
                parts.append((mine, _salts(mine, i, first, hot, groups), alike(i), alike(signed(xxhash.xxh64_intdigest(text, 42))), first.astype(np.int32), np.diff(starts, append=len(at)), h, c))
                held += len(at)
                if held > 200_000:
                    yield out(parts)
                    parts, held = [], 0
        if parts:
            yield out(parts)

    return source.mapInArrow(run, RUNS_DDL)


def repeated_windows(source: DataFrame, window: int, seed_words: int, bits: int, hot_share: float) -> DataFrame:
    """doc_id, content, block, bits: windows that start in a document with a smaller id as well, by their first words; bit k
    of block b is word 64 b + k."""
    seeds = materialise(shared_seeds(source, window, seed_words), "seeds")
    marks = source.sparkSession.sparkContext.broadcast((bitmap(seeds, bits), *hot_seeds(seeds, hot_share)))
    dealt = _runs(source, marks, window, seed_words, bits).repartition("seed", "salt")
    each = dealt.select("seed", "salt", "doc_id", "content", "at", F.posexplode(F.arrays_zip("h", "c")).alias("k", "w"))
    each = each.select("seed", "salt", F.col("w.h").alias("h"), F.col("w.c").alias("c"), "doc_id", "content", (F.col("at") + F.col("k")).alias("at"))
    counted = each.withColumn("low", F.min("doc_id").over(Window.partitionBy("seed", "salt", "h", "c")))  # where the rows are
    again = F.col("doc_id") > F.col("low")
    place = (F.shiftright("at", 6).alias("block"), F.expr("shiftleft(1L, at & 63)").alias("bit"))
    noted = counted.where(again | (F.col("salt") >= 0)).select("doc_id", "content", *place, F.when(~again, F.col("h")).alias("h"), F.when(~again, F.col("c")).alias("c"))
    noted = materialise(noted.groupBy("doc_id", "content", "block", "h", "c").agg(F.bit_or("bit").alias("bits")), "windows")
    firsts = noted.where("h is not null")
    least = materialise(firsts.groupBy("h", "c").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h", "c", "low"), "firsts")
    # A first window of one group is the smallest there; its copies there are known, those of other groups are here.
    late = firsts.join(least, ["h", "c"]).where(F.col("doc_id") > F.col("low")).select("doc_id", "content", "block", "bits")
    return noted.where("h is null").select("doc_id", "content", "block", "bits").unionByName(late)


def merged(blocks: np.ndarray, bits: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of the maximal intervals that windows cover."""
    order = np.argsort(blocks, kind="stable")
    blocks = blocks[order]
    first = np.flatnonzero(np.diff(blocks, prepend=-1))
    grid = np.unpackbits(np.bitwise_or.reduceat(bits[order], first).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(grid)
    at = blocks[first][row].astype(np.int64) * 64 + bit
    cut = np.flatnonzero(np.diff(at) > window)
    return at[np.concatenate([[0], cut + 1])], at[np.append(cut, len(at) - 1)] + window


SPANS = pa.schema([("doc_id", pa.int64()), ("content", pa.int64()), ("firsts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, seed_words: int = 30, bits: int = 26, hot_share: float = 0.25) -> DataFrame:
    """doc_id, content, firsts, ends: for each document that loses words, maximal intervals [first word, end) in order."""

    def run(batches):
        def rows():
            for b in batches:
                ends, flat = b.column(2).offsets.to_numpy(), b.column(2).values
                blocks, marks = (np.asarray(flat.field(k)) for k in (0, 1))
                for k, (i, content) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                    at = slice(ends[k], ends[k + 1])
                    first, end = merged(blocks[at], marks[at], window)
                    yield i, content, first.tolist(), end.tolist()

        yield from batched(rows(), SPANS, weigh=2)

    found = repeated_windows(_source(docs, id_col, text_col), window, seed_words, bits, hot_share)
    listed = found.groupBy("doc_id", "content").agg(F.collect_list(F.struct("block", "bits")).alias("places"))
    return listed.mapInArrow(run, "doc_id long, content long, firsts array<int>, ends array<int>")


KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
TEXTS = pa.schema([("doc_id", pa.int64()), ("kept", pa.string())])


def _joined(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    spans = materialise(removals(docs, id_col, text_col, **options), "removals")
    source = _source(docs, id_col, text_col).withColumn("content", F.xxhash64("text"))
    # The table of removals grows with the corpus: joined by a shuffle at every size.
    return source.join(spans.hint("merge"), ["doc_id", "content"], "left").select("doc_id", "text", "firsts", "ends")


def _kept_words(text: bytes, firsts, ends) -> tuple[int, list[bytes]]:
    words = words_of(text)
    if not firsts:
        return len(words), words
    out, at = [], 0
    for a, b in zip(firsts, ends, strict=True):
        out += words[at:a]
        at = b
    return len(words), out + words[at:]


def _each(out, schema, weigh=None):
    def run(batches):
        def rows():
            for b in batches:
                for i, text, f, e in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    n, kept = _kept_words(text, f, e)
                    yield out(i, n, kept)

        yield from batched(rows(), schema, weigh=weigh)

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, seed_words: int = 30, bits: int = 26, hot_share: float = 0.25) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    Words stand between bytes 20 and 09-0D, unchanged; null counts as no words. A word goes if a window of `window` words that
    covers it also starts in a document with a smaller id; windows are judged on the input. Rows without an id lose nothing
    and cause no loss; rows that repeat an id don't cause each other loss. An empty table gives an empty result. hot_share: the
    share of an average task's runs above which a minimiser is dealt over several groups; results don't depend on it."""

    def out(i, n, kept):
        return i, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    return _joined(docs, id_col, text_col, window=window, seed_words=seed_words, bits=bits, hot_share=hot_share).mapInArrow(_each(out, KEPT), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def kept_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, seed_words: int = 30, bits: int = 26, hot_share: float = 0.25) -> DataFrame:
    """doc_id and the kept words of every row joined by one space."""

    def out(i, n, kept):
        return i, b" ".join(kept).decode("utf-8", "replace")

    return _joined(docs, id_col, text_col, window=window, seed_words=seed_words, bits=bits, hot_share=hot_share).mapInArrow(_each(out, TEXTS, 1), "doc_id long, kept string")
