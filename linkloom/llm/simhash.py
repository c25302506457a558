"""SimHash near-duplicates by covering anchors.

Blocks of equal bits, as in banding, give most of the selectivity here; the covering code gives the rest.

Fingerprints of 64 bits link at `most` (2) or fewer differing bits. Of the three blocks into which the bits are cut, a linked
pair agrees on at least one, which is its own anchor (a code of radius 0). Of the other bits, 23 are covered by the anchors of
the binary Golay code: it is perfect, every word lies within the covering radius 3 of exactly one code word. A fingerprint
lives at that home anchor, and is replicated to every anchor within covering radius plus threshold (5): about 22. The pair's
other member lives at one of them, because its own home lies within 3 of it and so within 5 of this one. So a join on (block,
block value, anchor) meets every linked pair, with 33 bits of selectivity; candidates are compared there.

Equal fingerprints are one node from the start, so a group of copies costs one row. Components come from rounds of hooking
every node to its smallest neighbour, pointer jumping and contracting the links, each round written to the shared folder.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batched, drop_scratch, fresh, lean, materialise

BLOCKS = ((0, 21), (21, 21), (42, 22))  # first bit, bits
GOLAY = 0b101011100011  # generator polynomial of the [23, 12] code
RADIUS = 3


def _remainder(words: np.ndarray) -> np.ndarray:
    """Syndromes: words of 23 bits modulo the generator polynomial."""
    out = words.astype(np.uint32)
    for bit in range(22, 10, -1):
        out = np.where(out >> np.uint32(bit) & np.uint32(1), out ^ np.uint32(GOLAY << (bit - 11)), out)
    return out


@functools.cache
def _near(reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flips of at most reach bits, grouped by syndrome: flips, first of each syndrome, number of each syndrome."""
    flips = [0]
    for bit in range(23):
        flips += [f | 1 << bit for f in flips if f.bit_count() < reach]
    flips = np.array(sorted(flips, key=int.bit_count), np.uint32)
    syndromes = _remainder(flips)
    order = np.argsort(syndromes, kind="stable")
    n = np.bincount(syndromes, minlength=2048)
    return flips[order], np.concatenate(([0], np.cumsum(n)[:-1])), n


def anchors(words: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Code words within reach of words of 23 bits: index of the word, code word. reach 3 gives each word's only home."""
    flips, first, n = _near(reach)
    s = _remainder(words)
    count = n[s]
    owner = np.repeat(np.arange(len(words)), count)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return owner, words[owner] ^ flips[first[s][owner] + within]


def keys(prints: np.ndarray, block: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the fingerprint and join key for a block: block number, block value and anchor in one integer."""
    start, bits = BLOCKS[block]
    rest = np.concatenate([np.arange(start), np.arange(start + bits, 64)])[:23]
    value = prints >> np.uint64(start) & np.uint64((1 << bits) - 1)
    words = np.zeros(len(prints), np.uint32)
    for k, bit in enumerate(rest):
        words |= (prints >> np.uint64(bit) & np.uint64(1)).astype(np.uint32) << np.uint32(k)
    owner, anchor = anchors(words, reach)
    return owner, ((np.int64(block) << 45) | value[owner].astype(np.int64) << 23 | anchor.astype(np.int64))


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a text in UTF-8, lower-cased A-Z: over its shingles, repeats included; 0 without words."""
    words = text.lower().split()  # bytes: splits at 20 and 09-0D only
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return h(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = (starts + sizes)[shingle - 1 :].tolist()
    n = len(ends)
    hashes = np.zeros(-(-n // 255) * 255, np.uint64)
    hashes[:n] = [h(joined[a:b], seed) for a, b in zip(starts.tolist(), ends)]
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = bits.reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)  # 255 rows fit a byte
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("content", pa.int64())])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long) and content (hash of the text) of every row; null counts as empty."""

    def run(batches):
        def rows():
            for b in batches:
                for i, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                    fp, content = fingerprint(text, shingle), xxhash.xxh64_intdigest(text, 42)
                    yield i, fp - (fp >> 63 << 64), content - (content >> 63 << 64)

        yield from batched(rows(), PRINTS)

    return lean(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long, content long")


def _placed(prints: DataFrame, reach: int, name: str) -> DataFrame:
    def run(batches):
        for b in batches:
            fp = np.asarray(b.column(0)).astype(np.int64)
            for at in range(0, len(fp), 2000):
                part = fp[at : at + 2000]
                for block in range(len(BLOCKS)):
                    owner, key = keys(part.view(np.uint64), block, reach)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[owner])], ["key", name])

    return prints.mapInArrow(run, f"key long, {name} long")


def links(prints: DataFrame, most: int = 2) -> DataFrame:
    """Pairs a < b of different fingerprints (column fp, distinct) that differ in at most `most` (0 to 2) bits, each once."""
    if not 0 <= most <= 2:
        raise ValueError("three blocks find pairs of at most 2 differing bits")
    homes, guests = _placed(prints, RADIUS, "a"), _placed(prints, RADIUS + most, "b")
    # Spark takes what a Python stage returns to be as large as what it reads, so it would broadcast the 66 guests of each print.
    met = homes.hint("merge").join(guests, (homes["key"] == guests["key"]) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most))
    return met.select("a", "b").distinct()


def components(pairs: DataFrame, tag: str = "components") -> DataFrame:
    """node, root for every node of the links (a, b); root is the smallest node of its component.

    A round hooks every node to its smallest neighbour, if smaller, follows those pointers to their ends and replaces the
    links by links between ends: every component loses at least half of its nodes that still have links."""
    rest = materialise(pairs, f"{tag}-links")
    found: DataFrame | None = None
    while not rest.isEmpty():
        both = rest.union(rest.select(F.col("b"), F.col("a"))).toDF("node", "other")
        up = materialise(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("root")), f"{tag}-up")
        while True:
            to = up.select(F.col("node").alias("root"), F.col("root").alias("end"))
            jumped = materialise(up.join(to, "root").select("node", F.col("end").alias("root"), (F.col("end") != F.col("root")).alias("moved")), f"{tag}-jump")
            drop_scratch(up)
            up = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        before = found
        found = up if found is None else materialise(
            found.join(up.select(F.col("node").alias("root"), F.col("root").alias("end")), "root", "left").select("node", F.coalesce("end", "root").alias("root")), f"{tag}-found"
        )
        a, b = up.select(F.col("node").alias("a"), F.col("root").alias("ra")), up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        ends = rest.join(a, "a").join(b, "b").where("ra <> rb")
        used, rest = rest, materialise(ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"{tag}-links")
        drop_scratch(used, *([before, up] if before is not None else []))  # what later rounds don't read
    return found if found is not None else rest.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 2) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hexadecimal digits), component_id, n_links, content.

    Words are what stands between bytes 20 and 09-0D, lower-cased A-Z; a text of fewer words than a shingle is one shingle, a
    text without words (null: empty) has fingerprint 0 and links like any other. component_id is the smallest id reachable
    over links, itself included (null ids are reached but never the smallest; null if all are). n_links: other fingerprints
    linked to the row's own. Repeated rows get the same answer; an empty table gives an empty result."""
    rows = materialise(fingerprints(docs, id_col, text_col, shingle), "prints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    pairs = materialise(links(nodes.select("fp"), most), "pairs")
    roots = components(pairs)
    degrees = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    named = nodes.join(roots.join(degrees, "node"), nodes["fp"] == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    named = materialise(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = materialise(named.join(least, "root").select("fp", "component_id", "n_links"), "groups")  # an exchange right below the join lets Spark split a hot fingerprint
    return rows.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links", "content")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that name their component: of each group of near copies, the smallest id. Rows without
    an id stay only if their whole group has none; rows that repeat both id and text stay together."""
    kept = near_duplicates(docs, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "content").distinct()
    key, who, content = fresh(docs, "key", "who", "of")
    rows = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return rows.join(kept.toDF(who, content), F.col(id_col).eqNullSafe(F.col(who)) & (F.col(key) == F.col(content)), "left_semi").drop(key)
