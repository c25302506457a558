"""Near copies for the pipeline: groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more,
joined with SimHash's groups.

Candidates come from 20 bands of 4 minimum hashes: a pair of similarity s meets with probability 1 - (1 - s^4)^20, 0.99997 at
0.8. Each is verified on the shingles of the whole texts. A band's texts are first held against the smallest of them, so a group
of copies costs as many pairs as it has texts. What is left are texts of different components that share a band, as those with
a common passage do: they are compared where they meet, in blocks, each pair in the first band that it shares, by signatures (a
byte of each minimum; a similar pair falls below the level three times in 100,000) and then by shingles; a block hands on only
the links that join components. So the links that are written grow with the texts, not with the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batched, fresh, lean, materialise, signed
from .simhash import components, near_duplicates

BANDS, ROWS = 20, 4
_R = np.random.default_rng(42).integers(0, 2**63, (2, BANDS * ROWS), dtype=np.uint64)
FACTORS, SHIFTS = _R[0] * np.uint64(2) + np.uint64(1), _R[1]


def shingles(text: bytes, size: int = 5) -> np.ndarray:
    """Distinct hashes of the shingles of a text, A-Z lower-cased, in order; a text of fewer words is one, without any none."""
    words = text.lower().split()
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(b" ".join(words[k : k + size]), 42) for k in range(max(1, len(words) - size + 1))] if words else [], np.uint64))


def minima(s: np.ndarray) -> np.ndarray:
    """The least value of a set of hashes under each of BANDS * ROWS linear maps."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(s), 500):
        np.minimum(least, (s[k : k + 500, None] * FACTORS + SHIFTS).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> list[int]:
    """One key for each band."""
    return [signed(xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k)) for k in range(BANDS)]


MET = pa.schema([("node", pa.int64()), ("keys", pa.list_(pa.int64()))])
SHORT = pa.schema([("node", pa.int64()), ("signature", pa.binary()), ("keys", pa.binary()), ("held", pa.binary())])
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Texts of one band that are compared in one place.
BLOCK = 1024
SETS = pa.schema([("node", pa.int64()), ("held", pa.binary())])


def _bands(texts: DataFrame, size: int) -> DataFrame:
    def run(batches):
        def rows():
            for b in batches:
                for node, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                    s = shingles(text, size)
                    yield node, band_keys(minima(s)) if len(s) else [0] * BANDS  # texts without words meet

        yield from batched(rows(), MET)

    return texts.mapInArrow(run, "node long, keys array<long>")


def _spanning(held: list[tuple], least: float, agree: int):
    """Links (a, b) of similar texts in a block that join components: (node, root, signature, keys, side, shingles) in parts.
    side: 0 in a block that is held against itself, else -1 or 1, and only texts of different sides are compared."""
    node, root, signature, keys, side = (np.concatenate([x[k] for x in held]) for k in range(5))
    sets = [np.frombuffer(x, np.uint32) for part in held for x in part[5]]
    band, up = held[0][6], {}

    def find(r):
        while up.get(r, r) != r:
            up[r] = r = up.get(up[r], up[r])
        return r

    left = np.flatnonzero(side <= 0)
    right = left if not side.any() else np.flatnonzero(side > 0)
    for i in left.tolist():
        j = right[right > i] if right is left else right
        ok = ((signature[j] == signature[i]).sum(1) >= agree) & (root[j] != root[i]) & ~(keys[j, :band] == keys[i, :band]).any(1)
        for k in j[ok].tolist():
            p, q = find(int(root[i])), find(int(root[k]))
            if p == q:
                continue
            x, y = sets[i], sets[k]
            if min(len(x), len(y)) < least * max(len(x), len(y)):
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both >= least * (len(x) + len(y) - both):
                up[max(p, q)] = min(p, q)
                yield min(int(node[i]), int(node[k])), max(int(node[i]), int(node[k]))


def _joining(mixed: DataFrame, least: float) -> DataFrame:
    """Links a < b that join the components (key, band, node, root, signature, keys, held) of similar texts that share a key."""
    places = BANDS * ROWS
    agree = int(least * places - 4 * (places * least * (1 - least)) ** 0.5)

    def run(batches):
        def rows():
            now, held = None, []
            for b in batches:
                if not b.num_rows:
                    continue
                group = np.stack([np.asarray(b.column(k)) for k in range(3)], 1)
                band, node, root, side = (np.asarray(b.column(k)) for k in range(3, 7))
                signature = np.frombuffer(b"".join(b.column(7).to_pylist()), np.uint8).reshape(-1, places)
                keys = np.frombuffer(b"".join(b.column(8).to_pylist()), np.int64).reshape(-1, BANDS)
                sets = b.column(9).to_pylist()
                cuts = (np.flatnonzero((np.diff(group, axis=0) != 0).any(1)) + 1).tolist()
                for a, z in zip([0, *cuts], [*cuts, len(group)], strict=True):
                    if now != tuple(group[a]):
                        if held:
                            yield from _spanning(held, least, agree)
                        now, held = tuple(group[a]), []
                    held.append((node[a:z], root[a:z], signature[a:z], keys[a:z], side[a:z], sets[a:z], int(band[a])))
            if held:
                yield from _spanning(held, least, agree)

        yield from batched(rows(), PAIRS)

    # Bands of more texts than a block holds are dealt as pairs of blocks (i, j); side tells which of the two a row is of.
    blocks = mixed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("blocks"))
    dealt = mixed.join(blocks, "key").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(low == high, 0).when(F.col("mine") == low, -1).otherwise(1).cast("int")
    dealt = dealt.select("key", low.alias("i"), high.alias("j"), "band", "node", "root", side.alias("side"), "signature", "keys", "held")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long").distinct()


def _similar(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """Of the pairs (a, b) of nodes, those whose shingles are that similar."""

    def sets(batches):
        def rows():
            for b in batches:
                for node, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                    yield node, shingles(text, size).tobytes()

        yield from batched(rows(), SETS, weigh=1)

    def run(batches):
        for x in batches:
            good = []
            for p, q in zip(x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(both >= least * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = materialise(pairs, "copy-candidates")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    held = texts.join(asked, "node", "left_semi").mapInArrow(sets, "node long, held binary").groupBy("node").agg(F.min("held").alias("held"))
    held = materialise(held, "copy-shingles")
    a, b = held.select(F.col("node").alias("a"), F.col("held").alias("p")), held.select(F.col("node").alias("b"), F.col("held").alias("q"))
    return materialise(pairs.join(a, "a").join(b, "b").select("a", "b", "p", "q").mapInArrow(run, "a long, b long"), "copy-links")


def _shortened(texts: DataFrame, size: int) -> DataFrame:
    """node, signature, keys (of all bands, packed) and 32 bits of each shingle's hash, in order."""

    def run(batches):
        def rows():
            for b in batches:
                for node, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                    s = shingles(text, size)
                    least = minima(s)
                    keys = band_keys(least) if len(s) else [0] * BANDS
                    yield node, (least >> np.uint64(16)).astype(np.uint8).tobytes(), np.array(keys, np.int64).tobytes(), np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes()

        yield from batched(rows(), SHORT, weigh=3)

    return texts.mapInArrow(run, "node long, signature binary, keys binary, held binary")


def links(texts: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """Links a < b of nodes (node, text) whose components are those of all pairs of that Jaccard similarity that meet."""
    every = materialise(_bands(texts, size), "copy-bands")
    met = every.select(F.posexplode("keys").alias("band", "key"), "node").distinct()
    first = met.groupBy("band", "key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "key", "a")
    shared = materialise(met.hint("merge").join(first, ["band", "key"]), "copy-shared")  # Spark's estimate is a quarter of these rows
    star = _similar(shared.where("a < node").select("a", F.col("node").alias("b")).distinct(), texts, size, least)
    root = components(star, "copy-stars")
    named = shared.select("band", "key", "node").join(root, "node", "left").select("band", "key", "node", F.coalesce("root", "node").alias("root"))
    mixed = named.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band", "key")
    mixed = materialise(named.join(mixed, ["band", "key"], "left_semi"), "copy-mixed")
    held = _shortened(texts.join(mixed.select("node").distinct(), "node", "left_semi"), size)
    held = materialise(held.groupBy("node").agg(F.min(F.struct("signature", "keys", "held")).alias("x")).select("node", "x.*"), "copy-shortened")
    return star.union(_similar(_joining(mixed.join(held, "node"), least), texts, size, least))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, that have the smallest id of their group of near copies. Groups are components over
    texts that are equal, have `least` Jaccard similarity or more on shingles of `size` words, or are linked by SimHash (its
    own shingles and distance). Exactly one row of each group stays: a row without an id only if its whole group
    has none; ties go to the smallest content hash, and of rows that repeat both id and text any one stays."""
    content = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    texts = lean(docs).select(content.alias("node"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    simhash = materialise(near_duplicates(docs, id_col, text_col), "copy-prints")
    group = F.coalesce(F.col("component_id").cast("string"), F.col("fingerprint"))
    simhash = simhash.select("doc_id", F.col("content").alias("node"), group.alias("group"))
    lead = simhash.groupBy("group").agg(F.min("node").alias("a"))
    near = simhash.join(lead, "group").where("a < node").select("a", F.col("node").alias("b"))
    roots = components(links(texts, size, least).union(near).distinct(), "copies")
    nodes = simhash.groupBy("node").agg(F.min("doc_id").alias("low")).join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    best = nodes.groupBy("root").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "node")).alias("best"))
    key, who, node = fresh(docs, "key", "who", "node")
    kept = best.select(F.col("best.low").alias(who), F.col("best.node").alias(node))
    rows = docs.withColumn(key, content)
    return rows.join(kept, (F.col(key) == F.col(node)) & F.col(id_col).cast("long").eqNullSafe(F.col(who)), "left_semi").dropDuplicates([key]).drop(key)
