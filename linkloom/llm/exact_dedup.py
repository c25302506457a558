"""Exact deduplication with Patricia tries.

Each map task inserts its texts into a compressed radix trie and hands on one row for each distinct text (a partial
aggregate: full byte string, smallest and largest id, count). Those rows are dealt by length and content hash; the owner of
a (length, hash) inserts the full byte strings into a trie of its own, whose terminal nodes keep the smallest and the largest
identifier. A trie over its memory budget hands its largest subtree on, as partial aggregates too, and forgets it: the last,
small aggregate by digest merges what came in parts. So neither a hot text nor a large partition has to fit anywhere: a text
that a third of all rows carry reaches its owner once for each map task and salt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batched, fresh, lean, materialise, signed

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = b"abcdefghijklmnopqrstuvwxyz"
NODE_BYTES = 240


class _Node:
    __slots__ = ("edges", "held", "label")

    def __init__(self, label: bytes, held: list | None = None):
        self.label, self.edges, self.held = label, {}, held


def _shared(a: bytes, b: bytes, at: int) -> int:
    """How many bytes a has in common with b from position at of b on."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def _most(a, b):
    return b if a is None else a if b is None else max(a, b)


class PatriciaTrie:
    """A compressed radix trie over byte strings. Terminal nodes hold [smallest id, largest id, rows]."""

    def __init__(self) -> None:
        self.root, self.bytes = _Node(b""), 0

    def insert(self, key: bytes, low, high, rows: int) -> None:
        node, at, end = self.root, 0, len(key)
        while at < end:
            child = node.edges.get(key[at])
            if child is None:
                node.edges[key[at]] = child = _Node(key[at:])
                self.bytes += end - at + NODE_BYTES
                node, at = child, end
                break
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            n = _shared(child.label, key, at)
            middle = _Node(child.label[:n])
            child.label = child.label[n:]
            middle.edges[child.label[0]] = child
            node.edges[key[at]] = middle
            self.bytes += NODE_BYTES
            node, at = middle, at + n
        if node.held is None:
            node.held = [low, high, rows]
        else:
            h = node.held
            h[0], h[1], h[2] = _least(h[0], low), _most(h[1], high), h[2] + rows

    @staticmethod
    def _walk(node: _Node) -> Iterator[tuple[bytes, list]]:
        todo = [(node, node.label)]
        while todo:
            node, key = todo.pop()
            if node.held is not None:
                yield key, node.held
            todo.extend((x, key + x.label) for x in node.edges.values())

    def items(self) -> Iterator[tuple[bytes, list]]:
        return self._walk(self.root)

    def spill(self) -> Iterator[tuple[bytes, list]]:
        """The entries of the largest subtree under the root, which the trie then forgets."""

        def weight(node: _Node) -> int:
            total, todo = 0, [node]
            while todo:
                x = todo.pop()
                total += len(x.label) + NODE_BYTES
                todo.extend(x.edges.values())
            return total

        edge, size = max(((k, weight(x)) for k, x in self.root.edges.items()), key=lambda p: p[1])
        node = self.root.edges.pop(edge)
        self.bytes -= size
        return self._walk(node)


def _folded(column: pa.Array) -> list[bytes]:
    return [b.lower() for b in as_bytes(column)]  # bytes.lower() is A-Z only


PARTS = pa.schema([("n_bytes", pa.int64()), ("content_hash", pa.int64()), ("salt", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("rows", pa.int64()), ("body", pa.binary())])
PARTS_DDL = "n_bytes long, content_hash long, salt int, low long, high long, rows long, body binary"
OWNED = pa.schema([("digest", pa.binary()), ("low", pa.int64()), ("high", pa.int64()), ("rows", pa.int64())])
KEYED = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary())])


def _local(budget: int, salts: int):
    def run(batches):
        from pyspark import TaskContext

        trie, salt = PatriciaTrie(), TaskContext.get().partitionId() % salts

        def part(entry):
            key, (low, high, rows) = entry
            return len(key), signed(xxhash.xxh64_intdigest(key)), salt if rows > 1 else 0, low, high, rows, key

        def rows():
            for b in batches:
                for i, key in zip(b.column(0).to_pylist(), _folded(b.column(1)), strict=True):
                    trie.insert(key, i, i, 1)
                    while trie.bytes > budget and trie.root.edges:
                        yield from map(part, trie.spill())
            yield from map(part, trie.items())

        yield from batched(rows(), PARTS, weigh=6)

    return run


def _owners(budget: int):
    def run(batches):
        trie = PatriciaTrie()

        def own(entry):
            key, (low, high, rows) = entry
            return hashlib.sha256(key).digest(), low, high, rows

        def rows():
            for b in batches:
                for low, high, n, key in zip(*(b.column(k).to_pylist() for k in (3, 4, 5, 6)), strict=True):
                    trie.insert(key, low, high, n)
                    while trie.bytes > budget and trie.root.edges:
                        yield from map(own, trie.spill())
            yield from map(own, trie.items())

        yield from batched(rows(), OWNED)

    return run


def _digests(batches):
    def rows():
        for b in batches:
            for i, key in zip(b.column(0).to_pylist(), _folded(b.column(1)), strict=True):
                yield i, hashlib.sha256(key).digest()

    yield from batched(rows(), KEYED)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", trie_bytes: int = 64 << 20, salts: int = 16) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; a null text counts as empty. keep: whether the row with the
    "largest" or the "smallest" id stays. A null id is never kept unless all ids of its group are null; rows that repeat both
    id and text are one document and get the same answer. An empty table gives an empty result; other columns are not read.
    trie_bytes: memory of one trie; over it, subtrees are handed on in parts. salts: owners among which the partial rows of
    one repeated text are dealt.
    """
    source = lean(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = source.mapInArrow(_local(trie_bytes, salts), PARTS_DDL)
    owned = parts.repartition("n_bytes", "content_hash", "salt").mapInArrow(_owners(trie_bytes), "digest binary, low long, high long, rows long")
    owners = owned.groupBy("digest").agg((F.max("high") if keep == "largest" else F.min("low")).alias("keep_id"), F.sum("rows").alias("group_size"))
    owners = materialise(owners, "owners")  # an exchange right below the join lets Spark split a hot digest
    keyed = source.mapInArrow(_digests, "doc_id long, digest binary")
    return keyed.join(owners, "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of docs, all columns, that exact_dedup() keeps. Rows that repeat both id and text stay together."""
    kept = exact_dedup(docs, id_col, text_col, keep).where("kept").select("doc_id", F.unhex("text_sha256")).distinct()
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER.decode(), LOWER.decode())
    key, who, digest = fresh(docs, "key", "who", "digest")
    rows = docs.withColumn(key, F.unhex(F.sha2(text.cast("binary"), 256)))
    return rows.join(kept.toDF(who, digest), F.col(id_col).eqNullSafe(F.col(who)) & (F.col(key) == F.col(digest)), "left_semi").drop(key)


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
"""
