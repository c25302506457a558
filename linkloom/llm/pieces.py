"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the model holds the whitespace marker after another character, so no piece crosses the start of a marked word:
the ids of a text are the ids of its marked words, one after another. A task keeps a table of the distinct marked words it
has met; the library segments each of them once, and a text's ids are the table's entries joined by position. The join stays
in the task: a table of the whole corpus would have to be sent to every task, or every word's position shuffled.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batched, lean

MARK = "▁"
_models: dict[str, ChunkTable] = {}


class ChunkTable(dict):
    """chunk -> (ids as decimal text with a leading comma, decoded text). A chunk is a run of spaces and what follows up to
    the next space; a line feed, which stands in no piece, starts a chunk as well."""

    def __init__(self, model: bytes):
        import sentencepiece

        super().__init__()
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("this model has pieces that cross a whitespace marker")
        if self.sp.normalize(" a  b ") != f"{MARK}{MARK}a{MARK}{MARK}b{MARK}":
            raise ValueError("this model's normaliser changes more than the dummy prefix and the markers")
        self.line = not any("\n" in p for p in pieces)
        self.split = re.compile("\n[^ \n]*| +[^ \n]*|[^ \n]+" if self.line else " +[^ ]*|[^ ]+").findall
        self.mark = self.sp.piece_to_id(MARK)
        self.lead = self.sp.piece_to_id("a")

    def __missing__(self, chunk: str) -> tuple[str, str]:
        if chunk[0] == " ":
            ids = self.sp.encode(chunk[1:]) if len(chunk) > 1 else [self.mark]
        else:  # the library puts a marker before any text; before a line feed nothing merges with it
            ids = self.sp.encode(chunk)
            if ids[0] != self.mark:
                raise ValueError(f"no lone marker before {chunk!r}")
            ids = ids[1:]
        self[chunk] = out = ("".join(f",{i}" for i in ids), self.sp.decode([self.lead, *ids])[1:])
        return out

    def encode(self, text: str) -> tuple[str, str]:
        """Ids as decimal text joined by commas, and the text that they decode to."""
        if not text:
            return "", ""
        found = [self[c] for c in self.split(" " + text.replace(MARK, " "))]
        return "".join([x for x, _ in found])[1:], "".join([y for _, y in found])[1:]


def chunk_table(model: bytes) -> ChunkTable:
    """The table of this process for a model."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _models:
        _models[key] = ChunkTable(model)
    return _models[key]


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
CODES_DDL = "doc_id long, ids array<int>, decoded string"
CODES = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def _each(model, most_chunks: int, out, schema: pa.Schema, weigh: int | None):
    def run(batches):
        table = chunk_table(model.value)

        def rows():
            for b in batches:
                for i, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                    yield out(i, *table.encode(text.decode("utf-8", "replace")))
                    if len(table) > most_chunks:
                        table.clear()

        yield from batched(rows(), schema, weigh=weigh)
        table.clear()  # a worker outlives its task, and other operators' tasks run in it

    return run


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return lean(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _model(docs: DataFrame, model_path: str):
    """The model's bytes, half a megabyte whatever the corpus."""
    with open(model_path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", most_chunks: int = 200_000) -> DataFrame:
    """doc_id, ids and decoded text of every row; ids as the library's encode(text) gives them, without begin and end ids. A
    null text counts as empty and has no ids. most_chunks: entries at which a task's table starts anew; results don't depend
    on it."""

    def out(i, ids, decoded):
        return i, [int(x) for x in ids.split(",")] if ids else [], decoded

    return _source(docs, id_col, text_col).mapInArrow(_each(_model(docs, model_path), most_chunks, out, CODES, 2), CODES_DDL)


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", most_chunks: int = 200_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256 of every row, as encode_pieces() would
    give them. A null text counts as empty; repeated rows each give a row; other columns are not read; an empty table gives an
    empty result."""

    def out(i, ids, decoded):
        return i, ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    return _source(docs, id_col, text_col).mapInArrow(_each(_model(docs, model_path), most_chunks, out, DIGESTS, None), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
