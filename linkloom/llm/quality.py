"""Quality by perplexity: an interpolated modified Kneser-Ney trigram model of character classes, trained on trusted text.

Characters are folded into 64 classes, so trigrams are 18-bit codes. Counts of the trusted text are summed in Spark; the log
probabilities of all 262,144 trigrams, 2 MB whatever the text, are sent to all tasks, which score documents where they are read.
Thresholds are quantiles of the trusted documents' perplexities by language. Since this model's size is fixed, classify() also
asks the word model of words.py, which grows with the text and is sharded.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import as_bytes, lean, materialise, shuffles_dropped

CLASSES, BITS = 64, 6
CODES = 1 << 3 * BITS
#: Trusted ids up to this many are sent to every task; more are joined by a shuffle.
FEW_IDS = 500_000


def _classes() -> np.ndarray:
    out = np.full(256, 31, np.uint8)
    out[0x20] = 0
    out[0x61:0x7B] = np.arange(1, 27)
    out[0x41:0x5B] = 27
    out[0x30:0x3A] = 28
    out[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 29
    out[list(b".,;:!?'\"()-")] = 30
    out[0x80:] = 32 + (np.arange(0x80, 0x100) & 31)
    return out


CLASS_OF = _classes()


def grams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes of a text, with two line breaks before it, and their counts."""
    s = np.concatenate([np.full(2, 29, np.uint8), CLASS_OF[np.frombuffer(text, np.uint8)]]).astype(np.uint32)
    codes = s[:-2] << 2 * BITS | s[1:-1] << BITS | s[2:]
    if len(codes) > CODES:
        n = np.bincount(codes, minlength=CODES)
        found = np.flatnonzero(n)
        return found.astype(np.uint32), n[found]
    codes.sort()
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.diff(np.concatenate([first, [len(codes)]]))


def _varint(values: np.ndarray) -> bytes:
    """Seven bits to a byte, lowest first, the top bit set where more follow."""
    v, parts = values.astype(np.uint64), []
    more = np.ones(len(v), bool)
    while True:
        here = (v & np.uint64(127)).astype(np.uint8)
        v = v >> np.uint64(7)
        parts.append(np.where(more, here | np.where(v > 0, 128, 0).astype(np.uint8), 0))
        held = more
        more = more & (v > 0)
        if len(parts) == 1:
            keep = [held]
        else:
            keep.append(held)
        if not more.any():
            break
    return np.stack(parts, 1)[np.stack(keep, 1)].tobytes()


def _unvarint(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (place * 7).astype(np.uint64), starts) if len(raw) else np.zeros(0, np.uint64)


def _shard_order(codes: np.ndarray) -> np.ndarray:
    """Codes with the middle class in front, so that a shard's codes are near each other."""
    return (codes >> BITS & 63) << 2 * BITS | codes >> 2 * BITS << BITS | codes & 63


def pack(codes: np.ndarray, counts: np.ndarray) -> bytes:
    order = np.argsort(_shard_order(codes))
    o = _shard_order(codes)[order].astype(np.int64)
    return _varint(np.concatenate([np.diff(o, prepend=0), counts[order]]))


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    v = _unvarint(data).astype(np.int64)
    o = np.cumsum(v[: len(v) // 2])
    return (o >> BITS & 63) << 2 * BITS | o >> 2 * BITS << BITS | o & 63, v[len(v) // 2 :]


def discounts(n) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams that occur once to four times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    out = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(out))


def probabilities(codes: np.ndarray, counts: np.ndarray, unigrams: np.ndarray, high, low) -> np.ndarray:
    """Log probabilities of all trigrams of the middle classes that codes have, 0 for others. unigrams: for each class, the
    number of classes that it follows. high, low: discounts of trigrams and bigrams."""
    cube = np.zeros((CLASSES, CLASSES, CLASSES))  # middle, first, last
    cube[codes >> BITS & 63, codes >> 2 * BITS, codes & 63] = counts

    def split(n, d):
        less = np.select([n == 1, n == 2, n >= 3], d, 0.0)
        total = n.sum(-1, keepdims=True)
        safe = np.maximum(total, 1)
        return np.maximum(n - less, 0) / safe, np.where(total > 0, less.sum(-1, keepdims=True) / safe, 1.0)

    total = max(unigrams.sum(), 1)
    one = np.maximum(unigrams - 0.5, 0) / total + (np.minimum(unigrams, 0.5).sum() / total if unigrams.sum() else 1.0) / CLASSES
    direct, rest = split((cube > 0).sum(1).astype(float), low)
    two = direct + rest * one
    direct, rest = split(cube, high)
    three = direct + rest * two[:, None, :]
    out = np.log(np.maximum(three, 1e-12)).transpose(1, 0, 2)
    return out.ravel()


def _counted(trusted: DataFrame) -> DataFrame:
    """code, n: trigram counts of the trusted text; a task adds up its documents before it hands anything on."""

    def run(batches):
        total = np.zeros(CODES, np.int64)
        for b in batches:
            for text in as_bytes(b.column(0)):
                codes, n = grams(text)
                total[codes] += n
        found = np.flatnonzero(total)
        for k in range(0, len(found), 20_000):
            at = found[k : k + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["code", "n"])

    return trusted.mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def log_probabilities(counts: DataFrame) -> np.ndarray:
    """Log probabilities of all trigrams by the counts (code, n)."""
    told = counts.toArrow()  # CODES rows at most
    codes, n = told.column("code").to_numpy().astype(np.int64), told.column("n").to_numpy()
    pairs, kinds = np.unique(codes & (1 << 2 * BITS) - 1, return_counts=True)
    high, low = (discounts([(x == k).sum() for k in (1, 2, 3, 4)]) for x in (n, kinds))
    return probabilities(codes, n, np.bincount(pairs & 63, minlength=CLASSES).astype(float), high, low)


def perplexities(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows with perplexity in the place of their last column, a text; null where that is empty."""
    kept = rows.columns[:-1]
    table = rows.sparkSession.sparkContext.broadcast(log_probabilities(counts))

    def run(batches):
        for b in batches:
            out = []
            for text in as_bytes(b.column(len(kept))):
                codes, n = grams(text)
                out.append(math.exp(-float(table.value[codes] @ n) / len(text)) if text else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.float64())], [*kept, "perplexity"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField("perplexity", DoubleType())]))


def classify(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.995, slack: float = 1.03) -> DataFrame:
    """One row for each row of docs: doc_id, lang, perplexity, threshold, kept, word_perplexity, word_threshold.

    trusted_ids: one column doc_id; documents with such an id are the trusted text. A language's threshold is the quantile of
    its trusted documents' perplexities times slack; a language without trusted documents, null included, has the quantile
    over all of them. slack: how far above the quantile a document may lie, as the quantile of a few trusted documents is no
    limit for others. The word model counts four fifths of the trusted texts, as it would know by heart what it has counted; its
    thresholds come likewise from the others (by content hash), without which there are none. kept: both perplexities within
    their thresholds. A null or empty text has no perplexity and isn't kept; without any trusted text everything else is kept. A null id is never trusted; repeated rows get the same answer; an empty table
    gives an empty result."""
    from .words import held_back, word_perplexities

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = lean(docs).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    ids = materialise(trusted_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "trusted-ids")
    n = ids.count()
    trusted = source.join(F.broadcast(ids) if n <= FEW_IDS else ids, "doc_id", "left_semi")
    if n > FEW_IDS:  # it is read once a round
        with shuffles_dropped(docs.sparkSession):
            trusted = materialise(trusted, "trusted")
    counts = materialise(_counted(trusted.select("text")), "trigrams")
    rows = lean(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text).alias("content"), F.xxhash64(F.col(id_col).cast("long"), text).alias("ident"), text.alias("text"))
    scored = perplexities(rows, counts)
    worded = source.select(F.xxhash64("doc_id", "text").alias("ident"), "text")
    if n <= FEW_IDS:
        known = F.broadcast(ids.withColumnRenamed("doc_id", "known"))
        worded = source.join(known, F.col("doc_id") == F.col("known"), "left").select(
            F.xxhash64("doc_id", "text").alias("ident"), "text", (F.col("known").isNotNull() & ~held_back(F.xxhash64("text"))).alias("counted")
        )
    w = word_perplexities(worded, trusted.where(~held_back(F.xxhash64("text"))).select("text"))
    if w is None:
        scored = scored.withColumn("word_perplexity", F.lit(None).cast("double"))
    else:
        scored = scored.join(w.withColumnRenamed("ident", "wid"), scored["ident"] == F.col("wid"), "left")
    with shuffles_dropped(docs.sparkSession):
        scored = materialise(scored.select("doc_id", "lang", "content", "perplexity", "word_perplexity"), "perplexities")
    good = scored.join(ids, "doc_id", "left_semi").where("perplexity is not null")

    def cut(of: str):
        value = F.when(held_back(F.col("content")), F.col(of)) if of == "word_perplexity" else F.col(of)
        return F.percentile_approx(value, F.lit(quantile), F.lit(10_000)) * F.lit(slack)

    whole = good.agg(cut("perplexity").alias("whole"), cut("word_perplexity").alias("word_whole"))
    # A table of one row for each language: Spark sees its size and sends it to all tasks while it is small.
    by_lang = materialise(good.groupBy("lang").agg(cut("perplexity").alias("own"), cut("word_perplexity").alias("word_own")).withColumnRenamed("lang", "of"), "thresholds")
    told = scored.crossJoin(F.broadcast(whole)).join(by_lang, F.col("lang") == F.col("of"), "left")
    told = told.withColumn("threshold", F.coalesce("own", "whole")).withColumn("word_threshold", F.coalesce("word_own", "word_whole"))
    kept = F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    by_words = F.coalesce(F.col("word_perplexity") <= F.col("word_threshold"), F.lit(True))
    return told.select("doc_id", "lang", "perplexity", "threshold", (kept & by_words).alias("kept"), "word_perplexity", "word_threshold")
