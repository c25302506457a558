"""Language identification: averaged hashed subword embeddings with a linear softmax.

A document is the mean of the embeddings of its subwords (letter n-grams of marked words, hashed into buckets); a linear
softmax reads that mean. Embeddings and weights are trained by stochastic gradient descent in numpy on a
bounded sample of labelled documents; a fifth of the sample is kept back to fit the temperature and the level of rejection.
As mean and softmax input are linear, scoring needs one row of logits per bucket, summed over the whole text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batched, lean

UND = "und"
#: Characters read at a time.
SPAN = 1 << 18


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def subwords(text: str, bits: int, shortest: int, longest: int) -> Iterator[np.ndarray]:
    """Buckets of a text's subwords, a span of the text at a time: n-grams of lower-cased letters, where what isn't a letter
    is one mark that stands only at an n-gram's ends."""
    letter = _letters()
    for at in range(0, len(text), SPAN):
        # Two characters of context before the span and longest - 1 after it; lower-casing may change their number.
        head = text[max(0, at - 1) : at].lower() or "\0"
        body, tail = text[at : at + SPAN].lower(), text[at + SPAN : at + SPAN + longest].lower() or "\0"
        c = np.frombuffer((head[-1] + body + tail).encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(letter[c], c, 0).astype(np.uint64)
        n = len(body) + 1
        for size in range(shortest, longest + 1):
            last = min(n, len(c) - size + 1)
            if last <= 0:
                continue
            h, whole = np.full(last, size, np.uint64), np.ones(last, bool)
            for k in range(size):
                part = c[k : k + last]
                h = h * np.uint64(0x9E3779B97F4A7C15) + part
                if 0 < k < size - 1:
                    whole &= part > 0
            if size == 2:
                whole = (c[:last] | c[1 : last + 1]) > 0
            h = (h[whole] ^ (h[whole] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            yield (h >> np.uint64(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class LanguageModel:
    labels: tuple[str, ...]
    logits: np.ndarray  # buckets x labels: embeddings times weights
    bias: np.ndarray
    temperature: float
    level: float  # calibrated probability below which a document is rejected
    shortest: int
    longest: int

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Label, calibrated probability and whether it is too low to trust."""
        total, n = np.zeros(len(self.labels)), 0
        for part in subwords(text, self.logits.shape[0].bit_length() - 1, self.shortest, self.longest) if self.labels else ():
            total += self.logits[part].sum(0, dtype=np.float64)
            n += len(part)
        if not n:
            return UND, 0.0, True
        z = (total / n + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.labels[k], float(min(1.0, p[k])), bool(p[k] < self.level)


def _features(text: str, bits: int, shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.zeros(1 << bits, np.int64)
    for part in subwords(text, bits, shortest, longest):
        n += np.bincount(part, minlength=1 << bits)
    ids = np.flatnonzero(n)
    return ids, (n[ids] / max(n.sum(), 1)).astype(np.float32)


def train(sample: list[tuple[str, str]], bits: int = 16, dim: int = 12, epochs: int = 4, rate: float = 0.3, shortest: int = 2, longest: int = 3, seed: int = 5, reject: float = 0.002) -> LanguageModel:
    """Fit on (text, label) pairs; every fifth pair is kept back for calibration. reject: share of the rightly labelled pairs
    kept back that the level may turn away; the level never lies above one half."""
    labels = tuple(sorted({y for _, y in sample}))
    if not labels:
        return LanguageModel((), np.zeros((1 << bits, 0), np.float32), np.zeros(0), 1.0, 0.0, shortest, longest)
    rows = [(*_features(t, bits, shortest, longest), labels.index(y)) for t, y in sample]
    rows = [r for r in rows if len(r[0])]
    kept = rows[4::5]
    fit = [r for k, r in enumerate(rows) if k % 5 != 4] or rows
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
    w, b = np.zeros((dim, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    w += rng.normal(0, 0.1, w.shape).astype(np.float32)
    steps, at = max(1, epochs * len(fit)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(fit)):
            ids, n, y = fit[k]
            step = rate * (1 - at / steps)
            at += 1
            h = n @ e[ids]
            z = h @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = w @ p
            w -= step * np.outer(h, p)
            b -= step * p
            e[ids] -= (step * min(50.0, 1.0 / float(n @ n))) * n[:, None] * back
    logits = e @ w

    def scores(part):
        return np.array([n @ logits[ids] + b for ids, n, _ in part]), np.array([y for *_, y in part])

    z, y = scores(kept or fit)
    grid = np.geomspace(0.05, 20, 60)

    def soft(t):
        p = np.exp(z / t - (z / t).max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def loss(t):
        return -np.log(soft(t)[np.arange(len(y)), y] + 1e-12).mean()

    temperature = float(min(grid, key=loss)) if len(y) else 1.0
    p = soft(temperature)
    right = p.max(1)[p.argmax(1) == y]
    level = float(min(0.5, np.quantile(right, reject))) if len(right) else 0.0
    return LanguageModel(labels, logits, b.astype(np.float64), temperature, level, shortest, longest)


def labelled_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = 2000, most_bytes: int = 64 << 20) -> list[tuple[str, str]]:
    """At most `most` labelled (text, label) pairs of documents whose crc32(id as text) mod 3 is not 1, and as many whole texts
    as fit into most_bytes: those with the lowest digest of the id (ties: of text, then label); the same for any
    partitioning. What is taken is settled first, without texts."""
    learn = docs.where(F.col(lang_col).isNotNull() & (F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    learn = learn.select(F.struct(F.xxhash64(F.lit("langid"), F.col(id_col)).alias("a"), F.xxhash64(text).alias("b"), F.col(lang_col).alias("y")).alias("key"), text.alias("x"))
    n, size = 0, 0
    firsts = learn.select("key", F.octet_length("x").alias("size")).orderBy("key").limit(most).collect()
    for r in firsts:
        size += r["size"]
        if size > most_bytes:
            break
        n += 1
    if not n:
        return []
    a, b, y = firsts[n - 1]["key"]
    last = F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(y).alias("y"))
    return [(r.x, r["key"]["y"]) for r in learn.where(F.col("key") <= last).orderBy("key").limit(n).collect()]


PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score, rejected.

    lang_pred is `und`, with score 0, for a null text and for one without letters (such rows are rejected), and for every row
    if nothing could be learned. score is the calibrated probability of lang_pred. held_out: crc32(id as text) mod 3 is 1
    (false for a null id, which is never learned from). Ties go to the first label in code point order."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value

        def rows():
            for b in batches:
                for i, h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), strict=True):
                    yield (i, h, *model.predict(text.decode("utf-8", "replace")))

        yield from batched(rows(), PREDICTED)

    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    source = lean(docs).select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def filter_rejected(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that the model does not reject, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        model = shared.value
        for b in batches:
            yield b.filter(pa.array([not model.predict(x.decode("utf-8", "replace"))[2] for x in as_bytes(b.column(at))], pa.bool_()))

    return lean(docs).mapInArrow(run, docs.schema)
