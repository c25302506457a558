"""Scalar functions that Spark lacks, as Arrow-batched UDFs: accent folding and string similarities."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

MARKS = re.compile("[̀-ͯ]")


def fold(text: str | None) -> str:
    """Compatibility decomposition, without combining marks U+0300 to U+036F, in lower case; null gives an empty string."""
    if text is None:
        return ""
    return text.lower() if text.isascii() else MARKS.sub("", unicodedata.normalize("NFKD", text)).lower()


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for k, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & where.get(ch, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; 1 for two empty strings."""
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """1 if one token set holds the other and they meet; 0 if a side has no token; else the best of the ratios between the
    shared tokens and each side's shared and own tokens, sorted, and of the two sides."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not only_x or not only_y):
        return 1.0
    left, right = " ".join([*both, *only_x]), " ".join([*both, *only_y])
    best = indel_ratio(left, right)
    if both:
        core = " ".join(both)
        best = max(best, indel_ratio(core, left), indel_ratio(core, right))
    return best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio between the shorter string and the windows of its length, or shorter ones at the ends, of the longer."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n, m = len(short), len(long)
    spans = [(max(0, k), min(m, k + n)) for k in range(1 - n, m)]
    best = 0.0
    for i, j in spans:
        if 2 * (j - i) / (n + j - i) > best:
            best = max(best, indel_ratio(short, long[i:j]))
    return best


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity with a bonus of a tenth for each of up to four shared leading characters, above 0.7; 0 if a side is
    empty."""
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, mine = [False] * len(b), []
    for k, ch in enumerate(a):
        for j in range(max(0, k - reach), min(len(b), k + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                mine.append(ch)
                break
    if not mine:
        return 0.0
    theirs = [ch for ch, t in zip(b, taken, strict=True) if t]
    swaps = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    m = len(mine)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return jaro + same * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


RATIOS = {f.__name__: f for f in (indel_ratio, token_sort_ratio, token_set_ratio, partial_ratio, jaro_winkler)}


@F.pandas_udf(StringType())
def nfkd_fold(s: pd.Series) -> pd.Series:
    return s.map(fold, na_action=None)


def _ratio_udf(name: str):
    from linkloom.functions import fold as module

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        f = module.RATIOS[name]
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(run, DoubleType())


def register(spark: SparkSession) -> None:
    """Make the functions available to SQL under their own names."""
    spark.udf.register("nfkd_fold", nfkd_fold)
    for name in RATIOS:
        spark.udf.register(name, _ratio_udf(name))
