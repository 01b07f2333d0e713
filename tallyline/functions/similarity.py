"""String similarity: built-in edit distance, and one Arrow function for what has no built-in expression."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.functions.text import plain_words, skeleton


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts, 0 for one."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


@lru_cache(1 << 16)
def ratio(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return 1 - row[-1] / max(len(a), len(b))


@lru_cache(1 << 16)
def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler with half transpositions, and the prefix of up to four always rewarded."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, left = set(range(len(b))), []
    taken = []
    for i, x in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j in free and b[j] == x), None)
        if j is not None:
            free.discard(j)
            left.append(x)
            taken.append(j)
    m = len(left)
    if not m:
        return 0.0
    swaps = sum(x != b[j] for x, j in zip(left, sorted(taken), strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro)


def token_set(a: list[tuple[str, str]], b: list[tuple[str, str]]) -> float:
    """Greedy alignment of two lists of (token, skeleton), by the better of both ratios; the longer list's length divides."""
    if not a or not b:
        return 0.0
    rest, total = list(b), 0.0
    for t, s in a:
        scores = [max(ratio(t, u), ratio(s, v)) for u, v in rest]
        best = max(scores, default=0.0)
        total += best
        if best > 0:
            rest.pop(scores.index(best))
    return total / max(len(a), len(b))


def _closest(pairs: list[tuple[str, str]]) -> float:
    return max(max(ratio(x, y), jaro_winkler(x, y)) for x, y in pairs)


@F.pandas_udf(T.StructType([T.StructField(k, T.DoubleType()) for k in ("raw", "fold", "tokens")]))
def _compared(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for columns in batches:
        out = []
        for qc, qs, qf, qg, cc, cs, cf, cg in zip(*columns, strict=True):
            q, c = "".join(qc), "".join(cc)
            raw = _closest([(q, c), ("".join(sorted(qc)), "".join(sorted(cc)))])
            fold = _closest([(qf, cf), (qg or qf, cg or cf)]) if qf and cf else 0.0
            out.append((raw, fold, max(token_set(list(zip(qc, qs, strict=True)), list(zip(cc, cs, strict=True))), ratio(q, c))))
        yield pd.DataFrame(out, columns=["raw", "fold", "tokens"])


def with_folds(core: Column) -> list[Column]:
    """core, its tokens' skeletons, and the skeletons of all of it, in order and sorted."""
    return [core, F.transform(core, skeleton), skeleton(F.array_join(core, " ")), skeleton(F.array_join(F.array_sort(core), " "))]


def compared(query: list[Column], printed: list[Column]) -> Column:
    """struct(raw, fold, tokens) of two names, each given as with_folds() of its core."""
    return _compared(*query, *printed)


@F.pandas_udf(T.DoubleType())
def _text_similarity(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for a, b, sa, sb in batches:
        yield pd.Series([max(ratio(x, y), jaro_winkler(x, y), token_set(list(zip(x.split(" "), s, strict=True)), list(zip(y.split(" "), t, strict=True)))) if x and y else 0.0 for x, y, s, t in zip(a, b, sa, sb, strict=True)], dtype="float64")


def text_similarity(a: Column, b: Column) -> Column:
    """Similarity of two texts by their upper-case words; 0 if either has none."""
    x, y = plain_words(a), plain_words(b)
    both = (x != "") & (y != "")  # else nothing is folded or sent
    folds = lambda t: F.when(both, F.transform(F.split(t, " "), skeleton))
    return _text_similarity(F.when(both, x), F.when(both, y), folds(x), folds(y))
