"""Fuzzy string functions that have no built-in: Arrow-batched, with the similarity in bit-parallel form."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark import schemas as S


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of `a` at a time."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & where.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def partial_alignment(a: str, b: str, least: float = 0.0) -> tuple[float, int, int]:
    """The best ratio of the shorter string with a window of the longer one, and the window in b: the first of the best.

    Windows slide from prefixes to whole ones to suffixes. How many characters a window has in
    common with the shorter string, wherever they are, is kept up to date and bounds its ratio;
    windows that can't beat the best so far, or can't reach `least`, aren't compared.
    """
    if not a or not b:
        return (100.0 if a == b else 0.0), 0, 0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n, best = len(short), (-1.0, 0, 0)
    free: dict[str, int] = {}
    for ch in short:
        free[ch] = free.get(ch, 0) + 1
    inside = 0
    for step in range(1, len(long) + n):
        lo, hi = max(0, step - n), min(step, len(long))
        if step <= len(long) and (ch := long[step - 1]) in free:
            free[ch] -= 1
            inside += free[ch] >= 0
        if lo and (ch := long[lo - 1]) in free:
            free[ch] += 1
            inside -= free[ch] > 0
        bound = 200.0 * inside / (n + hi - lo)
        if bound <= best[0] or bound < least or (long[hi - 1] not in free and long[lo] not in free):
            continue
        score = ratio(short, long[lo:hi])
        if score > best[0]:
            best = score, lo, hi
            if score == 100.0:
                break
    if best[0] < max(least, 0.0):
        return 0.0, 0, 0
    return best if long is b else (best[0], 0, len(b))


def conflict(a: str, b: str) -> bool:
    """The plain-Python twin of functions.text.discriminators_conflict."""
    x, y = a.split(), b.split()
    led = lambda words, p: any(w.startswith(p) for w in words)
    opposed = any((led(x, p) and led(y, q)) or (led(x, q) and led(y, p)) for p, q in S.OPPOSED)
    sides = ("left" in x and "right" in y) or ("right" in x and "left" in y)
    return opposed or sides or set(re.findall(r"\d+", a)) != set(re.findall(r"\d+", b))


def fuzzily_anchored(term: str, note: str) -> bool:
    """The last two steps of anchoring: the best window, grown to whole words, mustn't conflict with the term."""
    score, lo, hi = partial_alignment(term, note, S.FUZZY_ANCHOR)
    if score < S.FUZZY_ANCHOR:
        return False
    lo = note.rfind(" ", 0, lo) + 1
    end = note.find(" ", hi)
    return not conflict(term, note[lo : len(note) if end < 0 else end])


@functools.lru_cache(1 << 16)
def likeness(p: str, g: str) -> float:
    """How alike two terms are, 0 where they conflict. Terms recur, so each pair is compared once in a while only."""
    return 0.0 if conflict(p, g) else token_sort_ratio(p, g)


def match_counts(pred: list[str], gold: list[str], fuzzy: bool) -> tuple[int, int, int]:
    """(tp, fp, fn): each prediction in turn takes the most similar gold entry that is left, the first among equals."""
    left, tp = dict(enumerate(gold)), 0
    for p in pred:
        scored = [(100.0 if p == g else likeness(p, g) if fuzzy else 0.0, -i) for i, g in left.items()]
        score, at = max(scored, default=(0.0, 0))
        if score >= (S.FUZZY_MATCH if fuzzy else 100.0):
            del left[-at]
            tp += 1
    return tp, len(pred) - tp, len(left)


@F.pandas_udf(T.DoubleType())
def token_sort_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else token_sort_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def partial_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else partial_alignment(x, y)[0] for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.BooleanType())
def fuzzily_anchored_udf(term: pd.Series, note: pd.Series) -> pd.Series:
    return pd.Series([bool(t) and n is not None and fuzzily_anchored(t, n) for t, n in zip(term, note)], dtype="bool")


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def all_anchored_udf(terms: pd.Series, note: pd.Series) -> pd.Series:
    """For each of a row's terms, whether its note anchors it fuzzily."""
    return pd.Series([[bool(t) and n is not None and fuzzily_anchored(t, n) for t in ts] if ts is not None else None for ts, n in zip(terms, note)], dtype="object")


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def resemble_udf(some: pd.Series, labels: pd.Series) -> pd.Series:
    """For each of a row's strings, whether one of its labels has a window that is like it."""
    like = lambda x, ys: any(partial_alignment(x, y, S.FUZZY_ANCHOR)[0] >= S.FUZZY_ANCHOR for y in ys)
    return pd.Series([[like(x, ys) for x in xs] if xs is not None else None for xs, ys in zip(some, labels)], dtype="object")


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("tp", "fp", "fn")]))
def match_counts_udf(pred: pd.Series, gold: pd.Series, fuzzy: pd.Series) -> pd.DataFrame:
    rows = [match_counts(list(p) if p is not None else [], list(g) if g is not None else [], bool(f)) for p, g, f in zip(pred, gold, fuzzy)]
    return pd.DataFrame(rows, columns=["tp", "fp", "fn"]).astype("int32")


def register(spark) -> None:
    """The similarity functions under SQL names."""
    for name, f in (("token_sort_ratio", token_sort_ratio_udf), ("partial_ratio", partial_ratio_udf), ("fuzzily_anchored", fuzzily_anchored_udf), ("match_counts", match_counts_udf)):
        spark.udf.register(name, f)
