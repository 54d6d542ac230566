"""Text on images: string similarity and fuzzy F1 by optimal assignment."""

from __future__ import annotations

import functools
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text

MATCH = 0.85


def text_similarity(df: DataFrame, ref: str, gen: str, out: str = "similarity") -> DataFrame:
    """Add the sequence-matcher ratio of two normalised texts, rounded to four decimals before anything is compared with it. Order matters."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([round(SequenceMatcher(None, x, y).ratio(), 4) for x, y in zip(a, b)], dtype=float)

    return df.withColumn(out, ratio(normalize_text(F.col(ref)), normalize_text(F.col(gen))))


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in an assignment of least total cost, for no more rows than columns: shortest augmenting paths over row and column prices.

    Rows begin with the price of their cheapest column and take it if it is free, so only rows in conflict need a path.
    """
    n, m = cost.shape
    u, v = np.append(0.0, cost.min(axis=1)), np.zeros(m + 1)
    owner, way = np.zeros(m + 1, int), np.zeros(m + 1, int)  # column 0 stands for none
    waiting = []
    for i, j in enumerate((cost.argmin(axis=1) + 1).tolist(), start=1):
        if owner[j]:
            waiting.append(i)
        else:
            owner[j] = i
    for i in waiting:
        owner[0], j = i, 0
        best, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while owner[j]:
            used[j] = True
            free = ~used[1:]
            now = cost[owner[j] - 1] - u[owner[j]] - v[1:]
            better = free & (now < best[1:])
            best[1:][better], way[1:][better] = now[better], j
            k = int(np.where(free, best[1:], np.inf).argmin()) + 1
            step = best[k]
            u[owner[used]] += step
            v[used] -= step
            best[1:][free] -= step
            j = k
        while j:
            owner[j] = owner[way[j]]
            j = way[j]
    out = np.full(n, -1)
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


#: Bytes of remembered similarities in a worker, by estimate; they are forgotten beyond it.
MEMO_BYTES = 48 << 20
_ENTRY_BYTES = 160


#: Texts up to this length are compared by searching stretches of one in the other, which is faster than a matcher's tables.
SHORT = 24


def short_ratio(a: str, b: str) -> float:
    """The sequence matcher's ratio of two short texts: the longest common stretch, the first one in `a` and then in `b`, and the same again on both of its sides."""
    if a == b:
        return 1.0
    if not set(a) & set(b):
        return 0.0
    matched, open_, find = 0, [(0, len(a), 0, len(b))], b.find
    while open_:
        alo, ahi, blo, bhi = open_.pop()
        size, at, to = 0, 0, 0
        i = alo
        while i + size < ahi and bhi - blo > size:  # only a longer stretch than the best one replaces it
            j = find(a[i : i + size + 1], blo, bhi)
            if j >= 0:
                size, at, to = size + 1, i, j
                while i + size < ahi and (j := find(a[i : i + size + 1], blo, bhi)) >= 0:
                    size, to = size + 1, j
            i += 1
        if size:
            matched += size
            if at > alo and to > blo:
                open_.append((alo, at, blo, to))
            if at + size < ahi and to + size < bhi:
                open_.append((at + size, ahi, to + size, bhi))
    return 2.0 * matched / (len(a) + len(b))


class Similarities:
    """Sequence-matcher ratios of pairs of texts, remembered from one sample to the next."""

    def __init__(self, limit: int = MEMO_BYTES):
        self.limit, self.held = limit, 0
        self.known: dict[str, dict[str, float]] = {}  # by the second text, of which a matcher is made once

    def matrix(self, ref: list[str], gen: list[str]) -> np.ndarray:
        if self.held > self.limit:
            self.known.clear()
            self.held = 0
        first, columns = set(ref), {}
        for b in set(gen):
            row = self.known.get(b)
            if row is None:
                row = self.known[b] = {}
                self.held += len(b) + _ENTRY_BYTES
            new = first.difference(row)
            matcher = None
            for a in new:
                if len(a) <= SHORT and len(b) <= SHORT:
                    row[a] = short_ratio(a, b)
                else:
                    matcher = matcher or SequenceMatcher(None, "", b)
                    matcher.set_seq1(a)
                    row[a] = matcher.ratio()
                self.held += len(a) + _ENTRY_BYTES
            columns[b] = row
        return np.array([[columns[b][a] for b in gen] for a in ref])


@functools.cache
def _worker_similarities() -> Similarities:
    return Similarities()


def alike_parts(sim: np.ndarray):
    """(rows, columns) of each part of a similarity matrix that is linked by values above 0; rows and columns without any are left out."""
    some = sim > 0
    if some.all():
        yield np.arange(sim.shape[0]), np.arange(sim.shape[1])
        return
    left = some.any(axis=1)
    while left.any():
        rows = np.zeros(len(left), bool)
        rows[left.argmax()] = True
        while True:
            columns = some[rows].any(axis=0)
            more = some[:, columns].any(axis=1)
            if (more == rows).all():
                break
            rows = more
        yield np.flatnonzero(rows), np.flatnonzero(columns)
        left &= ~rows


def best_partners(ref: list[str], gen: list[str], threshold: float, memo: Similarities) -> int | None:
    """Pairs that reach the threshold, if each text of the shorter side can have the most similar one of the other side to itself; else None.

    No matching has a greater sum then, and every one of that sum gives each of these texts a partner just as similar, so the number doesn't
    depend on which is taken. Equal texts, and they only, have similarity 1, so texts with an equal partner need not be compared.
    """
    short, long = (gen, ref) if len(gen) <= len(ref) else (ref, gen)
    free, left = Counter(long), []
    for text in short:
        if free[text] > 0:
            free[text] -= 1
        else:
            left.append(text)
    hits = (len(short) - len(left)) * (threshold <= 1)
    if left:
        sim = memo.matrix(ref, left).T if short is gen else memo.matrix(left, gen)
        for value, at in zip(sim.max(axis=1).tolist(), sim.argmax(axis=1).tolist()):
            if value > 0:
                if not free[long[at]]:
                    return None
                free[long[at]] -= 1
            hits += value >= threshold
    return hits


def fuzzy_f1(ref: list[str], gen: list[str], threshold: float = MATCH, memo: Similarities | None = None) -> float:
    """F1 of two lists of texts: pairs matched one to one for the greatest summed similarity, of which those reaching the threshold count.

    Parts of the lists that have nothing in common are matched by themselves: pairs of similarity 0 add nothing to the sum.
    """
    if not ref and not gen:
        return 1.0
    if not ref or not gen:
        return 0.0
    memo = memo or Similarities()
    hits = best_partners(ref, gen, threshold, memo)
    if hits is not None:
        return 2 * hits / (len(ref) + len(gen))
    sim = memo.matrix(ref, gen)
    hits = 0
    for rows, columns in alike_parts(sim):
        part = sim[np.ix_(rows, columns)]
        wide = part if part.shape[0] <= part.shape[1] else part.T
        chosen = assign(1 - wide)
        hits += int((wide[np.arange(len(wide)), chosen] >= threshold).sum())
    return 2 * hits / (len(ref) + len(gen))


def text_f1(pairs: DataFrame, key: str = "image", ref: str = "ref", gen: str = "gen", threshold: float = MATCH) -> DataFrame:
    """(key, ocr_f1) of samples with both sides' cleaned texts as arrays; a null side is empty."""

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        lists, memo = lambda x: [] if x is None else list(x), _worker_similarities()
        return pd.Series([fuzzy_f1(lists(x), lists(y), threshold, memo) for x, y in zip(a, b)], dtype=float)

    return pairs.select(key, score(ref, gen).alias("ocr_f1"))
