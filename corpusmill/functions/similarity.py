"""Similarity of strings and distance of word sequences."""

from __future__ import annotations

from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _indel_ratio(a: str, b: str) -> float:
    """A row of the table of common subsequences is one integer, a bit for each place where it does not grow (Hyyrö)."""
    if not a and not b:
        return 1.0
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for y in b:
        same = row & places.get(y, 0)
        row = ((row + same) | (row - same)) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def ratio(a: Column, b: Column) -> Column:
    """2 LCS / (m + n): 1 for equal strings; a substitution costs as much as a deletion and an insertion."""
    return F.pandas_udf(_ratio, "double")(a, b)


def levenshtein(a: Column, b: Column) -> Column:
    """Edit distance in characters."""
    return F.levenshtein(a, b)


#: Where the private use area begins: one character stands for each distinct word of a pair of texts.
_PRIVATE = 0xE000
_ALPHABET = "".join(chr(_PRIVATE + i) for i in range(6400))


def _coded(items: Column, vocabulary: Column) -> Column:
    return F.array_join(F.transform(items, lambda w: F.substr(F.lit(_ALPHABET), F.array_position(vocabulary, w).cast("int"), F.lit(1))), "")


#: So many words ahead an alignment looks for its place again.
_AHEAD = 8


def _aligned(x: list[str], y: list[str]) -> int:
    """Cost of one alignment, found in one walk: at words that differ either side skips up to where two words in a row agree
    again, else both go on by one. No less than the edit distance."""
    m, n, i, j, cost = len(x), len(y), 0, 0, 0
    while i < m and j < n:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        skip_x = skip_y = 1
        if not (i + 1 < m and j + 1 < n and x[i + 1] == y[j + 1]):
            for k in range(1, _AHEAD + 1):
                if i + k < m and x[i + k] == y[j] and x[i + k + 1 : i + k + 2] == y[j + 1 : j + 2]:
                    skip_x, skip_y = k, 0
                    break
                if j + k < n and x[i] == y[j + k] and x[i + 1 : i + 2] == y[j + k + 1 : j + k + 2]:
                    skip_x, skip_y = 0, k
                    break
        cost += max(skip_x, skip_y)
        i, j = i + skip_x, j + skip_y
    return cost + m - i + n - j


def _edits(x: list[str], y: list[str], bounds: bool = True) -> int:
    """Edit distance, exact and in linear memory: a column of the table is two integers of a bit a word (Myers, Hyyrö).

    With ``bounds`` the words that both have bound it from below and an alignment from above; where these meet, the table is
    not needed.
    """
    begin, end = 0, 0
    while begin < min(len(x), len(y)) and x[begin] == y[begin]:
        begin += 1
    while end < min(len(x), len(y)) - begin and x[-1 - end] == y[-1 - end]:
        end += 1
    x, y = x[begin : len(x) - end], y[begin : len(y) - end]
    if not x or not y:
        return len(x) + len(y)
    if bounds:
        least = max(len(x), len(y)) - (Counter(x) & Counter(y)).total()
        if _aligned(x, y) == least:
            return least
    places: dict[str, int] = {}
    for i, w in enumerate(x):
        places[w] = places.get(w, 0) | 1 << i
    full, top = (1 << len(x)) - 1, 1 << (len(x) - 1)
    up, down, distance = full, 0, len(x)
    for w in y:
        same = places.get(w, 0)
        across = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(across | up)), up & across
        distance += bool(more & top) - bool(less & top)
        more, less = (more << 1 | 1) & full, less << 1 & full
        same |= down
        up, down = less | (full & ~(same | more)), more & same
    return distance


def _word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _edits(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int64")


def word_edits(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of two arrays of words.

    Words become single characters of a private alphabet, so that the built-in character distance counts words. Pairs with
    more distinct words than the alphabet has are left to ``word_edits_any``.
    """
    one = F.array(F.struct(reference.alias("r"), hypothesis.alias("h"), F.array_union(reference, hypothesis).alias("v")))  # built once a row
    edits = lambda x: F.when(F.size(x["v"]) <= len(_ALPHABET), F.levenshtein(_coded(x["r"], x["v"]), _coded(x["h"], x["v"])).cast("long"))
    return F.element_at(F.transform(one, edits), 1)


def word_edits_any(reference: Column, hypothesis: Column) -> Column:
    """The same for any number of distinct words, in Python."""
    return F.pandas_udf(_word_distance, "long")(reference, hypothesis)


def with_word_edits(df: DataFrame, reference: str, hypothesis: str, name: str = "edits") -> DataFrame:
    """Rows with the edit distance of two arrays of words: pairs that the alphabet suffices for stay in the JVM, the others
    alone go to Python (a function of both in one expression would run for every row)."""
    few = F.size(F.array_union(reference, hypothesis)) <= len(_ALPHABET)
    near = df.filter(F.coalesce(few, F.lit(True))).withColumn(name, word_edits(F.col(reference), F.col(hypothesis)))
    return near.unionByName(df.filter(~few).withColumn(name, word_edits_any(F.col(reference), F.col(hypothesis))))


def text_edits(long: int):
    """For ``mapInArrow``: batches of two texts, whose words spaces part, as the sums of their edits and of the first one's
    words. A pair with a null has no edits; pairs of up to ``long`` words go to the table at once."""

    def run(it):
        for batch in it:
            edits, n = [], []
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = ([w for w in t.split(" ") if w] if t is not None else None for t in (a, b))
                if x is not None:
                    n.append(len(x))
                    if y is not None:
                        edits.append(_edits(x, y, max(len(x), len(y)) > long))
            yield pa.RecordBatch.from_arrays([pa.array([sum(v) if v else None], pa.int64()) for v in (edits, n)], names=["e", "n"])

    return run
