"""Maximal periodic runs of words, and texts with their repetitions collapsed.

A run is a stretch of words of which those ``q`` apart are identical, ``q`` being its smallest period, that no neighbouring word extends. Every run
of at least two periods holds a Lyndon word of length ``q`` which is the longest one at its place, under the order of the words or the reverse
one. So two scans from right to left find them all: a stack of suffixes, linked by the next smaller one, gives the longest Lyndon word at each
place. Suffixes that begin alike are compared by their longest common extension: the first few words directly, the rest by binary search over
a rolling hash modulo 2**61 - 1, whose end is confirmed on the words. Candidates are extended to both sides in the same way; a run is
taken only after all of its words were compared directly, and if they differ (two stretches of one hash), the text is done again with another base.
The base is random, so that two stretches of n different words have one hash with a chance of n / 2**61 at most.

A text of n words takes O(n log n) steps and O(n) memory; texts are independent of each other, so there is no shuffle.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; a null or empty text has no words, no runs, and collapses to the empty text; equal texts give
equal results; texts are read whole, however long; all columns are kept, new ones give way to names that are there; an empty table gives no rows.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.session import fresh

SHORTEST, REPEATS = 6, 4
#: So many words are compared one by one before hashes are asked.
DIRECT = 8
PRIME = (1 << 61) - 1

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
ARROW = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])


class Extensions:
    """Longest common extensions of two places of one list of word numbers, which ends with a number that no word has."""

    def __init__(self, words: list[int], base: int):
        self.words, self.n, self.base = words, len(words) - 1, base
        self.sums: list[int] = []
        self.powers: list[int] = []

    def _hashes(self) -> None:
        total, power = 0, 1
        sums, powers = [0], [1]
        for w in self.words:
            total = (total * self.base + w + 2) % PRIME
            power = power * self.base % PRIME
            sums.append(total)
            powers.append(power)
        self.sums, self.powers = sums, powers

    def _same(self, i: int, j: int, size: int) -> bool:
        s, p = self.sums, self.powers[size]
        return (s[i + size] - s[i] * p - s[j + size] + s[j] * p) % PRIME == 0

    def right(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on, i < j."""
        words, most = self.words, self.n - j
        for k in range(min(DIRECT, most)):
            if words[i + k] != words[j + k]:
                return k
        if most <= DIRECT:
            return most
        if not self.sums:
            self._hashes()
        low, step = DIRECT, DIRECT  # strides that double, then halves
        while low + step <= most and self._same(i + low, j + low, step):
            low, step = low + step, 2 * step
        high = min(most, low + step - 1)
        while low < high:
            mid = (low + high + 1) // 2
            if self._same(i, j, mid):
                low = mid
            else:
                high = mid - 1
        while low < most and words[i + low] == words[j + low]:  # the end is where words differ
            low += 1
        return low

    def left(self, i: int, j: int) -> int:
        """How many words that end before i equal those that end before j, i < j."""
        words = self.words
        for k in range(min(DIRECT, i)):
            if words[i - 1 - k] != words[j - 1 - k]:
                return k
        if i <= DIRECT:
            return i
        if not self.sums:
            self._hashes()
        low, step = DIRECT, DIRECT
        while low + step <= i and self._same(i - low - step, j - low - step, step):
            low, step = low + step, 2 * step
        high = min(i, low + step - 1)
        while low < high:
            mid = (low + high + 1) // 2
            if self._same(i - mid, j - mid, mid):
                low = mid
            else:
                high = mid - 1
        while low < i and words[i - 1 - low] == words[j - 1 - low]:
            low += 1
        return low


def next_smaller(words: list[int], common: Callable[[int, int], int]) -> list[int]:
    """Where the next smaller suffix begins, for each place: up to there reaches the longest Lyndon word. The last word is the least one, and there only."""
    n = len(words) - 1
    following = [n] * n
    for i in range(n - 1, -1, -1):
        own, j = words[i], i + 1
        while (other := words[j]) >= own:
            if other == own:
                same = common(i, j)
                if words[j + same] < words[i + same]:
                    break
            j = following[j]
        following[i] = j
    return following


def word_runs(words: list, shortest: int = SHORTEST, repeats: int = REPEATS, base: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least ``shortest`` words and ``repeats`` periods (2 at least), by start, then period."""
    if repeats < 2:
        raise ValueError("a run has at least two periods")
    n = len(words)
    if n < max(shortest, repeats):
        return []
    names: dict = {}
    numbers = [names.setdefault(w, len(names)) for w in words]
    if len(names) == n:
        return []
    base = base or random.randrange(1 << 32, PRIME - 1)
    top, found = len(names), set()
    ends = Extensions([*numbers, -1], base)
    array = np.array([*numbers, -1])
    for order in (ends.words, [top - x for x in numbers] + [-1]):
        following = np.array(next_smaller(order, ends.right))
        start = np.flatnonzero(array[:-1] == array[following])
        period = following[start] - start
        fit = period * repeats <= n
        if repeats > 2:  # the first Lyndon word of a run is followed by another copy of it
            after = np.minimum(start + 1, n)
            fit &= (start + 2 * period <= n) & ((period == 1) | (array[after] == array[np.minimum(after + period, n)]))
        known: dict[int, int] = {}  # by period, where the last stretch ends
        for i, p in zip(start[fit].tolist(), period[fit].tolist(), strict=True):
            if i + p <= known.get(p, 0):
                continue
            after = ends.right(i, i + p)
            back = ends.left(i, i + p)
            known[p] = i + p + after
            if back + p + after >= max(shortest, repeats * p):
                found.add((i - back, back + p + after, p))
    for s, length, p in found:
        if words[s : s + length - p] != words[s + p : s + length]:
            return word_runs(words, shortest, repeats)  # with another base
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for s, length, p in runs:
        depth[s + p] += 1
        depth[s + length] -= 1
    keep = (np.cumsum(depth[:-1]) == 0).tolist()
    return [w for w, k in zip(words, keep, strict=True) if k]


def find_runs(docs: DataFrame, text_col: str = "text", shortest: int = SHORTEST, repeats: int = REPEATS, into: str = "periodic") -> DataFrame:
    """``docs`` with a column of n_words, runs (start, length, period, by start and period) and the collapsed text, its kept words joined by one space."""
    name = fresh(into, docs.columns)
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 256):  # collapsed texts of so many documents are held at a time
                part = batch.slice(row, 256)
                column = part.column(at)
                told = []
                for text in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
                    words = (text.as_py() or b"").split()  # bytes part at space and \t to \r
                    runs = word_runs(words, shortest, repeats)
                    told.append({"n_words": len(words), "runs": [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], "collapsed": b" ".join(collapse(words, runs)).decode()})
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(told, ARROW)], names=[*part.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, FOUND)])
    return docs.mapInArrow(work, schema)


def digests(found: F.Column) -> list[F.Column]:
    """Digest columns of a column of ``find_runs``: how many runs, the longest one (ties: the first, then the shortest period), and hashes of runs and text."""
    runs = found["runs"]
    longest = F.get(F.array_sort(F.transform(runs, lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    told = F.array_join(F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return [
        F.size(runs).cast("bigint").alias("n_runs"), longest["start"].alias("start"), (-longest["a"]).alias("length"), longest["period"].alias("period"),
        F.floor(1000 * -longest["a"] / longest["period"]).cast("bigint").alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2(found["collapsed"], 256).alias("collapsed_sha256"),
    ]
