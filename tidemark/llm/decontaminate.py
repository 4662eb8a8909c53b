r"""Benchmark decontamination by Wu-Manber multi-pattern search.

Items and documents are lower-cased (A-Z) and cut into words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``. A window is
``window`` consecutive words of an item; an item of fewer words, but not none, is one window. Each window becomes a
byte pattern, its words with one space before, between and after, and documents are brought to the same form, so that a
pattern occurs exactly where the window's words stand consecutively.

The search is Wu-Manber's: over the first ``m`` bytes of every pattern (m: the shortest pattern) a shift table of hashed
blocks says how far no pattern can end, so most bytes are never looked at; where the shift is 0 a bucket of the
pattern's suffix block names the patterns to compare directly. Cursors of many stretches of text move together in NumPy.

Defined results: null texts have no words; documents without words and empty tables give zero counts; repeated rows are
judged alone, each gets its own row; items that repeat or share windows all count; items with a null id mark words but
are not listed. Texts of any length are searched whole.

The patterns are broadcast in blocks of at most ``block_bytes`` of item text. A larger benchmark takes several blocks, one
pass each, in one chain of maps without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.session import fresh
from tidemark.llm.bytesops import LOWER, U64, WORD, runs, slices, utf8

_HASH_BITS = 20
_K = U64(0x9FB21C651E98DF25)


def words_of(text: str | None) -> list[bytes]:
    data = LOWER[np.frombuffer((text or "").encode(), dtype=np.uint8)]
    starts, ends = runs(WORD[data], np.array([0, len(data)]))
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts, ends, strict=True)]


class WuManber:
    """Finds all occurrences of byte patterns. Patterns of very unlike lengths are searched in groups, so that one
    short pattern does not make the shifts of all others short."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        groups: dict[int, list[int]] = {}
        for i, p in enumerate(patterns):
            groups.setdefault(min(len(p), 48).bit_length() if len(p) < 24 else 6, []).append(i)
        self.groups = [self._tables(ids) for _, ids in sorted(groups.items())]

    def _tables(self, ids: list[int]):
        m = min(len(self.patterns[i]) for i in ids)
        block = min(8, m)
        mask = U64((1 << (8 * block)) - 1)
        heads = np.frombuffer(b"".join(self.patterns[i][:m].ljust(m + 8, b"\0") for i in ids), dtype=np.uint8).reshape(len(ids), m + 8)
        shift = np.full(1 << _HASH_BITS, m - block + 1, dtype=np.int32)
        for end in range(block, m + 1):  # later blocks have smaller shifts and overwrite
            at = np.ascontiguousarray(heads[:, end - block : end - block + 8]).view(U64).ravel() & mask
            shift[(at * _K) >> U64(64 - _HASH_BITS)] = m - end
        last = np.ascontiguousarray(heads[:, m - block : m - block + 8]).view(U64).ravel() & mask
        buckets: dict[int, list[int]] = {}
        for i, b in zip(ids, last.tolist(), strict=True):
            buckets.setdefault(b, []).append(i)
        return m, block, mask, shift, buckets, np.array(sorted(buckets), dtype=U64)

    def find(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, pattern) of every occurrence in ``data``."""
        n = len(data)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        windows = np.lib.stride_tricks.sliding_window_view(padded, 8)
        raw = data.tobytes()
        for m, block, mask, shift, buckets, known in self.groups:
            if n < m:
                continue
            lane = 1024
            at = np.arange(m, n + 1, lane, dtype=np.int64)  # ends of the windows looked at
            stop = np.minimum(at + lane, n + 1)
            while len(at):
                blocks = np.ascontiguousarray(windows[at - block]).view(U64).ravel() & mask
                step = shift[(blocks * _K) >> U64(64 - _HASH_BITS)]
                stay = np.flatnonzero(step == 0)
                if len(stay):
                    found = blocks[stay]
                    place = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    for k in stay[known[place] == found].tolist():
                        start = int(at[k]) - m
                        for i in buckets[int(blocks[k])]:
                            p = self.patterns[i]
                            if raw.startswith(p, start):
                                yield start, i
                at = at + np.maximum(step, 1)
                live = at < stop
                at, stop = at[live], stop[live]


class Benchmark:
    """Patterns of the windows of items, and the items of each pattern."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        of: dict[bytes, tuple[int, set]] = {}
        for item, text in items:
            words = words_of(text)
            for k in range(max(1, len(words) - window + 1) if words else 0):
                part = words[k : k + window]
                of.setdefault(b" " + b" ".join(part) + b" ", (len(part), set()))[1].add(item)
        self.sizes = [n for n, _ in of.values()]
        self.items = [ids for _, ids in of.values()]
        self.search = WuManber(list(of))


def _normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as single-spaced lower-case words with a space around; where each text starts; where the words start."""
    low = LOWER[data]
    word = WORD[low]
    starts, ends = runs(word, offsets)
    keep = word.copy()
    after = ends[ends < len(data)]
    # the byte after a word becomes its space, unless the next text begins there
    own = np.ones(len(data) + 1, bool)
    own[offsets[1:-1]] = False
    after_own = after[own[after]]
    keep[after_own] = True
    low[~word] = 32
    glued = np.setdiff1d(ends, after_own, assume_unique=True)  # words at the end of their text
    first_of = np.searchsorted(starts, offsets)  # word numbers
    begins = offsets[:-1]
    lead = np.diff(first_of) > 0
    kept = np.concatenate([[0], np.cumsum(keep)])
    size_raw = kept[offsets[1:]] - kept[begins]
    text_size = size_raw + lead + np.isin(offsets[1:], glued) * lead
    out_at = np.concatenate([[0], np.cumsum(text_size)])
    out = np.full(int(out_at[-1]), 32, np.uint8)
    which = np.repeat(np.arange(len(begins)), size_raw)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(size_raw) - size_raw, size_raw)
    out[out_at[which] + 1 + inside] = low[keep]
    text_of_word = np.searchsorted(offsets, starts, side="right") - 1
    word_at = out_at[text_of_word] + 1 + kept[starts] - kept[begins[text_of_word]]
    return out, out_at, word_at


def _judge(benchmark: Benchmark, data: np.ndarray, offsets: np.ndarray, spans: list[list], items: list[set]) -> np.ndarray:
    """Adds hit spans (word numbers within the text) and items of each text; returns the texts' word counts."""
    out, out_at, word_at = _normalised(data, offsets)
    first = np.searchsorted(word_at, out_at)
    for start, i in benchmark.search.find(out):
        word = int(np.searchsorted(word_at, start + 1))
        text = int(np.searchsorted(out_at, start, side="right")) - 1
        w = word - int(first[text])
        spans[text].append((w, w + benchmark.sizes[i]))
        items[text] |= benchmark.items[i]
    return np.diff(first)


def covered(spans: list[tuple[int, int]]) -> int:
    """How many numbers the half-open spans cover together."""
    total, end = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


HITS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
])


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[list[tuple]]:
    """The items in blocks of at most about ``block_bytes`` of text each. Only the blocks' number grows."""
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = int(size // block_bytes) + 1
    cut = [rows if n == 1 else rows.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k) for k in range(n)]
    return [[(r.i, r.t) for r in part.toLocalIterator()] for part in cut]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = 8 << 20, into: str = "hits") -> DataFrame:
    """``docs`` with a struct column (``into``, with underscores added if that name is taken): n_words, n_hit (words inside any occurrence of a window), n_items
    (items with occurring windows), items_sha256 (of their ids as strings, sorted and comma-joined), contaminated."""
    sc = docs.sparkSession.sparkContext
    name = fresh(into, docs.columns)
    state = fresh("state", [*docs.columns, name])
    blocks = item_blocks(benchmark, item_id_col, item_text_col, block_bytes)
    out = docs
    for k, block in enumerate(blocks):
        shared = sc.broadcast(block)
        final = k == len(blocks) - 1
        schema = T.StructType([*docs.schema.fields, T.StructField(name, HITS) if final else T.StructField(state, T.BinaryType())])
        out = out.mapInArrow(_mapper(shared, window, docs.columns, text_col, name, state, k > 0, final), schema)
    return out


def _mapper(shared, window, columns, text_col, name, state, resumed, final):
    def run(batches):
        import pickle

        bench = _built(shared, window)
        for batch in batches:
            data, offsets = utf8(batch.column(text_col))
            kept = [pickle.loads(x) for x in batch.column(state).to_pylist()] if resumed else [(0, [], set()) for _ in range(batch.num_rows)]
            counts = np.zeros(batch.num_rows, np.int64)
            for i, j in slices(offsets):
                counts[i:j] = _judge(bench, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], [k[1] for k in kept[i:j]], items := [k[2] for k in kept[i:j]])
                kept[i:j] = [(c, k[1], s) for c, k, s in zip(counts[i:j], kept[i:j], items, strict=True)]
            own = [batch.column(c) for c in columns]
            if not final:
                yield pa.RecordBatch.from_arrays([*own, pa.array([pickle.dumps(k) for k in kept], pa.binary())], names=[*columns, state])
                continue
            hit = [covered(k[1]) for k in kept]
            ids = [sorted(map(str, k[2] - {None})) for k in kept]
            made = pa.StructArray.from_arrays([
                pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids], pa.string()), pa.array([h > 0 for h in hit], pa.bool_()),
            ], names=HITS.names)
            yield pa.RecordBatch.from_arrays([*own, made], names=[*columns, name])

    return run


_cache: dict = {}


def _built(shared, window: int) -> Benchmark:
    """The search tables of a broadcast block, built once in each Python worker."""
    key = (shared._jid if hasattr(shared, "_jid") else id(shared), len(shared.value), hash(tuple(shared.value)), window)
    if key not in _cache:
        _cache.clear()
        _cache[key] = Benchmark(shared.value, window)
    return _cache[key]
