r"""Language-model scoring by context-tree weighting.

Texts are lower-cased (A-Z) and cut into tokens ``[^\x20\x09-\x0D]+``; the model reads a text as the bytes of its tokens,
a space after each, then a line end. The line end is the end token, so the bytes say the same as the tokens.

A byte is eight binary decisions. Each decision has a tree of contexts, the 0 to ``DEPTH`` bytes before; every node keeps
a Krichevsky-Trofimov estimate of its bits, and a node's weighted probability is half its own estimate and half the
product of its children's. The posterior of "stop here" along a context's path mixes the estimates of all depths.

Counts of all (context, byte) pairs are taken over all training texts: each task counts its own first, then they are
summed by key in a written table. No context is dropped, so the tree grows with the corpus. All contexts that end in the same
two bytes are one subtree and meet in one task, which weighs it bottom up; the driver weighs only the contexts of two, one and no bytes,
of which the alphabet allows 256**2 at most, and the subtrees are then read top down. A path ends at its deepest node with counts.

That gives one code length for each (context, byte) of the texts to score. The most frequent ones, at most ``FREQUENT``, are looked up in a
broadcast hash table; the others of each text are joined by key.

Defined results: null and white space only are the empty text, which is one line end; repeated rows score alike; texts
are read whole; with no training texts every byte has probability 1/256.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.session import durable
from tidemark.llm.bytesops import LOWER, SPACE, U64, runs, slices, span_hashes, utf8

DEPTH, CAPACITY = 5, 19
#: At most so many code lengths are broadcast; all others are joined. Both ways give the same scores.
FREQUENT = 1 << 21


def stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes the model reads, and where each text's begin."""
    low = LOWER[data]
    starts, ends = runs(~SPACE[low], offsets)
    sizes = ends - starts
    text = np.searchsorted(offsets, starts, side="right") - 1
    size = np.bincount(text, weights=sizes + 1, minlength=len(offsets) - 1).astype(np.int64) + 1
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(at[-1]), 32, np.uint8)
    out[at[1:] - 1] = 10
    first = np.cumsum(sizes + 1) - sizes - 1 + text  # each earlier text has one line end more
    where = np.repeat(first, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[where] = low[~SPACE[low]]
    return out, at


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte the model reads: DEPTH bytes before it (line ends before a text) above the byte, in one integer."""
    out, at = stream(data, offsets)
    before = np.concatenate([np.full(DEPTH, 10, np.uint8), out]).astype(U64)
    key = before[DEPTH:].copy()
    n = len(out)
    position = np.arange(n) - np.repeat(at[:-1], np.diff(at))
    for k in range(1, DEPTH + 1):
        past = before[DEPTH - k : DEPTH - k + n]
        key |= np.where(position >= k, past, U64(10)) << U64(8 * k)
    return key, at


def _count(batches):
    """Counts of this task's texts; kept sorted and merged, so a task emits a key once for each 8 million or so."""
    keys, counts = np.zeros(0, U64), np.zeros(0, np.int64)

    def out(k, c):
        for i in range(0, len(k), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(k[i : i + (1 << 16)].astype(np.int64)), pa.array(c[i : i + (1 << 16)])], names=["key", "n"])

    for batch in batches:
        data, offsets = utf8(batch.column(0))
        for i, j in slices(offsets, 2 << 20):
            key, _ = grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            key.sort()
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            k, c = key[first], np.diff(np.append(first, len(key)))
            both = np.concatenate([keys, k])
            order = np.argsort(both, kind="stable")
            both, n = both[order], np.concatenate([counts, c])[order]
            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
            keys, counts = both[first], np.add.reduceat(n, first) if len(first) else n
            if len(keys) > 4_000_000:
                yield from out(keys, counts)
                keys, counts = np.zeros(0, U64), np.zeros(0, np.int64)
    yield from out(keys, counts)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    less = np.zeros_like(x)
    for _ in range(6):
        less -= np.log(x)
        x = x + 1
    return less + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def _block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def _mask(depth: int) -> np.uint64:
    return U64((1 << (8 * (depth + 1))) - 1)


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def _nodes(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The trees of the eight decisions, of (context, byte) keys: (context, bits so far), zeros, ones."""
    context, byte = keys >> U64(8), keys & U64(255)
    k = np.concatenate([(context << U64(8)) | (U64(1) << U64(b)) | (byte >> U64(8 - b)) for b in range(8)])
    one = np.concatenate([((byte >> U64(7 - b)) & U64(1)).astype(np.float64) for b in range(8)])
    c = np.tile(counts.astype(np.float64), 8)
    u, inv = np.unique(k, return_inverse=True)
    ones = np.bincount(inv, weights=c * one, minlength=len(u))
    return u, np.bincount(inv, weights=c, minlength=len(u)) - ones, ones


def _weigh(u: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: tuple[np.ndarray, np.ndarray] | None, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of "stop here" and logarithm of the weighted probability of nodes of depth d, from those one deeper."""
    own = _block(zeros, ones)
    if below is None:
        return np.ones(len(u)), own
    parent = (((below[0] >> U64(8)) & (_mask(d) >> U64(8))) << U64(8)) | (below[0] & U64(255))
    children = np.bincount(np.searchsorted(u, parent), weights=below[1], minlength=len(u))
    total = np.logaddexp(own, children) - np.log(2)
    return np.exp(np.minimum(0, own - np.log(2) - total)), total


def _subtree(keys: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """For depth DEPTH to 2: nodes, zeros, ones, stop, total of all contexts that end in the same two bytes."""
    out, below = [], None
    for d in range(DEPTH, 1, -1):
        keys, inv = np.unique(keys & _mask(d), return_inverse=True)
        counts = np.bincount(inv, weights=counts, minlength=len(keys))
        nodes = _nodes(keys, counts)
        stop, total = _weigh(*nodes, below, d)
        below = (nodes[0], total)
        out.append((*nodes, stop, total))
    return out


def _read(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table["key"].to_numpy().astype(U64), table["n"].to_numpy().astype(np.float64)


def _bottom(table: pa.Table) -> pa.Table:
    """The nodes of two bytes, weighed with all that is below them."""
    keys, n = _read(table)
    u, zeros, ones, _, total = _subtree(keys[n > 0], n[n > 0])[-1]
    as_double = {c: pa.array(x.astype(np.float64)) for c, x in (("zeros", zeros), ("ones", ones), ("total", total))}  # NumPy counts nothing in integers
    return pa.table({"node": u.astype(np.int64), **as_double})


def _top_down(top: list[tuple[np.ndarray, ...]]):
    """top: nodes, zeros, ones and stop of depth 0 and 1."""

    def run(table: pa.Table) -> pa.Table:
        keys, n = _read(table)
        levels = [*top, *(x[:4] for x in _subtree(keys[n > 0], n[n > 0])[::-1])]
        byte, logp = keys & U64(255), np.zeros(len(keys))
        for b in range(8):
            bits, bit = (U64(1) << U64(b)) | (byte >> U64(8 - b)), ((byte >> U64(7 - b)) & U64(1)) == 1
            mixed, deeper = np.full(len(keys), 0.5), np.zeros(len(keys), bool)
            for d in range(DEPTH, -1, -1):
                u, zeros, ones, stop = levels[d]
                if not len(u):
                    continue
                at, hit = _lookup(u, (((keys >> U64(8)) & (_mask(d) >> U64(8))) << U64(8)) | bits)
                p = (np.where(bit, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1)
                mixed = np.where(hit, np.where(deeper, stop[at] * p + (1 - stop[at]) * mixed, p), mixed)
                deeper |= hit
            logp += np.log10(mixed)
        return pa.table({"key": table["key"], "n": table["n"], "logp": logp})

    return run


class Table:
    """A hash table from 64-bit keys to numbers: three places for each key, what finds none is sorted apart."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, kind=np.float32):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 1.5))))
        self.keys = np.full(1 << self.bits, ~U64(0), U64)
        self.values = np.zeros(1 << self.bits, kind)
        left = np.arange(len(keys))
        for probe in range(3):
            at = self._at(keys[left], probe)
            at_u, first = np.unique(at, return_index=True)
            free = self.keys[at_u] == ~U64(0)
            put = left[first[free]]
            self.keys[at_u[free]], self.values[at_u[free]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
        order = left[np.argsort(keys[left])]
        self.rest, self.rest_values = keys[order], values[order].astype(kind)

    def _at(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15 + 2 * probe * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF | 1)) >> U64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys were found."""
        at = self._at(keys, 0)
        hit, value = self.keys[at] == keys, self.values[at]
        for probe in (1, 2):
            miss = np.flatnonzero(~hit)
            if not len(miss):
                return value, hit
            at = self._at(keys[miss], probe)
            good = self.keys[at] == keys[miss]
            value[miss[good]] = self.values[at[good]]
            hit[miss[good]] = True
        miss = np.flatnonzero(~hit)
        if len(miss) and len(self.rest):
            at, good = _lookup(self.rest, keys[miss])
            value[miss[good]] = self.rest_values[at[good]]
            hit[miss[good]] = True
        return value, hit


class Model:
    """``counted``: (key, n) with one row for each (context, byte), in the shared folder; n may be 0."""

    def __init__(self, counted: DataFrame):
        self.counted = counted
        # at most 256**2 contexts of two bytes
        found = self._subtrees(counted).applyInArrow(_bottom, "node bigint, zeros double, ones double, total double").toArrow()
        node, zeros, ones, total = (found[c].to_numpy() for c in ("node", "zeros", "ones", "total"))
        node, order = np.sort(node).astype(U64), np.argsort(node)
        zeros, ones, below, self.top = zeros[order], ones[order], (node, total[order]), []
        for d in (1, 0):
            u, inv = np.unique((((node >> U64(8)) & (_mask(d) >> U64(8))) << U64(8)) | (node & U64(255)), return_inverse=True)
            zeros, ones = (np.bincount(inv, weights=x, minlength=len(u)) for x in (zeros, ones))
            stop, total = _weigh(u, zeros, ones, below, d)
            node, below = u, (u, total)
            self.top.insert(0, (u, zeros, ones, stop))

    @staticmethod
    def _subtrees(counted: DataFrame):
        return counted.groupBy(F.expr("shiftright(key, 8) & 65535").alias("ends"))

    def lengths(self, more: DataFrame | None = None) -> DataFrame:
        """(key, n, logp): log10 of the byte's probability, for all keys counted and those of ``more``."""
        rows = self.counted
        if more is not None:
            rows = rows.union(more.select("key", F.lit(0).cast("bigint"))).groupBy("key").agg(F.sum("n").alias("n"))
        return self._subtrees(rows).applyInArrow(_top_down(self.top), "key bigint, n bigint, logp double")

    def log10(self, keys: np.ndarray) -> np.ndarray:
        more = self.counted.sparkSession.createDataFrame([(int(k),) for k in np.unique(keys)], "key bigint")
        got = {r.key: r.logp for r in self.lengths(more).join(F.broadcast(more), "key", "left_semi").toLocalIterator()}
        return np.array([got[int(k)] for k in keys])


def fit(docs: DataFrame, *, text_col: str = "text", others: DataFrame | None = None) -> Model:
    """The tree of all ``docs``; the contexts of ``others`` are only put down as wanted, with no counts."""
    count = lambda df: df.select(F.col(text_col)).mapInArrow(_count, "key bigint, n bigint")
    counted = count(docs)
    if others is not None:
        counted = counted.union(count(others).select("key", F.lit(0).cast("bigint")))
    return Model(durable(counted.groupBy("key").agg(F.sum("n").alias("n"))))


def _most_frequent(lengths: DataFrame) -> tuple[Table, F.Column | None]:
    """A table of at most FREQUENT keys, and the condition for all others (None if there are none)."""
    size = F.floor(F.log2(F.col("n") + 1))
    least, total, whole = None, 0, True
    for r in sorted(lengths.groupBy(size.alias("size")).count().collect(), reverse=True):  # at most 64 rows
        total += r["count"]
        if total > FREQUENT:
            whole = False
            break
        least = r["size"]
    often = lengths.where(F.lit(False) if least is None else size >= least).select("key", "logp").toArrow()
    rest = None if whole else F.lit(True) if least is None else size < least
    return Table(often["key"].to_numpy().astype(U64), often["logp"].to_numpy()), rest


#: A token and its hash; the base model joins counts by this hash.
def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[data]
    starts, ends = runs(~SPACE[low], offsets)
    return span_hashes(low, starts, ends).astype(np.int64), np.searchsorted(offsets, starts, side="right") - 1


def _token_counts(batches):
    """(token hash, count) of a task; the end token has hash 0."""
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        for i, j in slices(offsets, 1 << 20):
            h, _ = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            u, c = np.unique(np.append(h, np.zeros(j - i, np.int64)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c.astype(np.int64))], names=["h", "c"])


def _lists(parts: list[np.ndarray], sizes: list[np.ndarray]) -> pa.ListArray:
    flat, at = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (parts, sizes))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(at)]).astype(np.int32)), pa.array(flat))


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def language_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams with one added), score (log10
    probability of the text by context-tree weighting), n_bytes (that the model reads) and bits_per_byte, its code length.

    Base counts are exact. Tokens of at least 1/2**CAPACITY of all occurrences are at most 2**CAPACITY, so they are
    broadcast; the rarer ones of each text are joined by key."""
    train = docs.where(~held_out(id_col)).select(text_col)
    sc = docs.sparkSession.sparkContext
    lengths = durable(fit(train, text_col=text_col, others=docs.where(held_out(id_col))).lengths())
    table, seldom = _most_frequent(lengths)
    model = sc.broadcast(table)  # at most FREQUENT keys
    counts = durable(train.mapInArrow(_token_counts, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")))
    n_train, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = F.col("c") * (1 << CAPACITY) >= n_train
    often = counts.where(frequent).toArrow()
    size = float(n_train + distinct + 1)
    known = sc.broadcast(Table(often["h"].to_numpy().astype(U64), np.log10((often["c"].to_numpy() + 1.0) / size), np.float64))

    def score(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            texts, n = [], np.zeros((4, batch.num_rows))
            rare, sizes, far, far_sizes = [], [], [], []
            for i, j in slices(offsets, 1 << 20):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                k, where = grams(part, at)
                value, hit = model.value.get(k)
                texts.append(np.add.reduceat(np.where(hit, value, 0).astype(np.float64), where[:-1]))
                n[3, i:j] = np.diff(where)
                far.append(k[~hit].astype(np.int64))
                far_sizes.append(np.add.reduceat((~hit).astype(np.int64), where[:-1]))
                h, text = tokens(part, at)
                h, text = np.append(h, np.zeros(j - i, np.int64)), np.append(text, np.arange(j - i))
                value, hit = known.value.get(h.astype(U64))
                n[0, i:j] = np.bincount(text, minlength=j - i)
                n[1, i:j] = np.bincount(text[hit], minlength=j - i)
                n[2, i:j] = np.bincount(text[hit], weights=value[hit], minlength=j - i)
                left = np.flatnonzero(~hit)
                left = left[np.argsort(text[left], kind="stable")]
                rare.append(h[left])
                sizes.append(np.bincount(text[left], minlength=j - i))
            lists = [_lists(rare, sizes), _lists(far, far_sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate([np.zeros(0), *texts])), pa.array(n[0].astype(np.int64)), pa.array(n[1].astype(np.int64)), pa.array(n[2]), pa.array(n[3].astype(np.int64)), *lists], names=["id", "row", "score", "n", "k", "b", "bytes", "rare", "far"])

    # 128 bits for each id and text
    key = F.unhex(F.md5(F.concat_ws("\0", F.coalesce(F.col(id_col).cast("string"), F.lit("\1")), F.coalesce(F.col(text_col), F.lit("")))))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("row"), F.col(text_col))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T._parse_datatype_string("row binary, score double, n bigint, k bigint, b double, bytes bigint, rare array<bigint>, far array<bigint>").fields])
    scored = durable(rows.mapInArrow(score, schema))
    # rows of the same id and text have the same rarer tokens, so one of them stands for all
    rare = scored.where("size(rare) > 0").groupBy("row").agg(F.first("rare").alias("rare")).select("row", F.explode("rare").alias("h"))
    rest = rare.groupBy("row", "h").agg(F.count("*").alias("m")).join(counts.where(~frequent), "h", "left")
    rest = rest.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("k2"), F.sum(F.col("m") * F.log10((F.coalesce("c", F.lit(0)) + 1.0) / F.lit(size))).alias("b2"))
    zero = F.lit(0)
    out, more = scored.join(rest, "row", "left"), F.lit(0.0)
    if seldom is not None:
        far = scored.where("size(far) > 0").groupBy("row").agg(F.first("far").alias("far")).select("row", F.explode("far").alias("key")).groupBy("row", "key").agg(F.count("*").alias("m"))
        far = far.join(lengths.where(seldom).select("key", "logp"), "key").groupBy("row").agg(F.sum(F.col("m") * F.col("logp")).alias("s2"))
        out, more = out.join(far, "row", "left"), F.coalesce("s2", F.lit(0.0))
    total = F.col("score") + more
    return out.select(
        F.col("id").alias(id_col), held_out("id").alias("held_out"), F.col("n").alias("n_tokens"), (F.col("k") + F.coalesce("k2", zero)).cast("bigint").alias("n_known"),
        F.lit(n_train).cast("bigint").alias("train_tokens"), (F.col("b") + F.coalesce("b2", F.lit(0.0))).alias("base_score"), total.alias("score"),
        F.col("bytes").alias("n_bytes"), (-total * F.lit(float(np.log2(10))) / F.col("bytes")).alias("bits_per_byte"),
    )
