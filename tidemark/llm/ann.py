"""Approximate nearest neighbours on balanced posting lists, by inner product.

Vectors are scaled by one power of two so that no norm is above 1 and lengthened by one component so that all norms are 1;
then the largest inner product is the smallest distance. Centroids, one for each ``LIST`` different vectors up to ``MOST``, are
fitted on a bounded sample (about ``PER_LIST`` vectors for each, chosen by the hash of the vector) by k-means with a penalty
on large clusters, in two levels. Each vector goes to the list of its nearest centroid and, if it lies near a boundary, to one more
whose distance is within ``REPLICATE`` of the nearest (``COPIES`` in all). Every row is indexed.

Centroids are linked to their neighbours in a graph in memory; a search walks it best first from the nearest entry points and
keeps a beam of the nearest centroids. A query takes the lists of its beam whose centroids' distances are within a ratio of the
nearest. Beam and ratio are measured, not guessed: ``TRIALS`` of the queries are compared with all rows by brute force, and the
smallest beam and then the smallest ratio are taken that find ``RECALL`` of their true neighbours. So lists that lie in clusters cost little, and vectors
without any structure, where near and far centroids hardly differ, still get their neighbours. Besides, a query takes lists until they hold
``ENOUGH`` times as many vectors as its answers could need, or all lists.

Lists that lie together are packed to parts of about ``PART`` entries, long ones are cut by the hash of the vector; queries of a part are dealt
to blocks of about ``BLOCK``, and a part is copied for each of its blocks. So no task holds a long list or an unbounded number of queries, and a query
is sent once to each part that it needs, not to each list.

Equal vectors are one entry with their smallest ids: a query can have only its ``k`` + 1 smallest copies among its k nearest.
The same holds for queries: equal ones are searched once. Scores are those of the original vectors in double precision.

Defined results: null, zero, non-finite vectors and such of another length than the most common one take no part, nor do null
ids; ties go to the smaller id; with fewer than k candidates all are returned; an empty table gives no rows. Repeated rows count once;
of several vectors of one id the one of the smallest hash counts, always the same. Products beyond the range of doubles are infinite.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.session import durable, fresh

LIST, MOST, PER_LIST, COPIES, REPLICATE, DEGREE = 64, 16_384, 16, 2, 1.06, 12
TRIALS, RECALL, ENOUGH = 128, 0.97, 4
PART, BLOCK = 8_192, 16_384


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _means(x: np.ndarray, k: int, rng, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Balanced k-means: a cluster that is larger than its share is farther away for the next round. Centroids, and the cluster of each row."""
    c = x[rng.permutation(len(x))[:k]].copy()
    weight = np.zeros(len(c))
    for _ in range(rounds):
        near, scale = np.empty(len(x), np.int64), 0.0
        for i in range(0, len(x), 8192):
            d = (c**2).sum(1)[None] - 2 * x[i : i + 8192] @ c.T + weight[None]
            near[i : i + 8192] = d.argmin(1)
            scale = max(scale, float(np.abs(d).mean()))
        count = np.bincount(near, minlength=len(c))
        weight += 0.05 * max(1e-9, scale) * (count / max(1, len(x) / len(c)) - 1).clip(-1, 1)
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(count)
        c[full] = np.add.reduceat(x[order], (np.cumsum(count) - count)[full], axis=0) / count[full, None]
    return c, near


def fit(x: np.ndarray, lists: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Centroids in two levels, those of one coarse cluster one after another, and one entry point for each coarse cluster."""
    rng = np.random.default_rng(seed)
    if lists <= 16:
        c, _ = _means(x, lists, rng)
        return c, np.arange(len(c))
    coarse, near = _means(x, round(np.sqrt(lists)), rng)
    found, entries, at = [], [], 0
    for i in range(len(coarse)):
        own = x[near == i]
        if len(own):
            c, _ = _means(own, min(len(own), max(1, round(lists * len(own) / len(x)))), rng)
            entries.append(at + int(((c - coarse[i]) ** 2).sum(1).argmin()))
            found.append(c)
            at += len(c)
    return np.concatenate(found), np.array(entries)


class Graph:
    """Centroids linked to their nearest ones, and entry points."""

    def __init__(self, centroids: np.ndarray, entries: np.ndarray):
        self.c = centroids.astype(np.float32)
        self.norm = (self.c**2).sum(1)
        self.entries = entries
        links = []
        for i in range(0, len(self.c), 1024):
            d = self.norm[None] - 2 * self.c[i : i + 1024] @ self.c.T
            some = min(DEGREE, len(self.c) - 1)
            links.append(np.argpartition(d, some, axis=1)[:, : some + 1])
        self.links = np.concatenate(links).astype(np.int32)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and squared distances of about the ``beam`` nearest centroids of each row of q, nearest first."""
        rows = max(16, (8 << 20) // max(len(self.c), 40 * beam))
        parts = [self._walk(q[i : i + rows].astype(np.float32), min(beam, len(self.c))) for i in range(0, len(q), rows)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _walk(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """All rows step together; each opens the nearest few unopened centroids of its beam until there are none."""
        n, own = len(q), (q**2).sum(1)
        seen = np.zeros((n, len(self.c)), bool)
        seen[:, self.entries] = True
        ids = np.tile(self.entries.astype(np.int32), (n, 1))
        dist = own[:, None] + self.norm[self.entries][None] - 2 * q @ self.c[self.entries].T
        if len(self.entries) < beam:
            short = ((0, 0), (0, beam - len(self.entries)))
            ids, dist = np.pad(ids, short, constant_values=-1), np.pad(dist, short, constant_values=np.inf)
        order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        opened, wide = ids < 0, max(3, beam // 12)
        while True:
            now = ~opened
            now &= np.cumsum(now, axis=1) <= wide
            row, col = np.nonzero(now)
            if not len(row):
                return ids, np.maximum(0, dist)
            opened |= now
            to = self.links[ids[row, col]]
            rows, to = np.repeat(row, to.shape[1]), to.ravel()
            new = ~seen[rows, to]
            key = np.unique(rows[new].astype(np.int64) * len(self.c) + to[new])
            r, t = key // len(self.c), key % len(self.c)
            if not len(r):
                continue
            seen[r, t] = True
            active, first, count = np.unique(r, return_index=True, return_counts=True)
            place = np.arange(len(r)) - np.repeat(first, count)
            line = np.repeat(np.arange(len(active)), count)
            more = np.full((len(active), int(count.max())), np.inf, np.float32)
            names = np.full(more.shape, -1, np.int32)
            more[line, place] = own[r] + self.norm[t] - 2 * np.einsum("ij,ij->i", q[r], self.c[t])
            names[line, place] = t
            both = np.concatenate([dist[active], more], axis=1)
            best = np.argsort(both, axis=1, kind="stable")[:, :beam]
            dist[active] = np.take_along_axis(both, best, 1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], names], axis=1), best, 1)
            opened[active] = np.take_along_axis(np.concatenate([opened[active], names < 0], axis=1), best, 1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _entry(v: np.ndarray, power: int) -> np.ndarray:
    v = np.ldexp(v, -power)
    return np.concatenate([v, np.sqrt(np.maximum(0, 1 - (v**2).sum(1)))[:, None]], axis=1)


def _query(v: np.ndarray) -> np.ndarray:
    """The direction is what counts."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return np.concatenate([v / np.sqrt((v**2).sum(1))[:, None], np.zeros((len(v), 1))], axis=1)


class Index:
    """The graph, and by measure: the beam, the ratio, the number of entries of each list."""

    def __init__(self, graph: Graph, power: int):
        self.graph, self.power = graph, power
        self.beam, self.ratio, self.sizes = len(graph.c), np.inf, None

    def lists_of_entries(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): at most COPIES for each row."""
        ids, d = self.graph.search(_entry(v, self.power), 4 * COPIES)
        ids, d = ids[:, :COPIES], np.sqrt(d[:, :COPIES])
        row, col = np.nonzero((ids >= 0) & (d <= d[:, :1] * REPLICATE + 1e-6))
        return row, ids[row, col]

    def lists_of_queries(self, v: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists that each row's query searches."""
        ids, d = self.graph.search(_query(v), self.beam)
        held = np.where(ids >= 0, self.sizes[ids], 0)
        near = (np.sqrt(d) <= np.sqrt(d[:, :1]) * self.ratio + 1e-6) | (np.cumsum(held, axis=1) - held < need)
        row, col = np.nonzero((ids >= 0) & near)
        lists = ids[row, col].astype(np.int64)
        short = np.flatnonzero(held.sum(axis=1) < need)  # too few in the whole beam: all lists
        if len(short):
            other = ~np.isin(row, short)
            row = np.append(row[other], np.repeat(short, len(self.sizes)))
            lists = np.append(lists[other], np.tile(np.arange(len(self.sizes)), len(short)))
        return row, lists

    def tune(self, queries: np.ndarray, owner: np.ndarray, neighbours: np.ndarray) -> float:
        """Sets beam and ratio by the true neighbours (vectors, each with the row of its query); the share of them that is found."""
        row, lists = self.lists_of_entries(neighbours)
        beam, total = min(32, len(self.graph.c)), len(neighbours)
        while True:
            ids, d = self.graph.search(_query(queries), beam)
            d = np.sqrt(d)
            far = np.full((len(queries), len(self.graph.c)), np.inf)
            r, c = np.nonzero(ids >= 0)
            far[r, ids[r, c]] = (d / np.maximum(d[:, :1], 1e-9))[r, c]
            needed = np.full(total, np.inf)  # the ratio at which each neighbour is found
            np.minimum.at(needed, row, far[owner[row], lists])
            found = np.isfinite(needed).mean() if total else 1.0
            if found >= RECALL + (1 - RECALL) / 3 or beam == len(self.graph.c):
                break
            beam = min(len(self.graph.c), beam * 5 // 4)
        self.beam, self.ratio = beam, 1.0
        if total and np.isfinite(needed).any():
            self.ratio = float(np.sort(needed)[min(int(np.ceil(RECALL * total)), int(np.isfinite(needed).sum())) - 1]) + 1e-6
        return float((needed <= self.ratio).mean()) if total else 1.0


def _best(owner: np.ndarray, score: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` best of each owner: by score, then by order."""
    by = np.lexsort((order, -score, owner))
    first = np.flatnonzero(np.concatenate([[True], owner[by][1:] != owner[by][:-1]])) if len(by) else np.zeros(0, np.int64)
    rank = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
    return by[rank < most]


def _products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inner products of paired rows: the same for the same two vectors wherever they stand."""
    with np.errstate(over="ignore", invalid="ignore"):
        return (q * p).sum(axis=1)


def _true_neighbours(distinct: DataFrame, trials: pa.Table, dim: int, power: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Brute force for the trial queries: queries, and their k nearest other vectors with the row of their query."""
    asked = _matrix(trials["v"], dim)
    names = list(zip(trials["a"].to_pylist(), trials["b"].to_pylist(), strict=True))
    unit = _query(asked)[:, :-1]
    mine = {x: i for i, x in enumerate(names)}

    def scan(batches):
        best_s, best_v, best_q = np.zeros(0), np.zeros((0, dim)), np.zeros(0, np.int64)
        for batch in batches:
            v = _matrix(batch.column("v"), dim)
            s = unit @ np.ldexp(v, -power).T
            a, b = (batch.column("g").field(x).to_pylist() for x in ("a", "b"))
            for i, x in enumerate(zip(a, b, strict=True)):
                if x in mine:
                    s[mine[x], i] = -np.inf
            top = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
            r = np.repeat(np.arange(len(unit)), top.shape[1])
            best_s, best_q = np.concatenate([best_s, s[r, top.ravel()]]), np.concatenate([best_q, r])
            best_v = np.concatenate([best_v, v[top.ravel()]])
            keep = _best(best_q, best_s, np.zeros(len(best_q)), k)
            keep = keep[np.isfinite(best_s[keep])]
            best_s, best_v, best_q = best_s[keep], best_v[keep], best_q[keep]
        at = pa.array((np.arange(len(best_v) + 1) * dim).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(best_q.astype(np.int32)), pa.array(best_s), pa.ListArray.from_arrays(at, pa.array(best_v.ravel()))], names=["q", "s", "v"])

    found = distinct.mapInArrow(scan, "q int, s double, v array<double>")
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "v"))).where(F.col("r") <= k)
    near = top.select("q", "v").orderBy("q", "r").toArrow()  # TRIALS times k rows at most
    return asked, near["q"].to_numpy().astype(np.int64), _matrix(near["v"], dim)


def _packed(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each list its first part and how many parts it is cut into; the number of parts."""
    first, cuts, part, room = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // PART)), -1, 0
    for i, n in enumerate(sizes):
        if n > room or cuts[i] > 1:
            part, room = part + 1, PART
        first[i] = part
        part += cuts[i] - 1
        room = 0 if cuts[i] > 1 else room - n
    return first, cuts, int(part + 1)


def _matches(dim: int, k: int, power: int):
    """Within a part and block: for each query the k + 1 best entries of the lists that it searches."""

    def run(q: pa.Table, p: pa.Table) -> pa.Table:
        empty = pa.table({"qa": pa.array([], pa.int64()), "qb": pa.array([], pa.int64()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "s": pa.array([], pa.float64())})
        if not q.num_rows or not p.num_rows:
            return empty
        qv = _matrix(q["v"], dim)
        own, place = np.unique(p["list"].to_numpy(), return_inverse=True)
        # an entry that stands in several lists of the part is one row here, with all its lists
        a, b = p["a"].to_numpy(), p["b"].to_numpy()
        by = np.lexsort((place, b, a))
        new = np.concatenate([[True], (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])])
        entry, heads = np.cumsum(new) - 1, by[new]
        nth = np.arange(len(by)) - np.flatnonzero(new)[entry]
        lists_of = np.full((len(heads), int(nth.max()) + 1), len(own))  # beyond the last list: none
        lists_of[entry, nth] = place[by]
        by = np.argsort(lists_of[:, 0], kind="stable")
        p, lists_of = p.take(pa.array(heads[by])), lists_of[by]
        pv = _matrix(p["v"], dim)
        unit, scaled = _query(qv)[:, :-1], np.ldexp(pv, -power)
        order = np.empty(len(pv), np.int64)
        order[pc.sort_indices(p["id"]).to_numpy()] = np.arange(len(pv))
        asked = q["lists"].combine_chunks()
        wanted, row = asked.flatten().to_numpy(), np.repeat(np.arange(len(qv)), np.diff(asked.offsets.to_numpy()))
        at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
        hit = own[at] == wanted
        opened = np.zeros((len(qv), len(own) + 1), bool)
        opened[row[hit], at[hit]] = True
        found = []
        for j in range(0, len(pv), 2048):
            block = lists_of[j : j + 2048]
            rows = np.flatnonzero(opened[:, np.unique(block)].any(axis=1))
            for i in range(0, len(rows), 1024):
                r = rows[i : i + 1024]
                seen = opened[r][:, block[:, 0]]
                for c in range(1, block.shape[1]):
                    seen |= opened[r][:, block[:, c]]
                s = np.where(seen, unit[r] @ scaled[j : j + 2048].T, -np.inf)
                take = min(k + 1, len(block))
                least = -np.partition(-s, take - 1, axis=1)[:, take - 1]
                a, b = np.nonzero((s >= least[:, None] - 1e-12) & seen)
                a, b = r[a], b + j
                score = _products(qv[a], pv[b])
                keep = _best(a, np.where(np.isnan(score), np.inf, score), order[b], k + 1)
                found.append((a[keep], b[keep], score[keep]))
        if not found:
            return empty
        a, b, score = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = _best(a, np.where(np.isnan(score), np.inf, score), order[b], k + 1)
        a, b, score = pa.array(a[keep]), pa.array(b[keep]), pa.array(score[keep])
        return pa.table({"qa": q["a"].take(a), "qb": q["b"].take(a), "a": p["a"].take(b), "b": p["b"].take(b), "s": score})

    return run


def build(distinct: DataFrame, trials: DataFrame, dim: int, k: int) -> tuple[Index, float] | None:
    """An index for the different vectors (g, v): graph, beam and ratio; and the share of the trial queries' neighbours that it finds."""
    def longest(batches):
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("v"), dim)
                top = np.abs(v).max(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([float((np.log2(top) + 0.5 * np.log2(((v / top[:, None]) ** 2).sum(axis=1))).max())]), pa.array([len(v)])], names=["top", "n"])

    power, n = distinct.select("v").mapInArrow(longest, "top double, n bigint").agg(F.max("top"), F.sum("n")).first()
    if not n:
        return None
    power = int(np.ceil(power + 1e-9))
    lists = int(min(MOST, max(1, n // LIST)))
    # about so many vectors, by their hashes; all if there are few
    share = min(1.0, max(4096, PER_LIST * lists) / n)
    chosen = distinct.where(F.pmod("g.a", F.lit(1 << 30)) <= int(share * (1 << 30))).select("g.a", "g.b", "v").toArrow()
    chosen = chosen.sort_by([("a", "ascending"), ("b", "ascending")])
    sample = _entry(_matrix(chosen["v"], dim), power) if chosen.num_rows else np.zeros((1, dim + 1))
    index = Index(Graph(*fit(sample, min(lists, len(sample)))), power)
    asked, owner, near = _true_neighbours(distinct, trials.toArrow(), dim, power, k)
    return index, index.tune(asked, owner, near) if len(asked) else 1.0


def nearest(vectors: DataFrame, queries: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> DataFrame:
    """(query_id, rank, <id_col>, score): the k nearest rows of each row for which ``queries`` is true, itself left out."""
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType
    found_id = "vec_id" if id_col == "query_id" else id_col
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("rank", T.IntegerType()), T.StructField(found_id, kind), T.StructField("score", T.DoubleType())])
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim = int(lengths.n)
    # 128 bits; -0.0 and 0.0 are the same number
    plain = F.transform("v", lambda x: x + F.lit(0).cast("float"))
    key = F.struct(F.xxhash64(F.lit(1), plain).alias("a"), F.xxhash64(F.lit(2), plain).alias("b"))
    rows = rows.where(F.size("v") == dim).withColumn("g", key)
    named = durable(rows.groupBy("id").agg(F.min("g").alias("g"), F.max("q").alias("q")))
    # of equal vectors the k + 1 smallest ids can be among the nearest; queries keep all theirs
    ranked = named.select("id", "g", F.row_number().over(Window.partitionBy("g").orderBy("id")).alias("r")).where(F.col("r") <= k + 1)
    members, asked = durable(ranked), named.where("q").select("id", "g")
    least = members.where("r = 1").select("g", "id")
    distinct = durable(rows.groupBy("g").agg(F.first("v").alias("v")).join(least, "g"))
    wanted = distinct.join(asked.select("g").distinct(), "g", "left_semi")
    made = build(distinct, wanted.orderBy("g").limit(TRIALS).select("g.a", "g.b", "v"), dim, k)
    if made is None:
        return spark.createDataFrame([], schema)
    index = made[0]
    shared = spark.sparkContext.broadcast(index)  # at most MOST centroids
    v_type, id_type = rows.schema["v"].dataType.simpleString(), kind.simpleString()

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                row, lists = shared.value.lists_of_entries(_matrix(batch.column("v"), dim))
                row = pa.array(row)
                g = batch.column("g")
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), g.field("a").take(row), g.field("b").take(row), batch.column("id").take(row), batch.column("v").take(row)], names=["list", "a", "b", "id", "v"])

    entries = durable(distinct.select("g", "id", "v").mapInArrow(place, f"list int, a bigint, b bigint, id {id_type}, v {v_type}"))
    sizes = np.zeros(len(index.graph.c), np.int64)
    for r in entries.groupBy("list").count().collect():  # at most MOST rows
        sizes[r["list"]] = r["count"]
    index.sizes = sizes
    first, cuts, parts = _packed(sizes)
    shared_q = spark.sparkContext.broadcast((index, first, cuts))
    # a vector stands in COPIES lists at most, so that many entries hold k + 1 different ones for certain
    need = ENOUGH * COPIES * (k + 1)

    def ask(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            found, first, cuts = shared_q.value
            row, lists = found.lists_of_queries(_matrix(batch.column("v"), dim), need)
            # a row for each query and part, with its lists there
            times = cuts[lists]
            part = np.repeat(first[lists], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            row, lists = np.repeat(row, times), np.repeat(lists, times)
            by = np.lexsort((lists, part, row))
            row, part, lists = row[by], part[by], lists[by]
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (part[1:] != part[:-1])]))
            at = pa.array(np.append(new, len(row)).astype(np.int32))
            mine, g = pa.array(row[new]), batch.column("g")
            yield pa.RecordBatch.from_arrays([pa.array(part[new].astype(np.int32)), g.field("a").take(mine), g.field("b").take(mine), batch.column("v").take(mine), pa.ListArray.from_arrays(at, pa.array(lists.astype(np.int32)))], names=["part", "a", "b", "v", "lists"])

    sent = durable(wanted.select("g", "v").mapInArrow(ask, f"part int, a bigint, b bigint, v {v_type}, lists array<int>"))
    blocks = np.ones(parts, np.int64)
    for r in sent.groupBy("part").count().collect():  # a row for each PART entries
        blocks[r["part"]] = -(-r["count"] // BLOCK)
    cut = F.broadcast(spark.createDataFrame([(i, int(f), int(c)) for i, (f, c) in enumerate(zip(first, cuts, strict=True))], "list int, first int, cuts int"))  # at most MOST rows
    many = spark.createDataFrame([(i, int(b)) for i, b in enumerate(blocks)], "part int, blocks int")
    left = sent.join(many, "part").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")).drop("blocks")
    right = entries.join(cut, "list").withColumn("part", (F.col("first") + F.pmod(F.col("b"), F.col("cuts"))).cast("int")).drop("first", "cuts")
    right = right.join(many, "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    pairs = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_matches(dim, k, index.power), "qa bigint, qb bigint, a bigint, b bigint, s double")
    pairs = pairs.select(F.struct(F.col("qa").alias("a"), F.col("qb").alias("b")).alias("q"), F.struct("a", "b").alias("g"), "s")
    # groups, not rows: k + 1 of them hold the k nearest rows, with all that tie at the end
    groups = pairs.groupBy("q", "g").agg(F.max("s").alias("s")).withColumn("r", F.rank().over(Window.partitionBy("q").orderBy(F.desc("s")))).where(F.col("r") <= k + 1)
    per_group = groups.select("q", "g", "s").join(members.select("g", "id"), "g")
    per_group = per_group.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "id"))).where(F.col("r") <= k + 1)
    me = fresh("me", ["id"])
    answers = asked.select(F.col("id").alias(me), F.col("g").alias("q")).join(per_group.select("q", "id", "s"), "q").where(F.col(me) != F.col("id"))
    last = Window.partitionBy(me).orderBy(F.desc("s"), "id")
    return answers.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select(F.col(me).alias("query_id"), "rank", F.col("id").alias(found_id), F.col("s").alias("score"))
