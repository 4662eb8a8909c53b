"""Near copies among vectors: an exact cosine join by epsilon grid order.

Unit vectors with a cosine of ``least`` or more are at most ``eps = sqrt(2 - 2 * least)`` apart. All rows are sorted by the cells, of side eps, that they fall
into on the leading principal dimensions (cell by cell the finer ones, of an eighth of that, follow), and numbered. Stretches of the
sequence are joined recursively, from the whole of it down to blocks: a pair of stretches is left out if their boxes on the leading dimensions or their
balls are provably more than eps apart, taken whole if their balls are provably within eps of each other, else their parts are paired. A
large group of near copies is so counted in a few steps, and not pair by pair. What is left of pairs of blocks is compared in tiles of blocks: the product on
the leading dimensions, with the lengths of the rest, bounds the cosine from above; only pairs that pass it are computed in double precision.

No pairs are sent on: a tile returns for each row how many links it has and the smallest row of its group within the tile, which is enough
for the components. A stretch's summary is of fixed size, its parts are rows of one record; so nothing is gathered for all vectors anywhere. Where
vectors have no structure, boxes overlap and the number of tiles is quadratic; the bound then costs about a quarter of all products in single precision.

Defined results: null and empty vectors, zero vectors, such with null or non-finite entries and vectors of another length than the most common one (ties: the longer)
link with nothing; rows are told apart by their place in the order, so repeated rows link with each other; the component of a row without links is its own id; null ids are
greater than all others, and a component of such has null; all columns are kept, new ones give way to names that are there; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations_with_replacement, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.order import numbered
from tidemark.functions.session import Workspace, fresh
from tidemark.llm.whitening import common_length, matrix, merged, regular
from tidemark.operators.components import connected_components

#: Dimensions of the cells, and of boxes and bounds.
GRID, LEADING = 8, 32
#: A stretch has 2**SHIFT parts, a side of a tile 2**TILE blocks.
SHIFT, TILE = 4, 3
FAN = 1 << SHIFT
#: Bytes of a block of at most ROWS vectors.
BLOCK_BYTES, ROWS = 1 << 19, 1024
#: What rounding may change of a distance in double, and of a cosine in single precision.
TINY, SLIGHT = 1e-9, 1e-4


def usable(vector: Column) -> Column:
    return regular(vector, float("inf")) & F.exists(vector, lambda x: x != 0)


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def summary(u: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Of a stretch: the box on the leading dimensions, the centre, the radius around it, and how many there are."""
    y, centre = u @ axes.T, u.mean(0)
    return np.concatenate([y.min(0), y.max(0), centre, [np.sqrt(((u - centre) ** 2).sum(1).max()), len(u)]])


def joint_summary(parts: np.ndarray, k: int) -> np.ndarray:
    """The summary of stretches that follow each other, a row for each."""
    n = parts[:, -1]
    centres = parts[:, 2 * k : -2]
    centre = n @ centres / n.sum()
    radius = (np.sqrt(((centres - centre) ** 2).sum(1)) + parts[:, -2]).max()
    return np.concatenate([parts[:, :k].min(0), parts[:, k : 2 * k].max(0), centre, [radius, n.sum()]])


def decide(a: np.ndarray, b: np.ndarray, k: int, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """For summaries of stretches, row by row: whether they may be within eps, and whether all of them are."""
    gap = np.maximum(0, np.maximum(b[:, :k] - a[:, k : 2 * k], a[:, :k] - b[:, k : 2 * k]))
    apart = np.sqrt(((a[:, 2 * k : -2] - b[:, 2 * k : -2]) ** 2).sum(1))
    reach = a[:, -2] + b[:, -2]
    return ((gap * gap).sum(1) <= (eps + TINY) ** 2) & (apart - reach <= eps + TINY), apart + reach < eps - TINY


def links_between(a: np.ndarray, b: np.ndarray | None, bound_a: np.ndarray, bound_b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a are linked with which of b, or of a itself where b is None, then each pair once. The bounds' product is never below the cosine."""
    may = bound_a @ bound_b.T >= least - SLIGHT
    if b is None:
        may, b = np.triu(may, 1), a
    if np.count_nonzero(may) * 8 > may.size:
        return np.nonzero(may & (a @ b.T >= least))
    i, j = np.nonzero(may)
    good = np.concatenate([np.einsum("ij,ij->i", a[i[s : s + 65536]], b[j[s : s + 65536]]) >= least for s in range(0, len(i), 65536)] or [np.zeros(0, bool)])
    return i[good], j[good]


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Brings the groups of linked rows together in ``root``, which tells the smallest row of each row's group."""
    while True:
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]).tobytes() != root.tobytes():
            root[:] = up


def _axes(df: DataFrame, vector: str, d: int) -> np.ndarray:
    """The leading principal dimensions of the unit vectors."""
    _, _, _, scatter = merged(df, vector, d, units)
    return np.ascontiguousarray(np.linalg.eigh(scatter + scatter.T)[1].T[::-1][:LEADING])


def _ordered(df: DataFrame, vector: str, d: int, axes: np.ndarray, eps: float, work: Workspace) -> tuple[DataFrame, str, int]:
    """The rows in grid order with their numbers 0, 1, 2 and so on, the number's name, and how many there are."""
    at, cells, tie = df.columns.index(vector), fresh("cells", df.columns), fresh("tie", df.columns)

    def gridded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = units(matrix(batch.column(at), d)) @ axes[:GRID].T if batch.num_rows else np.zeros((0, len(axes[:GRID])))
            grid = np.concatenate([np.floor(y / eps), np.floor(8 * y / eps)], axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(grid) + 1) * grid.shape[1], pa.int32()), pa.array(grid.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, cells])

    keyed = df.mapInArrow(gridded, T.StructType([*df.schema.fields, T.StructField(cells, T.ArrayType(T.IntegerType()))]))
    # equal vectors, however many, are dealt to several ranges by the hash of their rows
    keyed = keyed.withColumn(tie, F.xxhash64(*[F.col(f"`{f.name}`").cast("string") if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in df.schema.fields]))
    place = fresh("place", keyed.columns)
    rows, n = numbered(keyed, [cells, tie], place, work)
    return rows.drop(cells, tie), place, n


def _blocks(rows: DataFrame, place: str, vector: str, d: int, size: int, axes: np.ndarray) -> DataFrame:
    """(node, units, summary): a row for each ``size`` vectors of the order."""

    def packed(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("place")
        u = units(matrix(group.column("vector").combine_chunks(), d))
        return pa.table({"node": [group.column("place")[0].as_py() // size], "units": [u.tobytes()], "summary": [summary(u, axes).tobytes()]})

    keyed = rows.select(F.col(place).alias("place"), F.col(vector).alias("vector"))
    return keyed.groupBy(F.expr(f"place div {size}")).applyInArrow(packed, "node bigint, units binary, summary binary")


def _parents(nodes: DataFrame, k: int) -> DataFrame:
    """(node, parts, summary): a row for each FAN stretches, with their summaries one after another."""

    def packed(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("node").to_pylist(), group.column("summary").to_pylist(), strict=True))
        parts = np.stack([np.frombuffer(s) for _, s in rows])
        return pa.table({"node": [rows[0][0] >> SHIFT], "parts": [parts.tobytes()], "summary": [joint_summary(parts, k).tobytes()]})

    return nodes.select("node", "summary").groupBy(F.shiftright("node", SHIFT)).applyInArrow(packed, "node bigint, parts binary, summary binary")


def _descend(pairs: DataFrame, nodes: DataFrame, k: int, width: int, eps: float) -> DataFrame:
    """(a, b, near) of the parts of pairs of stretches that may be within eps; near tells that all of them are."""

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a, b = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                x, y = (np.frombuffer(batch.column(c)[row].as_buffer()).reshape(-1, width) for c in (2, 3))
                pick = combinations_with_replacement(range(len(x)), 2) if a == b else product(range(len(x)), range(len(y)))
                i, j = np.array(list(pick)).T
                may, near = decide(x[i], y[j], k, eps)
                yield pa.RecordBatch.from_pydict({"a": (a << SHIFT) + i[may], "b": (b << SHIFT) + j[may], "near": near[may]})

    a, b = nodes.select(F.col("node").alias("a"), F.col("parts").alias("x")), nodes.select(F.col("node").alias("b"), F.col("parts").alias("y"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(paired, "a bigint, b bigint, near boolean")


def _compared(pairs: DataFrame, blocks: DataFrame, d: int, size: int, axes: np.ndarray, least: float) -> DataFrame:
    """(row, links, root) for the linked rows of pairs of blocks, tile by tile."""

    def compare(group: pa.Table) -> pa.Table:
        names = group.column("node").to_pylist()
        u = {b: np.frombuffer(group.column("units")[i].as_buffer()).reshape(-1, d) for i, b in enumerate(names)}
        bound, start, total = {}, {}, 0
        for b, x in u.items():
            y = x @ axes.T
            rest = np.sqrt(np.maximum(0, 1 - (y * y).sum(1, keepdims=True)))
            bound[b] = np.concatenate([y, rest], axis=1).astype(np.float32)
            start[b], total = total, total + len(x)
        root, links = np.arange(total), np.zeros(total, np.int64)
        for a, partners in zip(names, group.column("partners").to_pylist(), strict=True):
            for b in partners:
                i, j = links_between(u[a], None if a == b else u[b], bound[a], bound[b], least)
                i, j = i + start[a], j + start[b]
                links += np.bincount(i, minlength=total) + np.bincount(j, minlength=total)
                unite(root, i, j)
        number = np.concatenate([b * size + np.arange(len(x)) for b, x in u.items()])
        got = links > 0
        return pa.table({"row": number[got], "links": links[got], "root": number[root[got]]})

    tile = [F.shiftright(c, TILE).alias(f"t{c}") for c in ("a", "b")]
    sides = pairs.select(*tile, F.col("a").alias("node"), F.col("b").alias("partner")).union(pairs.where("a <> b").select(*tile, "b", F.lit(None).cast("bigint")))
    wanted = sides.groupBy("ta", "tb", "node").agg(F.collect_list("partner").alias("partners"))  # at most the blocks of a side
    return wanted.join(blocks, "node").groupBy("ta", "tb").applyInArrow(compare, "row bigint, links bigint, root bigint")


def _within(near: DataFrame, n: int, size: int) -> tuple[DataFrame, DataFrame]:
    """(row, links) and edges (src, dst) of pairs (level, a, b) of stretches all of whose rows are linked with each other."""
    first = lambda c: F.expr(f"shiftleft({c}, level * {SHIFT}) * {size}")
    length = lambda c: F.expr(f"least(shiftleft(1L, level * {SHIFT}) * {size}, {n} - shiftleft({c}, level * {SHIFT}) * {size})")
    end = lambda node, links: F.struct(F.col(node).alias("node"), links.alias("links"))
    ends = F.when(F.col("a") == F.col("b"), F.array(end("a", length("a") - 1))).otherwise(F.array(end("a", length("b")), end("b", length("a"))))
    nodes = near.select("level", F.explode(ends).alias("e")).groupBy("level", F.col("e.node").alias("node")).agg(F.sum("e.links").alias("links"))
    nodes = nodes.select("links", first("node").alias("head"), F.expr(f"shiftleft(node, level * {SHIFT})").alias("block"), length("node").alias("n"))
    each = nodes.select("links", "head", F.explode(F.sequence("block", F.col("block") + F.expr(f"(n - 1) div {size}"))).alias("block"))
    rows = F.explode(F.sequence(F.col("block") * size, F.least((F.col("block") + 1) * size, F.lit(n)) - 1)).alias("row")
    links = each.groupBy("block").agg(F.sum("links").alias("links")).select(rows, "links")
    # all rows of a stretch that is linked with all of another, or itself, are of one component
    edges = each.select("head", "block").distinct().select(rows, "head").where("row <> head").union(near.where("a <> b").select(first("a"), first("b")))
    return links, edges.toDF("src", "dst")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", least: float = 0.9, into: str = "linked") -> DataFrame:
    """``df`` with a column of n_links (other rows whose cosine is ``least`` or more), component_id (the smallest id that links lead to) and kept (whether it is the row's own)."""
    if not 0 < least < 1:
        raise ValueError("least is a cosine between 0 and 1")
    name = fresh(into, df.columns)
    alone = F.struct(F.lit(0).cast("bigint").alias("n_links"), F.col(id_col).alias("component_id"), F.lit(True).alias("kept")).alias(name)
    d = common_length(df, vector, usable(F.col(vector)))
    if not d:
        return df.select("*", alone)
    good = usable(F.col(vector)) & (F.size(vector) == d)
    eps, spark = float(np.sqrt(2 - 2 * least)), df.sparkSession
    size = max(64, min(ROWS, BLOCK_BYTES // (8 * d)))
    with Workspace(spark) as work:
        axes = _axes(df.where(good), vector, d)
        k, width = len(axes), 2 * len(axes) + d + 2
        rows, place, n = _ordered(df.where(good), vector, d, axes, eps, work)
        blocks = work.table(_blocks(rows, place, vector, d, size, axes))
        levels, count = [work.table(_parents(blocks, k))], -(-n // (size << SHIFT))
        while count > 1:
            levels.append(work.table(_parents(levels[-1], k)))
            count = -(-count // FAN)
        pairs, near = spark.range(1).select(F.col("id").alias("a"), F.col("id").alias("b")), []
        for level in range(len(levels) - 1, -1, -1):
            found = work.table(_descend(pairs, levels[level], k, width, eps))
            near.append(found.where("near").select(F.lit(level).alias("level"), "a", "b"))
            pairs = found.where("not near").select("a", "b")
        tiles = work.table(_compared(pairs, blocks, d, size, axes, least))
        links, edges = _within(reduce(DataFrame.union, near), n, size)
        edges = tiles.where("row <> root").select(F.col("row").alias("src"), F.col("root").alias("dst")).union(edges)
        counts = tiles.select("row", "links").union(links).groupBy("row").agg(F.sum("links").alias("n_links"))
        parts = work.table(connected_components(edges))
        ids = rows.select(F.col(place).alias("row"), F.col(id_col).alias("id"))
        least_id = parts.join(ids, parts["node"] == ids["row"]).groupBy("component").agg(F.min("id").alias("component_id"))
        told = counts.join(parts.join(least_id, "component").select(F.col("node").alias("row"), "component_id"), "row")
        linked = F.struct(F.col("n_links"), F.col("component_id"), F.col(id_col).eqNullSafe(F.col("component_id")).alias("kept"))
        told = told.select(F.col("row").alias("__row"), F.col("n_links"), F.col("component_id"))
        joined = rows.join(told, rows[place] == F.col("__row"), "left").select(*[rows[c] for c in df.columns], F.when(F.col("__row").isNull(), alone).otherwise(linked).alias(name))
        return work.result(joined.union(df.where(~good).select("*", alone)))
