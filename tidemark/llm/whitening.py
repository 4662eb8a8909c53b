"""Whitening of vectors by their principal components, with the moments merged as Chan, Golub and LeVeque do.

Entries are first put on a grid of whole numbers, ``floor(scale * entry) + shift``, so that counts and sums are exact. Each partition keeps a count, the
sums, a local mean and the scatter around it, centred before it is multiplied, batch by batch; ``treeReduce`` merges the states of partitions
pairwise, so the driver gets one state of dimension squared, however many partitions there are, and takes its eigenvectors. A second pass
whitens all vectors, merges their moments in the same way and holds the covariance against the identity.

Defined results: null and empty vectors, such with null or non-finite entries or entries beyond 2**52, and vectors of another length than the most common one (ties: the longer)
take no part; rows are told apart by nothing, so repeated rows and ids count as often as they are there and null ids are ids; a component without
variance is explained to 0 and whitened to null, the identity is verified on the others (null if there are none); an empty table gives no rows and a model of no components. A deviation
is exact up to 38 digits, null beyond. All columns are kept, new ones give way to names that are there."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.session import fresh

SCALE, SHIFT = 1024, 100_000
#: Rows whose moments are taken at once, before they are merged with those before.
ROWS = 4096
#: A component with less than this part of the largest variance has none: so much is left by rounding.
FLAT = 1e-12

State = tuple[int, list[int], np.ndarray, np.ndarray]  # count, exact sums, mean, scatter around the mean


def regular(vector: Column, most: float = 2.0**52) -> Column:
    """Whether a vector has entries, all of them there and within bounds."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < most)), F.lit(False))


def common_length(df: DataFrame, vector: str, good: Column) -> int:
    """The most common length of good vectors, 0 without any."""
    found = df.where(good).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column without nulls, of d entries each, as doubles."""
    return np.asarray(column.flatten().cast(pa.float64())).reshape(-1, d)


def whole(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x).astype(np.int64) + SHIFT


def moments(x: np.ndarray) -> State:
    """The state of some rows. Sums of whole numbers are taken in two halves, so none overflows."""
    n = len(x)
    sums = [0] * x.shape[1]
    if x.dtype == np.int64:
        sums = [(int(h) << 32) + int(low) for h, low in zip((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), strict=True)]
    x = x.astype(np.float64)
    mean = x.mean(0)
    x -= mean
    rest = x.mean(0)  # what rounding of the mean has left
    return n, sums, mean + rest, x.T @ x - n * np.outer(rest, rest)


def merge(a: State | None, b: State) -> State:
    """The state of both sets of rows."""
    if a is None:
        return b
    n = a[0] + b[0]
    apart = b[2] - a[2]
    return n, [x + y for x, y in zip(a[1], b[1], strict=True)], a[2] + apart * (b[0] / n), a[3] + b[3] + np.outer(apart, apart) * (a[0] * b[0] / n)


def merged(df: DataFrame, vector: str, d: int, change: Callable[[np.ndarray], np.ndarray]) -> State:
    """The state of ``change`` of all vectors of df, of which there are some, all of length d: local states of partitions, merged in a tree."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            x = matrix(batch.column(0), d)
            for i in range(0, len(x), ROWS):
                state = merge(state, moments(change(x[i : i + ROWS])))
        if state is not None:
            n, sums, mean, scatter = state
            yield pa.RecordBatch.from_pydict({"n": [n], "sums": [[str(s) for s in sums]], "mean": [mean.tobytes()], "scatter": [scatter.tobytes()]})

    def unpacked(row) -> State:
        mean = np.frombuffer(row["mean"])
        return row["n"], [int(s) for s in row["sums"]], mean, np.frombuffer(row["scatter"]).reshape(len(mean), len(mean))

    states = df.select(vector).mapInArrow(local, "n bigint, sums array<string>, mean binary, scatter binary").rdd.map(unpacked)
    return states.treeReduce(merge)


@dataclass
class Whitening:
    """What ``fit`` learned: n vectors of dimension d with whole sums, unit components by falling variance, their part of all variance."""

    n: int
    d: int
    sums: list[int]
    components: np.ndarray
    variance: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n times x less the sums, exactly: 64-bit where they hold it, else Python's whole numbers."""
        largest = int(max(abs(int(x.max())), abs(int(x.min())))) * self.n + max(abs(s) for s in self.sums)
        if largest < 1 << 62:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Whole vectors on the components, over the root of their variance; not a number where there is none."""
        centred = self.apart(x).astype(np.float64) / self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.variance > 0, centred @ self.components.T / np.sqrt(self.variance), np.nan)

    def deviation(self, x: np.ndarray) -> list[int]:
        apart = self.apart(x)
        if apart.dtype != object and float(np.abs(apart).max()) ** 2 * self.d < 2.0**62:
            return (apart * apart).sum(1).tolist()
        return [sum(int(v) * int(v) for v in row) for row in apart]


def _fitting(df: DataFrame, vector: str, d: int) -> DataFrame:
    """The rows that take part, under the condition that gave d."""
    return df.where(regular(F.col(vector)) & (F.size(vector) == d))


def fit(df: DataFrame, vector: str = "embedding", components: int = 8) -> Whitening:
    """Learns the components from all vectors, then verifies on all of them that the whitened ones have the identity as covariance."""
    d = common_length(df, vector, regular(F.col(vector)))
    if not d:
        return Whitening(0, 0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    n, sums, _, scatter = merged(_fitting(df, vector, d), vector, d, whole)
    values, axes = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    k = min(components, d)
    values, axes = values[::-1], axes.T[::-1][:k]
    axes = axes * np.sign(axes[np.arange(k), np.abs(axes).argmax(1)])[:, None]  # the largest entry is positive
    total = float(np.trace(scatter)) / n
    variance = np.where((values[:k] > FLAT * values[0]) & (values[:k] > 0), values[:k], 0.0)
    model = Whitening(n, d, sums, axes, variance, variance / total if total > 0 else variance)
    live = variance > 0
    if live.any():
        check = merged(_fitting(df, vector, d), vector, d, lambda x: model.whiten(whole(x))[:, live])
        model.identity_error = float(np.abs(check[3] / n - np.eye(int(live.sum()))).max())
    return model


def transform(df: DataFrame, model: Whitening, vector: str = "embedding", into: str = "whitened") -> DataFrame:
    """The rows of df that take part, with a column of deviation and whitened values by component."""
    name = fresh(into, df.columns)
    at = df.columns.index(vector)
    kind = T.StructType([T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("values", T.ArrayType(T.DoubleType()))])
    arrow = pa.struct([("deviation", pa.decimal128(38, 0)), ("values", pa.list_(pa.float64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            if batch.num_rows:
                x = whole(matrix(batch.column(at), model.d))
                for far, values in zip(model.deviation(x), model.whiten(x).tolist(), strict=True):
                    told.append({"deviation": Decimal(far) if far < 10**38 else None, "values": [None if v != v else v for v in values]})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told, arrow)], names=[*batch.schema.names, name])

    fitting = df.where(F.lit(False)) if not model.d else _fitting(df, vector, model.d)
    return fitting.mapInArrow(work, T.StructType([*df.schema.fields, T.StructField(name, kind)]))


def by_component(model: Whitening, found: Column) -> Column:
    """A row for each component: component (from 1), n, deviation, whitened, explained and identity_error; to be exploded."""
    explained = F.array(*[F.lit(float(v)) for v in model.explained]) if len(model.explained) else F.array().cast("array<double>")
    error = F.lit(None).cast("double") if model.identity_error is None else F.lit(model.identity_error)
    return F.transform(found["values"], lambda v, i: F.struct(
        (i + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), found["deviation"].alias("deviation"), v.alias("whitened"), explained[i].alias("explained"), error.alias("identity_error"),
    ))
