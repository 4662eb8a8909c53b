"""The cost-sensitive classifier: gradient-boosted trees with class weights, and minority oversampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.order import numbered
from tidemark.functions.session import Workspace
from tidemark.operators.metrics import scale_pos_weight
from tidemark.operators.quantiles import smallest_digest

#: Fixed value: what stands for a missing feature.
SENTINEL = -999.0
SEED = 42
#: Kinds of rows that one task takes when trees are trained.
KINDS = 20_000
#: Of the search for neighbours: orders, turned coordinates that are looked at (8 bits each), points of a stretch, points that cuts are taken from.
TABLES, COORDINATES, STRETCH, SAMPLE = 8, 5, 128, 4096


def model_columns(columns: list[str], extra: tuple[str, ...] = ()) -> list[str]:
    """Features by name: V*, C<digits>, D<digits>, entity statistics, and ``extra`` if present."""

    def numbered(c: str) -> bool:
        return c[:1] in ("C", "D") and c[1:].isdigit()

    by_name = [c for c in columns if c.startswith("V") or numbered(c) or c.startswith(("device_fingerprint_", "card_entity_id_"))]
    return by_name + [c for c in extra if c in columns and c not in by_name]


def with_indicators(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Missing values become the sentinel and set ``<column>_isnull``: trees here take no missing values."""
    value = lambda c: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), SENTINEL).otherwise(F.col(c).cast("double"))
    marks = {f"{c}_isnull": F.coalesce(F.isnan(F.col(c).cast("double")), F.col(c).isNull(), F.lit(True)).cast("double") for c in features}
    return df.withColumns(marks).withColumns({f"{c}_filled": value(c) for c in features}), [*(f"{c}_filled" for c in features), *marks]


class TrainedModel:
    def __init__(self, stages, features: list[str], scale: float):
        self.stages, self.features, self.scale_pos_weight = stages, features, scale

    def predict(self, df: DataFrame, into: str = "fraud_probability") -> DataFrame:
        """``df`` with the probability of class 1."""
        ready, _ = with_indicators(df, self.features)
        scored = self.stages.transform(ready)
        return scored.select(*[F.col(c) for c in df.columns], vector_to_array("probability")[1].alias(into))


def train_model(df: DataFrame, features: list[str], label_col: str = "isFraud", params: dict | None = None) -> TrainedModel:
    """Positives weigh as much as all negatives together; ``params`` override the defaults.

    Trees see of a feature only its bin, so rows of equal bins and label are one row of their summed weight to them: every sum over rows that a split or a leaf is made of
    stays what it is. All rows are read four times, to weigh, cut (twice) and count them; what is read for each tree and level grows with the kinds of rows, not with the rows."""
    options = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.3, "maxBins": 32, "seed": SEED} | (params or {})
    scale = options.pop("scale_pos_weight", None)
    with Workspace(df.sparkSession) as work:
        df = work.table(df.select(*dict.fromkeys([*features, label_col])))
        scale = scale or scale_pos_weight(df, label_col)
        ready, _ = with_indicators(df, features)
        ready = ready.withColumn("__label", F.col(label_col).cast("double")).withColumn("__weight", F.when(F.col(label_col) == 1, scale).otherwise(1.0))
        binned = Bucketizer(splitsArray=_cuts(ready, features, options["maxBins"]), inputCols=[f"{c}_filled" for c in features], outputCols=[f"{c}_bin" for c in features])
        inputs = [*(f"{c}_bin" for c in features), *(f"{c}_isnull" for c in features)]
        kinds = work.table(_kinds(binned.transform(ready), inputs))
        assembled = VectorAssembler(inputCols=inputs, outputCol="__features")
        trees = GBTClassifier(featuresCol="__features", labelCol="__label", weightCol="__weight", **options)
        rows = assembled.transform(kinds.repartition(kinds.count() // KINDS + 1))
        return TrainedModel(PipelineModel([binned, assembled, trees.fit(rows)]), list(features), scale)


def _kinds(binned: DataFrame, inputs: list[str]) -> DataFrame:
    """Rows of equal inputs and label as one, with their weights' sum. Bins lose the mark of categories that they carry: they have an order."""
    return binned.groupBy(*[F.col(c).alias(c, metadata={}) for c in inputs], "__label").agg(F.sum("__weight").alias("__weight"))


def _cuts(ready: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Where the bins of each feature end, from all rows: between all values if there are no more than ``bins`` of them, else at quantiles of the present values (their ranks are
    within 1/10,000) and above the sentinel. A value that is equal to a quantile is below the cut."""
    fractions = [i / (bins - 1) for i in range(1, bins - 1)]
    present = lambda c: F.when(F.col(f"{c}_filled") != SENTINEL, F.col(f"{c}_filled"))
    sketch = ready.agg(*[f for i, c in enumerate(features) for f in (F.percentile_approx(present(c), fractions, 10000).alias(f"q{i}"), F.approx_count_distinct(f"{c}_filled", 0.01).alias(f"n{i}"))]).first()
    # the estimates are within a few values where there are so few; only these sets come to the driver
    few = {i: c for i, c in enumerate(features) if sketch[f"n{i}"] <= 2 * bins}
    values = ready.agg(*[F.collect_set(f"{c}_filled").alias(f"v{i}") for i, c in few.items()]).first() if few else None
    out = []
    for i in range(len(features)):
        own = sorted(set(values[f"v{i}"])) if i in few else None
        if own is not None and len(own) <= bins:
            cuts = {(a + b) / 2 for a, b in zip(own, own[1:], strict=False)}
        else:
            cuts = {float(np.nextafter(q, np.inf)) for q in (SENTINEL, *(sketch[f"q{i}"] or []))}
        out.append([-np.inf, *(sorted(c for c in cuts if np.isfinite(c)) or [0.0]), np.inf])
    return out


def smote(df: DataFrame, features: list[str], label_col: str, id_col: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """(features..., label): all rows and synthetic positives up to parity, as a table of its own. A synthetic row lies between a positive and one
    of its k nearest positives, as ``nearest_points`` finds them. Missing values count as the sentinel."""
    ready = df.select(F.col(id_col).alias("id"), *[F.coalesce(F.col(c).cast("double"), F.lit(SENTINEL)).alias(c) for c in features], F.col(label_col).cast("int").alias("label"))
    minority = ready.where("label = 1")
    n, pos = ready.agg(F.count("*"), F.count_if(F.col("label") == 1)).first()
    need = (n - pos) - pos
    out = ready.drop("id")
    if need <= 0 or pos < 2:
        return out
    with Workspace(df.sparkSession) as work:
        points = work.table(minority.select("id", F.array(*[F.col(c) for c in features]).alias("x")))
        near = work.table(nearest_points(points, k, work, seed))
        per, rest = divmod(need, pos)
        digest = F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}")))
        last = smallest_digest(points, digest, rest)
        times = points.select("id", "x", (F.lit(per) + (F.lit(0) if last is None else F.when(digest <= last, 1).otherwise(0))).alias("times"))
        # a small file of positives is many rows in the driver's memory: none of these sides is broadcast, however small its file
        made = times.where("times > 0").join(near.hint("merge"), "id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
        unit = lambda salt: F.pmod(F.xxhash64("id", "copy", F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        picked = made.select("x", F.get("nearest", F.floor(unit(seed) * F.size("nearest")).cast("int")).alias("nid"), unit(seed + 1).alias("u"))
        new = picked.join(points.select(F.col("id").alias("nid"), F.col("x").alias("nx")).hint("merge"), "nid").select(F.zip_with("x", "nx", lambda a, b: a + F.col("u") * (b - a)).alias("z"))
        return work.result(out.union(new.select(*[F.col("z")[i].alias(c) for i, c in enumerate(features)], F.lit(1).alias("label"))))


def nearest_points(points: DataFrame, k: int, work: Workspace, seed: int = SEED, tables: int = TABLES) -> DataFrame:
    """(id, nearest): for each (id, x) the ids of about its k nearest other points, nearest first, ties to the smaller id. Ids are unique.

    Random projections: in each of ``tables`` the points are turned at random, each of their first few coordinates is cut into 256 quantiles of a bounded sample
    (the SAMPLE points of the smallest hashes), and the points are sorted by the interleaved bits of these. The order is cut into stretches of STRETCH
    points, each of which is compared with itself and the one before it by exact distances, and the nearest of all tables are kept. So the work is points times
    tables times STRETCH, and no group is larger than two stretches, however many points are equal or close. The sample only sets where cuts lie. At
    least 0.9 of the true neighbours are found in up to ten dimensions (tested on clusters); raise ``tables`` for more."""
    sample = [r["x"] for r in points.select("x").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    if not sample:
        return points.select("id", F.array("id").alias("nearest"))
    values = np.array(sample)
    d, rng = values.shape[1], np.random.default_rng(seed)
    turns = [np.linalg.qr(rng.normal(size=(d, min(d, COORDINATES))))[0] for _ in range(tables)]
    shifts = rng.random(tables)
    cuts = [np.quantile(values @ q, (np.arange(255) + s) / 255, axis=0) for q, s in zip(turns, shifts, strict=True)]
    kind = points.schema["id"].dataType.simpleString()

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.stack(frame["x"].to_numpy()) if len(frame) else np.zeros((0, d))
            for t, (turn, cut) in enumerate(zip(turns, cuts, strict=True)):
                y, code = x @ turn, np.zeros(len(x), np.int64)
                cells = [np.searchsorted(cut[:, i], y[:, i]) for i in range(y.shape[1])]
                for bit in range(7, -1, -1):
                    for cell in cells:
                        code = code << 1 | (cell >> bit & 1)
                yield pd.DataFrame({"table": t, "code": code, "id": frame["id"], "x": frame["x"]})

    def compared(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        x, ids, own, table = np.stack(frame["x"].to_numpy()), frame["id"].to_numpy(), frame["own"].to_numpy(), frame["table"].to_numpy()
        far = ((x[:, None] - x[None]) ** 2).sum(2) if x.size * len(x) < 1 << 24 else np.maximum(0, (x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T)
        # of the stretch before only its pairs with this one are new
        far[(table[:, None] != table[None]) | np.eye(len(x), dtype=bool) | ~(own[:, None] | own[None])] = np.inf
        top = np.argsort(far, axis=1, kind="stable")[:, :k]
        row, col = np.repeat(np.arange(len(x)), top.shape[1]), top.ravel()
        keep = np.isfinite(far[row, col])
        return pd.DataFrame({"id": ids[row[keep]], "nid": ids[col[keep]], "d": far[row, col][keep]})

    codes = points.mapInPandas(coded, f"table int, code bigint, id {kind}, x array<double>")
    placed, _ = numbered(codes, ["table", "code", "id"], "place", work)
    stretch = F.floor(F.col("place") / STRETCH)
    both = placed.select("id", "x", "table", F.explode(F.array(F.struct(stretch.alias("s"), F.lit(True).alias("own")), F.struct((stretch + 1).alias("s"), F.lit(False).alias("own")))).alias("g"))
    pairs = both.select("id", "x", "table", "g.s", "g.own").groupBy("s").applyInPandas(compared, f"id {kind}, nid {kind}, d double")
    nearest = pairs.groupBy("id", "nid").agg(F.min("d").alias("d")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("d", "nid"))).alias("all"))  # 2 * k * tables at most
    return nearest.select("id", F.slice(F.transform("all", lambda p: p["nid"]), 1, k).alias("nearest"))
