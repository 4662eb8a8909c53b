"""Features of an entity over time, and smoothed target encoding."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _entity(entity_col: str, id_col: str) -> str:
    """Keys of an entity's rows; rows without an entity stand alone, so that they do not meet in one task."""
    return f"`{entity_col}`, case when `{entity_col}` is null then `{id_col}` end"


def transaction_velocity(entity_col: str, time_col: str, window_seconds: float, id_col: str = "TransactionID") -> Column:
    """Number of earlier rows of the entity from ``t - window_seconds`` on, that bound included. Of rows at the same time
    those with smaller ids are earlier. 0 where entity or time is missing.

    It is the number of rows from that time on, less the row itself and all that follow it. Both counts only grow along the
    entity's rows, latest first, so a row costs the same however many are in its window."""
    if window_seconds < 0:
        raise ValueError("window_seconds must not be negative")
    whole = float(window_seconds).is_integer()
    t, width = f"`{time_col}`", f"{int(window_seconds)}" if whole else f"{window_seconds!r}D"
    key = t if whole else f"cast({t} as double)"
    since = F.expr(f"count({t}) over (partition by {_entity(entity_col, id_col)} order by {key} desc range between unbounded preceding and {width} following)")
    following = F.expr(f"row_number() over (partition by {_entity(entity_col, id_col)} order by {key} desc, `{id_col}` desc)")
    return F.when(F.col(entity_col).isNotNull() & F.col(time_col).isNotNull(), since - following).otherwise(0).cast("bigint")


def by_time(entity_col: str, time_col: str, id_col: str = "TransactionID"):
    """One window for all lag features of an entity: one exchange and one sort."""
    alone = F.when(F.col(entity_col).isNull(), F.col(id_col))
    return Window.partitionBy(F.col(entity_col), alone).orderBy(F.col(time_col).asc_nulls_last(), F.col(id_col))


def time_since_last(entity_col: str, time_col: str, id_col: str = "TransactionID") -> Column:
    lagged = F.lag(time_col).over(by_time(entity_col, time_col, id_col))
    return F.when(F.col(entity_col).isNotNull(), F.col(time_col) - lagged).cast("double")


def addr_change_flag(entity_col: str, time_col: str, addr_cols: tuple[str, ...] = ("addr1", "addr2"), id_col: str = "TransactionID") -> Column:
    """True if any address differs from the entity's previous row's, both present."""
    w = by_time(entity_col, time_col, id_col)
    changed = F.lit(False)
    for c in addr_cols:
        changed = changed | F.coalesce(F.lag(c).over(w) != F.col(c), F.lit(False))
    return F.coalesce(F.col(entity_col).isNotNull() & changed, F.lit(False))


def risk_rates(df: DataFrame, category_col: str, label_col: str, smoothing: float) -> tuple[DataFrame, float]:
    """(category, rate) and the global rate; missing categories form no group, missing labels are not counted."""
    overall = df.agg(F.avg(label_col)).first()[0]
    label = F.col(label_col)
    grouped = df.where(F.col(category_col).isNotNull()).groupBy(F.col(category_col).alias("category")).agg(F.avg(label).alias("mean"), F.count(label).alias("n"))
    rate = F.try_divide(F.coalesce("mean", F.lit(0.0)) * F.col("n") + F.lit(overall) * F.lit(float(smoothing)), F.col("n") + F.lit(float(smoothing)))
    return grouped.select("category", F.coalesce(rate, F.lit(overall)).alias("rate")), overall


class MerchantRiskModel(Model):
    def __init__(self, category_col: str, output_col: str, rates: DataFrame, global_rate: float):
        super().__init__()
        self.category_col, self.output_col, self.rates, self.global_rate = category_col, output_col, rates, global_rate

    def _transform(self, df: DataFrame) -> DataFrame:
        key, rate = "__category", "__rate"
        rates = self.rates.select(F.col("category").alias(key), F.col("rate").alias(rate))
        joined = df.join(rates, df[self.category_col] == F.col(key), "left")
        return joined.withColumn(self.output_col, F.coalesce(rate, F.lit(self.global_rate))).drop(key, rate)


class MerchantRiskEncoder(Estimator):
    """Smoothed mean of the label by category. Fit on training rows only. Unseen and missing categories get the global rate."""

    def __init__(self, category_col: str, label_col: str = "isFraud", smoothing: float = 10.0, output_col: str = "merchant_risk"):
        super().__init__()
        self.category_col, self.label_col, self.smoothing, self.output_col = category_col, label_col, smoothing, output_col
        self.model: MerchantRiskModel | None = None

    def _fit(self, df: DataFrame) -> MerchantRiskModel:
        rates, overall = risk_rates(df, self.category_col, self.label_col, self.smoothing)
        self.model = MerchantRiskModel(self.category_col, self.output_col, rates, overall)
        return self.model

    def transform(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise RuntimeError("MerchantRiskEncoder must be fitted before transform")
        return self.model.transform(df)


class HierarchicalRiskEncoder(Estimator):
    """Smoothed mean of the label by categories within categories: ``levels`` go from the widest to the narrowest, and a rate leans on that of the level
    above with the weight of ``smoothing`` rows, the widest on the global rate. One rollup over the rows gives all levels. A row gets the rate of the narrowest level that
    was seen with its categories; missing categories form no group. Fit on training rows only."""

    def __init__(self, levels: list[str], label_col: str = "isFraud", smoothing: float = 10.0, output_col: str = "hierarchical_risk"):
        super().__init__()
        self.levels, self.label_col, self.smoothing, self.output_col = levels, label_col, smoothing, output_col

    def _fit(self, df: DataFrame) -> HierarchicalRiskModel:
        names = [f"l{i}" for i in range(len(self.levels))]
        rows = df.select(*[F.col(c).alias(n) for n, c in zip(names, self.levels, strict=True)], F.col(self.label_col).cast("double").alias("y"))
        # what is grouped tells a missing category from a level that is summed up
        sums = rows.rollup(*names).agg(F.sum("y").alias("s"), F.count("y").alias("n"), F.grouping_id().alias("g"))
        depth = F.lit(len(names)) - F.bit_count("g")
        present = F.aggregate(F.array(*[F.col(n).isNotNull().cast("int") for n in names]), F.lit(0), lambda a, x: a + x)
        sums = sums.withColumn("depth", depth).where((F.col("n") > 0) & (present == F.col("depth")))
        rates = sums.where("depth = 0").select((F.col("s") / F.col("n")).alias("rate"))
        tables = [rates]
        for i in range(1, len(names) + 1):
            own = sums.where(F.col("depth") == i)
            parent = tables[-1].withColumnRenamed("rate", "above")
            both = own.join(parent, names[: i - 1]) if i > 1 else own.crossJoin(F.broadcast(parent))  # one row
            tables.append(both.select(*names[:i], ((F.coalesce("s", F.lit(0.0)) + F.col("above") * self.smoothing) / (F.col("n") + self.smoothing)).alias("rate")))
        return HierarchicalRiskModel(self.levels, self.output_col, tables)


class HierarchicalRiskModel(Model):
    def __init__(self, levels: list[str], output_col: str, tables: list[DataFrame]):
        super().__init__()
        self.levels, self.output_col, self.tables = levels, output_col, tables

    def rates(self) -> DataFrame:
        """(depth, l0, l1 and so on, rate) of all levels, the global rate at depth 0."""
        names = [f"l{i}" for i in range(len(self.levels))]
        kinds = {n: self.tables[-1].schema[n].dataType for n in names}
        parts = [t.select(F.lit(i).alias("depth"), *[(F.col(n) if n in t.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in names], "rate") for i, t in enumerate(self.tables)]
        return reduce(DataFrame.union, parts)

    def _transform(self, df: DataFrame) -> DataFrame:
        out, found = df, []
        for i, table in enumerate(self.tables):
            rate = f"__rate{i}"
            side = table.select(*[F.col(f"l{j}").alias(f"__l{i}_{j}") for j in range(i)], F.col("rate").alias(rate))
            on = [out[c] == side[f"__l{i}_{j}"] for j, c in enumerate(self.levels[:i])]
            out = out.join(side, on, "left") if on else out.crossJoin(F.broadcast(side))  # one row
            out = out.drop(*[f"__l{i}_{j}" for j in range(i)])
            found.append(rate)
        return out.withColumn(self.output_col, F.coalesce(*reversed(found))).drop(*found)
