"""Class weights and ranking metrics. All group by the score before any running sum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_GRID = tuple(i / 100 for i in range(1, 100))


def scale_pos_weight(df: DataFrame, label_col: str = "isFraud") -> float:
    positive, n = df.agg(F.sum((F.col(label_col) == 1).cast("int")), F.count(label_col)).first()
    if not positive:
        raise ValueError("no positive labels")
    return (n - positive) / positive


def running(df: DataFrame, order, *sums: str) -> DataFrame:
    """Running sums of columns over distinct keys, without one task for all rows: ranges are summed first."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    from tidemark.functions.session import durable

    ranged = durable(df.repartitionByRange(n, order).withColumn("__p", F.spark_partition_id()))
    totals = ranged.groupBy("__p").agg(*[F.sum(s).alias(s) for s in sums])
    earlier = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__p", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"__b_{s}") for s in sums])
    own = Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.join(F.broadcast(before), "__p")  # a row for each range
    return out.select(*df.columns, *[(F.sum(s).over(own) + F.col(f"__b_{s}")).alias(f"cum_{s}") for s in sums])


def average_precision(df: DataFrame, label_col: str, score_col: str) -> DataFrame:
    """(pr_auc): sum of precision times the step of recall over distinct scores; 0 without positives."""
    known = df.where(F.col(score_col).isNotNull() & F.col(label_col).isNotNull())
    steps = known.groupBy(F.col(score_col).alias("s")).agg(F.count("*").alias("n"), F.sum((F.col(label_col) == 1).cast("bigint")).alias("tp"))
    cum = running(steps, F.desc("s"), "n", "tp")
    return cum.agg(F.coalesce(F.try_divide(F.sum(F.col("tp") * F.col("cum_tp") / F.col("cum_n")), F.sum("tp")), F.lit(0.0)).alias("pr_auc"))


def pr_auc(df: DataFrame, label_col: str, score_col: str) -> float:
    return average_precision(df, label_col, score_col).first()[0]


def precision_recall_at_threshold(df: DataFrame, label_col: str, score_col: str, threshold: float) -> DataFrame:
    """(precision, recall); a score equal to the threshold is positive; 0 for empty denominators."""
    hit = F.coalesce(F.col(score_col) >= F.lit(threshold), F.lit(False)) & ~F.coalesce(F.isnan(F.col(score_col).cast("double")), F.lit(False))
    real = F.coalesce(F.col(label_col) == 1, F.lit(False))
    tp, fp, fn = F.count_if(hit & real), F.count_if(hit & ~real), F.count_if(~hit & real)
    return df.agg(F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall"))


def threshold_costs(df: DataFrame, label_col: str, score_col: str, cost_fp: float, cost_fn: float, thresholds=DEFAULT_GRID) -> DataFrame:
    """(idx, threshold, fp, fn, cost) of each threshold in one pass: each row falls between two thresholds, rows are counted by
    place, and the grid (a driver-side list) adds the counts up."""
    grid = [float(t) for t in thresholds]
    spark = df.sparkSession
    edges = sorted(set(grid))
    place = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col(score_col)))
    real = F.coalesce(F.col(label_col) == 1, F.lit(False))
    score = F.col(score_col).cast("double")
    above = F.when(F.isnan(score) | score.isNull(), 0).otherwise(place)
    counts = df.groupBy(above.alias("p")).agg(F.count_if(real).alias("pos"), F.count_if(~real).alias("neg"))
    table = spark.createDataFrame([(i, t, edges.index(t) + 1) for i, t in enumerate(grid)], "idx int, threshold double, place int")
    joined = F.broadcast(table).crossJoin(counts)  # both have a row for each threshold at most
    out = joined.groupBy("idx", "threshold").agg(F.sum(F.when(F.col("p") >= F.col("place"), F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(F.col("p") < F.col("place"), F.col("pos")).otherwise(0)).alias("fn"))
    return out.withColumn("cost", F.col("fp") * float(cost_fp) + F.col("fn") * float(cost_fn))


def select_threshold_by_cost(df: DataFrame, label_col: str, score_col: str, cost_fp: float, cost_fn: float, thresholds=DEFAULT_GRID) -> tuple[float | None, float]:
    """The first threshold of least cost; (None, inf) for an empty grid."""
    if not len(list(thresholds)):
        return None, float("inf")
    best = threshold_costs(df, label_col, score_col, cost_fp, cost_fn, thresholds).orderBy("cost", "idx").first()
    return (best.threshold, best.cost) if best else (list(thresholds)[0], 0.0)
