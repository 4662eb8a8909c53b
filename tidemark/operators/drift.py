"""Drift statistics and injected drift."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.metrics import running
from tidemark.operators.quantiles import quantiles, smallest_digest

FLOOR = 1e-6


def _values(df: DataFrame, c: str) -> DataFrame:
    v = F.col(c).cast("double")
    return df.select(v.alias("x")).where(v.isNotNull() & ~F.isnan(v))


def interior_edges(reference: DataFrame, col: str, bins: int = 10) -> list[float]:
    """The distinct inner quantiles of the reference."""
    got = quantiles(reference, col, [i / bins for i in range(1, bins)] or [0.0])
    if got[0] is None:
        raise ValueError("the reference sample is empty")
    return sorted(set(got)) if bins > 1 else []


def place(edges: list[float], x: Column) -> Column:
    """The number of the bin that x falls into."""
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= x)) if edges else F.lit(0)


def bin_shares(reference: DataFrame, comparison: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """(bin, ref, cmp): counts over the reference's quantile bins."""
    edges = interior_edges(reference, col, bins)
    at = place(edges, F.col("x"))
    both = _values(reference, col).select(at.alias("bin"), F.lit(1).alias("r"), F.lit(0).alias("c")).union(_values(comparison, col).select(at, F.lit(0), F.lit(1)))
    counted = both.groupBy("bin").agg(F.sum("r").alias("ref"), F.sum("c").alias("cmp"))
    every = reference.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.coalesce("ref", F.lit(0)).alias("ref"), F.coalesce("cmp", F.lit(0)).alias("cmp"))


def reference_bins(reference: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """One row, (edges, counts): the quantile bins of a reference and how many of its values lie in each. Kept as a table, it stands for the reference
    in any later comparison."""
    edges = interior_edges(reference, col, bins)
    at = place(edges, F.col("x"))
    counts = [F.count_if(at == i) for i in range(len(edges) + 1)]
    return _values(reference, col).agg(F.array(*[F.lit(e) for e in edges]).cast("array<double>").alias("edges"), F.array(*counts).alias("counts"))


def psi_of_counts(reference: Column, comparison: Column) -> Column:
    """PSI of two arrays of counts over the same bins; null if either has none."""
    share = lambda counts: (lambda total: F.transform(counts, lambda c: F.greatest(F.try_divide(c, total), F.lit(FLOOR))))(F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, c: a + c))
    terms = F.zip_with(share(reference), share(comparison), lambda p, q: (q - p) * F.ln(q / p))
    some = lambda counts: F.exists(counts, lambda c: c > 0)
    return F.when(some(reference) & some(comparison), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))


def psi_frame(reference: DataFrame, comparison: DataFrame, col: str, bins: int = 10) -> DataFrame:
    counts = bin_shares(reference, comparison, col, bins)
    totals = counts.agg(F.sum("ref").alias("nr"), F.sum("cmp").alias("nc"))
    p = F.greatest(F.col("ref") / F.col("nr"), F.lit(FLOOR))
    q = F.greatest(F.try_divide(F.col("cmp"), F.col("nc")), F.lit(FLOOR))
    return counts.crossJoin(F.broadcast(totals)).agg(F.sum((q - p) * F.ln(q / p)).alias("psi"))  # bins by one row


def population_stability_index(reference: DataFrame, comparison: DataFrame, col: str, bins: int = 10) -> float:
    if _values(comparison, col).isEmpty():
        raise ValueError("the comparison sample is empty")
    return psi_frame(reference, comparison, col, bins).first()[0]


def is_drifted(psi: float | Column, threshold: float = 0.2):
    return psi > threshold


def ks_frame(reference: DataFrame, comparison: DataFrame, col: str) -> DataFrame:
    """(d, n1, n2) of the two-sample Kolmogorov-Smirnov test."""
    both = _values(reference, col).select("x", F.lit(1).alias("a"), F.lit(0).alias("b")).union(_values(comparison, col).select("x", F.lit(0), F.lit(1)))
    steps = both.groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n = steps.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    cum = running(steps, F.asc("x"), "a", "b").crossJoin(F.broadcast(n))  # one row
    return cum.agg(F.max(F.abs(F.col("cum_a") / F.col("n1") - F.col("cum_b") / F.col("n2"))).alias("d"), F.first("n1").alias("n1"), F.first("n2").alias("n2"))


def ks_p_value(d: float, n1: int, n2: int) -> float:
    """Two-sided: exact by counting lattice paths up to 10,000 rows a side, else Kolmogorov's limit law."""
    if max(n1, n2) <= 10_000:
        return _exact(d, n1, n2)
    n = round(n1 * n2 / (n1 + n2))
    x = d * math.sqrt(n)
    if x < 1e-6:
        return 1.0
    if x < 1:
        k = sum(math.exp(-((2 * i - 1) ** 2) * math.pi**2 / (8 * x * x)) for i in range(1, 60))
        return float(min(1.0, max(0.0, 1 - math.sqrt(2 * math.pi) / x * k)))
    return float(min(1.0, max(0.0, 2 * sum((-1) ** (i - 1) * math.exp(-2 * i * i * x * x) for i in range(1, 60)))))


def _exact(d: float, n1: int, n2: int) -> float:
    """Probability that a random path from (0, 0) to (n1, n2) reaches a distance of d from the diagonal somewhere. A walk that goes
    right or up in proportion to the sides is followed step by step, all its places at once, as long as it is nearer than d; its chance
    to be at the end, over that of any walk, is the share of such paths. Differences are multiples of 1 / (n1 * n2)."""
    near = (math.ceil(d * n1 * n2 - 1e-6) - 0.5) / (n1 * n2)
    if near < 0:
        return 1.0
    right, up = n1 / (n1 + n2), n2 / (n1 + n2)
    per = 1 / n1 + 1 / n2
    chance = np.zeros(n1 + 2)  # by steps to the right, moved by one
    chance[1] = 1.0
    for step in range(1, n1 + n2 + 1):
        low, high = max(0, step - n2, math.floor((step / n2 - near) / per) + 1), min(n1, step, math.ceil((step / n2 + near) / per) - 1)
        if high < low:
            return 1.0
        chance[low + 1 : high + 2] = up * chance[low + 1 : high + 2] + right * chance[low : high + 1]
        chance[low] = 0.0
        chance[high + 2 : high + 3] = 0.0
    if chance[n1 + 1] <= 0:
        return 1.0
    free = math.lgamma(n1 + n2 + 1) - math.lgamma(n1 + 1) - math.lgamma(n2 + 1) + n1 * math.log(right) + n2 * math.log(up)
    return float(min(1.0, max(0.0, -math.expm1(min(0.0, math.log(chance[n1 + 1]) - free)))))


def ks_drift_test(reference: DataFrame, comparison: DataFrame, col: str) -> tuple[float, float]:
    d, n1, n2 = ks_frame(reference, comparison, col).first()
    return d, ks_p_value(d, n1, n2)


def perturb_amount(df: DataFrame, amount_col: str = "TransactionAmt", multiplier: float = 2.0) -> DataFrame:
    return df.withColumn(amount_col, F.col(amount_col) * multiplier)


def _digest(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def perturb_category_mix(df: DataFrame, category_col: str, target_category: str, target_share: float, id_col: str, seed: int = 42) -> DataFrame:
    """Turns other rows into the target, those of the smallest hashes of their ids, until it has ``int(share * n)`` rows."""
    target = F.col(category_col).eqNullSafe(F.lit(target_category))
    n, have = df.agg(F.count("*"), F.count_if(target)).first()
    flip = max(0, min(int(target_share * n) - have, n - have))
    digest = _digest(id_col, seed)
    last = smallest_digest(df.where(~target), digest, flip)
    return df if last is None else df.withColumn(category_col, F.when(~target & (digest <= last), F.lit(target_category)).otherwise(F.col(category_col)))


def _uniform(id_col: str, seed: int) -> Column:
    return (F.conv(F.substring(_digest(id_col, seed), 1, 12), 16, 10).cast("double") + 1.0) / F.lit(281474976710657.0)


def gaussian(id_col: str, seed: int = 42) -> Column:
    """A normal number that depends on the row's id and the seed only, by Box and Muller."""
    return F.sqrt(-2.0 * F.ln(_uniform(id_col, seed))) * F.cos(2.0 * math.pi * _uniform(id_col, seed + 1))


def degrade_feature_signal(df: DataFrame, feature_col: str, noise_std: float, id_col: str, seed: int = 42) -> DataFrame:
    return df.withColumn(feature_col, F.col(feature_col) + F.lit(float(noise_std)) * gaussian(id_col, seed))
