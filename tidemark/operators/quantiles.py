"""Exact order statistics of any number of rows: values are counted, ranges of values are summed, and only the wanted places are read."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.metrics import running


def quantiles(df: DataFrame, column: str, fractions: list[float]) -> list[float | None]:
    """Linearly interpolated quantiles of the present values; None for each if there are none. No task holds all values."""
    x = F.col(column).cast("double")
    counted = df.select(x.alias("x")).where(x.isNotNull() & ~F.isnan(x)).groupBy("x").agg(F.count("*").alias("n"))
    cum = running(counted, F.asc("x"), "n")
    total = cum.agg(F.max("cum_n")).first()[0]
    if not total:
        return [None for _ in fractions]
    places = [f * (total - 1) for f in fractions]
    wanted = sorted({int(k) for p in places for k in (math.floor(p), math.ceil(p))})
    holds = F.exists(F.lit(wanted), lambda k: (k >= F.col("cum_n") - F.col("n")) & (k < F.col("cum_n")))
    rows = cum.where(holds).collect()  # two for each fraction at most
    at = {k: next(r["x"] for r in rows if r["cum_n"] - r["n"] <= k < r["cum_n"]) for k in wanted}
    out = []
    for p in places:
        low, high = at[math.floor(p)], at[math.ceil(p)]
        out.append(low + (high - low) * (p - math.floor(p)))
    return out


def smallest_digest(df: DataFrame, digest: Column, k: int) -> str | None:
    """The k-th smallest of the rows' hexadecimal digests (all of one length); None if k < 1 or there are fewer. Each pass counts the
    rows by the next four digits of the range that holds it, so the driver sees 65,536 counts at most."""
    rows, prefix, left = df.select(digest.alias("h")), "", k
    while left >= 1:
        inside = rows.where(F.startswith("h", F.lit(prefix)))
        step = inside.groupBy(F.substring("h", 1, len(prefix) + 4).alias("p")).count().collect()
        longer = None
        for r in sorted(step):
            if left <= r["count"]:
                longer = r["p"]
                break
            left -= r["count"]
        if longer is None:
            return None
        if longer == prefix:  # all digits are used
            return prefix
        prefix = longer
    return None
