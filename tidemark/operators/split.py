"""Temporal split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quantiles import quantiles


def cutoff(df: DataFrame, time_col: str, frac: float) -> float | None:
    """The exact, linearly interpolated quantile of time."""
    return quantiles(df, time_col, [frac])[0]


def temporal_split(df: DataFrame, time_col: str = "TransactionDT", train_frac: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Rows up to the quantile and rows after it; rows without a time are in neither. Both are filters on the scan."""
    c = cutoff(df, time_col, train_frac)
    limit = F.lit(c).cast("double")
    return df.where(F.col(time_col) <= limit), df.where(F.col(time_col) > limit)
