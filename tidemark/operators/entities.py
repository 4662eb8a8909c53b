"""Entity keys: device fingerprints, card entities, and the cap on frequent ones. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: What stands for a missing card or address part and a missing origin day.
MISSING_PART, MISSING_DAY = "-1", -999999


def normalize_device_info(value: Column) -> Column:
    words = F.regexp_replace(F.lower(value.cast("string")), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.btrim(words, F.lit("_")), F.lit("")), F.lit(UNKNOWN))


def device_fingerprint(device_info_col: str = "DeviceInfo", browser_col: str = "id_31") -> Column:
    """Missing if neither part says anything."""
    device, browser = normalize_device_info(F.col(device_info_col)), normalize_device_info(F.col(browser_col))
    return F.when((device != UNKNOWN) | (browser != UNKNOWN), F.concat(F.lit("device:"), device, F.lit("|browser:"), browser))


def _part(c: Column) -> Column:
    whole = c.cast("double") == F.floor(c.cast("double"))
    return F.coalesce(F.when(whole, c.cast("double").cast("bigint").cast("string")).otherwise(c.cast("string")), F.lit(MISSING_PART))


def card_entity_id(card_cols=("card1", "card2", "card3", "card5"), addr_cols=("addr1", "addr2"), d1_col: str = "D1", time_col: str = "TransactionDT", seconds_per_day: int = 86400) -> Column:
    """``card:...|origin:day``; never missing. The day rounds half to even; whole numbers print without a point."""
    parts = F.concat_ws("_", *[_part(F.col(c)) for c in (*card_cols, *addr_cols)])
    day = F.coalesce(F.rint(F.col(time_col) / F.lit(seconds_per_day) - F.col(d1_col)).cast("bigint"), F.lit(MISSING_DAY))
    return F.concat(F.lit("card:"), parts, F.lit("|origin:"), day.cast("string"))


def cap_high_frequency_entities(df: DataFrame, value_col: str, max_count: int = 1000) -> DataFrame:
    """Values that occur more than ``max_count`` times become missing. Counted before the shuffle; the frequent ones are
    few (rows / max_count at most), so the join back is broadcast or split by adaptive execution as their size asks."""
    hit = "__frequent"
    frequent = df.where(F.col(value_col).isNotNull()).groupBy(F.col(value_col).alias("__value")).agg(F.count("*").alias(hit)).where(F.col(hit) > max_count)
    joined = df.join(frequent, df[value_col] == F.col("__value"), "left")
    return joined.withColumn(value_col, F.when(F.col(hit).isNull(), F.col(value_col))).drop("__value", hit)
