"""Interval join: pairs of rows of one key that lie close in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key's rows of one bucket of time are split so that about so many meet in a group.
GROUP = 4096


def pairs_within(df: DataFrame, key: str, time: str, width: int, id_col: str = "TransactionID", differ: str | None = None, group: int = GROUP) -> DataFrame:
    """(key, first, second, gap): ids of each two rows of one key whose times, whole numbers, are at most ``width`` apart, the earlier one first (ties: the smaller
    id), and which differ in ``differ`` if that is given.

    Time is cut into buckets of ``width``; a row meets those of its own bucket as either one, and those of the next bucket as the earlier one, so the join is on
    equal keys and buckets, and no pair that is farther than two buckets apart is looked at. Where a bucket of a key has more than ``group`` rows, the later rows are
    dealt to salts and the earlier ones copied to each, so that a busy key is many groups; there are never more salts than rows over ``group``.
    Rows without key, time or id make no pair; unknown values do not differ."""
    rows = df.select(F.col(key).alias("key"), F.col(time).cast("bigint").alias("t"), F.col(id_col).alias("id"), (F.col(differ) if differ else F.lit(None)).alias("d")).where("key is not null and t is not null and id is not null")
    rows = rows.withColumn("bucket", F.expr(f"floor(t / {width})"))
    early = rows.select("key", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("bucket"), F.col("t").alias("t1"), F.col("id").alias("first"), F.col("d").alias("d1"))
    busy = rows.groupBy("key", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > group).select("key", "bucket", F.ceil(F.col("n") / group).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    late = rows.join(busy, ["key", "bucket"], "left").withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int")).drop("salts")
    early = early.join(busy, ["key", "bucket"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    near = (F.col("t") - F.col("t1")).between(0, width) & ((F.col("t1") < F.col("t")) | (F.col("first") < F.col("id")))
    met = early.join(late, ["key", "bucket", "salt"]).where(near & (F.col("d1") != F.col("d")) if differ else near)
    return met.select("key", "first", F.col("id").alias("second"), (F.col("t") - F.col("t1")).alias("gap"))
