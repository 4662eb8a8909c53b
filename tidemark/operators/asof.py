"""As-of join: each row of the left with the last row of its key that the right side had at that time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.session import Workspace

#: A key with more rows than this on both sides together is cut into RANGES ranges of time.
HEAVY, RANGES = 1_000_000, 512


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, as_of: str = "last_updated", tie: str | None = None, heavy: int = HEAVY, work: Workspace | None = None) -> DataFrame:
    """The rows of ``left`` with all columns of ``right`` but the key, as they were at ``time``: those of the latest ``as_of`` up to and with it.

    Of right rows of one key and ``as_of`` the greatest in ``tie`` counts (without it, or if they agree in it, the greatest row). Left rows that have no key, no time or no
    earlier row keep nulls; right rows without key or ``as_of`` are left out; repeated rows stay. Both sides are merged by one exchange on the key and
    sorted by time, so a row costs the same however many versions its key has. A key with more than ``heavy`` rows is cut into ranges of time of about as many rows each, a
    group of its own; what a range starts with is the last version of the ranges before it. Where there are such keys, the answer is a table of
    ``work``, or without it one that stays. Columns of one name on both sides are an error."""
    clash = {c.lower() for c in left.columns} & {c.lower() for c in right.columns if c != key}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    told = [c for c in right.columns if c != key]
    version = F.struct(F.col(as_of).alias("at"), *([F.col(tie).alias("tie")] if tie else []), F.struct(*told).alias("row"))
    rights = right.where(F.col(key).isNotNull() & F.col(as_of).isNotNull()).select(F.col(key).alias("k"), F.col(as_of).alias("t"), F.lit(None).cast(left.schema).alias("l"), version.alias("v"))
    timed = F.col(key).isNotNull() & F.col(time).isNotNull()
    rows = rights.union(left.where(timed).select(F.col(key).alias("k"), F.col(time).alias("t"), F.struct(*left.columns).alias("l"), F.lit(None).cast(rights.schema["v"].dataType).alias("v")))
    alone = left.where(~timed).select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in told])

    sizes = rows.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > heavy)
    if sizes.isEmpty():
        found = _known(rows.withColumn("range", F.lit(0)))
        return found.select("l.*", "own.row.*").union(alone)
    with Workspace(left.sparkSession) as own:
        # a row for each ``heavy`` rows at most; kept, as approximate percentiles need not be the same if they are taken again
        of_heavy = rows.join(sizes.select("k"), "k", "left_semi").groupBy("k")
        cuts = own.table(of_heavy.agg(F.array_distinct(F.percentile_approx("t", [i / RANGES for i in range(1, RANGES)], 4 * RANGES)).alias("cuts")))
        placed = rows.join(cuts, "k", "left").withColumn("range", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("t"))), F.lit(0))).drop("cuts")
        ends = placed.where("v is not null").join(cuts.select("k"), "k", "left_semi").groupBy("k", "range").agg(F.max("v").alias("v"))
        every = cuts.select("k", F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("range"))
        earlier = Window.partitionBy("k").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
        before = every.join(ends, ["k", "range"], "left").select("k", "range", F.last("v", ignorenulls=True).over(earlier).alias("before"))
        found = _known(placed).join(before, ["k", "range"], "left").select("l", F.coalesce("own", "before").alias("own"))
        return (work.table if work else own.result)(found.select("l.*", "own.row.*").union(alone))


def _known(rows: DataFrame) -> DataFrame:
    """The left rows of (k, t, l, v, range) with the last version of their range. Versions come before left rows of the same time."""
    so_far = Window.partitionBy("k", "range").orderBy("t", F.col("l").isNotNull(), "v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("own", F.last("v", ignorenulls=True).over(so_far)).where("l is not null")
