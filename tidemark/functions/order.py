"""Numbers for rows in a global order, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.session import Workspace, fresh


def numbered(df: DataFrame, by: list[str], into: str, work: Workspace) -> tuple[DataFrame, int]:
    """``df`` with numbers 0, 1, 2 and so on in the order of the columns ``by``, as ``into``, and how many rows there are. Rows are dealt out by ranges, each range
    is sorted and written to a table of ``work``, and numbers go on from one range to the next. The driver gets a count for each range. Rows
    that are equal in ``by`` come in any order, fixed by the table."""
    spark = df.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(width, *by).sortWithinPartitions(*by)
    table = work.table(ranged.withColumn(into, F.monotonically_increasing_id()))  # the range in the upper 31 bits
    part, offset = fresh("part", table.columns), fresh("offset", table.columns)
    at = F.shiftrightunsigned(into, 33)
    counts = {r["p"]: r["n"] for r in table.groupBy(at.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, starts = 0, []
    for p in sorted(counts):
        starts.append((p, before - (p << 33)))
        before += counts[p]
    starts = spark.createDataFrame(starts, f"`{part}` bigint, `{offset}` bigint")
    out = table.join(F.broadcast(starts), at == F.col(part))  # a row for each range
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(into) + F.col(offset)).alias(into)), before
