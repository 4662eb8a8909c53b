"""URL filters by a sort-merge range join.

The key of a host is its labels in reverse, each with a dot: ``com.example.www.``. The hosts that a rule fits are exactly
those whose keys begin with the rule's key, an interval of the sorted keys; intervals of two rules are nested or apart.
Rules and urls are sorted together by key, and a sweep carries the stack of rules that are open: each rule knows the rules its own interval lies in,
so the stack at a url is the last rule begun and its enclosing ones, less those whose interval has ended. Of the
open rules whose path the url's path starts with, the longest wins (host and path together; then the smaller rule text).

All on DataFrame functions. Urls are dealt to buckets by a hash of their row, so no host is too large for a task; rules go to each
bucket, at most ``MOST_RULES`` of them, which is checked; more are swept in blocks whose winners are compared.

Defined results: null urls and such without ``://`` have empty host and path and no rule; the verdict without a rule is allow;
repeated rules count once (block wins over allow for the same host and path); repeated rows each get their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.session import fresh

MOST_RULES = 100_000


def host_of(url: Column) -> Column:
    rest = F.substring_index(F.substring_index(F.substring_index(_after(url), "/", 1), "?", 1), "#", 1)
    # only A-Z change
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    plain = F.substring_index(F.substring_index(_after(url), "?", 1), "#", 1)
    slash = F.locate("/", plain)
    return F.when(slash > 0, F.substr(plain, slash)).otherwise("")


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def key_of(host: Column) -> Column:
    """Labels in reverse, each followed by a dot; below every other key's characters, so nesting is prefixing."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, "\\.", -1)), "."), F.lit(".")))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _nested(rules: DataFrame) -> DataFrame:
    """One row for each rule host: its key, and the rules of it and of all hosts around it, the innermost last."""
    own = rules.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("key", "path", "rule", "verdict"))).alias("own"))
    labels = F.split(F.col("key"), "\\.", -1)
    around = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))
    up = own.select("key", F.explode(around).alias("outer"))
    outer = own.select(F.col("key").alias("outer"), F.col("own").alias("theirs"))
    return up.join(outer, "outer").groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("outer", "theirs"))), lambda x: x["theirs"])).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow", into: str = "judged") -> DataFrame:
    """``pages`` with a struct column ``into`` (underscores are added if that name is taken): host, path, rule, verdict. rules: host, path, verdict."""
    spark = pages.sparkSession
    rules = rules.where("host is not null and path is not null").select(F.lower("host").alias("host"), "path", "verdict")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block is above allow
    rules = rules.select(key_of(F.col("host")).alias("key"), "path", F.concat("host", "path").alias("rule"), "verdict")
    n = rules.count()
    blocks = n // MOST_RULES + 1
    out = pages.select(F.struct(*[F.col(c) for c in pages.columns]).alias("page"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    out = out.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit("")), "best": F.lit(None).cast("struct<n:int,text:string,verdict:string>")})
    for b in range(blocks):
        part = rules if blocks == 1 else rules.where(F.pmod(F.xxhash64("rule"), F.lit(blocks)) == b)
        out = _sweep(spark, out, part)
    best = F.col("best")
    return out.select("page.*", F.struct("host", "path", best["text"].alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict")).alias(fresh(into, pages.columns)))


def _sweep(spark: SparkSession, urls: DataFrame, rules: DataFrame) -> DataFrame:
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = urls.withColumn("key", key_of(F.col("host"))).withColumn("bucket", F.pmod(F.xxhash64("page", "host", "path"), F.lit(n)).cast("int"))
    urls = urls.withColumns({"kind": F.lit(1), "stack": F.lit(None).cast("array<struct<key:string,path:string,rule:string,verdict:string>>")})
    opened = _nested(rules).select(F.lit(None).alias("page"), F.lit(None).alias("host"), F.lit(None).alias("path"), F.lit(None).alias("best"), "key", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bucket"), F.lit(0).alias("kind"), "stack")
    events = urls.unionByName(opened)
    sweep = Window.partitionBy("bucket").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    fits = F.filter("stack", lambda r: F.startswith(F.col("key"), r["key"]) & F.startswith(F.col("path"), r["path"]) & (F.col("key") != ""))
    ranked = F.transform(fits, lambda r: F.struct((-F.char_length(r["rule"])).cast("int").alias("n"), r["rule"].alias("text"), r["verdict"].alias("verdict")))
    best = F.array_min(F.when(F.col("best").isNull(), F.coalesce(ranked, F.array())).otherwise(F.array_append(F.coalesce(ranked, F.array()), F.col("best"))))
    return swept.withColumn("best", best).select("page", "host", "path", "best")
