"""The entity table of a batch job that runs again and again: each batch of new transactions updates what it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.session import Workspace
from tidemark.operators.components import connected_components
from tidemark.operators.graph import ENTITY

ENTITIES = "entity_col string, entity_value string, degree bigint, part string, last_updated timestamp, bucket int"
PARTS = "part string, root string, bucket int"
SIZES = "root string, size bigint, bucket int"


class EntityTable:
    """(entity_col, entity_value, degree, component_size, last_updated) of all transactions so far, in three tables under ``path``.

    ``entities`` has the degree of each entity, the component it was first put into and the time of the last batch that held it; ``parts`` tells
    which component that has become part of (its root), ``sizes`` how many transactions and entities a root holds (rows of former roots stay and are not read). So a batch that joins two components rewrites the
    parts of the smaller one only: a part changes its root at most log2(n) times, whatever is put together. Each table lies in ``buckets``
    folders by the hash of its key; an update overwrites the folders that it touches, from rows that were written elsewhere first.

    The transactions of a batch must be new. If an update breaks off while it overwrites, the table is to be rebuilt or restored; before that
    nothing is changed. One update runs at a time."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _read(self, name: str, schema: str) -> DataFrame:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _bucket(self, *key: str) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        entities = self._read("entities", ENTITIES).join(self._read("parts", PARTS).select("part", "root"), "part").join(self._read("sizes", SIZES).select("root", "size"), "root")
        return entities.select(*ENTITY, "degree", F.col("size").alias("component_size"), "last_updated")

    def update(self, edges: DataFrame, as_of: str) -> None:
        """Takes in the distinct (txn_id, entity_col, entity_value) of new transactions, which hold at ``as_of``."""
        with Workspace(self.spark) as work:
            stamp = F.lit(as_of).cast("timestamp")
            name = F.to_json(F.array(*ENTITY))
            edges = work.table(edges.select("txn_id", *ENTITY, name.alias("e")))
            fresh_degree = edges.groupBy(*ENTITY, "e").agg(F.count("*").alias("more"))
            touched = work.table(fresh_degree.withColumn("bucket", self._bucket(*ENTITY)))
            old = self._of("entities", ENTITIES, touched)
            known = old.join(self._read("parts", PARTS).select("part", "root"), "part").select(*ENTITY, "degree", "part", "root")
            # a known entity is its component's root, a new one stands for itself
            mine = work.table(touched.join(known, ENTITY, "left").withColumn("node", F.coalesce("root", "e")))
            of_edges = edges.join(mine.select(*ENTITY, "node"), ENTITY)
            heads = work.table(of_edges.groupBy("txn_id").agg(F.min("node").alias("head")))
            links = of_edges.join(heads, "txn_id").select(F.col("head").alias("src"), F.col("node").alias("dst"))
            groups = connected_components(links, work=work)

            # of the components that come together the largest is the root of all
            sizes = self._of("sizes", SIZES, groups.select(F.col("node").alias("root")), "root").select(F.col("root").alias("node"), "size")
            held = work.table(groups.join(sizes, "node", "left"))
            entities = mine.where("root is null").select(F.col("node"), F.lit(1).alias("n"))
            gained = entities.union(heads.select(F.col("head").alias("node"), F.lit(1))).groupBy("node").agg(F.sum("n").alias("n")).join(groups, "node").groupBy("component").agg(F.sum("n").alias("gained"))
            biggest = F.max(F.struct(F.coalesce("size", F.lit(0)).alias("size"), F.col("node")))
            roots = work.table(held.groupBy("component").agg(biggest["node"].alias("new_root"), F.sum("size").alias("before")).join(gained, "component", "left"))
            moved = work.table(held.join(roots, "component").select(F.col("node").alias("root"), "new_root", F.col("size").isNull().alias("is_new")))

            rows = touched.join(mine.select(*ENTITY, "degree", "part", "node"), ENTITY).join(moved, F.col("node") == F.col("root"))
            rows = rows.select(*ENTITY, (F.coalesce("degree", F.lit(0)) + F.col("more")).alias("degree"), F.coalesce("part", "new_root").alias("part"), stamp.alias("last_updated"), "bucket")
            # parts whose root is no longer one, and the founders of new components
            gone = moved.where("not is_new and root <> new_root").select("root", "new_root")
            parts = self._read("parts", PARTS).join(gone, "root").select("part", F.col("new_root").alias("root"), "bucket")
            founded = moved.where("is_new and root = new_root").select(F.col("root").alias("part"), "root").withColumn("bucket", self._bucket("part"))
            parts = parts.union(founded)
            now = roots.select(F.col("new_root").alias("root"), (F.coalesce("before", F.lit(0)) + F.coalesce("gained", F.lit(0))).alias("size")).withColumn("bucket", self._bucket("root"))
            ready = [self._merged("entities", ENTITIES, rows, ENTITY, work), self._merged("parts", PARTS, parts, ["part"], work), self._merged("sizes", SIZES, now, ["root"], work)]
            for table, new in zip(("entities", "parts", "sizes"), ready, strict=True):
                new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{table}")

    def _of(self, table: str, schema: str, keys: DataFrame, *key: str) -> DataFrame:
        """The rows of a table whose keys are among ``keys``; only their folders are read."""
        key = key or tuple(ENTITY)
        return self._folders(table, schema, keys.select(self._bucket(*key).alias("bucket"))).join(keys.select(*key).distinct(), list(key), "left_semi")

    def _folders(self, table: str, schema: str, touched: DataFrame) -> DataFrame:
        numbers = [r["bucket"] for r in touched.select("bucket").distinct().collect()]  # at most ``buckets``
        return self._read(table, schema).where(F.col("bucket").isin(numbers))

    def _merged(self, table: str, schema: str, new: DataFrame, key: list[str], work: Workspace) -> DataFrame:
        """All rows of the folders that ``new`` touches, with the new ones in place of the old."""
        new = work.table(new)
        kept = self._folders(table, schema, new).join(new.select(*key), key, "left_anti")
        return work.table(kept.select(*new.columns).union(new))
