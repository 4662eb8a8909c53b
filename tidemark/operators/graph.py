"""The bipartite graph of transactions and entities, its statistics, and their way back to the transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.order import numbered
from tidemark.functions.session import Workspace
from tidemark.operators.communities import _modularity_of, louvain
from tidemark.operators.components import connected_components

STATS = ("degree", "component_size", "community_id", "clustering_coeff")
ENTITY = ["entity_col", "entity_value"]


def bipartite_edges(df: DataFrame, id_col: str, entity_cols: list[str]) -> DataFrame:
    """Distinct (txn_id, entity_col, entity_value); a missing entity makes no edge."""
    wide = df.select(F.col(id_col).alias("txn_id"), *[F.col(c).cast("string").alias(c) for c in entity_cols])
    return wide.unpivot(["txn_id"], list(entity_cols), "entity_col", "entity_value").where("entity_value is not null").distinct()


def transaction_nodes(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("txn_id")).distinct()


def isolated_transactions(df: DataFrame, id_col: str, entity_cols: list[str]) -> DataFrame:
    return transaction_nodes(df, id_col).join(bipartite_edges(df, id_col, entity_cols), "txn_id", "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(*ENTITY).agg(F.count("*").alias("degree"))


def projection(edges: DataFrame) -> DataFrame:
    """Entity pairs that share a transaction, and how many they share. A transaction has at most one entity per column,
    so this is linear in the transactions."""
    return _pairs(edges.select("txn_id", F.struct(*ENTITY).alias("e")))


def _pairs(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) of (txn_id, e)."""
    a, b = edges.select("txn_id", F.col("e").alias("src")), edges.select("txn_id", F.col("e").alias("dst"))
    return a.join(b, "txn_id").where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def entity_numbers(edges: DataFrame, work: Workspace) -> tuple[DataFrame, int]:
    """(entity_col, entity_value, e): the entities numbered in their order, and how many there are. Rounds over the graph shuffle
    numbers, not texts."""
    numbers, n = numbered(edges.select(*ENTITY).distinct(), ENTITY, "e", work)
    return work.table(numbers), n


def coded_pairs(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """A projection of entities by their numbers."""
    for end in ("src", "dst"):
        number = entities.select(F.struct(*ENTITY).alias(end), F.col("e").alias(f"{end}_e"))
        pairs = pairs.join(number, end)
    return pairs.select(F.col("src_e").alias("src"), F.col("dst_e").alias("dst"), "weight")


def components(edges: DataFrame) -> DataFrame:
    """(entity_col, entity_value, component, component_size): size counts transactions and entities; component is the number of its
    smallest entity in the order of all."""
    with Workspace(edges.sparkSession) as work:
        entities, _ = entity_numbers(edges, work)
        coded = work.table(edges.join(entities, ENTITY).select("txn_id", "e"))
        return work.result(entities.join(_component_sizes(coded, work), "e").select(*ENTITY, "component", "component_size"))


def _component_sizes(coded: DataFrame, work: Workspace) -> DataFrame:
    """(e, component, component_size) of (txn_id, e). A transaction links its smallest entity with each other one, so it need not be a node."""
    heads = work.table(coded.groupBy("txn_id").agg(F.min("e").alias("head")))
    links = coded.join(heads, "txn_id").select(F.col("head").alias("src"), F.col("e").alias("dst"))
    parts = connected_components(links, work=work)
    of = parts.select(F.col("node").alias("e"), "component")
    members = of.groupBy("component").agg(F.count("*").alias("entities"))
    crossed = heads.groupBy(F.col("head").alias("e")).agg(F.count("*").alias("n")).join(of, "e").groupBy("component").agg(F.sum("n").alias("transactions"))
    sizes = members.join(crossed, "component").select("component", (F.col("entities") + F.col("transactions")).alias("component_size"))
    return of.join(sizes, "component").select("e", "component", "component_size")


def clustering(pairs: DataFrame) -> DataFrame:
    """(entity_col, entity_value, clustering_coeff) of entities in the projection."""
    with Workspace(pairs.sparkSession) as work:
        pairs = work.table(pairs.select("src", "dst", "weight"))
        entities, _ = entity_numbers(pairs.select(F.explode(F.array("src", "dst")).alias("n")).select("n.*"), work)
        return work.result(_named_clustering(entities, coded_pairs(pairs, entities), work))


def clustering_of_entities(edges: DataFrame) -> DataFrame:
    """The same of the entities of edges that share a transaction with another one. Entities are numbered before they are paired, so no pair is made of texts."""
    with Workspace(edges.sparkSession) as work:
        edges = work.table(edges)
        entities, _ = entity_numbers(edges, work)
        return work.result(_named_clustering(entities, _pairs(edges.join(entities, ENTITY).select("txn_id", "e")), work))


def _named_clustering(entities: DataFrame, pairs: DataFrame, work: Workspace) -> DataFrame:
    return entities.join(_clustering(work.table(pairs), work, _column_starts(entities)), F.col("e") == F.col("n")).select(*ENTITY, "clustering_coeff")


def _column_starts(entities: DataFrame) -> list[int]:
    """The first number of each column of entities: numbers follow their order, so a column's are a range. One for each column comes to the driver."""
    return sorted(r["first"] for r in entities.groupBy("entity_col").agg(F.min("e").alias("first")).collect())


def _clustering(pairs: DataFrame, work: Workspace, starts: list[int]) -> DataFrame:
    """(n, clustering_coeff) of pairs of numbers (src < dst), in whose ranges from ``starts`` on lie the columns. An edge points to its end of greater degree (ties: greater number). A triangle is found
    once: as two edges from its least node whose ends are a pair too. A node that many point to is one of the greatest and points to few, so hubs make no quadratic number of paths: with m edges no
    node points to more than sqrt(2 m) others. Ends of two columns of which no pair is made (as a rule one column and itself) are never brought together, so
    paths are a node's edges to one column times those to another. Rows are three numbers."""
    k = work.table(pairs.select(F.explode(F.array("src", "dst")).alias("n")).groupBy("n").agg(F.count("*").alias("k")))
    ks, kd = k.select(F.col("n").alias("src"), F.col("k").alias("ks")), k.select(F.col("n").alias("dst"), F.col("k").alias("kd"))
    ranked = pairs.select("src", "dst").join(ks, "src").join(kd, "dst")
    up = F.struct("ks", "src") < F.struct("kd", "dst")
    directed = work.table(ranked.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("v")))
    column = lambda c: sum((F.when(F.col(c) >= s, 1).otherwise(0) for s in starts[1:]), F.lit(0))
    met = pairs.select(column("src").alias("a"), column("dst").alias("b")).distinct().collect()  # the square of the columns at most
    others = F.lit(None).cast("array<int>")
    for a in {r["a"] for r in met}:
        others = F.when(F.col("column") == a, F.array(*[F.lit(r["b"]) for r in met if r["a"] == a])).otherwise(others)
    closed = _paths(directed.withColumn("column", column("v")).withColumn("others", others)).join(pairs.select(F.col("src").alias("v"), F.col("dst").alias("w")), ["v", "w"])
    corners = closed.select(F.explode(F.array("u", "v", "w")).alias("n")).groupBy("n").agg(F.count("*").alias("t"))
    value = F.when(F.col("k") > 1, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0)
    return k.join(corners, "n", "left").select("n", value.alias("clustering_coeff"))


def _paths(directed: DataFrame) -> DataFrame:
    """(u, v, w): u points to v and to w, v < w, and w is of one of the columns that pairs link with that of v (``others``)."""
    ends = directed.select("u", "v", F.explode("others").alias("column"))
    return ends.join(directed.select("u", F.col("v").alias("w"), "column"), ["u", "column"]).where("v < w").select("u", "v", "w")


def communities(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(entity_col, entity_value, community_id): -1 for all if no two entities share a transaction; else communities of the projection by
    modularity, an entity without a neighbour being one of its own. An id is the rank of the community's smallest member."""
    with Workspace(edges.sparkSession) as work:
        entities, _ = entity_numbers(edges, work)
        if pairs.isEmpty():
            return work.result(entities.select(*ENTITY, F.lit(-1).cast("bigint").alias("community_id")))
        return work.result(entities.join(_community_ids(entities, coded_pairs(pairs, entities), work), "e").select(*ENTITY, "community_id"))


def communities_of_entities(edges: DataFrame) -> DataFrame:
    """The same of edges alone. Entities are numbered before they are paired, so no pair is made of texts."""
    with Workspace(edges.sparkSession) as work:
        entities, _, _, of = partition(edges, work)
        return work.result(entities.join(of, "e").select(*ENTITY, "community_id"))


def partition(edges: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Tables of ``work``: the entities by numbers (entity_col, entity_value, e), the edges (txn_id, e), the pairs (src, dst, weight) and the communities (e, community_id)."""
    edges = work.table(edges)
    entities, _ = entity_numbers(edges, work)
    coded = work.table(edges.join(entities, ENTITY).select("txn_id", "e"))
    pairs = work.table(_pairs(coded))
    of = entities.select("e", F.lit(-1).cast("bigint").alias("community_id")) if pairs.isEmpty() else _community_ids(entities, pairs, work)
    return entities, coded, pairs, work.table(of)


def component_sizes(coded: DataFrame, work: Workspace) -> DataFrame:
    """A table of ``work``: (e, component, component_size) of (txn_id, e)."""
    return work.table(_component_sizes(coded, work))


def modularity(pairs: DataFrame, of: DataFrame, name: str) -> float:
    """Of the parts that column ``name`` of (e, name) gives to the ends of pairs; 0 without pairs."""
    edges = pairs.select("src", "dst", F.col("weight").cast("double").alias("w"))
    total = edges.agg(F.sum("w")).first()[0]
    return _modularity_of(edges, of.select(F.col("e").alias("v"), F.col(name).alias("name")), total) if total else 0.0


def _community_ids(entities: DataFrame, pairs: DataFrame, work: Workspace) -> DataFrame:
    """(e, community_id) of numbered entities and pairs of them."""
    found = louvain(pairs, work)
    named = work.table(entities.select("e").join(found, F.col("e") == F.col("node"), "left").select("e", F.coalesce("community", "e").alias("community")))
    ids, _ = numbered(named.select("community").distinct(), ["community"], "community_id", work)
    return named.join(ids, "community").select("e", "community_id")


def entity_features(df: DataFrame, id_col: str, entity_cols: list[str], stats: tuple[str, ...] | list[str] = STATS) -> DataFrame:
    """One row for each entity, with the given statistics: degree, component_size, community_id, clustering_coeff."""
    with Workspace(df.sparkSession) as work:
        edges = work.table(bipartite_edges(df, id_col, entity_cols))
        entities, _ = entity_numbers(edges, work)
        coded = work.table(edges.join(entities, ENTITY).select("txn_id", "e"))
        out = entities
        if "degree" in stats:
            out = out.join(coded.groupBy("e").agg(F.count("*").alias("degree")), "e")
        if "component_size" in stats:
            out = out.join(_component_sizes(coded, work), "e")
        if "community_id" in stats or "clustering_coeff" in stats:
            pairs = work.table(_pairs(coded))
        if "community_id" in stats:
            out = out.withColumn("community_id", F.lit(-1).cast("bigint")) if pairs.isEmpty() else out.join(_community_ids(entities, pairs, work), "e")
        if "clustering_coeff" in stats:
            out = out.join(_clustering(pairs, work, _column_starts(entities)).withColumnRenamed("n", "e"), "e", "left").withColumn("clustering_coeff", F.coalesce("clustering_coeff", F.lit(0.0)))
        return work.result(out.select(*ENTITY, *[s for s in STATS if s in stats]))


def transaction_entity_features(df: DataFrame, entity_cols: list[str], features: DataFrame) -> DataFrame:
    """For each entity column a left lookup of every statistic, as ``<column>_<statistic>``; unknown and missing entities get
    nulls. Entities must be unique."""
    if not features.groupBy(*ENTITY).count().where("count > 1").isEmpty():
        raise ValueError("entity rows are not unique")
    stats = [c for c in features.columns if c not in ENTITY]
    out = df
    # rows without an entity find nothing; they are dealt by their hash, so that they do not meet in one task
    spot = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(1 << 20)) + 1
    for c in entity_cols:
        side = features.where((F.col("entity_col") == c) & F.col("entity_value").isNotNull()).select(F.lit(0).cast("bigint").alias("__spot"), F.col("entity_value").alias("__entity"), *[F.col(s).alias(f"{c}_{s}") for s in stats])
        keyed = out.withColumns({"__at": F.when(F.col(c).isNull(), spot).otherwise(0), "__value": F.coalesce(F.col(c).cast("string"), F.lit(""))})
        out = keyed.join(side, (F.col("__at") == F.col("__spot")) & (F.col("__value") == F.col("__entity")), "left").drop("__spot", "__entity", "__at", "__value")
    return out
