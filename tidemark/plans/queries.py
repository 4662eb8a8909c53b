"""Queries over the driver's tables, one for each operator, with DuckDB SQL for the same rows where it can be said."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.session import Workspace
from tidemark.operators.asof import asof_join
from tidemark.operators.entity_table import EntityTable
from tidemark.operators import drift, entities, features, graph, metrics, model, scoring, sketches
from tidemark.operators.interval import pairs_within
from tidemark.operators.split import temporal_split
from tidemark.plans import pipelines
from tidemark.plans.surrogate import EPOCH, ORDERS_SQL, TX_SQL, identity, order_entities, table, transactions
from tidemark.sources.transactions import REQUIRED_COLUMNS, join_identity, load_transactions, read_features, validate_schema, write_features
from tidemark.streaming import online

QUERIES: dict = {}
SQL: dict[str, str] = {}
TWO, THREE = ["customer", "cell"], ["customer", "cell", "price"]


def query(sql: str | None = None, ctes: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (f"WITH RECURSIVE {ctes} " if ctes else "") + sql
        return f

    return add


def joined(spark: SparkSession, sf: str) -> DataFrame:
    df = join_identity(transactions(spark, sf), identity(spark, sf))
    validate_schema(df)
    return df


def six(c) -> F.Column:
    return F.round(c, 6)


# sources and split


@query("SELECT TransactionID, TransactionDT, TransactionAmt, isFraud, DeviceInfo, id_31 FROM tx LEFT JOIN ident USING (TransactionID)", TX_SQL)
def load_left_join(spark, sf):
    return joined(spark, sf).select("TransactionID", "TransactionDT", "TransactionAmt", "isFraud", "DeviceInfo", "id_31")


@query("SELECT TransactionID, TransactionDT, TransactionAmt, isFraud, ProductCD, card2, addr1, D1, DeviceInfo, id_31 FROM tx LEFT JOIN ident USING (TransactionID)", TX_SQL)
def load_csv(spark, sf):
    """Both tables as CSV with NA for what is missing, and read again."""
    with Workspace(spark) as work:
        for name, df in (("tx", transactions(spark, sf).select(*REQUIRED_COLUMNS)), ("ident", identity(spark, sf))):
            df.write.option("header", True).option("nullValue", "NA").csv(f"{work.path}/{name}")
        df = load_transactions(spark, f"{work.path}/tx", f"{work.path}/ident")
        return work.result(df.select("TransactionID", "TransactionDT", "TransactionAmt", "isFraud", "ProductCD", "card2", "addr1", "D1", "DeviceInfo", "id_31"))


_SPLIT = TX_SQL + ", cut AS (SELECT quantile_cont(TransactionDT, 0.7) AS c FROM tx)"


@query("SELECT CASE WHEN TransactionDT <= c THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(TransactionDT) AS first, max(TransactionDT) AS last FROM tx, cut GROUP BY 1", _SPLIT)
def temporal_split_counts(spark, sf):
    train, test = temporal_split(transactions(spark, sf).select("TransactionDT"))
    both = train.withColumn("part", F.lit("train")).union(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.min("TransactionDT").alias("first"), F.max("TransactionDT").alias("last"))


@query("SELECT TransactionID FROM tx, cut WHERE TransactionDT <= c", _SPLIT)
def temporal_split_train(spark, sf):
    return temporal_split(transactions(spark, sf).select("TransactionID", "TransactionDT"))[0].select("TransactionID")


@query("SELECT TransactionID FROM tx, cut WHERE TransactionDT > c", _SPLIT)
def temporal_split_test(spark, sf):
    return temporal_split(transactions(spark, sf).select("TransactionID", "TransactionDT"))[1].select("TransactionID")


# features over time


def _velocity_sql(time: str, width: int) -> str:
    return f"""SELECT TransactionID, count(*) OVER (PARTITION BY user_id ORDER BY {time} RANGE BETWEEN {width} PRECEDING AND CURRENT ROW)
  - count(*) OVER (PARTITION BY user_id, {time}) + row_number() OVER (PARTITION BY user_id, {time} ORDER BY TransactionID) - 1 AS velocity FROM tx"""


@query(_velocity_sql("TransactionDT", 3600), TX_SQL)
def velocity_1h(spark, sf):
    return transactions(spark, sf).select("TransactionID", features.transaction_velocity("user_id", "TransactionDT", 3600).alias("velocity"))


@query(_velocity_sql("hour", 24), TX_SQL)
def velocity_ties(spark, sf):
    return transactions(spark, sf).select("TransactionID", features.transaction_velocity("user_id", "hour", 24).alias("velocity"))


@query("SELECT TransactionID, CAST(TransactionDT - lag(TransactionDT) OVER (PARTITION BY user_id ORDER BY TransactionDT, TransactionID) AS DOUBLE) AS since FROM tx", TX_SQL)
def time_since_last(spark, sf):
    return transactions(spark, sf).select("TransactionID", features.time_since_last("user_id", "TransactionDT").alias("since"))


@query("SELECT TransactionID, coalesce(lag(addr1) OVER w <> addr1, false) OR coalesce(lag(addr2) OVER w <> addr2, false) AS changed FROM tx WINDOW w AS (PARTITION BY user_id ORDER BY TransactionDT, TransactionID)", TX_SQL)
def addr_change_flag(spark, sf):
    return transactions(spark, sf).select("TransactionID", features.addr_change_flag("user_id", "TransactionDT").alias("changed"))


_RISK = _SPLIT + """, train AS (SELECT tx.* FROM tx, cut WHERE TransactionDT <= c), g AS (SELECT avg(isFraud) AS r FROM train),
rates AS (SELECT ProductCD AS category, (avg(isFraud) * count(isFraud) + r * 10) / (count(isFraud) + 10) AS rate FROM train, g GROUP BY ProductCD, r)"""


@query("SELECT category, round(rate, 6) AS rate FROM rates", _RISK)
def merchant_risk_fit(spark, sf):
    train, _ = temporal_split(transactions(spark, sf))
    return features.risk_rates(train, "ProductCD", "isFraud", 10.0)[0].select("category", six("rate").alias("rate"))


@query("SELECT TransactionID, round(coalesce(rate, r), 6) AS merchant_risk FROM tx CROSS JOIN g LEFT JOIN rates ON category = ProductCD", _RISK)
def merchant_risk_transform(spark, sf):
    df = transactions(spark, sf)
    encoder = features.MerchantRiskEncoder("ProductCD")
    encoder.fit(temporal_split(df)[0])
    return encoder.transform(df).select("TransactionID", six("merchant_risk").alias("merchant_risk"))


_TREE = _SPLIT + """, train AS (SELECT ProductCD AS l0, k % 4 AS l1, card2 AS l2, isFraud AS y FROM tx, cut WHERE TransactionDT <= c), r0 AS (SELECT avg(y) AS r FROM train),
r1 AS (SELECT l0, (sum(y) + any_value(r) * 20) / (count(y) + 20) AS r1 FROM train, r0 WHERE l0 IS NOT NULL GROUP BY l0),
r2 AS (SELECT l0, l1, (sum(y) + any_value(r1) * 20) / (count(y) + 20) AS r2 FROM train JOIN r1 USING (l0) WHERE l1 IS NOT NULL GROUP BY l0, l1),
r3 AS (SELECT l0, l1, l2, (sum(y) + any_value(r2) * 20) / (count(y) + 20) AS r3 FROM train JOIN r2 USING (l0, l1) WHERE l2 IS NOT NULL GROUP BY l0, l1, l2)"""


def _risk_tree(spark, sf):
    df = transactions(spark, sf).withColumn("k4", F.col("k") % 4)
    return df, features.HierarchicalRiskEncoder(["ProductCD", "k4", "card2"], smoothing=20.0).fit(temporal_split(df)[0])


@query("SELECT 0 AS depth, NULL AS l0, NULL AS l1, NULL AS l2, round(r, 6) AS rate FROM r0 UNION ALL SELECT 1, l0, NULL, NULL, round(r1, 6) FROM r1 UNION ALL SELECT 2, l0, l1, NULL, round(r2, 6) FROM r2 UNION ALL SELECT 3, l0, l1, l2, round(r3, 6) FROM r3", _TREE)
def hierarchical_risk_fit(spark, sf):
    return _risk_tree(spark, sf)[1].rates().withColumn("rate", six("rate"))


@query("SELECT TransactionID, round(coalesce(r3, r2, r1, r), 6) AS hierarchical_risk FROM (SELECT TransactionID, ProductCD AS l0, k % 4 AS l1, card2 AS l2 FROM tx) CROSS JOIN r0 LEFT JOIN r1 USING (l0) LEFT JOIN r2 USING (l0, l1) LEFT JOIN r3 USING (l0, l1, l2)", _TREE)
def hierarchical_risk_transform(spark, sf):
    df, fitted = _risk_tree(spark, sf)
    return fitted.transform(df).select("TransactionID", six("hierarchical_risk").alias("hierarchical_risk"))


# entity keys

_NORM = "coalesce(nullif(trim(regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown')"
_DEVICE = f"SELECT TransactionID, user_id, TransactionDT, {_NORM.format('DeviceInfo')} AS d, {_NORM.format('id_31')} AS b FROM tx LEFT JOIN ident USING (TransactionID)"
_PRINT = f"{TX_SQL}, dev AS (SELECT TransactionID, user_id, CASE WHEN d <> 'unknown' OR b <> 'unknown' THEN 'device:' || d || '|browser:' || b END AS fingerprint FROM ({_DEVICE}))"


@query(f"SELECT TransactionID, d AS device FROM ({_DEVICE})", TX_SQL)
def normalize_device(spark, sf):
    return joined(spark, sf).select("TransactionID", entities.normalize_device_info(F.col("DeviceInfo")).alias("device"))


@query("SELECT TransactionID, fingerprint FROM dev", _PRINT)
def device_fingerprint(spark, sf):
    return joined(spark, sf).select("TransactionID", entities.device_fingerprint().alias("fingerprint"))


_CARD_ID = "'card:' || concat_ws('_', " + ", ".join(f"coalesce(CAST(CAST({c} AS BIGINT) AS VARCHAR), '-1')" for c in ("card1", "card2", "card3", "card5", "addr1", "addr2")) + ") || '|origin:' || coalesce(CAST(CAST(round_even(TransactionDT / 86400 - D1, 0) AS BIGINT) AS VARCHAR), '-999999')"


@query(f"SELECT TransactionID, {_CARD_ID} AS card_entity FROM tx", TX_SQL)
def card_entity_id(spark, sf):
    return transactions(spark, sf).select("TransactionID", entities.card_entity_id().alias("card_entity"))


@query("SELECT TransactionID, CASE WHEN count(fingerprint) OVER (PARTITION BY fingerprint) <= 20 THEN fingerprint END AS fingerprint FROM dev", _PRINT)
def cap_entities(spark, sf):
    prints = joined(spark, sf).select("TransactionID", entities.device_fingerprint().alias("fingerprint"))
    return entities.cap_high_frequency_entities(prints, "fingerprint", 20)


@query("""SELECT a.fingerprint AS key, a.TransactionID AS first, b.TransactionID AS second, b.TransactionDT - a.TransactionDT AS gap FROM s a JOIN s b ON a.fingerprint = b.fingerprint AND b.TransactionDT BETWEEN a.TransactionDT AND a.TransactionDT + 3600
  AND (a.TransactionDT < b.TransactionDT OR a.TransactionID < b.TransactionID) AND a.user_id <> b.user_id""", _PRINT + ", s AS (SELECT fingerprint, TransactionID, tx.user_id, tx.TransactionDT FROM dev JOIN tx USING (TransactionID) WHERE fingerprint IS NOT NULL)")
def device_pairs(spark, sf):
    """Transactions of different users on one device within an hour."""
    df = joined(spark, sf).withColumn("device", entities.device_fingerprint())
    return pairs_within(df, "device", "TransactionDT", 3600, differ="user_id")


# graph

_EDGES = ORDERS_SQL + """, edge AS (SELECT DISTINCT txn, entity_col, entity_value FROM (SELECT txn, 'customer' AS entity_col, customer AS entity_value FROM o
  UNION ALL SELECT txn, 'cell', cell FROM o UNION ALL SELECT txn, 'price', price FROM o) WHERE entity_value IS NOT NULL)"""
_PAIRS = _EDGES + """, pair AS (SELECT a.entity_col AS c1, a.entity_value AS v1, b.entity_col AS c2, b.entity_value AS v2, count(*) AS weight FROM edge a JOIN edge b USING (txn)
  WHERE (a.entity_col, a.entity_value) < (b.entity_col, b.entity_value) GROUP BY ALL)"""
@query("SELECT txn AS txn_id, entity_col, entity_value FROM edge", _EDGES)
def bipartite_edges(spark, sf):
    return graph.bipartite_edges(order_entities(spark, sf), "txn", THREE)


@query("SELECT TransactionID AS txn_id FROM dev WHERE fingerprint IS NULL", _PRINT)
def isolated_transactions(spark, sf):
    prints = joined(spark, sf).select("TransactionID", entities.device_fingerprint().alias("fingerprint"))
    return graph.isolated_transactions(prints, "TransactionID", ["fingerprint"])


@query("SELECT entity_col, entity_value, count(*) AS degree FROM edge GROUP BY ALL", _EDGES)
def entity_degree(spark, sf):
    return graph.degrees(graph.bipartite_edges(order_entities(spark, sf), "txn", THREE))


def _component_ctes(kinds: list[str]) -> str:
    """Labels go to the smaller neighbour 40 times, which is enough for graphs of so many links across."""
    ends = " UNION ".join(f"SELECT '{k}' || chr(1) || {k} AS x FROM o WHERE {k} IS NOT NULL" for k in kinds)
    first = "coalesce(" + ", ".join(f"'{k}' || chr(1) || {k}" for k in kinds) + ")"
    links = " UNION ".join(f"SELECT DISTINCT {first} AS a, '{k}' || chr(1) || {k} AS b FROM o WHERE {k} IS NOT NULL" for k in kinds)
    return f""", link AS ({links}), ent AS (SELECT x, row_number() OVER (ORDER BY x) AS n FROM ({ends})),
num AS MATERIALIZED (SELECT p.n AS a, q.n AS b FROM link JOIN ent p ON p.x = a JOIN ent q ON q.x = b), near AS MATERIALIZED (SELECT a, b FROM num UNION ALL SELECT b, a FROM num),
step(i, n, label) AS (SELECT 0, n, n FROM ent UNION ALL SELECT i + 1, s.a, min(label) FROM step JOIN near s ON s.b = step.n WHERE i < 40 GROUP BY i, s.a),
comp AS (SELECT n, label FROM step WHERE i = 40),
crossed AS (SELECT label, count(*) AS t FROM o JOIN ent ON x = {first} JOIN comp USING (n) GROUP BY label), sized AS (SELECT label, count(*) AS e FROM comp GROUP BY label),
size AS (SELECT split_part(x, chr(1), 1) AS entity_col, split_part(x, chr(1), 2) AS entity_value, e + t AS component_size FROM ent JOIN comp USING (n) JOIN sized USING (label) JOIN crossed USING (label))"""


@query("SELECT entity_col, entity_value, component_size FROM size", ORDERS_SQL + _component_ctes(TWO))
def component_size(spark, sf):
    return graph.components(graph.bipartite_edges(order_entities(spark, sf), "txn", TWO)).select("entity_col", "entity_value", "component_size")


@query("SELECT c1, v1, c2, v2, weight FROM pair", _PAIRS)
def entity_projection(spark, sf):
    pairs = graph.projection(graph.bipartite_edges(order_entities(spark, sf), "txn", THREE))
    return pairs.select(F.col("src.entity_col").alias("c1"), F.col("src.entity_value").alias("v1"), F.col("dst.entity_col").alias("c2"), F.col("dst.entity_value").alias("v2"), "weight")


_CLUSTER = _PAIRS + """, half AS (SELECT c1 || chr(1) || v1 AS x, c2 || chr(1) || v2 AS y FROM pair), sym AS (SELECT x, y FROM half UNION ALL SELECT y, x FROM half),
k AS (SELECT x, count(*) AS k FROM sym GROUP BY x), tri AS (SELECT a.x, count(*) / 2 AS t FROM sym a JOIN sym b ON a.y = b.x JOIN sym c ON c.x = b.y AND c.y = a.x GROUP BY a.x)"""


@query("SELECT split_part(k.x, chr(1), 1) AS entity_col, split_part(k.x, chr(1), 2) AS entity_value, round(CASE WHEN k > 1 THEN 2.0 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END, 6) AS clustering_coeff FROM k LEFT JOIN tri USING (x)", _CLUSTER)
def clustering_coeff(spark, sf):
    edges = graph.bipartite_edges(order_entities(spark, sf), "txn", THREE)
    return graph.clustering_of_entities(edges).withColumn("clustering_coeff", six("clustering_coeff"))


@query("SELECT DISTINCT 'customer' AS entity_col, customer AS entity_value, CAST(-1 AS BIGINT) AS community_id FROM o", ORDERS_SQL)
def community_no_edges(spark, sf):
    edges = graph.bipartite_edges(order_entities(spark, sf), "txn", ["customer"])
    return graph.communities(edges, graph.projection(edges))


@query()
def louvain_communities(spark, sf):
    return graph.communities_of_entities(graph.bipartite_edges(order_entities(spark, sf), "txn", THREE))


@query("""SELECT (SELECT count(*) FROM (SELECT DISTINCT entity_col, entity_value FROM edge)) AS entities, (SELECT count(*) FROM (SELECT DISTINCT entity_col, entity_value FROM edge)
  WHERE (entity_col, entity_value) NOT IN (SELECT (c1, v1) FROM pair UNION ALL SELECT (c2, v2) FROM pair)) AS alone, CAST(0 AS BIGINT) AS without_community, CAST(0 AS BIGINT) AS spanning, CAST(0 AS BIGINT) AS gaps, true AS gains""", _PAIRS)
def louvain_contract(spark, sf):
    """What holds for any good partition: each entity has a community, those without a neighbour one of their own, none spans two components,
    ids are 0, 1, 2 and so on, and modularity is above that of the components and above 0."""
    with Workspace(spark) as work:
        _, coded, pairs, of = graph.partition(graph.bipartite_edges(order_entities(spark, sf), "txn", THREE), work)
        both = work.table(of.join(graph.component_sizes(coded, work), "e", "left"))
        gains = graph.modularity(pairs, both, "community_id") > max(0.0, graph.modularity(pairs, both, "component"))
        linked = pairs.select(F.explode(F.array("src", "dst")).alias("e")).distinct().withColumn("linked", F.lit(True))
        # by communities: their members, those with a neighbour, their components
        each = both.join(linked, "e", "left").groupBy("community_id").agg(F.count("*").alias("n"), F.count("linked").alias("linked"), F.min("component").alias("low"), F.max("component").alias("high"))
        alone = F.count_if((F.col("n") == 1) & (F.col("linked") == 0))
        without = F.coalesce(F.sum(F.when(F.col("community_id").isNull() | (F.col("community_id") < 0), F.col("n"))), F.lit(0))
        gaps = F.max("community_id") + 1 - F.count("community_id")
        out = each.agg(F.sum("n").alias("entities"), alone.alias("alone"), without.cast("bigint").alias("without_community"), F.count_if(F.col("low") < F.col("high")).alias("spanning"), gaps.cast("bigint").alias("gaps"))
        return work.result(out.withColumn("gains", F.lit(gains)))


@query("""SELECT entity_col, entity_value, degree, component_size, round(coalesce(c, 0), 6) AS clustering_coeff FROM size
  JOIN (SELECT entity_col, entity_value, count(*) AS degree FROM edge GROUP BY ALL) USING (entity_col, entity_value)
  LEFT JOIN (SELECT split_part(k.x, chr(1), 1) AS entity_col, split_part(k.x, chr(1), 2) AS entity_value, CASE WHEN k > 1 THEN 2.0 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END AS c FROM k LEFT JOIN tri USING (x)) USING (entity_col, entity_value)""", _CLUSTER + _component_ctes(THREE))
def entity_statistics(spark, sf):
    """All statistics but the community, of all entities."""
    out = graph.entity_features(order_entities(spark, sf), "txn", THREE, [s for s in graph.STATS if s != "community_id"])
    return out.withColumn("clustering_coeff", six("clustering_coeff"))


@query("SELECT o.txn, a.n AS customer_degree, b.n AS cell_degree FROM o LEFT JOIN (SELECT customer, count(*) AS n FROM o GROUP BY 1) a USING (customer) LEFT JOIN (SELECT cell, count(*) AS n FROM o GROUP BY 1) b USING (cell)", ORDERS_SQL)
def entity_join_back(spark, sf):
    df = order_entities(spark, sf)
    stats = graph.degrees(graph.bipartite_edges(df, "txn", TWO))
    return graph.transaction_entity_features(df, TWO, stats).select("txn", "customer_degree", "cell_degree")


# models and metrics

_SCORE = TX_SQL + ", s AS (SELECT isFraud AS y, TransactionAmt / 600 AS p FROM tx)"


def _scored(spark, sf):
    return transactions(spark, sf).select(F.col("isFraud").alias("y"), (F.col("TransactionAmt") / 600).alias("p"))


@query("SELECT round((count(*) - sum(isFraud)) / sum(isFraud), 6) AS scale_pos_weight FROM tx", TX_SQL)
def class_weight(spark, sf):
    w = metrics.scale_pos_weight(transactions(spark, sf))
    return spark.range(1).select(F.round(F.lit(w), 6).alias("scale_pos_weight"))


def _trained(spark, sf):
    df = pipelines.time_features(joined(spark, sf))
    train, _ = temporal_split(df)
    names = ["TransactionAmt", "velocity_1h", "k"]
    return df, names, model.train_model(train, names)


@query()
def train_predict(spark, sf):
    df, _, fitted = _trained(spark, sf)
    return fitted.predict(df).select("TransactionID", "isFraud", "fraud_probability")


@query("SELECT round(sum(tp * ctp / cn) / sum(tp), 6) AS pr_auc FROM (SELECT tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM (SELECT p, count(*) AS n, sum(y) AS tp FROM s GROUP BY p) WINDOW w AS (ORDER BY p DESC))", _SCORE)
def pr_auc(spark, sf):
    return metrics.average_precision(_scored(spark, sf), "y", "p").select(six("pr_auc").alias("pr_auc"))


@query("SELECT round(count(*) FILTER (p >= 0.2 AND y = 1) / count(*) FILTER (p >= 0.2), 6) AS precision, round(count(*) FILTER (p >= 0.2 AND y = 1) / count(*) FILTER (y = 1), 6) AS recall FROM s", _SCORE)
def precision_recall(spark, sf):
    return metrics.precision_recall_at_threshold(_scored(spark, sf), "y", "p", 0.2).select(six("precision").alias("precision"), six("recall").alias("recall"))


_GRID = ", ".join(f"({i}, CAST({i + 1} AS DOUBLE) / 100)" for i in range(99))


@query(f"SELECT idx, threshold, count(*) FILTER (p >= threshold AND y = 0) AS fp, count(*) FILTER (p < threshold AND y = 1) AS fn, round(count(*) FILTER (p >= threshold AND y = 0) * 5.0 + count(*) FILTER (p < threshold AND y = 1) * 100.0, 6)::DOUBLE AS cost FROM s, (VALUES {_GRID}) AS t(idx, threshold) GROUP BY ALL", _SCORE)
def threshold_cost(spark, sf):
    return metrics.threshold_costs(_scored(spark, sf), "y", "p", 5.0, 100.0)


@query(f"SELECT threshold, cost FROM (SELECT idx, threshold, round(count(*) FILTER (p >= threshold AND y = 0) * 5.0 + count(*) FILTER (p < threshold AND y = 1) * 100.0, 6)::DOUBLE AS cost FROM s, (VALUES {_GRID}) AS t(idx, threshold) GROUP BY ALL) ORDER BY cost, idx LIMIT 1", _SCORE)
def threshold_select(spark, sf):
    return spark.createDataFrame([metrics.select_threshold_by_cost(_scored(spark, sf), "y", "p", 5.0, 100.0)], "threshold double, cost double")


def _entity_table(spark, sf):
    """What a batch knew at its time: device entities of the training part."""
    df = joined(spark, sf).withColumn("device", entities.device_fingerprint())
    train, _ = temporal_split(df)
    return df, graph.degrees(graph.bipartite_edges(train, "TransactionID", ["device"]))


@query("SELECT dev.TransactionID, coalesce(n, 0) AS device_degree, n IS NULL AS is_new_entity FROM dev LEFT JOIN (SELECT fingerprint, count(*) AS n FROM dev JOIN tx USING (TransactionID), cut WHERE TransactionDT <= c AND fingerprint IS NOT NULL GROUP BY 1) USING (fingerprint)", _PRINT + ", cut AS (SELECT quantile_cont(TransactionDT, 0.7) AS c FROM tx)")
def score_batch_features(spark, sf):
    df, known = _entity_table(spark, sf)
    return scoring.serving_features(df, known, {"device": F.col("device")}).select("TransactionID", "device_degree", "is_new_entity")


@query()
def score_batch(spark, sf):
    df, known = _entity_table(spark, sf)
    _, _, fitted = _trained(spark, sf)
    return scoring.score_batch(df, fitted, known, {"device": F.col("device")})


# drift

_PARTS = _SPLIT + """, ref AS (SELECT TransactionAmt AS x FROM tx, cut WHERE TransactionDT <= c), cmp AS (SELECT TransactionAmt * {scale} AS x FROM tx, cut WHERE TransactionDT > c),
qs AS (SELECT list_distinct(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS q FROM ref),
binned AS (SELECT len(list_filter(q, lambda z: z <= x)) AS b, 1 AS r, 0 AS c FROM ref, qs UNION ALL SELECT len(list_filter(q, lambda z: z <= x)), 0, 1 FROM cmp, qs),
share AS (SELECT b, greatest(sum(r) / (SELECT count(*) FROM ref), 1e-6) AS p, greatest(sum(c) / (SELECT count(*) FROM cmp), 1e-6) AS q FROM binned GROUP BY b)"""


def _split_amounts(spark, sf):
    return temporal_split(transactions(spark, sf).select("TransactionDT", "TransactionAmt"))


@query("SELECT round(sum((q - p) * ln(q / p)), 6) AS psi FROM share", _PARTS.format(scale="1.0"))
def psi_split(spark, sf):
    return drift.psi_frame(*_split_amounts(spark, sf), "TransactionAmt").select(six("psi").alias("psi"))


@query("SELECT round(sum((q - p) * ln(q / p)), 6) AS psi FROM share", _PARTS.format(scale="3.0"))
def psi_perturbed(spark, sf):
    train, test = _split_amounts(spark, sf)
    return drift.psi_frame(train, drift.perturb_amount(test, multiplier=3.0), "TransactionAmt").select(six("psi").alias("psi"))


@query("SELECT sum((q - p) * ln(q / p)) > 0.2 AS drifted FROM share", _PARTS.format(scale="3.0"))
def is_drifted(spark, sf):
    train, test = _split_amounts(spark, sf)
    return drift.psi_frame(train, drift.perturb_amount(test, multiplier=3.0), "TransactionAmt").select(drift.is_drifted(F.col("psi")).alias("drifted"))


def _daily(spark, sf):
    """Sketches of each day's amounts in the earlier and the later part."""
    train, test = temporal_split(transactions(spark, sf).select("TransactionDT", "TransactionAmt"))
    both = train.withColumn("later", F.lit(False)).union(test.withColumn("later", F.lit(True)))
    day = F.struct(F.expr("TransactionDT div 86400").alias("day"), "later")
    return both, sketches.daily_sketches(both, day, "TransactionAmt").withColumn("later", F.col("period.later"))


@query("SELECT f AS fraction, CAST(count(*) AS BIGINT) AS n, true AS within FROM tx, (SELECT unnest([0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]::DOUBLE[]) AS f) WHERE TransactionAmt IS NOT NULL GROUP BY f", TX_SQL)
def sketch_quantiles(spark, sf):
    """Quantiles of all days from the sketches of each day; the exact ranks of the values found are within 2 % of all rows."""
    rows, daily = _daily(spark, sf)
    each = [F.struct(F.lit(f).alias("fraction"), sketches.quantile(F.col("sketch"), f).alias("v")) for f in (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)]
    found = sketches.merged(daily).select(F.explode(F.array(*each)).alias("e")).select("e.*")
    ranks = rows.where("TransactionAmt is not null").crossJoin(F.broadcast(found)).groupBy("fraction")  # by seven rows
    ranks = ranks.agg(F.count("*").alias("n"), F.count_if(F.col("TransactionAmt") < F.col("v")).alias("below"), F.count_if(F.col("TransactionAmt") <= F.col("v")).alias("upto"))
    return ranks.select("fraction", "n", ((F.col("below") / F.col("n") <= F.col("fraction") + 0.02) & (F.col("upto") / F.col("n") >= F.col("fraction") - 0.02)).alias("within"))


@query("SELECT true AS near, sum((q - p) * ln(q / p)) > 0.2 AS drifted FROM share", _PARTS.format(scale="1.0"))
def sketch_psi(spark, sf):
    """Drift of the later days from sketches alone, within 0.02 of the exact statistic."""
    _, daily = _daily(spark, sf)
    of = sketches.merged(daily, "later")
    psi = sketches.sketched_psi(of.where("not later"), of.where("later"))
    exact = drift.psi_frame(*_split_amounts(spark, sf), "TransactionAmt").withColumnRenamed("psi", "exact")
    return psi.crossJoin(exact).select((F.abs(F.col("psi") - F.col("exact")) < 0.02).alias("near"), drift.is_drifted(F.col("psi")).alias("drifted"))  # a row each


@query("SELECT TransactionID, TransactionAmt * 3.0 AS amount FROM tx", TX_SQL)
def amount_perturbed(spark, sf):
    return drift.perturb_amount(transactions(spark, sf), multiplier=3.0).select("TransactionID", F.col("TransactionAmt").alias("amount"))


@query("SELECT round(max(abs(a / n1 - b / n2)), 6) AS d, CAST(max(n1) AS BIGINT) AS n1, CAST(max(n2) AS BIGINT) AS n2 FROM (SELECT sum(a) OVER w AS a, sum(b) OVER w AS b FROM (SELECT x, sum(i) AS a, sum(j) AS b FROM (SELECT x, 1 AS i, 0 AS j FROM ref UNION ALL SELECT x, 0, 1 FROM cmp) GROUP BY x) WINDOW w AS (ORDER BY x)), (SELECT count(*) AS n1 FROM ref), (SELECT count(*) AS n2 FROM cmp)", _PARTS.format(scale="1.0"))
def ks_statistic(spark, sf):
    return drift.ks_frame(*_split_amounts(spark, sf), "TransactionAmt").select(six("d").alias("d"), "n1", "n2")


@query()
def ks_test(spark, sf):
    d, p = drift.ks_drift_test(*_split_amounts(spark, sf), "TransactionAmt")
    return spark.createDataFrame([(float(d), float(p))], "d double, p double")


@query("""SELECT TransactionID, CASE WHEN r <= flip THEN 'click' ELSE ProductCD END AS ProductCD FROM (SELECT TransactionID, ProductCD, CASE WHEN ProductCD = 'click' THEN 9000000000 ELSE row_number() OVER (PARTITION BY ProductCD IS NOT DISTINCT FROM 'click' ORDER BY md5(TransactionID || ':42'), TransactionID) END AS r FROM tx),
  (SELECT greatest(0, CAST(floor(0.5 * count(*)) AS BIGINT) - count(*) FILTER (ProductCD = 'click')) AS flip FROM tx)""", TX_SQL)
def category_mix(spark, sf):
    df = transactions(spark, sf).select("TransactionID", "ProductCD")
    return drift.perturb_category_mix(df, "ProductCD", "click", 0.5, "TransactionID")


_U = "((CAST(('0x' || substr(md5(TransactionID || ':{}'), 1, 12)) AS BIGINT) + 1.0::DOUBLE) / 281474976710657.0::DOUBLE)"


@query(f"SELECT TransactionID, round(TransactionAmt + 2.0 * sqrt(-2 * ln({_U.format(42)})) * cos(2 * pi() * {_U.format(43)}), 6) AS amount FROM tx", TX_SQL)
def noise(spark, sf):
    df = drift.degrade_feature_signal(transactions(spark, sf), "TransactionAmt", 2.0, "TransactionID")
    return df.select("TransactionID", six("TransactionAmt").alias("amount"))


# reports, pipelines, streams


@query("SELECT isFraud, count(*) AS n, round(count(*) / (SELECT count(*) FROM tx), 6) AS share FROM tx GROUP BY 1", TX_SQL)
def class_balance(spark, sf):
    counts = transactions(spark, sf).where("isFraud is not null").groupBy("isFraud").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("isFraud", "n", six(F.col("n") / F.col("total")).alias("share"))  # a row for each class, by one


@query("SELECT min(TransactionDT) AS first, max(TransactionDT) AS last FROM tx", TX_SQL)
def time_range(spark, sf):
    return transactions(spark, sf).agg(F.min("TransactionDT").alias("first"), F.max("TransactionDT").alias("last"))


@query(f"""SELECT f.TransactionID, velocity, since, changed, CASE WHEN dd <= 1000 THEN dd END AS device_degree, cd AS card_degree, CAST(0 AS DOUBLE) AS card_clustering, true AS card_in_component, 2026 AS updated FROM (SELECT TransactionID, card, fingerprint,
    count(*) OVER (PARTITION BY card ORDER BY TransactionDT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY card, TransactionDT) + row_number() OVER (PARTITION BY card, TransactionDT ORDER BY TransactionID) - 1 AS velocity,
    CAST(TransactionDT - lag(TransactionDT) OVER w AS DOUBLE) AS since, coalesce(lag(addr1) OVER w <> addr1, false) OR coalesce(lag(addr2) OVER w <> addr2, false) AS changed
    FROM (SELECT tx.*, {_CARD_ID} AS card, fingerprint FROM tx JOIN dev USING (TransactionID)) WINDOW w AS (PARTITION BY card ORDER BY TransactionDT, TransactionID)) f
  LEFT JOIN (SELECT fingerprint, count(*) AS dd FROM dev WHERE fingerprint IS NOT NULL GROUP BY 1) USING (fingerprint) LEFT JOIN (SELECT {_CARD_ID} AS card, count(*) AS cd FROM tx GROUP BY 1) USING (card)""", _PRINT)
def feature_pipeline(spark, sf):
    """All features as a batch job makes them, written to a table and read again; of the statistics those that SQL can say."""
    with Workspace(spark) as work:
        write_features(pipelines.build_features(joined(spark, sf)), f"{work.path}/features", as_of="2026-01-01")
        out = read_features(spark, f"{work.path}/features")
        return work.result(out.select(
            "TransactionID", F.col("velocity_1h").alias("velocity"), F.col("time_since_last").alias("since"), F.col("addr_change").alias("changed"), F.col("device_fingerprint_degree").alias("device_degree"),
            F.col("card_entity_id_degree").alias("card_degree"), F.col("card_entity_id_clustering_coeff").alias("card_clustering"), (F.col("card_entity_id_component_size") > F.col("card_entity_id_degree")).alias("card_in_component"),
            F.year("last_updated").alias("updated"),
        ))


@query()
def train_evaluate(spark, sf):
    """Split, features of the past, trees, threshold by cost; the scored later part with what was chosen."""
    features_ = pipelines.time_features(joined(spark, sf))
    _, scored, found = pipelines.train_and_evaluate(features_)
    return scored.select("TransactionID", "isFraud", "fraud_probability", *[F.lit(found[k]).alias(k) for k in ("pr_auc", "threshold", "cost")])


_LATER = "SELECT count(*) AS rows, sum(isFraud)::BIGINT AS positives, count(*) AS in_range, true AS gains"


def _contract(scored, pr_auc, **more):
    """What holds for any model that has learned something: a probability for each row of the later part, and a PR-AUC above the share of positives."""
    counts = scored.agg(F.count("*").alias("rows"), F.sum("isFraud").alias("positives"), F.count_if(F.col("fraud_probability").between(0, 1)).alias("in_range"))
    return counts.select("*", (F.lit(pr_auc) > F.col("positives") / F.col("rows")).alias("gains"), *[F.lit(v).alias(k) for k, v in more.items()])


@query(_LATER + ", true AS on_grid, true AS cost_right, true AS least FROM tx, cut WHERE TransactionDT > c", _SPLIT)
def train_evaluate_contract(spark, sf):
    """The chosen threshold lies on the grid, its cost is that of the scores, counted anew, and no other threshold's is below it."""
    with Workspace(spark) as work:
        _, scored, found = pipelines.train_and_evaluate(pipelines.time_features(joined(spark, sf)))
        scored = work.table(scored.select("isFraud", "fraud_probability"))
        at = lambda t: pipelines.COST_FP * F.count_if((F.col("fraud_probability") >= t) & (F.col("isFraud") == 0)) + pipelines.COST_FN * F.count_if((F.col("fraud_probability") < t) & (F.col("isFraud") == 1))
        costs = scored.agg(*[at(i / 100).alias(f"c{i}") for i in range(1, 100)]).first().asDict()
        i = round(100 * found["threshold"])
        right = dict(on_grid=i / 100 == found["threshold"] and 1 <= i <= 99, cost_right=costs[f"c{i}"] == found["cost"], least=found["cost"] == min(costs.values()))
        return work.result(_contract(scored, found["pr_auc"], **right))


@query(_LATER + " FROM tx, cut WHERE TransactionDT > c", _SPLIT)
def smote_baseline(spark, sf):
    """Trained on oversampled rows of the earlier part, scored on the later."""
    _, scored, pr_auc = pipelines.smote_baseline(pipelines.time_features(joined(spark, sf)))
    return _contract(scored, pr_auc)


@query("SELECT count(*) FILTER (y = 0) AS negatives, greatest(count(*) FILTER (y = 0), count(*) FILTER (y = 1)) AS positives, CAST(0 AS BIGINT) AS outside, round(min(p * 600) FILTER (y = 1), 6) AS least, round(max(p * 600) FILTER (y = 1), 6) AS most FROM s", _SCORE)
def smote_bounds(spark, sf):
    """Synthetic positives lie within the box of the real ones, whose ends are among all."""
    df = transactions(spark, sf)
    box = df.where("isFraud = 1").agg(*[f(c).alias(f"{n}_{c}") for c in ("TransactionAmt", "k") for n, f in (("least", F.min), ("most", F.max))])
    out = model.smote(df, ["TransactionAmt", "k"], "isFraud", "TransactionID").crossJoin(F.broadcast(box))  # one row
    outside = ~(F.col("TransactionAmt").between(F.col("least_TransactionAmt"), F.col("most_TransactionAmt")) & F.col("k").between(F.col("least_k"), F.col("most_k")))
    one = F.col("label") == 1
    return out.agg(
        F.count_if(~one).alias("negatives"), F.count_if(one).alias("positives"), F.count_if(one & outside).alias("outside"),
        six(F.min(F.when(one, F.col("TransactionAmt")))).alias("least"), six(F.max(F.when(one, F.col("TransactionAmt")))).alias("most"),
    )


@query()
def graph_features(spark, sf):
    df = order_entities(spark, sf)
    return graph.transaction_entity_features(df, THREE, graph.entity_features(df, "txn", THREE))


@query("SELECT y AS label, CAST(greatest(count(*), CASE WHEN y = 1 THEN (SELECT count(*) FROM s WHERE y = 0) ELSE 0 END) AS BIGINT) AS n FROM s GROUP BY y", _SCORE)
def smote_counts(spark, sf):
    df = transactions(spark, sf)
    return model.smote(df, ["TransactionAmt", "k"], "isFraud", "TransactionID").groupBy("label").agg(F.count("*").alias("n"))


@query(SQL["score_batch_features"].removeprefix("WITH RECURSIVE " + _PRINT + ", cut AS (SELECT quantile_cont(TransactionDT, 0.7) AS c FROM tx) "), _PRINT + ", cut AS (SELECT quantile_cont(TransactionDT, 0.7) AS c FROM tx)")
def stream_enrich(spark, sf):
    """The events as a stream of files, enriched with the entity table, all that is there at once."""
    _, known = _entity_table(spark, sf)
    events = table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    k = F.get_json_object("props", "$.k").cast("int")
    mine = F.col("event_id") % 4 == 0
    info = F.when(mine, F.concat(F.lit("SM-G"), (F.col("user_id") % 37).cast("string"), F.lit(" Build/NRD"), (k % 5).cast("string")))
    browser = F.when(mine, F.concat(F.lit("Chrome "), (k % 7).cast("string"), F.lit(".0")))
    rows = stream.select(F.col("event_id").alias("TransactionID"), info.alias("DeviceInfo"), browser.alias("id_31")).withColumn("device", entities.device_fingerprint())
    return _drained(spark, online.enrich(rows, known, {"device": F.col("device")}).select("TransactionID", "device_degree", "is_new_entity"))


@query("""SELECT TransactionID, velocity, since, changed FROM (""" + _velocity_sql("TransactionDT", 3600) + """) JOIN (SELECT TransactionID,
  CAST(TransactionDT - lag(TransactionDT) OVER w AS DOUBLE) AS since, coalesce(lag(addr1) OVER w <> addr1, false) OR coalesce(lag(addr2) OVER w <> addr2, false) AS changed
  FROM tx WINDOW w AS (PARTITION BY user_id ORDER BY TransactionDT, TransactionID)) USING (TransactionID)""", TX_SQL)
def stream_velocity(spark, sf):
    events = table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    k = F.get_json_object("props", "$.k").cast("int")
    rows = stream.select("event_id", "user_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("at"), F.when(k % 10 != 0, k).alias("addr1"), (80 + k % 3).alias("addr2"))
    out = _drained(spark, online.stream_features(rows, "event_id", "user_id", "at", 3600, ("addr1", "addr2")))
    return out.select(F.col("id").alias("TransactionID"), "velocity", F.col("since_last").alias("since"), F.col("addr_changed").alias("changed"))


@query("""SELECT TransactionID, degree, CAST(TransactionDT - last_updated AS BIGINT) AS age FROM tx ASOF LEFT JOIN (SELECT user_id, (TransactionDT // 86400 + 1) * 86400 AS last_updated,
  CAST(sum(count(*)) OVER (PARTITION BY user_id ORDER BY TransactionDT // 86400) AS BIGINT) AS degree FROM tx GROUP BY user_id, TransactionDT // 86400) s ON tx.user_id = s.user_id AND TransactionDT >= last_updated""", TX_SQL)
def asof_entity_features(spark, sf):
    """What a job that runs every midnight had told of a transaction's user when it came, and how old that was."""
    tx = transactions(spark, sf)
    daily = tx.groupBy("user_id", F.expr("TransactionDT div 86400").alias("day")).agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("user_id").orderBy("day"))
    known = daily.select("user_id", ((F.col("day") + 1) * 86400).alias("last_updated"), so_far.alias("degree"))
    out = asof_join(tx.select("TransactionID", "user_id", "TransactionDT"), known, "user_id", "TransactionDT")
    return out.select("TransactionID", "degree", (F.col("TransactionDT") - F.col("last_updated")).alias("age"))


#: The last days of the first two batches, and the days on which batches are taken in.
_BATCHES = ("1997-06-30", "1999-06-30")
_BATCH = f"CASE WHEN o_orderdate <= '{_BATCHES[0]}' THEN 1 WHEN o_orderdate <= '{_BATCHES[1]}' THEN 2 ELSE 3 END"


@query(f"""SELECT entity_col, entity_value, degree, component_size, last_batch FROM size JOIN (SELECT entity_col, entity_value, count(*) AS degree, max(batch) AS last_batch FROM edge JOIN (SELECT o_orderkey AS txn,
  {_BATCH} AS batch FROM orders) USING (txn) GROUP BY ALL) USING (entity_col, entity_value)""", _EDGES + _component_ctes(TWO))
def entity_table_batches(spark, sf):
    """The entity table after three batches of orders, one after another."""
    dates = table(spark, sf, "orders").select(F.col("o_orderkey").alias("txn"), F.col("o_orderdate").cast("date").alias("day"))
    number = F.when(F.col("day") <= _BATCHES[0], 1).when(F.col("day") <= _BATCHES[1], 2).otherwise(3)
    with Workspace(spark) as work:
        orders = work.table(order_entities(spark, sf).join(dates.select("txn", number.alias("batch")), "txn"))
        kept = EntityTable(spark, f"{work.path}/entity-table", buckets=16)
        for k in (1, 2, 3):
            kept.update(graph.bipartite_edges(orders.where(F.col("batch") == k), "txn", TWO), f"2026-01-0{k}")
        return work.result(kept.read().select("entity_col", "entity_value", "degree", "component_size", F.dayofmonth("last_updated").alias("last_batch")))


@query("""SELECT day, CAST(sum(c) AS BIGINT) AS n, round(sum((q - p) * ln(q / p)), 6) AS psi, sum((q - p) * ln(q / p)) > 0.2 AS drifted FROM (SELECT day, bin, c, greatest(c / sum(c) OVER (PARTITION BY day), 1e-6) AS q, p
  FROM (SELECT d.day, r.bin, p, coalesce(c, 0) AS c FROM (SELECT DISTINCT day FROM placed WHERE (day + 1) * 86400000000 <= (SELECT max(us) // 1000 * 1000 FROM placed) - 3600000000) d CROSS JOIN refs r LEFT JOIN (SELECT day, bin, count(*) AS c FROM placed GROUP BY ALL) USING (day, bin))) GROUP BY day""",
  _SPLIT + """, qs AS (SELECT list_distinct(quantile_cont(TransactionAmt, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS q FROM tx, cut WHERE TransactionDT <= c),
bins AS (SELECT unnest(generate_series(0, len(q))) AS bin FROM qs), refs AS (SELECT bin, greatest(count(b) / sum(count(b)) OVER (), 1e-6) AS p FROM bins LEFT JOIN (SELECT len(list_filter(q, lambda z: z <= TransactionAmt)) AS b FROM tx, cut, qs WHERE TransactionDT <= c) ON b = bin GROUP BY bin),
placed AS (SELECT epoch_us(ts) - 1704067200000000 AS us, (epoch_us(ts) - 1704067200000000) // 86400000000 AS day, len(list_filter(q, lambda z: z <= value)) AS bin FROM events, qs)""")
def stream_drift(spark, sf):
    """Events as a stream of files: the amounts of each day against those of the training part, whose bins are a table. The last day stays open."""
    with Workspace(spark) as work:
        bins = work.table(drift.reference_bins(temporal_split(transactions(spark, sf).select("TransactionDT", "TransactionAmt"))[0], "TransactionAmt"))
        events = table(spark, sf, "events")
        stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
        rows = stream.select(F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("amount"))
        out = _drained(spark, online.windowed_drift(rows, "at", "amount", bins))
    day = F.expr(f"(unix_seconds(start) - {EPOCH}) div 86400")
    return out.select(day.alias("day"), "n", six("psi").alias("psi"), "drifted")


def _drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """What a stream gives of all that is there; its state goes with it."""
    with Workspace(spark) as work:
        stream.writeStream.format("parquet").option("path", f"{work.path}/rows").option("checkpointLocation", f"{work.path}/state").trigger(availableNow=True).start().awaitTermination()
        return work.result(spark.read.schema(stream.schema).parquet(f"{work.path}/rows"))
