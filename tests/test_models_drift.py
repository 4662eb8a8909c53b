import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift, metrics, model, scoring
from tidemark.sources import transactions as sources

PAIR = "y int, s double"


def frame(spark, ys, ss):
    return spark.createDataFrame(list(zip(ys, ss, strict=True)), PAIR)


def test_weight(spark):
    assert metrics.scale_pos_weight(frame(spark, [0, 1, 0, 0, 1, 0, 0], [0.0] * 7), "y") == 2.5
    with pytest.raises(ValueError):
        metrics.scale_pos_weight(frame(spark, [0] * 5, [0.0] * 5), "y")


def test_ranking(spark):
    # by hand: 1/1 at the first of three positives, 2/3 at the second, 3/5 at the third
    assert metrics.pr_auc(frame(spark, [1, 0, 1, 0, 1], [5.0, 4.0, 3.0, 2.0, 1.0]), "y", "s") == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)
    assert metrics.pr_auc(frame(spark, [1, 0, 0, 1], [0.3] * 4), "y", "s") == 0.5
    assert metrics.pr_auc(frame(spark, [0] * 3, [0.2, 0.7, 0.7]), "y", "s") == 0.0
    df = frame(spark, [1, 1, 0, 0, 1, None], [0.75, 0.25, 0.75, 0.5, None, 0.9])
    assert tuple(metrics.precision_recall_at_threshold(df, "y", "s", 0.75).first()) == pytest.approx((1 / 3, 1 / 3))
    assert tuple(metrics.precision_recall_at_threshold(df, "y", "s", 2.0).first()) == (0.0, 0.0)


def test_average_precision_random(spark):
    rng = random.Random(1)
    ys, ss = [rng.randrange(2) for _ in range(150)], [rng.randrange(20) / 20 for _ in range(150)]
    total, ap, last = sum(ys), 0.0, 0.0
    for t in sorted(set(ss), reverse=True):
        hit = [y for y, s in zip(ys, ss, strict=True) if s >= t]
        ap += (sum(hit) / total - last) * sum(hit) / len(hit)
        last = sum(hit) / total
    assert metrics.pr_auc(frame(spark, ys, ss), "y", "s") == pytest.approx(ap)


def test_costs(spark):
    df = frame(spark, [1, 0, 1, 0, 0, 1], [0.15, 0.35, 0.55, 0.55, 0.75, 0.95])
    by_hand = {0.1: 3 * 2 + 0 * 9, 0.5: 2 * 2 + 1 * 9, 0.9: 0 * 2 + 2 * 9}
    for t, cost in by_hand.items():
        assert metrics.select_threshold_by_cost(df, "y", "s", 2, 9, [t]) == (t, cost)
    assert metrics.select_threshold_by_cost(df, "y", "s", 2, 9, list(by_hand)) == (0.1, 6.0)
    assert metrics.select_threshold_by_cost(df, "y", "s", 2, 9, [0.16, 0.2])[0] == 0.16
    assert metrics.select_threshold_by_cost(df, "y", "s", 2, 9, []) == (None, float("inf"))


def test_train_and_score(spark):
    """A late shop with large baskets is the risky one; a missing basket says nothing."""
    rng = random.Random(77)
    rows = [(i, rng.uniform(0, 24), None if rng.random() < 0.1 else rng.gauss(50, 20)) for i in range(130)]
    df = spark.createDataFrame([(*r, int(r[1] > 20 and (r[2] or 0) > 40)) for r in rows], "id bigint, hour double, basket double, risky int")
    positives = df.where("risky = 1").count()
    fitted = model.train_model(df, ["hour", "basket"], "risky", {"maxIter": 5, "maxDepth": 3})
    assert fitted.scale_pos_weight == pytest.approx((130 - positives) / positives) and positives > 3
    scored = fitted.predict(df, into="chance")
    assert scored.columns == [*df.columns, "chance"] and scored.where("chance between 0 and 1").count() == 130
    means = {r.risky: r.m for r in scored.groupBy("risky").agg(F.avg("chance").alias("m")).collect()}
    assert means[1] > 0.7 > 0.3 > means[0]


RECORDS = [{"TransactionID": 7, "shop": "s1", "card": "c1", "a": 0.25}, {"TransactionID": 8, "shop": "s9", "card": "c1", "a": 0.5}, {"TransactionID": 9, "shop": None, "card": "c2", "a": None}]
ENTITIES = [("shop", "s1", 4, 0.5), ("card", "c1", 2, None), ("card", "c2", 9, 0.125), ("shop", "c1", 77, 0.0)]
NAMES = ["a", "shop_degree", "card_clustering_coeff", "is_new_entity", "absent"]


def entity_lookup(prefix):
    return lambda key: next(({"degree": d, "clustering_coeff": c} for p, k, d, c in ENTITIES if (p, k) == (prefix, key)), None)


def test_score_transaction(spark):
    seen = []

    def predict(values):
        seen.append(values)
        return 0.125

    found = [scoring.score_transaction(spark, r, predict, NAMES, lambda key: entity_lookup(key[0])(key[1]), {p: (lambda t, p=p: (p, t[p])) for p in ("shop", "card")}) for r in RECORDS]
    assert found == [scoring.ScoredTransaction(7, 0.125, False), scoring.ScoredTransaction(8, 0.125, True), scoring.ScoredTransaction(9, 0.125, True)]
    assert seen == [[0.25, 4, None, 0, None], [0.5, 0, None, 1, None], [None, 0, 0.125, 1, None]]


def test_batch_and_single_scores_agree(spark):
    rng = random.Random(2)
    rows = [(i, rng.random(), rng.randrange(9), rng.random(), rng.randrange(2), int(rng.random() < 0.4)) for i in range(80)]
    df = spark.createDataFrame(rows, "TransactionID bigint, a double, shop_degree int, card_clustering_coeff double, is_new_entity int, isFraud int").withColumn("absent", F.lit(None).cast("double"))
    fitted = model.train_model(df, NAMES, params={"maxIter": 3, "maxDepth": 2})
    batch = spark.createDataFrame([tuple(r.values()) for r in RECORDS], "TransactionID bigint, shop string, card string, a double")
    table = spark.createDataFrame([(*e, "2026-01-01") for e in ENTITIES], "entity_col string, entity_value string, degree int, clustering_coeff double, last_updated string")
    many = {r.transaction_id: r for r in scoring.score_batch(batch, fitted, table, {"shop": F.col("shop"), "card": F.col("card")}).collect()}
    assert "card_last_updated" in scoring.serving_features(batch, table, {"card": F.col("card")}).columns
    for r in RECORDS:
        one = scoring.score_transaction(spark, r, fitted, NAMES, lambda key: entity_lookup(key[0])(key[1]), {p: (lambda t, p=p: (p, t[p])) for p in ("shop", "card")})
        assert (one.fraud_probability, one.is_new_entity) == (many[r["TransactionID"]].fraud_probability, many[r["TransactionID"]].is_new_entity)


def test_smote(spark):
    df = spark.createDataFrame([(i, float(i), int(i < 6)) for i in range(40)], "id bigint, a double, y int")
    got = model.smote(df, ["a"], "y", "id").collect()
    assert sum(r.label for r in got) == 34 and len(got) == 68 and all(r.a <= 5 for r in got if r.label == 1)


def test_smote_broadcasts_no_side_that_grows(spark, monkeypatch):
    from tidemark.functions.session import Workspace

    plans, result = [], Workspace.result
    monkeypatch.setattr(Workspace, "result", lambda work, df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or result(work, df))
    df = spark.createDataFrame([(i, float(i), int(i % 4 == 0)) for i in range(40)], "id bigint, a double, y int")
    assert {r["label"]: r["count"] for r in model.smote(df, ["a"], "y", "id").groupBy("label").count().collect()} == {0: 30, 1: 30}
    assert len(plans) == 1 and plans[0].count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in plans[0]


def test_smote_to_its_end(spark):
    """Many positives: each new row lies between two near positives; a model of all rows scores."""
    import numpy as np

    rng = np.random.default_rng(5)
    pos = rng.normal(size=(4100, 2))
    rows = [(i, float(a), float(b), 1) for i, (a, b) in enumerate(pos)] + [(10_000 + i, float(i % 90), -40.0, 0) for i in range(4500)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, y int")
    got = model.smote(df, ["a", "b"], "y", "id")
    made = np.array([(r.a, r.b) for r in got.where("label = 1").collect()])
    assert len(made) == 4500 and got.count() == 9000
    old = {tuple(p) for p in pos}
    new = np.array([p for p in map(tuple, made) if p not in old])
    d = np.sort(((pos[:, None] - pos[None, :200]) ** 2).sum(2), axis=0)[5] ** 0.5  # how far five neighbours reach
    assert len(new) == 400 and np.median(((new[:, None] - pos[None]) ** 2).sum(2).min(1) ** 0.5) <= np.median(d)
    fitted = model.train_model(got, ["a", "b"], "label", {"maxIter": 2, "maxDepth": 2})
    assert fitted.scale_pos_weight == 1.0
    assert fitted.predict(df).where((F.col("fraud_probability") > 0.5) != (F.col("y") == 1)).count() < 50


@pytest.mark.parametrize("case", ["uniform", "clusters", "ties"])
def test_nearest_points_against_all_pairs(spark, case):
    import numpy as np

    from tidemark.functions.session import Workspace

    rng = np.random.default_rng(6)
    x = {"uniform": rng.random((3000, 4)), "clusters": np.repeat(rng.normal(size=(30, 10)) * 3, 100, axis=0) + rng.normal(size=(3000, 10)), "ties": rng.integers(0, 3, (900, 2)).astype(float)}[case]
    x = x * np.exp(rng.normal(size=x.shape[1]))
    points = spark.createDataFrame([(i * 7, v) for i, v in enumerate(x.tolist())], "id bigint, x array<double>")
    with Workspace(spark) as work:
        got = {r.id // 7: [i // 7 for i in r.nearest] for r in model.nearest_points(points, 5, work).collect()}
    far = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(far, np.inf)
    assert len(got) == len(x) and all(len(set(n)) == 5 and i not in n for i, n in got.items())
    fifth = np.sort(far, axis=1)[:, 4]
    found = np.mean([(far[i, n] <= fifth[i] * (1 + 1e-9)).mean() for i, n in got.items()])
    assert found >= (0.9 if case != "ties" else 0.99)


def test_nearest_points_compare_a_bounded_number(spark, monkeypatch):
    """All groups are two stretches at most, also where half of all points are the same; so work is linear in the points."""
    from tidemark.functions.session import Workspace

    monkeypatch.setattr(model, "STRETCH", 16)
    points = spark.range(2000).selectExpr("id", "array(if(id % 2 = 0, 1.0D, sin(id)), if(id % 2 = 0, 1.0D, cos(id)))  as x")
    with Workspace(spark) as work:
        out = model.nearest_points(points, 3, work, tables=2)
        assert out.count() == 2000 and out.where("size(nearest) <> 3").count() == 0
        same = out.where("id % 2 = 0").select("id", F.explode("nearest").alias("n")).where("n % 2 = 1").count()
        assert same == 0
        few = model.nearest_points(points.limit(2), 3, work).collect()
        assert len(few) == 2 and all([r.id] != r.nearest and len(r.nearest) == 1 for r in few)
        assert model.nearest_points(points.limit(0), 3, work).count() == 0


def ones(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x double")


def test_psi(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    ref, other = rng.gamma(2.0, size=700).round(2), rng.gamma(3.0, size=300).round(2)
    inner = np.unique(np.quantile(ref, [i / 10 for i in range(1, 10)]))
    p, q = (np.maximum(np.bincount(np.searchsorted(inner, x, side="right"), minlength=len(inner) + 1) / len(x), 1e-6) for x in (ref, other))
    assert drift.population_stability_index(ones(spark, ref), ones(spark, other), "x") == pytest.approx(float(((q - p) * np.log(q / p)).sum()))
    assert drift.population_stability_index(ones(spark, ref), ones(spark, ref), "x") == pytest.approx(0)
    assert drift.population_stability_index(ones(spark, [3] * 6), ones(spark, [1] * 4), "x", bins=4) == pytest.approx((1 - 1e-6) * math.log(1e6) * 2)
    assert [r.ref for r in drift.bin_shares(ones(spark, [2] * 12 + [5, 6, 7]), ones(spark, [2]), "x", bins=5).orderBy("bin").collect()] == [0, 12, 3]
    assert drift.is_drifted(0.21) and not drift.is_drifted(0.2)
    for a, b in (([], [1]), ([1], [])):
        with pytest.raises(ValueError):
            drift.population_stability_index(ones(spark, a), ones(spark, b), "x")


def test_ks(spark):
    a, b = [0.5, 1, 2, 2, 9], [2, 3, 3, 8, 9, 9, 11]
    d, p = drift.ks_drift_test(ones(spark, a), ones(spark, b), "x")
    assert d == pytest.approx(max(abs(sum(x <= t for x in a) / 5 - sum(x <= t for x in b) / 7) for t in a + b)) and 0 < p < 1


@pytest.mark.parametrize(("n1", "n2"), [(2, 2), (3, 5), (6, 4), (7, 7), (1, 9)])
def test_ks_against_all_orders(n1, n2):
    """Every order of the two samples, counted."""
    from itertools import combinations

    reach = []
    for places in combinations(range(n1 + n2), n1):
        i, most = 0, 0.0
        for k in range(n1 + n2):
            i += k in places
            most = max(most, abs(i / n1 - (k + 1 - i) / n2))
        reach.append(most)
    for d in sorted(set(reach)):
        assert drift.ks_p_value(d, n1, n2) == pytest.approx(sum(r >= d - 1e-12 for r in reach) / len(reach))


def test_ks_of_large_samples():
    import time

    began = time.perf_counter()
    exact = drift.ks_p_value(0.02, 10_000, 10_000)
    assert time.perf_counter() - began < 3
    assert exact == pytest.approx(drift.ks_p_value(0.02, 10_001, 10_001), abs=2e-3)
    assert drift.ks_p_value(0.3, 9000, 10_000) < 1e-9


def test_perturbations(spark):
    df = spark.createDataFrame([(i, "xyz"[i % 3] if i % 7 else None, i / 4) for i in range(210)], "id bigint, c string, v double")
    assert [r.v for r in drift.perturb_amount(df, "v", 1.5).orderBy("id").collect()] == [i * 0.375 for i in range(210)]
    for share, expected in ((0.0, 60), (0.28, 60), (0.29, 60), (0.5, 105), (0.777, 163), (1.0, 210), (3.0, 210)):
        out = drift.perturb_category_mix(df, "c", "x", share, "id")
        assert out.where("c = 'x'").count() == expected and out.columns == df.columns
        assert out.join(df.withColumnRenamed("c", "old"), "id").where("old = 'x' and c <> 'x'").count() == 0
    a, b = (drift.degrade_feature_signal(df, "v", 0.5, "id").orderBy("id").collect() for _ in range(2))
    assert a == b and a != df.orderBy("id").collect()
    mean = sum(r.v - r.id / 4 for r in a) / 210
    assert abs(mean) < 0.15 and 0.35 < (sum((r.v - r.id / 4 - mean) ** 2 for r in a) / 210) ** 0.5 < 0.65


def test_drift_by_batch(spark):
    import numpy as np

    from tidemark.streaming import online

    rng = np.random.default_rng(2)
    reference, seen = ones(spark, rng.normal(size=400)), []
    each = online.drift_batches(reference, "x", lambda number, psi: seen.append((number, psi)))
    for number, part in enumerate((rng.normal(size=200), [], rng.normal(3.0, size=200))):
        each(ones(spark, part), number)
    assert [n for n, _ in seen] == [0, 2] and seen[0][1] < 0.2 < seen[1][1]


def test_schema_and_csv(spark, tmp_path):
    with pytest.raises(ValueError, match="Missing required columns"):
        sources.validate_schema(spark.createDataFrame([(1,)], "TransactionID bigint"))
    t, i = tmp_path / "t.csv", tmp_path / "i.csv"
    t.write_text(",".join(sources.REQUIRED_COLUMNS) + "\n1,10,5.5,0,W,1,NA,3,4,5,6,\n2,20,1.5,1,null,1,2,3,4,5,6,0\n")
    i.write_text("TransactionID,DeviceInfo\n1,NA\n2,Windows\n")
    got = sources.load_transactions(spark, str(t), str(i)).orderBy("TransactionID").collect()
    assert [r.card2 for r in got] == [None, 2.0] and [r.DeviceInfo for r in got] == [None, "Windows"] and [r.ProductCD for r in got] == ["W", None]
    with pytest.raises(ValueError):
        sources.join_identity(spark.createDataFrame([(1, 2)], "TransactionID bigint, a int"), spark.createDataFrame([(1, 2)], "TransactionID bigint, a int"))


def test_trees_are_the_same_on_kinds_of_rows(spark, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rng = random.Random(7)
    rows = [(float(rng.randrange(9)), None if i % 5 == 0 else float(rng.randrange(12)), int(rng.random() < 0.3)) for i in range(3000)]
    df = spark.createDataFrame([(a, b, int(y or a > 6)) for a, b, y in rows], "a double, b double, isFraud int").repartition(3)
    seen, kinds = [], model._kinds
    monkeypatch.setattr(model, "_kinds", lambda *args: seen.append(kinds(*args)) or seen[-1])
    params = {"maxIter": 4, "maxDepth": 3, "stepSize": 0.3, "seed": 42}
    fitted = model.train_model(df, ["a", "b"], params=params)
    assert len(seen) == 1 and fitted.stages.stages[-1].numFeatures == 4
    ready, inputs = model.with_indicators(df, ["a", "b"])
    ready = ready.withColumn("y", F.col("isFraud").cast("double")).withColumn("w", F.when(F.col("isFraud") == 1, fitted.scale_pos_weight).otherwise(1.0))
    plain = Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="x"), GBTClassifier(featuresCol="x", labelCol="y", weightCol="w", **params)]).fit(ready)
    from pyspark.ml.functions import vector_to_array

    want = {(r.a, r.b): r.p for r in plain.transform(ready).select("a", "b", vector_to_array("probability")[1].alias("p")).collect()}
    got = {(r.a, r.b): r.fraud_probability for r in fitted.predict(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_cuts_lie_between_few_values_and_at_quantiles_of_many(spark):
    df = spark.range(5000).select((F.col("id") % 3).cast("double").alias("few"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("many"), F.lit(4).alias("one"))
    ready, _ = model.with_indicators(df, ["few", "many", "one"])
    few, many, one = model._cuts(ready, ["few", "many", "one"], 32)
    assert few == [-np.inf, 0.5, 1.5, np.inf] and one == [-np.inf, 0.0, np.inf]
    assert len(many) == 33 and -999 < many[1] < -998 and all(abs(c - 5000 * i / 31) < 10 for i, c in enumerate(many[2:-1], 1))
