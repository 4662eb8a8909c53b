"""Interval joins, rates in levels, and sketches, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift, features, sketches
from tidemark.operators.interval import pairs_within


@pytest.mark.parametrize("group", [4096, 8])
def test_pairs_within(spark, group):
    rng = random.Random(group)
    keys = ["hot"] * 5 + ["a", "b", None]
    rows = [(i, rng.choice(keys), rng.choice([None, *range(-300, 900)]), rng.choice(["x", "y", "z", None])) for i in range(500)] + [(500, "edge", 0, "x"), (501, "edge", 60, "y"), (502, "edge", 121, "x"), (503, "edge", 60, "z"), (None, "edge", 60, "q")]
    df = spark.createDataFrame(rows, "id bigint, k string, t bigint, card string").repartition(3)
    order = lambda r: (r[2], r[0])
    good = [r for r in rows if None not in r[:3]]
    for differ in (None, "card"):
        want = []
        for a in good:
            for b in good:
                if a[1] == b[1] and order(a) < order(b) and b[2] - a[2] <= 60 and (differ is None or (None not in (a[3], b[3]) and a[3] != b[3])):
                    want.append((a[1], a[0], b[0], b[2] - a[2]))
        got = pairs_within(df, "k", "t", 60, "id", differ, group)
        assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100
    assert pairs_within(df.limit(0), "k", "t", 60, "id").count() == 0


def test_a_busy_key_is_many_groups(spark):
    df = spark.range(300).selectExpr("id", "'k' as k", "id % 10 as t")
    got = pairs_within(df, "k", "t", 100, "id", group=30)
    assert got.count() == 300 * 299 // 2
    plan = got._jdf.queryExecution().toString()
    assert "salt" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_rates_in_levels(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice(["food", "toys", None]), rng.choice([1, 2, None]), rng.choice([None, 0, 0, 1])) for i in range(200)] + [(200, "rare", 1, 1), (201, "void", 1, None)]
    df = spark.createDataFrame(rows, "id bigint, shop string, size int, y int")
    fitted = features.HierarchicalRiskEncoder(["shop", "size"], "y", 5.0, "risk").fit(df)
    mean = lambda ys, above: (sum(ys) + 5 * above) / (len(ys) + 5)
    labels = lambda *on: [r[3] for r in rows if r[3] is not None and all(r[1 + i] == v for i, v in enumerate(on))]
    whole = labels()
    top = sum(whole) / len(whole)
    rate = {(): top} | {(s,): mean(labels(s), top) for s in ("food", "toys", "rare")}
    rate |= {(s, z): mean(labels(s, z), rate[s,]) for s in ("food", "toys") for z in (1, 2)} | {("rare", 1): mean([1], rate["rare",])}
    found = {tuple(v for v in (r.l0, r.l1) if v is not None): r.rate for r in fitted.rates().collect()}
    assert found == pytest.approx(rate)  # a category without labels has no rate of its own
    seen = [(1, "food", 2), (2, "food", None), (3, "food", 9), (4, "new", 1), (5, None, 1), (6, "rare", 1), (7, "rare", 2), (8, "void", 1)]
    got = {r.id: r.risk for r in fitted.transform(spark.createDataFrame(seen, "id bigint, shop string, size int")).collect()}
    assert got == pytest.approx({1: rate["food", 2], 2: rate["food",], 3: rate["food",], 4: top, 5: top, 6: rate["rare", 1], 7: rate["rare",], 8: top})


def test_sketches_of_days(spark):
    rng = random.Random(5)
    rows = [(d, rng.gauss(d, 3)) for d in range(6) for _ in range(2000)] + [(2, None), (3, float("nan"))]
    df = spark.createDataFrame(rows, "day int, v double").repartition(4)
    daily = sketches.daily_sketches(df, F.col("day"), "v").cache()
    assert {r.period: r.n for r in daily.collect()} == dict.fromkeys(range(6), 2000)
    for days in (range(6), range(2, 4)):
        one = sketches.merged(daily.where(F.col("period").isin(*days)))
        values = sorted(v for d, v in rows if d in days and v is not None and v == v)
        for f in (0.0, 0.05, 0.5, 0.95, 1.0):
            v = one.select(sketches.quantile(F.col("sketch"), f)).first()[0]
            assert abs(sum(x <= v for x in values) / len(values) - f) < 0.02
    early, late = daily.where("period < 3"), daily.where("period >= 3")
    exact = drift.population_stability_index(df.where("day < 3"), df.where("day >= 3"), "v")
    assert sketches.sketched_psi(sketches.merged(early), sketches.merged(late)).first().psi == pytest.approx(exact, rel=0.1) and exact > 0.2
    alike = spark.createDataFrame([(i % 2, float(i % 5)) for i in range(500)], "day int, v double")  # few values, many ties
    both = sketches.daily_sketches(alike, F.col("day"), "v")
    assert sketches.sketched_psi(sketches.merged(both.where("period = 0")), sketches.merged(both.where("period = 1"))).first().psi == pytest.approx(0.0, abs=1e-9)
