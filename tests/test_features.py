import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features
from tidemark.operators.split import temporal_split

ROWS = "id bigint, e string, t bigint"


def velocity(spark, rows, w):
    df = spark.createDataFrame(rows, ROWS).select("id", features.transaction_velocity("e", "t", w, "id").alias("v"))
    return [r.v for r in df.orderBy("id").collect()]


@pytest.mark.parametrize(
    ("rows", "w", "expected"),
    [
        ([(0, "k", 7), (1, "k", 31), (2, "k", 36), (3, "k", 37), (4, "k", 95)], 30, [0, 1, 2, 3, 0]),
        ([(0, "m", 5), (1, "n", 6), (2, "n", 7), (3, "m", 8), (4, "n", 9)], 3, [0, 0, 1, 1, 2]),
        ([(0, "k", 4), (1, "k", 4), (2, "k", 4), (3, "k", 4)], 0, [0, 1, 2, 3]),
        ([(0, "k", 11), (1, "k", 24), (2, "k", 37)], 13, [0, 1, 1]),
        ([(0, None, 3), (1, None, 3), (2, "k", None)], 9, [0, 0, 0]),
    ],
)
def test_velocity(spark, rows, w, expected):
    assert velocity(spark, rows, w) == expected


def test_velocity_against_counting(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["A", "B", None]), rng.randrange(40)) for i in range(200)]
    expected = [0 if e is None else sum(1 for j, f, s in rows if f == e and (s, j) < (t, i) and s >= t - 7.5) for i, e, t in rows]
    assert velocity(spark, rows, 7.5) == expected


def test_velocity_costs_the_same_per_row(spark):
    import time

    def took(n):
        df = spark.range(n).select(F.col("id"), F.lit("one").alias("e"), F.col("id").alias("t")).select(features.transaction_velocity("e", "t", n, "id").alias("v"))
        began = time.perf_counter()
        assert df.agg(F.sum("v")).first()[0] == n * (n - 1) // 2
        return time.perf_counter() - began

    took(1000)
    assert took(200_000) < 4 * took(50_000) + 4


def test_negative_window():
    with pytest.raises(ValueError):
        features.transaction_velocity("e", "t", -1)


def test_recency_and_address(spark):
    """Random visits of a few travellers, against a walk over each one's own rows."""
    rng = random.Random(31)
    rows = [(i, rng.choice(["ann", "bo", "cy", None]), rng.choice(range(3, 90, 7)), rng.choice([None, 21.5, 22.5]), float(rng.randrange(2))) for i in range(160)]
    df = spark.createDataFrame(rows, "id bigint, who string, t bigint, street double, town double")
    got = {r.id: (r.s, r.c) for r in df.select("id", features.time_since_last("who", "t", "id").alias("s"), features.addr_change_flag("who", "t", ["street", "town"], "id").alias("c")).collect()}
    for who in ("ann", "bo", "cy"):
        own = sorted((r for r in rows if r[1] == who), key=lambda r: (r[2], r[0]))
        for before, r in zip([None, *own], own, strict=False):
            if before is None:
                assert got[r[0]] == (None, False)
                continue
            assert got[r[0]] == (float(r[2] - before[2]), any(x is not None and y is not None and x != y for x, y in zip(before[3:], r[3:], strict=True)))


def test_merchant_risk(spark):
    rows = [("gas", 1), ("gas", 1), ("gas", 0), ("toys", 0), ("toys", 0), ("books", None), ("books", 1), (None, 0)]
    train = spark.createDataFrame(rows, "shop string, y int")
    encoder = features.MerchantRiskEncoder("shop", "y", smoothing=4.0)
    with pytest.raises(RuntimeError):
        encoder.transform(train)
    encoder.fit(train)
    seen = spark.createDataFrame([("gas",), ("toys",), ("books",), ("new",), (None,)], "shop string")
    got = {r.shop: r.merchant_risk for r in encoder.transform(seen).collect()}
    overall = 3 / 7  # of rows with a label
    assert got == pytest.approx({"gas": (2 + 4 * overall) / 7, "toys": 4 * overall / 6, "books": (1 + 4 * overall) / 5, "new": overall, None: overall})


def test_split(spark):
    rng = random.Random(4)
    times = [rng.randrange(500) for _ in range(350)]
    df = spark.createDataFrame([(t,) for t in times] + [(None,)], "TransactionDT bigint")
    for share in (0.0, 0.35, 0.7, 1.0):
        train, test = ([r[0] for r in part.collect()] for part in temporal_split(df, train_frac=share))
        place = share * 349
        low, high = sorted(times)[int(place)], sorted(times)[min(349, int(place) + 1)]
        c = low + (high - low) * (place - int(place))
        assert sorted(train) == sorted(t for t in times if t <= c) and sorted(test) == sorted(t for t in times if t > c)
    assert [part.count() for part in temporal_split(df.limit(0))] == [0, 0]


def test_quantiles_and_digests(spark):
    import numpy as np

    from tidemark.operators.quantiles import quantiles, smallest_digest

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=300).round(1), [float("nan")] * 5])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(999, None)], "id bigint, x double")
    fractions = [0.0, 0.1, 0.333, 0.5, 0.999, 1.0]
    assert quantiles(df, "x", fractions) == pytest.approx(list(np.quantile(x[:300], fractions)))
    digest = F.md5(F.col("id").cast("string"))
    every = sorted(r[0] for r in df.select(digest).collect())
    assert [smallest_digest(df, digest, k) for k in (0, 1, 7, 306, 307)] == [None, every[0], every[6], every[305], None]
