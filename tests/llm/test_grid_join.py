"""The cosine join by epsilon grid order against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import grid_join, queries

SF = "/root/testdata/sf0.001"


def all_pairs(x, ids, least=0.9):
    """n_links and the smallest id of its component for each vector."""
    u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = u @ u.T >= least
    np.fill_diagonal(linked, False)
    root = np.arange(len(u))
    i, j = np.nonzero(linked)
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        root = root[root]
        if (root == before).all():
            break
    smallest = {r: min(ids[root == r]) for r in set(root)}
    return linked.sum(1), np.array([smallest[r] for r in root])


def compare(df, x, ids, least=0.9):
    links, component = all_pairs(x, ids, least)
    got = {r.vec_id: r.linked for r in grid_join.near_vectors(df, least=least).collect()}
    assert len(got) == len(ids)
    assert [got[i].n_links for i in ids] == links.tolist()
    assert [got[i].component_id for i in ids] == component.tolist()
    assert [got[i].kept for i in ids] == (component == ids).tolist()
    return links


def frame(spark, x, ids):
    return spark.createDataFrame([(int(i), v) for i, v in zip(ids, x.tolist(), strict=True)], "vec_id bigint, embedding array<double>").repartition(3)


@pytest.mark.parametrize("case", ["clusters", "one crowd", "chain"])
def test_against_all_pairs(spark, monkeypatch, case):
    monkeypatch.setattr(grid_join, "ROWS", 64)  # more levels
    rng = np.random.default_rng(7)
    if case == "clusters":  # spread so that cosines lie on both sides of 0.9
        x = np.repeat(rng.normal(size=(30, 12)), 60, axis=0)
        x += rng.normal(size=x.shape) * rng.choice([0.05, 0.3, 0.5], size=(len(x), 1))
    elif case == "one crowd":  # a third of all rows are near copies, some the same
        x = rng.normal(size=(1500, 40))
        x[:500] = x[0] + rng.normal(size=(500, 40)) * 0.02
        x[500:540] = x[500]
    else:  # neighbours on a circle: every link only leads to the next ones
        t = np.linspace(0, 5, 900)
        x = np.stack([np.cos(t), np.sin(t), 0.3 + 0 * t], axis=1)
    x *= np.exp(rng.normal(size=(len(x), 1)))
    ids = rng.permutation(len(x)) * 3 - 50
    links = compare(frame(spark, x, ids), x, ids, 0.97 if case == "chain" else 0.9)
    assert links.max() > 20


def test_stretches_that_are_taken_whole():
    """Pairs of blocks of one crowd are decided without a product; distant ones too."""
    rng = np.random.default_rng(2)
    a, far = np.eye(20)[0] + rng.normal(size=(128, 20)) * 0.01, np.eye(20)[1] + rng.normal(size=(64, 20)) * 0.01
    axes, eps = np.eye(20)[:5], np.sqrt(0.2)
    parts = np.stack([grid_join.summary(grid_join.units(p), axes) for p in (a[:64], a[64:], far)])
    may, near = grid_join.decide(parts[[0, 0, 0]], parts[[0, 1, 2]], 5, eps)
    assert may.tolist() == [True, True, False] and near.tolist() == [True, True, False]
    both = grid_join.joint_summary(parts[:2], 5)
    whole = grid_join.summary(grid_join.units(a), axes)
    assert np.allclose(both[:-2], whole[:-2]) and both[-1] == 128 and both[-2] >= whole[-2]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [1.0, 0.0, 0.0]), (3, [9.0, 0.1, 0.0]), (3, [1e-200, 0.0, 0.0]), (None, [1e200, 0.0, -0.0]), (None, [0.0, 0.0, 2.0]), (1, [0.0, 0.0, 0.0]), (2, None), (4, []),
        (6, [1.0, None, 0.0]), (7, [nan, 0.0, 1.0]), (8, [inf, 0.0, 0.0]), (9, [1.0, 0.0]), (10, [0.0, -1.0, 0.0]), (11, [0.0, 1.0, 0.0]),
    ]
    df = spark.createDataFrame([(i, v, "a", k) for k, (i, v) in enumerate(rows)], "vec_id int, embedding array<double>, Linked string, place int")
    out = grid_join.near_vectors(df)
    assert out.columns == [*df.columns, "linked_"]
    got = {r.place: tuple(r.linked_) for r in out.collect()}
    assert len(got) == len(rows)
    assert [got[k] for k in range(4)] == [(3, 3, False), (3, 3, True), (3, 3, True), (3, 3, False)]
    assert got[4] == (0, None, True) and all(got[k] == (0, rows[k][0], True) for k in range(5, 14))
    assert grid_join.near_vectors(df.limit(0)).count() == 0
    assert [tuple(r.linked_) for r in grid_join.near_vectors(df.where("vec_id = 1")).collect()] == [(0, 1, True)]
    with pytest.raises(ValueError, match="cosine"):
        grid_join.near_vectors(df, least=1.0)


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    links, component = all_pairs(x, ids)
    out = queries.op12_vector_duplicates(spark, SF)
    assert dict(out.dtypes) == {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}
    got = {r.vec_id: r for r in out.collect()}
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in ids] == [(n, c, c == i) for i, n, c in zip(ids, links, component, strict=True)]


def test_whole_table_with_copies(spark, monkeypatch):
    """Rows of the table with copies and near copies added, of which some go through stretches that are taken whole."""
    monkeypatch.setattr(grid_join, "ROWS", 64)
    base = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    copies = base.where("vec_id < 3").select(F.explode(F.sequence(F.col("vec_id") * 1000 + 1000, F.col("vec_id") * 1000 + 1300)).alias("vec_id"), "embedding")
    near = copies.select("vec_id", F.transform("embedding", lambda v, i: v + 0.01 * F.sin(F.col("vec_id") * 7.0 + i)).alias("embedding"))
    rows = base.union(near).collect()
    x, ids = np.array([r.embedding for r in rows]), np.array([r.vec_id for r in rows])
    links = compare(frame(spark, x, ids), x, ids)
    assert sorted(links)[-900] >= 300
