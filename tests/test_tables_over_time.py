"""As-of joins, the entity table over several batches, and drift over windows of a stream."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.session import Workspace, shared_folder
from tidemark.operators import drift, graph
from tidemark.operators.asof import asof_join
from tidemark.operators.entity_table import EntityTable
from tidemark.streaming import online


@pytest.mark.parametrize("heavy", [10**6, 20])
def test_asof_join(spark, heavy):
    rng = random.Random(heavy)
    keys = ["hot"] * 6 + ["a", "b", "c", None]
    left = [(i, rng.choice(keys), rng.choice([None, *range(40)])) for i in range(400)] + [(400, "nobody", 5), (1, "hot", 7), (1, "hot", 7)]
    right = [(rng.choice(keys[:-1]), rng.randrange(-5, 40), rng.randrange(3), rng.choice([None, rng.random()])) for _ in range(300)] + [(None, 1, 1, 0.5), ("a", None, 1, 0.5)]
    lefts = spark.createDataFrame(left, "id bigint, k string, at bigint").repartition(3)
    rights = spark.createDataFrame(right, "k string, last_updated bigint, version int, value double").repartition(2)
    with Workspace(spark) as work:
        out = asof_join(lefts, rights, "k", "at", tie="version", heavy=heavy, work=work)
        assert out.columns == ["id", "k", "at", "last_updated", "version", "value"]
        got = sorted(map(repr, map(tuple, out.collect())))
    order = lambda r: (r[1], r[2], r[3] is not None, r[3] or 0)  # noqa: E731  nulls are the least
    expected = []
    for row in left:
        before = [r for r in right if r[0] == row[1] and None not in (row[1], row[2], r[1]) and r[1] <= row[2]]
        best = max(before, key=order, default=(None,) * 4)
        expected.append(repr((*row, *best[1:])))
    assert got == sorted(expected)


def test_asof_join_of_little(spark):
    left, right = spark.createDataFrame([(1, "a", 5)], "id int, k string, at int"), spark.createDataFrame([("a", 6, 1.0)], "k string, last_updated int, x double")
    assert [tuple(r) for r in asof_join(left, right, "k", "at").collect()] == [(1, "a", 5, None, None)]
    assert asof_join(left.limit(0), right, "k", "at").count() == 0
    assert [tuple(r) for r in asof_join(left, right.limit(0), "k", "at").collect()] == [(1, "a", 5, None, None)]
    with pytest.raises(ValueError, match="both sides"):
        asof_join(left.withColumn("X", F.lit(1)), right, "k", "at")


def folders(path):
    return {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("bucket=")}


def test_entity_table_over_batches(spark):
    rng = random.Random(8)
    rows = [(i, f"a{min(rng.randrange(40), rng.randrange(40))}", f"b{rng.randrange(60)}" if rng.random() < 0.7 else None) for i in range(90)]
    rows += [(100 + i, None, f"z{i}") for i in range(3)] + [(200, None, None)]
    batches = [rows[:30] + rows[90:92], rows[30:31], rows[31:90] + rows[92:], []]
    schema = "txn bigint, a string, b string"
    with Workspace(spark) as work:
        table = EntityTable(spark, f"{work.path}/kept", buckets=8)
        assert table.read().count() == 0
        so_far, seen = [], {}
        for k, batch in enumerate(batches, 1):
            so_far += batch
            for _, a, b in batch:
                seen |= {key: k for key in (("a", a), ("b", b)) if key[1]}
            before = folders(f"{table.path.removeprefix('file:')}/entities") if k > 1 else {}
            table.update(graph.bipartite_edges(spark.createDataFrame(batch, schema), "txn", ["a", "b"]), f"2026-03-0{k}")
            whole = graph.entity_features(spark.createDataFrame(so_far, schema), "txn", ["a", "b"], ["degree", "component_size"])
            want = {(r.entity_col, r.entity_value): (r.degree, r.component_size, seen[r.entity_col, r.entity_value]) for r in whole.collect()}
            got = {(r.entity_col, r.entity_value): (r.degree, r.component_size, r.last_updated.day) for r in table.read().collect()}
            assert got == want and table.read().count() == len(want)
            after = folders(f"{table.path.removeprefix('file:')}/entities")
            changed = {d for d in after if after[d] != before.get(d)}
            if k == 2:  # one transaction, two entities at most
                assert len(changed) <= 2 < len(after)
            if k == 4:
                assert not changed
    assert not os.path.exists(table.path.removeprefix("file:"))


def test_components_that_come_together(spark):
    """The parts of the smaller component get a new root, those of the larger stay."""
    edges = lambda *rows: spark.createDataFrame([(t, "e", x) for t, xs in rows for x in xs], "txn_id bigint, entity_col string, entity_value string")
    with Workspace(spark) as work:
        table = EntityTable(spark, f"{work.path}/kept", buckets=4)
        table.update(edges((1, "ab"), (2, "bc"), (3, "xy"), (4, "q")), "2026-01-01")
        roots = lambda: {r.part: r.root for r in table._read("parts", "part string, root string, bucket int").collect()}
        assert sorted(r.component_size for r in table.read().collect()) == [2, 3, 3, 5, 5, 5]
        big, small = '["e","c"]', '["e","y"]'  # of new ones the greatest
        assert roots() == {big: big, small: small, '["e","q"]': '["e","q"]'}
        table.update(edges((5, "xcn")), "2026-01-02")
        assert roots() == {big: big, small: big, '["e","q"]': '["e","q"]'}
        got = {r.entity_value: (r.degree, r.component_size, r.last_updated.day) for r in table.read().collect()}
        assert got == {"a": (1, 10, 1), "b": (2, 10, 1), "c": (2, 10, 2), "x": (2, 10, 2), "y": (1, 10, 1), "n": (1, 10, 2), "q": (1, 2, 1)}


def test_counts_give_the_same_psi(spark):
    rng = random.Random(3)
    a = spark.createDataFrame([(rng.gauss(0, 1),) for _ in range(300)] + [(None,), (float("nan"),)], "x double")
    b = spark.createDataFrame([(rng.gauss(0.4, 2),) for _ in range(90)] + [(None,)], "x double")
    bins = drift.reference_bins(a, "x")
    assert bins.count() == 1 and sum(bins.first()["counts"]) == 300 and len(bins.first()["edges"]) == 9
    own = drift.reference_bins(b, "x").first()
    counts = b.where("x is not null").agg(F.array(*[F.count_if(drift.place(list(bins.first()["edges"]), F.col("x")) == i) for i in range(10)]).alias("c")).first()["c"]
    lists = lambda c: F.array(*[F.lit(v).cast("bigint") for v in c])
    row = spark.range(1).select(drift.psi_of_counts(lists(bins.first()["counts"]), lists(counts)).alias("p"), drift.psi_of_counts(lists(own["counts"]), lists([0] * 10)).alias("none")).first()
    assert row.p == pytest.approx(drift.population_stability_index(a, b, "x")) and row.none is None


def test_drift_over_windows(spark, tmp_path):
    start = datetime(2026, 1, 1)
    reference = spark.createDataFrame([(float(i % 10),) for i in range(100)], "v double")
    rows = [(start + timedelta(minutes=7 * i), float(i % 10)) for i in range(100)]  # the first hours as the reference
    rows += [(start + timedelta(hours=13, minutes=i), 9.0) for i in range(50)] + [(start + timedelta(hours=18, minutes=i), None) for i in range(5)] + [(start + timedelta(hours=30), float("nan")), (None, 1.0)]
    spark.createDataFrame(rows, "t timestamp, v double").repartition(2).write.parquet(f"{tmp_path}/in")
    bins = drift.reference_bins(reference, "v", 5)
    stream = spark.readStream.schema("t timestamp, v double").parquet(f"{tmp_path}/in")
    out = online.windowed_drift(stream, "t", "v", bins, "6 hours", "1 hour")
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {r.start.hour: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert set(got) == {0, 6, 12, 18}  # the window that holds the latest time is open
    assert got[0].psi < 0.05 and not got[0].drifted and got[12].drifted and got[12].n == 50
    assert got[18].n == 0 and got[18].psi is None and got[18].drifted is None
    batch = spark.createDataFrame(rows, "t timestamp, v double").where(F.col("t") < start + timedelta(hours=6))
    told = []
    each = online.drift_batches(reference, "v", lambda k, p: told.append((k, p)), 5)
    each(batch, 4)
    each(batch.limit(0), 5)
    assert told == [(4, pytest.approx(got[0].psi))]


@pytest.mark.parametrize(("name", "rows"), [("entity_table_batches", 1552), ("load_csv", 1000), ("stream_velocity", 1000), ("stream_drift", 29)])
def test_queries_leave_nothing_but_their_result(spark, name, rows):
    from tidemark.plans.queries import QUERIES

    folder = shared_folder(spark).removeprefix("file:")
    known = lambda: {f for f in os.listdir(folder) if f.startswith(("work-", "result-", "table-", "csv-", "stream-", "features-"))}
    before = known()
    out = QUERIES[name](spark, "/root/testdata/sf0.001")
    new = known() - before
    assert len(new) == 1 and new.pop().startswith("result-") and out.count() == rows
