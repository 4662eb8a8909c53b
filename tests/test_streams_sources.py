import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.plans import pipelines
from tidemark.sources import transactions as sources
from tidemark.streaming import online

AT = "id bigint, shop string, at timestamp, town string"


def rows_of(n, seed=6):
    rng = random.Random(seed)
    start = dt.datetime(2026, 1, 1)
    return [(i, rng.choice(["a", "b", "c", None]), start + dt.timedelta(seconds=rng.randrange(400) * 30), rng.choice(["x", "y", None])) for i in range(n)]


def streamed(spark, tmp_path, batches, **options):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame([], AT).schema
    query = None
    got = []
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, AT).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        found = online.stream_features(stream, "id", "shop", "at", 600, ("town",), **options)
        query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        rows = spark.read.parquet(out).collect()
        got.append({r.id: (r.velocity, r.since_last, r.addr_changed) for r in rows if r.id not in {i for g in got for i in g}})
    return got


def test_stream_in_several_batches(spark, tmp_path):
    rows = sorted(rows_of(160), key=lambda r: (r[2], r[0]))
    batches = [rows[:50], rows[50:90], rows[90:]]
    got = {k: v for g in streamed(spark, tmp_path, batches, delay="1 day") for k, v in g.items()}
    expected = {}
    for i, (key, shop, at, town) in enumerate(rows):
        if shop is None:
            continue
        earlier = [r for r in rows[:i] if r[1] == shop]
        last = earlier[-1] if earlier else None
        changed = bool(last and last[3] and town and last[3] != town)
        expected[key] = (sum((at - r[2]).total_seconds() <= 600 for r in earlier), (at - last[2]).total_seconds() if last else None, changed)
    assert got == expected


def test_late_rows_and_forgotten_entities(spark, tmp_path):
    t = lambda m: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m)
    first = [(1, "a", t(0), "x"), (2, "a", t(20), "x"), (3, "b", t(0), "x")]
    late = [(4, "a", t(15), "y"), (5, "a", t(21), None)]  # row 4 is behind row 2
    far = [(6, "a", t(600), "y")]
    after = [(7, "b", t(601), "y"), (8, "a", t(601), "z")]
    got = streamed(spark, tmp_path, [first, late, far, after], delay="1 minute", forget_after=3600)
    assert got[0] == {1: (0, None, False), 2: (0, 1200.0, False), 3: (0, None, False)}
    assert got[1].get(5) == (1, 60.0, False) and got[1].get(4) in (None, (0, None, False))
    assert got[2] == {6: (0, 579 * 60.0, False)}
    assert got[3] == {7: (0, None, False), 8: (1, 60.0, True)}  # b's state was dropped after an hour


def test_paths(spark, tmp_path):
    for read in (sources.read_csv, sources.read_features):
        with pytest.raises(FileNotFoundError):
            read(spark, str(tmp_path / "none"))
    df = spark.createDataFrame([(1, 0.5)], "a int, b double")
    sources.write_features(df, str(tmp_path / "table"), as_of="2026-02-03 04:05:06")
    got = sources.read_features(spark, str(tmp_path / "table")).first()
    assert (got.a, got.b, got.last_updated) == (1, 0.5, dt.datetime(2026, 2, 3, 4, 5, 6))


def test_train_and_evaluate(spark):
    from tidemark.plans.queries import joined

    df = pipelines.time_features(joined(spark, "/root/testdata/sf0.001"))
    _, scored, found = pipelines.train_and_evaluate(df, params={"maxIter": 2, "maxDepth": 2})
    total = scored.agg(F.count_if((F.col("fraud_probability") >= found["threshold"]) & (F.col("isFraud") == 0)).alias("fp"), F.count_if((F.col("fraud_probability") < found["threshold"]) & (F.col("isFraud") == 1)).alias("fn")).first()
    assert found["cost"] == total.fp * 5 + total.fn * 100 and 0 < found["pr_auc"] <= 1
    report = pipelines.drift_report(df)
    assert report["split"] < 0.2 < report["perturbed"]


def test_columns_for_the_model():
    from tidemark.operators.model import model_columns

    columns = ["V1", "V20", "C3", "C", "Cx", "D15", "card1", "device_fingerprint_degree", "card_entity_id_degree", "amount"]
    assert model_columns(columns, ("amount", "gone", "V1")) == ["V1", "V20", "C3", "D15", "device_fingerprint_degree", "card_entity_id_degree", "amount"]


def test_chunks_of_times():
    """Counts of a sorted list, late times and repeated ones too; a time rewrites one chunk, whose size does not grow with the window."""
    import bisect

    rng, stored, index, plain, sizes = random.Random(3), {}, {}, [], []
    for i in range(1500):
        x = float(i // 3) if rng.random() < 0.9 else float(rng.randrange(i // 3 + 1))
        chunks = online.Chunks(index, lambda n: stored[n], 16)
        for at in (x, x - 100, x + 0.5):
            assert chunks.before(at, "left") == bisect.bisect_left(plain, at) and chunks.before(at, "right") == bisect.bisect_right(plain, at)
        chunks.add(x)
        bisect.insort(plain, x)
        assert len(chunks.changed) == 1
        for n in chunks.drop_before(plain[-1] - 200):
            stored.pop(n)
        stored |= {n: chunks.times[n].tolist() for n in chunks.changed}
        sizes += [len(stored[n]) for n in chunks.changed]
        index = chunks.index
        plain = sorted(t for n in index for t in stored[n])
    assert len(plain) > 500 and len(stored) > 20 and max(sizes) <= 64 and max(sizes[-200:]) <= 64


class Store:
    """State of one entity that counts its calls."""

    def __init__(self):
        self.calls, self.value, self.maps = [], None, {}

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def getMapState(self, name, *schemas):  # noqa: N802
        store, kept = self, self.maps.setdefault(name, {})

        class Map:
            def iterator(self):
                store.calls.append("iterator")
                return iter(list(kept.items()))

            def getValue(self, key):  # noqa: N802
                store.calls.append("getValue")
                return kept[key]

            def updateValue(self, key, value):  # noqa: N802
                store.calls.append("updateValue")
                kept[key] = value

            def removeKey(self, key):  # noqa: N802
                store.calls.append("removeKey")
                del kept[key]

            def clear(self):
                kept.clear()

        return Map()

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):  # noqa: N802
        self.calls.append(f"timer {at}")


class Now:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def entity_batch(state, rows, packs=1, watermark=0):
    """{id: (velocity, since_last, addr_changed)} of (id, second, town), in so many packs."""
    import pyarrow as pa
    from pyspark.sql import Row

    found = []
    for k in range(packs):
        ids, at, towns = zip(*rows[k::packs], strict=True)
        batch = pa.RecordBatch.from_pydict({"entity": ["a"] * len(ids), "us": pa.array([t * 1_000_000 for t in at], pa.int64()), "id": pa.array(ids, pa.int64()), "a0": pa.array(towns, pa.string())})
        found += [Row(packed=r["packed"]) for out in online._packs(iter([batch])) for r in out.to_pylist()]
    out = [tuple(v) for r in state.handleInputRows(("a",), iter(found), Now(watermark)) for v in zip(r.ids, r.velocity, r.since_last, r.addr_changed, strict=True)]
    assert len(out) == len({v[0] for v in out}) == (len(rows) if not watermark else sum(r[1] * 1000 > watermark for r in rows))
    return {v[0]: v[1:] for v in out}


def test_an_entity_costs_few_calls_of_its_state():
    """A new entity reads and writes one value and sets a timer, a known one does not even that, however many rows it has; a timer that later rows have put off is set again."""
    store = Store()
    state = online.EntityState(100, 1000, 64)
    state.init(store)
    assert entity_batch(state, [(k, 50 * k, "x") for k in range(40)]) == {k: (min(k, 2), 50.0 if k else None, False) for k in range(40)}
    assert store.calls == ["get", f"timer {(1950 + 1000) * 1000}", "update"]
    store.calls.clear()
    assert entity_batch(state, [(40, 2000, "y")]) == {40: (2, 50.0, True)}
    assert store.calls == ["get", "update"]
    # of a pack only what is behind the watermark is left out
    assert entity_batch(state, [(41, 1990, "z"), (42, 1995, "z"), (43, 2000, "y")], watermark=1_990_000) == {42: (2, None, False), 43: (4, 0.0, False)}
    assert entity_batch(state, [(44, 1990, "z")], watermark=1_990_000) == {} and store.value[0] == 2000
    store.calls.clear()
    assert list(state.handleExpiredTimer(("a",), Now(2_950_000), None)) == [] and store.value is not None
    assert store.calls == ["get", "timer 3000000", "update"]
    assert list(state.handleExpiredTimer(("a",), Now(3_000_000), None)) == [] and store.value is None


def test_busy_entities_keep_chunks_and_leave_them():
    """Against a plain count: quiet and busy times, equal times, missing ids and towns, several packs, rows that are late within what is kept."""
    rng, store, plain, at, n = random.Random(8), Store(), [], 0, 0
    state = online.EntityState(100, 10_000, 16)
    state.init(store)
    chunked = []
    for k in range(60):
        rows = []
        for _ in range(rng.randrange(1, 60)):
            at += rng.randrange(2) if k % 20 < 10 else rng.randrange(40)
            rows.append((n, at, rng.choice(["x", "y", None])))
            n += 1
        rng.shuffle(rows)
        late = [(n, at - 1000, "late")] if k == 59 else []
        n += len(late)
        got, expected, last = entity_batch(state, rows + late, rng.choice([1, 2]) if len(rows) > 1 else 1), {}, plain[-1] if plain else None
        for row in sorted(rows, key=lambda r: (r[1], r[0])):
            changed = bool(last and last[2] and row[2] and last[2] != row[2])
            expected[row[0]] = (sum(row[1] - p[1] <= 100 for p in plain), float(row[1] - last[1]) if last else None, changed)
            plain.append(row)
            last = row
        if late:
            assert got.pop(late[0][0])[1:] == (None, False)
        assert got == expected
        plain = plain[-2500:]
        assert all(len(v[0]) <= 64 for v in store.maps["chunks"].values()) and store.maps["chunks"].keys() == store.maps["index"].keys()
        chunked.append(store.value[3] is None)
        assert bool(store.maps["chunks"]) == chunked[-1] and (chunked[-1] or len(store.value[3]) <= 16)
    assert any(chunked) and not all(chunked[10:]) and chunked.index(True) < len(chunked) - 1 - chunked[::-1].index(False)


def test_packs_are_in_order_and_lose_nothing(monkeypatch):
    import pickle

    import pyarrow as pa

    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.randrange(20) * 1_000_000, rng.choice([None, k]), rng.choice(["x", None])) for k in range(200)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(["entity", "us", "id", "a0"], r, strict=True)) for r in rows[k : k + 30]], pa.schema({"entity": pa.string(), "us": pa.int64(), "id": pa.int64(), "a0": pa.string()})) for k in range(0, 200, 30)]
    for limit, count in ((1 << 19, 3), (60, 12)):  # in three fours: two batches each, and the last one
        monkeypatch.setattr(online, "PACKED", limit)
        packs = [r for out in online._packs(iter(batches)) for r in out.to_pylist()]
        assert len(packs) == count
        back = []
        for r in packs:
            ids, us, (towns,) = pickle.loads(r["packed"])
            assert [(t, i is None, i or 0) for t, i in zip(us, ids, strict=True)] == sorted((t, i is None, i or 0) for t, i in zip(us, ids, strict=True))
            assert r["t"] == dt.datetime.fromtimestamp(us[-1] / 1e6, dt.UTC)
            back += [(r["entity"], *v) for v in zip(us, ids, towns, strict=True)]
        assert sorted(back, key=str) == sorted(rows, key=str)
        of_a = [pickle.loads(r["packed"]) for r in packs if r["entity"] == "a"]
        ids, us, _ = online._by_time(of_a)
        assert us == sorted(us) and len(ids) == sum(r[0] == "a" for r in rows)
