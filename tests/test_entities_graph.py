import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import entities, graph
from tidemark.operators.components import connected_components

CARD = "id bigint, card1 double, card2 double, card3 double, card5 double, addr1 double, addr2 double, D1 double, TransactionDT bigint"


def test_normalize(spark):
    given = {"Pixel 7/TQ3A  (beta)": "pixel_7_tq3a_beta", "__x__": "x", "UNKNOWN": "unknown", "  ": "unknown", "ÄB-9": "b_9", None: "unknown"}
    df = spark.createDataFrame([(x,) for x in given], "x string")
    assert [r[0] for r in df.select(entities.normalize_device_info(F.col("x"))).collect()] == list(given.values())


def test_fingerprint(spark):
    rows = [("Moto G(8)", "Firefox 99"), ("MOTO g 8", "firefox-99"), (None, "Edge"), ("unknown", "!"), ("", None), ("Nokia", "")]
    df = spark.createDataFrame(rows, "DeviceInfo string, id_31 string")
    got = [r[0] for r in df.select(entities.device_fingerprint()).collect()]
    assert got == ["device:moto_g_8|browser:firefox_99"] * 2 + ["device:unknown|browser:edge", None, None, "device:nokia|browser:unknown"]


def test_card_ids(spark):
    day = 86400
    rows = [
        (0, 310.0, 7.5, 185.0, 226.0, 44.0, 87.0, 3.0, 5 * day), (1, 310.0, 7.5, 185.0, 226.0, 44.0, 87.0, 9.0, 11 * day), (2, 310.0, 7.5, 185.0, 226.0, 44.0, 87.0, 3.0, 6 * day),
        (3, None, None, None, 226.0, None, None, None, 7), (4, None, None, None, 226.0, None, None, 1.0, None), (5, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 7 * day // 2), (6, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 9 * day // 2),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, CARD).select(entities.card_entity_id()).collect()]
    assert got[0] == got[1] == "card:310_7.5_185_226_44_87|origin:2" and got[2] == "card:310_7.5_185_226_44_87|origin:3"
    assert got[3] == got[4] == "card:-1_-1_-1_226_-1_-1|origin:-999999"
    assert got[5].endswith("|origin:2") and got[6].endswith("|origin:4")  # halves go to the even day


def test_cap(spark):
    df = spark.createDataFrame([(x,) for x in ["often"] * 7 + ["limit"] * 4 + ["once", None, None]], "v string")
    got = sorted(str(r.v) for r in entities.cap_high_frequency_entities(df, "v", 4).collect())
    assert got == ["None"] * 9 + ["limit"] * 4 + ["once"]


def test_stats(spark):
    rows = [(10, "p"), (11, "q"), (12, "p"), (13, None), (14, "p"), (15, "p"), (16, "q"), (10, "p"), (17, None)]
    df = spark.createDataFrame(rows, "txn bigint, device string")
    got = {r.entity_value: r for r in graph.entity_features(df, "txn", ["device"]).collect()}
    assert (got["p"].degree, got["p"].component_size) == (4, 5) and (got["q"].degree, got["q"].component_size) == (2, 3)
    assert all(r.community_id == -1 and r.clustering_coeff == 0.0 for r in got.values())
    back = [(r.txn, r.device_degree) for r in graph.transaction_entity_features(df, ["device"], graph.degrees(graph.bipartite_edges(df, "txn", ["device"]))).collect()]
    assert sorted(back) == sorted((t, {"p": 4, "q": 2, None: None}[d]) for t, d in rows)
    assert sorted(r.txn_id for r in graph.isolated_transactions(df, "txn", ["device"]).collect()) == [13, 17]


def test_triangle_and_namespaces(spark):
    df = spark.createDataFrame([(1, "x", "x", "z")], "txn bigint, a string, b string, c string")
    rows = graph.entity_features(df, "txn", ["a", "b", "c"]).collect()
    assert len(rows) == 3 and all(r.clustering_coeff == 1.0 and r.component_size == 4 for r in rows)
    assert len({r.community_id for r in rows}) == 1


def test_duplicate_entities_raise(spark):
    df = spark.createDataFrame([(1, "x")], "txn bigint, a string")
    stats = spark.createDataFrame([("a", "x", 1), ("a", "x", 2)], "entity_col string, entity_value string, degree int")
    with pytest.raises(ValueError):
        graph.transaction_entity_features(df, ["a"], stats)


def test_clustering_against_counting(spark):
    rng = random.Random(5)
    rows = [(i, f"a{rng.randrange(6)}", f"b{rng.randrange(6)}", f"c{rng.randrange(6)}") for i in range(25)]
    df = spark.createDataFrame(rows, "txn bigint, a string, b string, c string")
    near = {}
    for _, *vs in rows:
        for x, y in combinations([(n, v) for n, v in zip("abc", vs, strict=True)], 2):
            near.setdefault(x, set()).add(y)
            near.setdefault(y, set()).add(x)
    got = {(r.entity_col, r.entity_value): r.clustering_coeff for r in graph.clustering(graph.projection(graph.bipartite_edges(df, "txn", ["a", "b", "c"]))).collect()}
    for x, ns in near.items():
        t = sum(1 for p, q in combinations(ns, 2) if q in near[p])
        assert got[x] == pytest.approx(2 * t / (len(ns) * (len(ns) - 1)) if len(ns) > 1 else 0)


def test_clustering_does_not_open_the_paths_between_hubs(spark, monkeypatch):
    # 60 entities that each share transactions with 20 hubs, and one triangle: pairs of hubs are no work
    rows = [(60 * h + i, f"a{i}", f"h{h}", None) for h in range(20) for i in range(60)] + [(5000, "x", "y", "z")]
    df = spark.createDataFrame(rows, "txn bigint, a string, b string, c string")
    opened, paths = [], graph._paths
    monkeypatch.setattr(graph, "_paths", lambda d: opened.append(paths(d).count()) or paths(d))
    got = {(r.entity_col, r.entity_value): r.clustering_coeff for r in graph.clustering_of_entities(graph.bipartite_edges(df, "txn", ["a", "b", "c"])).collect()}
    assert opened == [1] and len(got) == 83
    assert {k for k, v in got.items() if v} == {("a", "x"), ("b", "y"), ("c", "z")} and got["a", "x"] == 1.0


def test_clustering_opens_paths_from_the_least_node(spark, monkeypatch):
    # 600 customers of one order, 20 cells, 10 prices: two edges of each customer, not each customer's cell with all its prices
    rows = [(i, f"c{i}", f"d{i % 20}", f"p{i // 20 % 10}") for i in range(600)]
    opened, paths = [], graph._paths
    monkeypatch.setattr(graph, "_paths", lambda d: opened.append(paths(d).count()) or paths(d))
    df = spark.createDataFrame(rows, "txn bigint, a string, b string, c string")
    got = {(r.entity_col, r.entity_value): r.clustering_coeff for r in graph.clustering_of_entities(graph.bipartite_edges(df, "txn", ["a", "b", "c"])).collect()}
    assert opened == [600] and len(got) == 630 and all(got["a", f"c{i}"] == 1.0 for i in range(600))
    assert got["b", "d0"] == pytest.approx(2 * 30 / (40 * 39)) and got["c", "p0"] == pytest.approx(2 * 60 / (80 * 79))


def test_statistics_open_paths_from_the_least_node(spark, monkeypatch):
    opened, paths = [], graph._paths
    monkeypatch.setattr(graph, "_paths", lambda d: opened.append(paths(d).count()) or paths(d))
    df = spark.createDataFrame([(i, f"c{i}", f"d{i % 20}", f"p{i // 20 % 10}") for i in range(600)], "txn bigint, a string, b string, c string")
    got = graph.entity_features(df, "txn", ["a", "b", "c"], ["degree", "clustering_coeff"]).where("entity_col = 'a'").distinct()
    assert opened == [600] and got.where("degree = 1 and clustering_coeff = 1.0").count() == got.count() == 600


def test_clustering_of_transactions_with_two_entities_of_a_column(spark):
    rows = [(1, "x", "y"), (1, "z", None), (2, "x", "v"), (3, "w", "v"), (4, "w", "u")]
    df = spark.createDataFrame(rows, "txn bigint, a string, b string")
    got = {r.entity_value: r.clustering_coeff for r in graph.clustering_of_entities(graph.bipartite_edges(df, "txn", ["a", "b"])).collect()}
    assert got == {"x": pytest.approx(1 / 3), "y": 1.0, "z": 1.0, "v": 0.0, "w": 0.0, "u": 0.0}


def test_components_random(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {x: find(x) for x in list(up)}


def test_louvain_contract(spark):
    rows = [(i, f"a{i % 3}", f"b{i % 3}") for i in range(9)] + [(100, "a9", None)]
    edges = graph.bipartite_edges(spark.createDataFrame(rows, "txn bigint, a string, b string"), "txn", ["a", "b"])
    got = {(r.entity_col, r.entity_value): r.community_id for r in graph.communities(edges, graph.projection(edges)).collect()}
    assert len(set(got.values())) == 4 and all(got["a", f"a{i}"] == got["b", f"b{i}"] for i in range(3))
    assert min(got.values()) == 0 and max(got.values()) == 3


def _modularity(pairs, of):
    m = sum(w for *_, w in pairs)
    inside, degree = 0, {}
    for a, b, w in pairs:
        inside += w * (of[a] == of[b])
        for x in (a, b):
            degree[of[x]] = degree.get(of[x], 0) + w
    return inside / m - sum(k * k for k in degree.values()) / (4 * m * m)


def _sequential(pairs):
    """Communities by moving one node at a time, level by level; a plain version to be held against."""
    m = sum(w for *_, w in pairs)
    of = {x: x for a, b, _ in pairs for x in (a, b)}
    while True:
        near, loops = {}, {}
        for a, b, w in pairs:
            a, b = of[a], of[b]
            if a == b:
                loops[a] = loops.get(a, 0) + w
                near.setdefault(a, {})
            else:
                for x, y in ((a, b), (b, a)):
                    near.setdefault(x, {})[y] = near.get(x, {}).get(y, 0) + w
        k = {x: sum(ys.values()) + 2 * loops.get(x, 0) for x, ys in near.items()}
        home, total, moved, again = {x: x for x in near}, dict(k), False, True
        while again:
            again = False
            for x in sorted(near):
                to = {}
                for y, w in near[x].items():
                    to[home[y]] = to.get(home[y], 0) + w
                total[home[x]] -= k[x]
                best = max(sorted({home[x], *to}), key=lambda c: (round(to.get(c, 0) - total[c] * k[x] / (2 * m), 9), c == home[x]))
                total[best] += k[x]
                if best != home[x]:
                    home[x], moved, again = best, True, True
        if not moved:
            return of
        of = {x: home[c] for x, c in of.items()}


def _hangs_together(members, near):
    seen, todo = set(), [next(iter(members))]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [y for y in near[x] if y in members]
    return seen == members


@pytest.mark.parametrize("case", ["groups", "orders", "hub"])
def test_communities_against_one_node_at_a_time(spark, case):
    rng = random.Random(9)
    if case == "groups":  # four groups of entities that share transactions, and few between them
        rows = []
        for i in range(240):
            g = rng.randrange(4)
            other = g if rng.random() < 0.95 else rng.randrange(4)
            rows.append((i, f"a{g}{rng.randrange(4)}", f"b{other}{rng.randrange(4)}"))
    elif case == "orders":
        from tidemark.plans.surrogate import order_entities

        rows = [(r.txn, r.customer, r.cell) for r in order_entities(spark, "/root/testdata/sf0.001").collect()]
    else:  # half of all edges are those of one entity
        rows = [(i, "hub" if i % 2 else f"a{i % 30}", f"b{i % 60}") for i in range(600)]
    rows.append((-1, "far", None))
    edges = graph.bipartite_edges(spark.createDataFrame(rows, "txn bigint, a string, b string"), "txn", ["a", "b"]).cache()
    projected = graph.projection(edges).cache()
    pairs = [((r.src.entity_col, r.src.entity_value), (r.dst.entity_col, r.dst.entity_value), r.weight) for r in projected.collect()]
    got = {(r.entity_col, r.entity_value): r.community_id for r in graph.communities(edges, projected).collect()}
    assert len(got) == edges.select("entity_col", "entity_value").distinct().count()
    assert sorted(set(got.values())) == list(range(max(got.values()) + 1)) and list(got.values()).count(got["a", "far"]) == 1
    assert _modularity(pairs, got) >= 0.98 * _modularity(pairs, _sequential(pairs)) > 0
    near, members = {}, {}
    for a, b, _ in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for x, c in got.items():
        members.setdefault(c, set()).add(x)
    assert all(_hangs_together(xs, near | {("a", "far"): set()}) for xs in members.values())


def test_a_community_is_cut_where_it_does_not_hang_together(spark):
    from tidemark.functions.session import Workspace
    from tidemark.operators import communities

    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (4, 5, 1.0), (3, 6, 1.0)], "src bigint, dst bigint, w double")
    names = spark.createDataFrame([(1, 1), (2, 1), (3, 6), (4, 1), (5, 1), (6, 6), (7, 1)], "v bigint, name bigint")
    with Workspace(spark) as work:
        got = {r.v: r.name for r in communities._connected(edges, names, work).collect()}
        assert communities._modularity_of(edges, names, 4.0) == pytest.approx(3 / 4 - (5**2 + 3**2) / 64)
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 3, 7: 7}


def test_numbers_in_order(spark):
    from tidemark.functions.order import numbered
    from tidemark.functions.session import Workspace

    df = spark.createDataFrame([(f"x{i * 7 % 101:03d}", i) for i in range(101)], "Part string, offset int").repartition(3)
    with Workspace(spark) as work:
        out, n = numbered(df, ["Part"], "e", work)
        assert n == 101 and out.columns == ["Part", "offset", "e"]
        assert [r.Part for r in out.orderBy("e").collect()] == [f"x{i:03d}" for i in range(101)] and {r.e for r in out.collect()} == set(range(101))
        assert numbered(df.limit(0), ["Part"], "e", work)[1] == 0


def test_nothing_but_the_result_stays(spark):
    import os

    from tidemark.functions.session import shared_folder

    df = spark.createDataFrame([(i, f"a{i % 3}", f"b{i % 5}") for i in range(30)], "txn bigint, a string, b string")
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = graph.entity_features(df, "txn", ["a", "b"])
    new = set(os.listdir(folder)) - before
    assert len(new) == 1 and new.pop().startswith("result-") and out.count() == 8


def test_a_step_of_moves_joins_twice(spark):
    from tidemark.operators import communities

    # a triangle 1, 2, 3 and an edge 4, 5, both ways, each with the degree of its first end
    both = spark.createDataFrame([(a, b, 1.0, 2.0) for a in (1, 2, 3) for b in (1, 2, 3) if a != b] + [(4, 5, 1.0, 1.0), (5, 4, 1.0, 1.0)], "v bigint, u bigint, w double, k double")
    home = spark.createDataFrame([(v, v, 2.0 if v < 4 else 1.0) for v in range(1, 6)], "v bigint, c bigint, k double")
    for share in range(communities.SHARES):
        home = communities._step(home, both, 4.0, 0, share)
        if not share:
            assert home._jdf.queryExecution().analyzed().toString().count("Join ") == 2
    got = {r.v: (r.c, r.k) for r in home.collect()}
    assert {v: k for v, (_, k) in got.items()} == {1: 2.0, 2: 2.0, 3: 2.0, 4: 1.0, 5: 1.0}
    assert got[4][0] == got[5][0] and not {got[v][0] for v in (1, 2, 3)} & {got[4][0]} and len({got[v][0] for v in (1, 2, 3)}) < 3


def test_communities_from_edges_alone(spark):
    rows = [(i, f"a{i % 3}", f"b{i % 3}") for i in range(9)] + [(100, "a9", None)]
    edges = graph.bipartite_edges(spark.createDataFrame(rows, "txn bigint, a string, b string"), "txn", ["a", "b"])
    got, as_before = graph.communities_of_entities(edges).collect(), graph.communities(edges, graph.projection(edges)).collect()
    assert sorted(got) == sorted(as_before) and len(got) == 7
    single = graph.communities_of_entities(edges.where("entity_col = 'a'"))
    assert {r.community_id for r in single.collect()} == {-1} and single.count() == 4
