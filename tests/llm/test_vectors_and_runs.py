"""Whitening and periodic runs against plain versions, over their tables and over odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import periodic, queries, whitening

SF = "/root/testdata/sf0.001"


# periodic runs


def plain_runs(w, shortest=6, repeats=4):
    """By trying every period at every place."""
    found, n = set(), len(w)
    for p in range(1, n // repeats + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            whole = w[i : j + p]
            if j > i and len(whole) >= max(shortest, repeats * p) and not any(whole[q:] == whole[:-q] for q in range(1, p)):
                found.add((i, len(whole), p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapse(w, runs):
    gone = {k for s, length, p in runs for k in range(s + p, s + length)}
    return [x for k, x in enumerate(w) if k not in gone]


@pytest.mark.parametrize(("shortest", "repeats"), [(6, 4), (2, 2), (4, 3)])
def test_runs_of_random_words(shortest, repeats):
    rng, some = random.Random(shortest), 0
    for _ in range(1500):
        n, letters = rng.randrange(60), rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(letters) for _ in range(n)]
        if rng.random() < 0.5:
            root = [rng.randrange(letters) for _ in range(rng.randrange(1, 6))]
            w[n // 2 : n // 2] = root * rng.randrange(2, 9) + root[: rng.randrange(len(root))]
        runs = periodic.word_runs(w, shortest, repeats)
        assert runs == plain_runs(w, shortest, repeats)
        assert periodic.collapse(w, runs) == plain_collapse(w, runs)
        some += len(runs)
    assert some > 300


def test_long_extensions_and_few_hashes(monkeypatch):
    monkeypatch.setattr(periodic, "DIRECT", 1)
    root = list(range(40))
    w = ["x", *root * 30, *root[:17], "y", *["z"] * 500, *root * 3]
    assert periodic.word_runs(w) == [(1, 1217, 40), (1219, 500, 1)]
    # with base 1 all orders of the same words have one hash: what is found is held against the words, then another base is taken
    rng, again, real = random.Random(4), [], random.randrange
    monkeypatch.setattr(periodic.random, "randrange", lambda *a: again.append(1) or real(*a))
    for _ in range(300):
        w = [rng.randrange(2) for _ in range(40)]
        assert set(periodic.word_runs(w, 6, 2, base=1)) <= set(plain_runs(w, 6, 2))
    assert again
    with pytest.raises(ValueError, match="two periods"):
        periodic.word_runs(["a"], repeats=1)


def test_fibonacci_words_have_no_long_run():
    a, b = ["a"], ["a", "b"]
    while len(b) < 5000:
        a, b = b, b + a
    assert periodic.word_runs(b) == []  # their highest power is below 3.62
    assert periodic.word_runs(b[:300], 6, 3) == plain_runs(b[:300], 6, 3) != []


def test_find_runs(spark):
    rows = [(1, "a b " * 9, "own", 1), (2, None, "own", 2), (3, "", None, 3), (None, " \t x x x x\n" * 2, "own", 4), (1, "a b " * 9, "own", 5), (5, "w " * 300_000 + "end", "own", 6), (6, "あ " * 6 + "b", "own", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, Periodic string, k int")
    out = periodic.find_runs(df)
    assert out.columns == [*df.columns, "periodic_"]
    got = {r.k: r.periodic_ for r in out.collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 18, 2)] and got[1].collapsed == "a b" and got[1] == got[5]
    assert got[2] == got[3] and got[2].n_words == 0 and got[2].runs == [] and got[2].collapsed == ""
    assert got[4].n_words == 4 and got[4].runs == [] and got[4].collapsed == "x x x x x x x x"
    assert [tuple(r) for r in got[6].runs] == [(0, 300_000, 1)] and got[6].collapsed == "w end"
    assert got[7].collapsed == "あ b"
    assert periodic.find_runs(df.limit(0)).count() == 0
    told = {r.k: r for r in out.select("k", *periodic.digests(F.col("periodic_"))).collect()}
    assert told[2][1:5] == (0, None, None, None) and told[2].runs_sha256 == told[2].collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    assert told[1][1:6] == (1, 0, 18, 2, 9000)


def test_periodic_query(spark):
    """Every document of the table against the plain version."""
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    docs, planted, some = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect(), 0, 0
    assert len(got) == len(docs)
    for doc in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", doc.text or "")
        h = zlib.crc32(str(doc.doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, planted = [w[i if i < a else a + (i - a) % p] for i in range(n)], planted + 1
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        expected = (len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(plain_collapse(w, runs))))
        r = got[doc.doc_id]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == expected
        some += len(runs)
    assert planted > 5 and some > 5


# whitening


def plain_whitening(vectors, k=8):
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[a - s / n for a, s in zip(row, sums, strict=True)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return deviations, centred @ axes[:, ::-1][:, :k] / np.sqrt(values[::-1][:k]), values[::-1][:k] / values.sum()


def test_whitening_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    deviations, white, explained = plain_whitening([r.embedding for r in rows])
    out = queries.op11_whitening(spark, SF)
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    got = out.orderBy("vec_id", "component").collect()
    assert len(got) == 8 * len(rows) and {r.n for r in got} == {len(rows)} and max(r.identity_error for r in got) < 1e-9
    assert [r.deviation for r in got[::8]] == deviations
    assert np.allclose([r.explained for r in got[:8]], explained, rtol=1e-10)
    found = np.array([r.whitened for r in got]).reshape(-1, 8)
    assert np.allclose(found * np.sign((found * white).sum(0)), white, atol=1e-9)


def test_merged_moments_are_those_of_all_rows():
    rng = np.random.default_rng(3)
    x = rng.integers(-(10**6), 10**6, (5000, 5)) + 10**8
    state = None
    for part in np.array_split(x, [1, 2, 900, 901, 4000]):
        state = whitening.merge(state, whitening.moments(part))
    n, sums, mean, scatter = state
    assert n == 5000 and sums == [int(s) for s in x.sum(0)] and np.allclose(mean, x.mean(0), rtol=1e-14)
    assert np.allclose(scatter, np.cov(x.T, bias=True) * n, rtol=1e-11)
    far = np.full((3, 1), 1 << 61)
    assert whitening.moments(far)[1] == [3 << 61]


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = (rng.normal(size=(40, 3)) * [3, 1, 0.2]).tolist()
    bad = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [1.0, float("inf"), 0.0], [1e300, 0.0, 0.0], [1.0, 2.0]]
    rows = [(k % 7 if k % 5 else None, v, "a", "b") for k, v in enumerate([*good, good[0], *bad])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, Whitened string, n string")
    model = whitening.fit(df)
    out = whitening.transform(df, model)
    assert out.columns == [*df.columns, "whitened_"] and out.count() == 41 and model.n == 41 and len(model.components) == 3
    deviations, white, explained = plain_whitening([*good, good[0]])
    got = out.select("whitened_.*").collect()
    assert sorted(int(r.deviation) for r in got) == sorted(deviations) and np.allclose(model.explained, explained)
    assert np.allclose(sorted(abs(r["values"][0]) for r in got), sorted(np.abs(white[:, 0])))
    flat = whitening.fit(df.where("get(embedding, 0) = 1e300 or size(embedding) = 2"))  # lengths: one of 2, none of 3 that is within bounds
    assert flat.n == 1 and flat.d == 2 and flat.identity_error is None and flat.explained.tolist() == [0, 0]
    one = whitening.transform(df, flat).select("whitened_.*").collect()
    assert [(int(r.deviation), r["values"]) for r in one] == [(0, [None, None])]
    none = whitening.fit(df.limit(0))
    assert none.n == 0 and whitening.transform(df, none).count() == 0
    assert whitening.transform(df, none).select(F.explode(whitening.by_component(none, F.col("whitened_")))).count() == 0


def test_large_deviations_are_exact():
    model = whitening.Whitening(10**9, 2, [3 * 10**14, 5], np.eye(2), np.ones(2), np.ones(2) / 2)
    assert model.deviation(np.array([[7, 1 << 61], [300_000, 0]])) == [(7 * 10**9 - 3 * 10**14) ** 2 + ((1 << 61) * 10**9 - 5) ** 2, 25]


def test_planted_texts(spark):
    """Texts without words stay as they are; null ids are not chosen."""
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0][:5]
    texts = ["", None, " \t ", "a", "a b c d e f g h i j k l m n o p"]
    df = spark.createDataFrame([*zip(ids, texts, strict=True), (None, "x y")], "doc_id bigint, text string")
    got = {r.doc_id: r.t for r in df.select("doc_id", queries.planted(F.col("text"), F.col("doc_id")).alias("t")).collect()}
    g = zlib.crc32(str(ids[4]).encode()) // 10
    a, w = g % 16, texts[4].split()
    p = 1 + (16 - a) // (3 + g % 8)
    assert [got[i] for i in ids[:4]] == texts[:4] and got[None] == "x y"
    assert got[ids[4]] == " ".join(w[i if i < a else a + (i - a) % p] for i in range(16))
