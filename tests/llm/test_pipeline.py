"""The pipeline's stages: whole documents in, decisions in effect, nulls, repeats, other columns, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, quality
from tidemark.llm.queries import vocabulary

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, hits string, tid string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    at = str(tmp_path_factory.mktemp("tables"))
    prose = lambda n: " ".join(rng.choice(["water", "stone", "river", "light", "under", "green", "house", "early"]) + str(rng.randrange(60)) for _ in range(n))
    items = [prose(14) for _ in range(3)]
    texts, labels = [], []
    for i in range(240):
        text = prose(40)
        bad = i % 4 == 0
        texts.append(" ".join(w + "$$$" for w in text.split()) if bad else text)
        labels.append((i, int(not bad), 0))
    near = lambda t: " ".join([*t.split()[:-1], "changed"])
    rows = list(enumerate(texts))
    rows += [(500, texts[1]), (501, near(texts[1])), (502, near(texts[2])), (None, texts[3]), (None, None), (503, ""), (504, None), (1, texts[1]), (505, f"{prose(30)} {items[0]} {prose(9)}"), (506, items[1]), (507, "word " * 20_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "own", "own") for i, t in rows], SCHEMA)
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 0), (7000, 0, 0), (1, None, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([*enumerate(items), (9, None), (None, "")], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, items


def test_stages(spark, folder):
    at, rows, items = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{at}/labels.parquet").where(~quality.held_out()))
    (n1, rate), (n2, near), (n3, clean), (n4, code) = corpus_pipeline.STAGES
    good = rate(spark, docs, at)
    assert good.schema == docs.schema
    scored = quality.scored(docs, model)
    expected = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in scored.where(F.col(scored.columns[-1]) >= 0.7).collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in good.collect()) == expected
    kept = {r.doc_id for r in good.collect()}
    assert not any(i in kept for i in range(0, 240, 4)) and sum(i in kept for i in range(240)) == 180

    single = near(spark, docs, at)
    assert single.schema == docs.schema
    left = single.collect()
    ids = [r.doc_id for r in left]
    assert len({r.text or "" for r in left}) == len(left)  # equal texts, null and empty ones too, are one
    assert 1 in ids and 2 in ids and 3 in ids and not {500, 501, 502} & set(ids) and ids.count(1) == 1
    assert set(range(240)) <= set(ids) and {505, 506, 507} <= set(ids) and 503 in ids and 504 not in ids and None not in ids

    unseen = clean(spark, docs, at)
    assert unseen.schema == docs.schema
    # the items' passages are made of the same few words: count by brute force
    windows = {tuple(i.split()[k : k + 10]) for i in items for k in range(5)}
    dirty = lambda t: any(tuple((t or "").split()[k : k + 10]) in windows for k in range(len((t or "").split())))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in unseen.collect()) == sorted((i is None, i or 0, t or "") for i, t in rows if not dirty(t))
    assert any(dirty(t) for _, t in rows)

    t = bpe.tokenizer(vocabulary())
    coded = code(spark, docs, at).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in coded) == sorted((i is None, i or 0, len(t.encode(x or ""))) for i, x in rows)


def test_run_is_its_stages(spark, folder):
    at, _, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, at).collect(), stage(spark, docs, at).schema)
    out = corpus_pipeline.run(spark, at)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(out.collect(), key=str) == sorted(docs.collect(), key=str)


def test_empty_tables(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    assert corpus_pipeline.run(spark, at).count() == 0
