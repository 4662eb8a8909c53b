"""Operators on documents: brute force on small fixtures, and nulls, empties, repeats, clashing names, empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, ctw, decontaminate, license_scan, neardup, quality
from tidemark.llm.queries import vocabulary

SCHEMA = "doc_id bigint, text string, hits string, ids int, score double, host string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return WORD.findall(lower(t))


def prose(rng, n, vocabulary=40):
    return " ".join(f"Wörd{rng.randrange(vocabulary)}" + rng.choice(["", ",", ".\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    out = [prose(rng, rng.randrange(1, 60)) for _ in range(40)] + [None, "", " \n", "!!!", "a", "é", "x" * 30_000, prose(rng, 6000)]
    return out + out[3:6] + [None]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "h", 1, 0.5, "h") for i, t in enumerate(texts)] + [(0, texts[0], "h", 1, 0.5, "h"), (None, "null id", None, None, None, None)], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("block_bytes", [8 << 20, 100])
def test_decontaminate(spark, docs, empty, texts, block_bytes):
    items = [(0, texts[1]), (1, texts[2]), (2, "a"), (3, None), (4, "..."), (5, texts[1]), (None, texts[4]), (6, prose(random.Random(9), 30, 9999)), (7, "é")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    out = decontaminate.decontaminate(docs, bench, window=4, block_bytes=block_bytes)
    assert out.columns == [*docs.columns, "hits_"] and out.count() == docs.count()
    for r in out.collect():
        w, hit, ids = words(r.text), set(), set()
        for item, t in items:
            iw = words(t)
            for s in range(max(1, len(iw) - 3) if iw else 0):
                p = iw[s : s + 4]
                for a in range(len(w) - len(p) + 1):
                    if w[a : a + len(p)] == p:
                        hit |= set(range(a, a + len(p)))
                        ids.add(item)
        names = sorted(str(i) for i in ids if i is not None)
        assert tuple(r.hits_) == (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert {r.hits_.n_hit for r in decontaminate.decontaminate(docs, bench.limit(0)).collect()} == {0}


def bag(t):
    w = words(t)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def test_near_duplicates(spark, empty):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 200))] for _ in range(30)]
    rows = [" ".join(b) for b in base]
    for b in base[:20]:
        for n in (1, 2, 4):
            c = list(b)
            for _ in range(n):
                c[rng.randrange(len(c))] = f"z{rng.randrange(10**6)}"
            rows.append(" ".join(c))
    rows += [rows[0], rows[0].upper(), None, "", None, "!!!", "!!!", "a b", "A, b", "", "x " * 40, "x " * 50]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(rows)] + [(0, rows[0], "c")], "doc_id bigint, text string, class_id string")
    bags = [bag(t) for t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            either = sum((bags[i] | bags[j]).values())
            if (rows[i] or "") == (rows[j] or "") or (either and sum((bags[i] & bags[j]).values()) / either >= 0.8):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows) + 1
    assert {r.doc_id: r.class_id for r in got} == {i: find(i) for i in range(len(rows))}
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in range(len(rows))})
    assert neardup.near_duplicates(empty).count() == 0 and neardup.drop_near_duplicates(empty).count() == 0


def test_classes_that_share_an_id(spark):
    rng = random.Random(11)
    text = lambda: [f"w{rng.randrange(5000)}" for _ in range(60)]
    a, b, c, d, e = (text() for _ in range(5))
    near = " ".join([*d[:-1], "other"])
    rows = [(None, " ".join(a)), (None, " ".join(b)), (7, " ".join(c)), (7, " ".join(d)), (9, near), (None, near), (None, " ".join(a)), (3, " ".join(e)), (3, " ".join(e))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for part in (docs, docs.where("doc_id is null or doc_id <> 9").where(F.col("text") != near)):  # with links and without any
        kept = neardup.drop_near_duplicates(part).collect()
        assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, " ".join(a)), (0, " ".join(b)), (7, " ".join(c)), (7, " ".join(d)), (3, " ".join(e))])
        got = neardup.near_duplicates(part).collect()
        assert len({r.component for r in got}) == 5 and len({r.component for r in got if r.keep}) == 5


def test_bpe_against_the_library(docs, empty, texts):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(vocabulary())
    extra = ["<|endoftext|> A<|startoftext|>b<|x", "Σίσυφος ΑΣ İ é́ a\x85c\xa0d", "it's WE'RE 'S 12 ½ 日本語", "the" * 3000, "!?" * 900]
    ours = bpe.tokenizer(vocabulary())
    for t in [x or "" for x in texts] + extra:
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert ours.encode(t) == ids
        assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)
    assert ours.decode([-1, *ours.encode("a b"), 10**6]) == "a</w> b</w>"
    state = bpe.Bytes(ours)
    pieces = [state.feed([i]) for i in ours.encode("naïve 日本 text")]
    assert "".join(pieces) + state.end() == "naïve 日本 text "
    n = {r.doc_id: r.n_tokens for r in bpe.code_digests(docs, vocabulary()).collect()}
    assert n[texts.index(None)] == 0 and n[texts.index("a")] == 1
    coded = bpe.encode_texts(docs, vocabulary())
    assert coded.columns[-1] == "ids_" and coded.count() == docs.count()
    assert bpe.code_digests(empty, vocabulary()).count() == 0


def test_small_windows_agree(texts):
    t = bpe.Tokenizer(vocabulary())
    rng = random.Random(1)
    for _ in range(5):
        word = "".join(rng.choice("thereinaos") for _ in range(3000))
        symbols = [*word[:-1], word[-1] + t.end]
        whole = t.transducer._merge(list(symbols))
        t.transducer.window = t.transducer.lookahead + rng.randrange(1, 300)
        assert list(t.transducer.tokens(symbols)) == whole


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_on_all_characters(name, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    theirs, ours = Tokenizer.from_file(path), bpe.Tokenizer(path)
    theirs.encode_special_tokens = False
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(7)
    texts = ["".join(every[i : i + 50]) for i in range(0, 0x34000, 50)] + ["q" + "q 1".join(every[i : i + 30]) for i in range(0, 0x1F000, 30)]
    texts += ["".join(rng.choice(every[: rng.choice([200, 3000, 0x20000])]) for _ in range(rng.randrange(60))) for _ in range(1500)]
    monkeypatch.setattr(bpe, "PIECE", 20)  # many pieces
    for t, theirs_ids in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = ours.encode(t)
        assert ids == theirs_ids.ids, [hex(ord(c)) for c in t]
        assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_merging_with_a_heap_agrees():
    t = bpe.Tokenizer(vocabulary()).transducer
    rng = random.Random(3)
    for _ in range(60):
        symbols = [rng.choice("theraonsi!?.") for _ in range(rng.randrange(2, 33))]
        assert t._merge_many(list(symbols)) == t._merge(list(symbols))


def test_language_model(spark, docs, empty, texts):
    got = ctw.language_scores(docs).collect()
    assert len(got) == docs.count()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    counts = collections.Counter()
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for i, t in rows:
        if not held(i):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = sorted((i is None, i or 0, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for i, t in rows for w in [tokens(t)])
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert all(r.score < 0 for r in got)
    size = {i: len("".join(x + " " for x in tokens(t)[:-1]).encode()) + 1 for i, t in rows}
    assert all(r.n_bytes == size[r.doc_id] and r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / r.n_bytes) for r in got)
    assert ctw.language_scores(empty).count() == 0


def test_language_model_with_clashing_names(spark):
    rows = [(i, f"some words {i % 5}") for i in range(40)]
    plain = spark.createDataFrame(rows, "doc_id bigint, text string")
    wide = plain.withColumns({c: F.lit(1) for c in ("id", "row", "score", "n", "key", "held_out", "h", "bytes")})
    assert sorted(ctw.language_scores(plain).collect()) == sorted(ctw.language_scores(wide).collect())


def test_language_model_is_a_distribution(spark):
    import numpy as np

    docs = spark.createDataFrame([("the cat sat on the mat, the cat ran. " * 20,), ("a dog and a cat",)], "text string")
    model = ctw.fit(docs)
    for context in (b"e cat", b"zzzzz", b"\n\n\n\n\n", b" the "):
        past = sum(c << (8 * (k + 1)) for k, c in enumerate(context[::-1]))
        total = (10.0 ** model.log10(np.array([past | b for b in range(256)], dtype=np.uint64)).astype(float)).sum()
        assert total == pytest.approx(1, abs=1e-4)


def test_language_model_keeps_rare_contexts(spark):
    import numpy as np

    docs = spark.createDataFrame([("the cat sat on the mat " * 60_000,), ("qzxjv",)], "text string")
    past = sum(c << (8 * (k + 1)) for k, c in enumerate(b"\nqzxj"[::-1]))
    assert ctw.fit(docs).log10(np.array([past | ord("v")], dtype=np.uint64))[0] > math.log10(0.05)


def test_language_model_against_a_plain_one(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["tea", "teas", "eat", "é", "sea"]) for _ in range(12))) for i in range(40)] + [(50, "unseen words"), (50, "unseen words"), (51, None)]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    assert any(held(i) for i, _ in rows)

    def steps(text):
        data = "".join(w + " " for w in (text or "").split()).encode() + b"\n"
        for at, byte in enumerate(data):
            context = (b"\n" * ctw.DEPTH + data[:at])[-ctw.DEPTH :]
            for b in range(8):
                yield [(context[len(context) - d :], (1 << b) | (byte >> (8 - b))) for d in range(ctw.DEPTH + 1)], (byte >> (7 - b)) & 1

    count = collections.defaultdict(lambda: [0, 0])
    for i, t in rows:
        for path, bit in steps(t) if not held(i) else ():
            for node in path:
                count[node][bit] += 1
    own = lambda z, o: math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)
    total, below = {}, collections.defaultdict(float)
    for node in sorted(count, key=lambda x: -len(x[0])):
        e = own(*count[node])
        a, b = max(e, below[node]), min(e, below[node])
        total[node] = e if len(node[0]) == ctw.DEPTH else a + math.log1p(math.exp(b - a)) - math.log(2)
        if node[0]:
            below[node[0][1:], node[1]] += total[node]

    def chance(path, bit):
        mixed = None
        for node in path[::-1]:
            if node in count:
                p = (count[node][bit] + 0.5) / (sum(count[node]) + 1)
                stop = math.exp(own(*count[node]) - math.log(2) - total[node])
                mixed = p if mixed is None else stop * p + (1 - stop) * mixed
        return 0.5 if mixed is None else mixed

    expected = sorted((i, round(sum(math.log10(chance(*s)) for s in steps(t)), 3)) for i, t in rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for frequent in (ctw.FREQUENT, 60, 0):  # all broadcast, some joined, all joined
        monkeypatch.setattr(ctw, "FREQUENT", frequent)
        got = sorted((r.doc_id, r.score) for r in ctw.language_scores(docs).collect())
        assert [i for i, _ in got] == [i for i, _ in expected]
        assert all(a[1] == pytest.approx(b[1], abs=2e-3) for a, b in zip(got, expected, strict=True))


def test_quality(spark, empty):
    rng = random.Random(6)
    bad = lambda: " ".join(w + "%%%" for w in prose(rng, 50).split())
    rows = [(i, bad() if i % 3 == 0 else prose(rng, 50)) for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "x" * 50_000), (902, "x" * 50_000)], "doc_id bigint, text string").withColumn("score", F.lit("own"))
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i, _ in rows] + [(900, None, 0)], "doc_id bigint, quality int, toxic int")
    out = quality.scored(docs, quality.fit(docs, labels.where(~quality.held_out())))
    assert out.columns == ["doc_id", "text", "score", "score_"] and out.count() == 304
    test = [r for r in out.collect() if r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum((r.score_ >= 0.7) == (r.doc_id % 3 != 0) for r in test) / len(test) > 0.95
    assert all(0 <= r.score_ <= 1 for r in out.collect())
    nothing = quality.fit(docs, labels.limit(0))
    assert {round(r.score_, 6) for r in quality.scored(docs, nothing).collect()} == {0.5}
    assert quality.scored(empty, nothing).count() == 0


def test_quality_features(texts):
    import numpy as np

    some = [t or "" for t in texts if len(t or "") < 3000]
    model = quality.Model(np.random.default_rng(1).normal(size=1 << quality.BITS), 0.25)

    def arrays(ts):
        raw = [t.encode() for t in ts]
        return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])

    kinds = [np.bincount(of, minlength=len(some)) for _, of in quality.features(*arrays(some))]
    for i, t in enumerate(some):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t))
        assert [k[i] for k in kinds] == [n, max(0, n - 1), max(0, len(t) - 2), max(0, len(t) - 3)]
    together = model.score(*arrays(some))
    assert together == pytest.approx([model.score(*arrays([t]))[0] for t in some])
    # the same words and characters score alike, others do not
    assert model.score(*arrays(["naïve é x"]))[0] == model.score(*arrays(["naïve é x"]))[0] != model.score(*arrays(["naïve è x"]))[0]


def test_license_scan(spark, docs, empty):
    assert license_scan.scan(empty).count() == 0
    own = spark.createDataFrame([
        (1, "x Licensed under CC BY-NC 4.0. cc by"), (2, "All rights reserved; all rights RESERVED."), (3, None), (4, "rights reserved all"),
        (5, "Released under the fine MIT License."), (6, "GNU General Public License, version 3"), (2, "All rights reserved; all rights RESERVED."),
    ], "doc_id bigint, text string")
    got = {r.doc_id: r for r in license_scan.scan(own).collect()}
    assert license_scan.scan(own).count() == 7 and license_scan.scan(docs).count() == docs.count()
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].labels) == (2, 3, 8, "cc-by", "cc-by,notice:cc-by-nc")
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].labels) == (2, 0, 3, "reserved")
    assert (got[3].n_words, got[3].n_base, got[3].first_word, got[3].labels, got[3].score) == (0, 0, None, "", 0.0)
    assert got[4].n_base == 0 and got[5].labels == "notice:mit" and got[6].base_labels == "gpl"


def test_license_texts(spark):
    from tidemark.llm.license_texts import BODIES

    rng = random.Random(12)
    filler = lambda n: " ".join(f"w{rng.randrange(50)}" for _ in range(n))
    rows, expected = [], []
    for label, body in BODIES:
        w = words(body)
        changed = [x for x in w for x in ([x, "inserted"] if rng.random() < 0.02 else [x])]
        # whole, with words put in, cut in half, all sentences there but out of order
        blocks = [w[i : i + 6] for i in range(0, len(w), 6)]
        rng.shuffle(blocks)
        for text, found in ((body, True), (" ".join(changed), True), (" ".join(w[: len(w) // 2]), False), (" ".join(x for b in blocks for x in b), False)):
            rows.append((len(rows), f"{filler(30)} {text} {filler(300)}"))
            expected.append((label, found))
    rows += [(i, t) for i, t in rows[:2]] + [(None, rows[0][1]), (None, rows[0][1])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, labels string, n int")
    got = license_scan.scan(docs).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None and "text:mit" in r.labels for r in got) == 2
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, (label, found) in enumerate(expected):
        assert (label in by[i].labels.split(",")) == found, (label, i, by[i])
    own = license_scan.scan(docs, templates=(("base", 2, (("mine", "w1 w2"),)), ("notice", 4, (("other", "w3 w4 w5 w6 w7"),))))
    for r in own.collect():
        w = words(dict(rows)[r.doc_id])
        at = [i for i in range(len(w) - 1) if w[i : i + 2] == ["w1", "w2"]]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
    with pytest.raises(ValueError):
        license_scan.template_rows((("notice", 4, (("short", "a b"),)),))


def test_links_beside_a_crowd_of_strangers(spark):
    # all texts are near 0.75 of each other, so a bucket's head is a stranger to nearly all; each has one partner above 0.8
    rng, rows = random.Random(11), []
    base = [f"w{i}" for i in range(400)]
    for p in range(60):
        own = list(base)
        for j in rng.sample(range(0, 80), 2):
            own[5 * j] = f"x{p}a{j}"
        for side in range(2):
            text = list(own)
            for j in rng.sample(range(0, 80), 4):
                text[5 * j + 2] = f"y{p}b{side}c{j}"
            rows.append((2 * p + side, " ".join(text)))
    grams = [{tuple(t.split()[i : i + 5]) for i in range(396)} for _, t in rows]
    links = [(a, b) for b in range(len(rows)) for a in range(b) if len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.8]
    up = list(range(len(rows)))
    for _ in rows:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(set(up)) > 30 and len(links) >= 50 and got == dict(enumerate(up))


@pytest.mark.parametrize("span", [1 << 21, 900])
def test_a_crowd_in_one_bucket_gives_no_more_links_than_texts(spark, monkeypatch, span):
    # stretches of a line of shingles: neighbours are near, others are not, and all are in one bucket
    monkeypatch.setattr(neardup, "SPAN", span)
    spelt = [(k, list(range(4 * k, 4 * k + 40))) for k in range(60) if k % 20]
    members = spark.createDataFrame([(5, k, k) for k, _ in spelt] + [(6, k, k // 30) for k, _ in spelt if k < 30] + [(7, 1, 0), (7, 2, 1)], "h bigint, k bigint, c bigint")
    mixed = neardup._mixed(members)
    assert {r.h for r in mixed.select("h").distinct().collect()} == {5, 7} and mixed.where("minor and h = 5").count() == len(spelt) - 1
    got = [(r.dst, r.src) for r in neardup._crossing(mixed.where("h = 5"), spark.createDataFrame(spelt, "k bigint, shingles array<bigint>"), 0.8).collect()]
    assert set(got) == {(a, a + 1) for a, _ in spelt if (a + 1) % 20 and a + 1 < 60}
    assert span == 900 or len(got) < len(spelt)
    wide = spark.createDataFrame([(k, [*range(40), k + 100]) for k, _ in spelt], "k bigint, shingles array<bigint>")
    joined = neardup._crossing(mixed.where("h = 5"), wide, 0.8).count()
    assert joined == len(spelt) - 1 if span > 900 else joined < len(spelt) ** 2 / 4
