r"""Near copies by DartMinHash signatures and banded joining.

A text is the multiset of its shingles: five consecutive words (lower-cased A-Z, ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``); a
text of fewer words, but not none, has one shingle of them all. The weight of a shingle is how often it stands there, and
similarity is weighted Jaccard: the sum of smaller weights over the sum of larger ones.

DartMinHash: every shingle owns a strip of the plane weight x rank that is cut into dyadic regions; hashed darts fall
into a region as a Poisson process of rate one, the same for each text with that shingle. A text sees the darts under its
weights with ranks below ``t / total weight``, about ``t = k ln k + 2k`` in all however long it is; each dart hits one of k
coordinates, and the earliest of each coordinate is the signature. If a coordinate stays empty, t doubles for that text.
Two texts agree in a coordinate with the probability of their weighted Jaccard.

``bands`` x ``rows`` coordinates are joined band by band. First each member of a bucket meets one of them (the first or the last, by the
bucket's hash), which makes one class of a large group of copies without its pairs; these pairs are judged by the whole signature if that is decisive
(``SURE``, ``UNLIKE``), else exactly on the shingles. Then, in each bucket whose members are not of one class, all pairs of different classes are compared exactly, within
tasks that hold the shingles, so no pair that shares a bucket and could change a class is left out and no pair is a row: a group gives only links that join
two of its classes, fewer than it has texts. Links make classes as connected components.

At similarity s the chance to share a bucket is 1 - (1 - s^rows)^bands: 0.9999 at 0.8 with 24 bands of 5.

Defined results: null is the empty text; equal texts are one class always, also those without words; other texts without
words are classes of their own; repeated rows each get their row. Texts are taken whole at any length; equal texts are joined
to one before anything else, after a signature that each row gets without a shuffle. Different texts are told apart by
64 bits of their MD5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.session import durable, fresh, release
from tidemark.llm.bytesops import LOWER, U64, WORD, mix, runs, slices, span_hashes, utf8
from tidemark.operators.components import connected_components

SHINGLE = 5
BANDS, ROWS = 24, 5
#: Ranks below 1/8, then [1/8, 1/4), [1/4, 1/2) and so on; weights [0, 1), [1, 2), [2, 4), [4, 8) and so on.
_RANK0 = 0.125
FILTER_BITS = 27
#: Texts signed together: each has about 900 darts.
STEP = 512
#: At 0.8 an estimate from 120 coordinates has a deviation of 0.037: these are 4 above and 5 below.
SURE, UNLIKE = 0.95, 0.61
#: Shingles of a bucket's texts that one group holds of each side (8 bytes each).
SPAN = 1 << 21


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle hash) in order, and how often each occurs. Hashes have 44 bits."""
    n = len(offsets) - 1
    low = LOWER[data]
    starts, ends = runs(WORD[low], offsets)
    words = span_hashes(low, starts, ends)
    first = np.searchsorted(starts, offsets)
    count = np.diff(first)
    size = np.minimum(count, SHINGLE)
    grams = np.maximum(count - SHINGLE + 1, (count > 0).astype(np.int64))
    text = np.repeat(np.arange(n), grams)
    at = np.repeat(first[:-1], grams) + np.arange(len(text)) - np.repeat(np.cumsum(grams) - grams, grams)
    width = size[text]
    h = np.full(len(text), 17, U64)
    for k in range(SHINGLE):
        more = width > k
        h[more] = mix(h[more] + words[at[more] + k] * U64(2 * k + 3))
    if n >= 1 << 20:
        raise ValueError("too many texts at once")
    key = np.sort((text.astype(U64) << U64(44)) | (h >> U64(20)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(new)
    weight = np.diff(np.append(begin, len(key)))
    key = key[begin]
    return (key >> U64(44)).astype(np.int64), key & U64((1 << 44) - 1), weight


def _poisson(area: float) -> np.ndarray:
    p, total, out, k = np.exp(-area), 0.0, [], 0
    while total < 1 - 1e-15 and k < area + 20 * np.sqrt(area) + 40:
        total += p
        out.append(total)
        k += 1
        p *= area / k
    return np.array(out)


def _cells(limit: float, first: float):
    """Dyadic regions [0, first), [first, 2 first), ... up to ``limit``."""
    low, high, k = 0.0, first, 0
    while low < limit:
        yield k, low, high
        low, high, k = high, high * 2, k + 1


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """An n x k array of dart hashes; rows of texts without elements are 0."""
    out = np.zeros((n, k), U64)
    if len(text) == 0:
        return out
    total = np.bincount(text, weights=weight, minlength=n)
    t = k * np.log(k) + 2 * k
    todo = total > 0
    while todo.any():
        _throw(out, text, element, weight, np.where(todo, t / np.maximum(total, 1), 0.0), k)
        todo &= (out == 0).any(axis=1)
        t *= 2
    return out


def _throw(out, text, element, weight, threshold, k):
    use = threshold[text] > 0
    text, element, weight = text[use], element[use], weight[use]
    ranks, hashes, places = [], [], []
    for layer, w_low, w_high in _cells(float(weight.max()), 1.0):
        heavy = np.flatnonzero(weight > w_low) if layer else np.arange(len(text))
        limit = threshold[text[heavy]]
        for cell, r_low, r_high in _cells(float(limit.max()), _RANK0):
            inside = heavy[limit > r_low]
            seed = mix(element[inside] ^ U64((layer << 52) | (cell << 44)))
            cdf = _poisson((w_high - w_low) * (r_high - r_low))
            u = (seed >> U64(11)).astype(np.float64) * 2.0**-53
            darts = np.searchsorted(cdf, u, side="right")
            hit = np.flatnonzero(darts)
            of = np.repeat(hit, darts[hit])
            number = np.arange(len(of)) - np.repeat(np.cumsum(darts[hit]) - darts[hit], darts[hit])
            h = mix(seed[of] + U64(0x632BE59BD9B4E019) * (number.astype(U64) + U64(1)))
            own = inside[of]
            rank = r_low + (r_high - r_low) * ((mix(h) >> U64(11)).astype(np.float64) * 2.0**-53)
            good = rank < threshold[text[own]]
            if layer > 1:
                at = w_low + (w_high - w_low) * ((mix(h ^ U64(0xABCDEF)) >> U64(11)).astype(np.float64) * 2.0**-53)
                good &= at < weight[own]
            h, own = h[good], own[good]
            ranks.append(rank[good])
            hashes.append(h | U64(1))
            places.append(text[own] * k + (h >> U64(33)).astype(np.int64) % k)
    rank, h, place = np.concatenate(ranks), np.concatenate(hashes), np.concatenate(places)
    order = np.argsort(-rank, kind="stable")  # the earliest is written last
    out.ravel()[place[order]] = h[order]


def bands_of(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.zeros((len(sig), bands), U64) + mix(np.arange(bands))  # so that bands never share a bucket
    part = sig.reshape(len(sig), bands, rows)
    for r in range(rows):
        h = mix(h + part[:, :, r] * U64(2 * r + 3))
    return h.astype(np.int64)


def _sign(bands: int, rows: int):
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            parts, short, empty = [], [], []
            for i, j in slices(offsets, 1 << 20):
                for a in range(i, j, STEP):
                    b = min(j, a + STEP)
                    text, element, weight = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    sig = signatures(text, element, weight, b - a, bands * rows)
                    parts.append(bands_of(sig, bands, rows))
                    short.append((sig >> U64(40)).astype(np.uint8).view(np.int8))
                    empty.append(np.bincount(text, minlength=b - a) == 0)
            flat = np.concatenate(parts).ravel() if parts else np.zeros(0, np.int64)
            gone = np.concatenate(empty) if empty else np.zeros(0, bool)
            at = np.concatenate([[0], np.cumsum(np.where(gone, 0, bands))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(flat.reshape(-1, bands)[~gone].ravel()))
            k = bands * rows
            marks = np.concatenate(short) if short else np.zeros((0, k), np.int8)
            sketch = pa.ListArray.from_arrays(pa.array(at // bands * k), pa.array(marks[~gone].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, sketch], names=["tid", "bands", "sketch"])

    return run


def _spell(shared):
    """Shingles as distinct hashes; the second of the same shingle counts as another one, and so on."""

    def run(batches):
        bits = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            place = batch.column(1).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1))
            data, offsets = utf8(batch.column(2))
            lists = []
            for i, j in slices(offsets, 1 << 20):
                for a in range(i, j, STEP):
                    b = min(j, a + STEP)
                    text, element, weight = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
                    each = np.repeat(element, weight)
                    values = np.where(nth == 0, each, mix(each * U64(3) + mix(nth))).astype(np.int64)
                    at = np.concatenate([[0], np.cumsum(np.bincount(text, weights=weight, minlength=b - a))]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(at), pa.array(values)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int64()))], names=["k", "shingles"])

    return run


def text_key(text) -> F.Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(tid, copies, rep_id, component, class_id, first_tid, n_links, class_texts)`` for each different text: tid is the MD5
    of it, rep_id the smallest id of its rows, component the key of its class, class_id the smallest rep_id of its class,
    first_tid the text that stands for its class, n_links its verified links. Classes can share a class_id (null ids, one id
    on several texts), never a component."""
    texts = docs.select(text_key(F.col(text_col)).alias("tid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = texts.select(F.struct("tid", "id").alias("tid"), "text").mapInArrow(_sign(bands, rows), "tid struct<tid: binary, id: bigint>, bands array<bigint>, sketch array<tinyint>")
    unique = signed.groupBy("tid.tid").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.min("tid.id").alias("rep_id"), F.count("*").alias("copies"))
    unique = durable(unique.withColumn("k", F.xxhash64("tid")))

    # a bucket is the 64-bit hash h of its band and coordinates; its head is the first by key or, if h is odd, the last
    live = unique.select(F.explode("bands").alias("h"), "k")
    ends = live.groupBy("h").agg(F.min("k").alias("low"), F.max("k").alias("high")).where("low <> high")
    heads = ends.select("h", F.when(F.col("h") % 2 == 0, F.col("low")).otherwise(F.col("high")).alias("head"))
    met = durable(live.join(heads, "h"))  # heads too; only texts that share a bucket are needed from here on
    known = durable(unique.select("k", "sketch").join(met.select("k").distinct(), "k", "left_semi"))
    release(docs.sparkSession)
    judged = durable(_estimated(met.where("k <> head").select("k", "head").distinct(), known))
    good = durable(_linked(judged, threshold, docs, unique, id_col, text_col))
    release(docs.sparkSession)
    if not judged.isEmpty():
        # a bucket whose members are not all of one class by now has links left to find: there all pairs of different classes are compared
        of = met.select("h", "k").join(connected_components(good).select(F.col("node").alias("k"), "component"), "k", "left").select("h", "k", F.coalesce("component", "k").alias("c"))
        members = durable(_mixed(of))
        if not members.isEmpty():
            spelt = _spelt(members.select("k"), docs, unique, id_col, text_col)
            good = durable(good.union(_crossing(members, spelt, threshold)).distinct())
        release(docs.sparkSession)
    parts = connected_components(good).select(F.col("node").alias("k"), "component")
    counts = good.select(F.explode(F.array("src", "dst")).alias("k")).groupBy("k").agg(F.count("*").alias("n_links"))
    whole = unique.drop("bands", "sketch").join(parts, "k", "left").join(counts, "k", "left").withColumn("component", F.coalesce("component", "k"))
    order = F.min(F.struct(F.col("rep_id").isNull(), "rep_id", "tid"))
    tops = whole.groupBy("component").agg(order.alias("top"), F.count("*").alias("class_texts"))
    return whole.join(tops, "component").select("tid", "copies", "rep_id", "component", F.col("top.rep_id").alias("class_id"), F.col("top.tid").alias("first_tid"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "class_texts")


def _estimated(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs with the share of coordinates whose sketches, 8 bits each, agree."""
    a = known.select("k", F.col("sketch").alias("a"))
    b = known.select(F.col("k").alias("head"), F.col("sketch").alias("b"))
    same = F.size(F.filter(F.zip_with("a", "b", lambda x, y: x == y), lambda x: x))
    return pairs.join(a, "k").join(b, "head").select("k", "head", (same / F.size("a")).alias("about"))


def _linked(judged: DataFrame, threshold: float, docs: DataFrame, unique: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(dst, src) of the pairs that meet the threshold: by the whole signature where it is decisive, all others by their shingles."""
    sure = judged.where(F.col("about") >= SURE).select("k", "head", F.col("about").alias("sim"))
    open_ = durable(judged.where((F.col("about") < SURE) & (F.col("about") >= UNLIKE)).select("k", "head"))
    links = sure if open_.isEmpty() else sure.union(_similar(open_, _spelt(open_.select(F.explode(F.array("k", "head")).alias("k")), docs, unique, id_col, text_col)))
    return links.where(F.col("sim") >= threshold).select(F.least("k", "head").alias("dst"), F.greatest("k", "head").alias("src")).distinct()


def _mixed(of: DataFrame) -> DataFrame:
    """The rows (h, k, c) of buckets h whose texts are of more than one class c; ``minor`` tells those that are not of the bucket's largest one."""
    sizes = of.groupBy("h", "c").agg(F.count("*").alias("n"))
    tops = sizes.groupBy("h").agg(F.max(F.struct("n", "c")).alias("top"), F.count("*").alias("classes")).where("classes > 1")
    return of.join(tops, "h").select("h", "k", "c", (F.col("c") != F.col("top.c")).alias("minor"))


def _crossing(members: DataFrame, spelt: DataFrame, threshold: float) -> DataFrame:
    """(dst, src): links between the classes of each bucket, enough to join all that are linked there. Of two texts of different classes one is not of the largest,
    so all texts of a bucket meet those. Both sides are dealt into blocks of about SPAN shingles, and each block of one with each block of the other is a group."""
    sized = members.join(spelt.select("k", F.size("shingles").cast("bigint").alias("size")), "k")
    blocks = sized.groupBy("h").agg(F.ceil(F.sum("size") / SPAN).alias("all"), F.ceil(F.sum(F.when(F.col("minor"), F.col("size"))) / SPAN).alias("few"))
    placed = members.join(blocks, "h").select("h", "k", "c", "minor", "all", "few", F.pmod(F.xxhash64("k"), F.col("all")).alias("i"), F.pmod(F.xxhash64("k", F.lit(1)), F.col("few")).alias("j"))
    here = placed.select("h", "i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("few") - 1)).alias("j"), F.lit(False).alias("second"), "k", "c")
    there = placed.where("minor").select("h", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("all") - 1)).alias("i"), "j", F.lit(True).alias("second"), "k", "c")
    dealt = here.union(there).join(spelt, "k").repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "second", "k")
    return dealt.select("h", "i", "j", "second", "k", "c", "shingles").mapInArrow(_compare(threshold), "dst bigint, src bigint")


def _compare(threshold: float):
    def run(batches):
        held = None
        for batch in batches:
            group = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            lists = batch.column(6)
            now = [group, *(batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5)), lists.value_lengths().to_numpy(), lists.flatten().to_numpy()]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            yield from groups(held, False)
            held = rest(held)
        if held is not None:
            yield from groups(held, True)

    def begins(held):
        return np.flatnonzero(np.concatenate([[True], (held[0][1:] != held[0][:-1]).any(axis=1)])) if len(held[0]) else np.zeros(0, int)

    def rest(held):
        """The last group, which may go on in the next batch."""
        begin = begins(held)[-1:].sum()
        return [*(x[begin:] for x in held[:-1]), held[-1][held[4][:begin].sum() :]]

    def groups(held, last):
        starts = begins(held)
        ends = np.append(starts[1:], len(held[0])) if last else starts[1:]
        at = np.concatenate([[0], np.cumsum(held[4])])
        found = [joined(*(x[a:b] for x in held[1:5]), held[5][at[a] : at[b]]) for a, b in zip(starts, ends, strict=False)]
        pairs = [p for ps in found for p in ps]
        if pairs:
            x, y = np.array(pairs, dtype=np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["dst", "src"])

    def joined(second, key, kind, size, values):
        """Links of a group. Classes that they join are one from then on."""
        border, at = int((~second).sum()), np.concatenate([[0], np.cumsum(size)])
        _, kind = np.unique(kind, return_inverse=True)
        known, values = np.unique(values, return_inverse=True)
        mark, pairs = np.zeros(len(known), bool), []
        for r in range(border, len(key)):
            lengths = size[:border]
            fits = (kind[:border] != kind[r]) & (np.minimum(lengths, size[r]) >= threshold * np.maximum(lengths, size[r]))
            near = np.flatnonzero(fits)
            if not len(near):
                continue
            own = values[at[r] : at[r + 1]]
            mark[own] = True
            lengths = size[near].astype(np.int64)
            begin = np.cumsum(lengths) - lengths
            both = np.add.reduceat(mark[values[np.repeat(at[near] - begin, lengths) + np.arange(lengths.sum())]], begin, dtype=np.int64)
            mark[own] = False
            for x in near[both / (size[r] + size[near] - both) >= threshold]:
                if kind[x] != kind[r]:
                    pairs.append((key[x], key[r]))
                    kind[kind == kind[x]] = kind[r]
        return pairs

    return run


def _spelt(keys: DataFrame, docs: DataFrame, unique: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The shingles of each text of ``keys`` (k). All texts are read again, but a bitmap of fixed size (2**FILTER_BITS bits,
    about 16 MB) lets only the wanted rows' shingles, and few others, go on."""
    wanted = keys.distinct().join(unique.select("k", "rep_id"), "k")
    places = wanted.select(F.pmod(F.xxhash64("k", "rep_id"), F.lit(1 << FILTER_BITS)).alias("p"))
    maps = places.groupBy(F.expr("bitmap_bucket_number(p + 1)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p + 1))").alias("m"))
    bitmap = bytearray((1 << FILTER_BITS) // 8 + 4096)
    for r in maps.toLocalIterator():
        bitmap[(r.b - 1) * 4096 : r.b * 4096] = r.m
    shared = docs.sparkSession.sparkContext.broadcast(bytes(bitmap))
    texts = docs.select(F.xxhash64(text_key(F.col(text_col))).alias("k"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.select("k", F.pmod(F.xxhash64("k", "id"), F.lit(1 << FILTER_BITS)).alias("p"), "text")
    return durable(texts.mapInArrow(_spell(shared), "k bigint, shingles array<bigint>").dropDuplicates(["k"]))


def _similar(pairs: DataFrame, spelt: DataFrame) -> DataFrame:
    """The exact weighted Jaccard of each pair."""
    a = spelt.select("k", F.col("shingles").alias("a"))
    b = spelt.select(F.col("k").alias("head"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(a, "k").join(b, "head").select("k", "head", (both / (F.size("a") + F.size("b") - both)).alias("sim"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of ``docs``: id, class_id, component, keep (true for the rows of one id and text of each class),
    n_links, class_texts. Rows are of one class if they have the same component; class_id is its smallest id, which classes can share."""
    classes = near_classes(docs, id_col=id_col, text_col=text_col, threshold=threshold, bands=bands, rows=rows)
    rows_ = docs.select(F.col(id_col), text_key(F.col(text_col)).alias("tid"))
    keep = F.col(id_col).eqNullSafe(F.col("class_id")) & (F.col("tid") == F.col("first_tid"))
    return rows_.join(classes, "tid").select(id_col, "class_id", "component", keep.alias("keep"), "n_links", "class_texts")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class: of the class's texts with the smallest id the first by key, and of that text a row
    of that id. Columns and their names stay."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    classes = near_classes(docs, **options)
    first = classes.where(F.col("tid") == F.col("first_tid")).select(F.col("tid").alias("_t"), F.col("class_id").alias("_c"))
    tid = fresh("tid", docs.columns)
    marked = docs.withColumn(tid, text_key(F.col(text_col)))
    out = marked.join(first, (F.col(tid) == F.col("_t")) & marked[id_col].eqNullSafe(F.col("_c")), "left_semi")
    return out.dropDuplicates([tid]).drop(tid)
