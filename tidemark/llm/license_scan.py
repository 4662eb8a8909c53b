r"""License scans by diagonal voting.

Texts are lower-cased (A-Z) and cut into words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``. The hashes of all rolling word k-grams are joined to
the positions of the same grams in the templates: k is 2 for phrases and short notices, 4 for license texts. A hit at word i of the text and word j of the
template votes for diagonal i - j. A template's votes on one diagonal are one alignment; diagonals of the same template in a text that lie within ``SLACK``
of each other are merged, which bridges words put in or left out. A span is verified: of the template's grams, those count that are found in
order, each behind all before it; their share of all its grams is the coverage.

Short phrases are verified strictly: all grams on one diagonal, which is the same as the words standing there one
after another. Notices and texts of licenses count from a coverage of ``LEAST``. Templates are a parameter.

All on DataFrame functions, in one pass over the texts: grams are made within arrays (a 4-gram's hash is that of two pairs' hashes). One row stands for
the text itself; behind it the grams of a text that has any of the templates' are exploded and met with those, a broadcast as large as the templates. Only texts' own rows and hits are
shuffled, by id and text. Gram hashes have 64 bits. Defined results: null texts are empty; texts without a label have empty label strings, score 0 and null
positions; repeated rows each get their row; texts are read whole; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.license_texts import BODIES, NOTICES, PHRASES

LEAST, SLACK, GRAM = 0.6, 3, 4
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: kind, k and templates.
TEMPLATES = (("base", 2, PHRASES), ("notice", 2, NOTICES), ("notice", GRAM, BODIES))


def words_array(text: Column) -> Column:
    # the Kelvin sign alone would become an ASCII letter; other letters may change, which makes no difference to ASCII templates
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), "")


def words(text: str) -> list[str]:
    """Words of an ASCII template."""
    return WORD.findall(text.lower())


def template_rows(templates=TEMPLATES) -> list[tuple[str, str, int, int, int, list[str]]]:
    """(kind, label, k, position, grams of the template, gram) of each gram."""
    rows = []
    for kind, k, group in templates:
        for label, text in group:
            w = words(text)
            if len(w) < k:
                raise ValueError(f"template {label} has fewer than {k} words")
            rows += [(kind, label, k, j, len(w) - k + 1, w[j : j + k]) for j in range(len(w) - k + 1)]
    return rows


def _templates(spark: SparkSession, templates) -> DataFrame:
    rows = spark.createDataFrame(template_rows(templates), "kind string, label string, k int, j int, grams int, w array<string>")
    w = F.col("w")
    pair = F.xxhash64(w[0], w[1])
    h = F.when(F.col("k") == 2, pair).otherwise(F.xxhash64(pair, F.xxhash64(F.get(w, F.lit(2)), F.get(w, F.lit(3)))))
    own = spark.createDataFrame([("text", None, 0, 0, 0)], "kind string, label string, k int, j int, grams int").withColumn("h", F.xxhash64(F.lit("a text")))
    return rows.select("kind", "label", "k", "j", "grams", h.alias("h")).union(own)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once, however often it is used there."""
    return F.transform(F.array(value), use)[0]


def _grams(w: Column, known: Column) -> Column:
    """(n, grams): how many words; hashes: one that stands for the text and, if any is known, the pair at each word and then the 4-gram at
    each word (null where it does not fit)."""
    after = lambda x, k: F.slice(x, k + 1, F.greatest(F.size(x), F.lit(1)))
    hashed = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.xxhash64(a, b))
    own = F.array(F.xxhash64(F.lit("a text")))
    shown = lambda grams: F.when(F.arrays_overlap(grams, known), F.concat(own, grams)).otherwise(own)
    whole = lambda pairs: _once(F.concat(pairs, F.zip_with(pairs, after(pairs, GRAM // 2), hashed)), shown)
    return _once(w, lambda w: F.struct(F.size(w).alias("n"), _once(F.zip_with(w, after(w, 1), hashed), whole).alias("grams")))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row."""
    t = _templates(docs.sparkSession, templates)
    known = F.lit([r.h for r in t.where("kind <> 'text'").select("h").distinct().collect()])  # as many as the templates have grams
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(text_col, F.lit("")))).alias("key"), _grams(words_array(F.col(text_col)), known).alias("w"))
    rows = rows.select("id", "key", F.col("w.n").alias("n"), F.posexplode("w.grams").alias("p", "h"))
    hits = rows.join(F.broadcast(t), "h").withColumn("i", F.when(F.col("k") == 2, F.col("p") - 1).otherwise(F.col("p") - 1 - F.col("n"))).where("kind = 'text' or (k = 2) = (p <= n)")
    # rows of one id and text are one here; their votes are the same, so each is counted once
    lines = hits.groupBy("id", "key", "kind", "label", "grams", F.when(F.col("kind") != "text", F.col("i") - F.col("j")).alias("d")).agg(F.collect_set("j").alias("js"), F.count("*").alias("copies"), F.max("n").alias("n"))
    same = Window.partitionBy("id", "key", "label").orderBy("d")
    apart = F.coalesce(F.col("d") - F.lag("d").over(same) > SLACK, F.lit(True)) | (F.col("kind") != "notice")
    lines = lines.withColumn("span", F.sum(F.when(apart, 1).otherwise(0)).over(same))
    places = F.flatten(F.collect_list(F.transform("js", lambda j: F.struct(j.alias("j"), (j + F.col("d")).alias("i")))))
    spans = lines.groupBy("id", "key", "kind", "label", "grams", "span").agg(places.alias("at"), F.min("d").alias("d"), F.max("copies").alias("copies"), F.max("n").alias("n"))
    # in order of the template, a gram counts if it stands behind all before it
    zero = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("found"), F.lit(-1).alias("j"))
    later = lambda s, x: F.when((x["i"] > s["last"]) & (x["j"] > s["j"]), F.struct(x["i"].alias("last"), (s["found"] + 1).alias("found"), x["j"].alias("j"))).otherwise(s)
    cover = F.aggregate(F.array_sort("at"), zero, later)["found"] / F.col("grams")
    spans = spans.select("id", "key", "kind", "label", "d", "copies", "n", F.when(F.col("kind") != "text", cover).alias("cover"))
    good = (F.col("kind") == "base") & (F.col("cover") == 1)
    out = spans.groupBy("id", "key").agg(
        F.max(F.when(F.col("kind") == "text", F.col("copies"))).alias("copies"), F.max("n").cast("bigint").alias("n_words"), F.count_if(good).alias("n_base"),
        F.min(F.when(good, F.col("d"))).cast("bigint").alias("first_word"), F.max(F.when(good, F.col("d"))).cast("bigint").alias("last_word"),
        F.collect_set(F.when(good, F.col("label"))).alias("b"), F.collect_set(F.when((F.col("kind") == "notice") & (F.col("cover") >= LEAST), F.col("label"))).alias("m"),
        F.max(F.when(F.col("kind") == "notice", F.col("cover"))).alias("cover"),
    )
    joined = lambda x: F.array_join(F.array_sort(x), ",")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", joined(F.col("b")).alias("base_labels"), joined(F.array_union("b", "m")).alias("labels"),
        F.when(F.size("b") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
    )
