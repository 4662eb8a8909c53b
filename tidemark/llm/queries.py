"""The queries of this subpackage for the driver: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann as _ann
from tidemark.llm import bpe as _bpe
from tidemark.llm import chat as _chat
from tidemark.llm import ctw as _ctw
from tidemark.llm import decontaminate as _decontaminate
from tidemark.llm import grid_join as _grid
from tidemark.llm import html_extract as _html
from tidemark.llm import license_scan as _license
from tidemark.llm import neardup as _neardup
from tidemark.llm import periodic as _periodic
from tidemark.llm import quality as _quality
from tidemark.llm import url_rules as _url
from tidemark.llm import whitening as _whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _html.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(~_quality.held_out())
    out = _quality.scored(docs, _quality.fit(docs, labels))
    return out.select("doc_id", _quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: Host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return _url.judge(pages, _url.rules_frame(spark, RULES)).select("page_id", "judged.*")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bpe.code_digests(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ctw.language_scores(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    messages = rows.union(own).withColumn("parts", _chat.text_part(F.col("text")))
    out = _chat.format_messages(messages).withColumn("turns", _chat.read_back(F.col("formatted")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = _chat.loss_text(_chat.loss_mask(F.col("formatted")))
    return out.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return _decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark")).select("doc_id", "hits.*")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _license.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ann.nearest(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neardup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = _whitening.fit(vectors)
    rows = _whitening.transform(vectors, model).select("vec_id", F.explode(_whitening.by_component(model, F.col("whitened"))).alias("c"))
    return rows.select("vec_id", "c.component", "c.n", F.expr("try_cast(c.deviation as bigint)").alias("deviation"), "c.whitened", "c.explained", "c.identity_error")


def op12_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid.near_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", "linked.*")


def planted(text: Column, doc_id: Column) -> Column:
    """In a tenth of the documents, told by their ids, all words from some place on repeat those from there on with a period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, "[ \t-\r]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    rounds = F.ceil((n - a) / p).cast("int")
    periodic = F.array_join(F.concat(F.slice(words, 1, a), F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), rounds)), 1, n - a)), " ")
    return F.when((h % 10 == 0) & F.coalesce(n > 0, F.lit(False)), periodic).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    return _periodic.find_runs(docs).select("doc_id", *_periodic.digests(F.col("periodic")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extract, op2_quality, op3_url_rules, op4_bpe, op5_language_model, op6_chat_format, op7_decontaminate, op8_license_scan, op9_nearest, op10_near_duplicates,
        op11_whitening, op12_vector_duplicates, op13_periodic_runs,
    )
}

_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _AZ + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {}

SQL["op3_url_rules"] = f"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(str(r) for r in RULES)}),
cut AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, row_number() OVER () AS r, {_AZ.format("split_part(coalesce(rest, ''), '/', 1)")} AS host,
  CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM cut),
hit AS (SELECT u.r, arg_max(q.host || q.path, length(q.host || q.path)) AS rule, arg_max(q.verdict, length(q.host || q.path)) AS verdict
  FROM u JOIN rules q ON (u.host = q.host OR ends_with(u.host, '.' || q.host)) AND starts_with(u.path, q.path) GROUP BY u.r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN hit USING (r)
"""

SQL["op6_chat_format"] = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum(23 + length(replace(role, '<|', '<|!|>')) + length(replace(text, '<|', '<|!|>'))) AS size FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(size AS BIGINT) AS formatted_chars FROM g
"""


def _license_sql() -> str:
    """Templates as lists of grams; an alignment is a diagonal, neighbouring ones are merged as the operator does."""
    base = [(label, _license.words(text)) for label, text in _license.PHRASES]
    spots = " UNION ALL ".join(f"SELECT r, '{label}' AS label, i FROM d, generate_series(0, len(w) - {len(w)}) AS s(i) WHERE " + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(w)) for label, w in base)
    grams = ", ".join(f"('{label}', {k}, {j}, {n}, '{' '.join(g)}')" for kind, label, k, j, n, g in _license.template_rows() if kind == "notice")
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
spots AS ({spots}),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS b FROM spots GROUP BY r),
t(label, k, j, grams, g) AS (VALUES {grams}),
word AS (SELECT r, i, k, array_to_string(w[i + 1 : i + k], ' ') AS g FROM d, (VALUES (2), ({_license.GRAM})) AS q(k), generate_series(0, len(w) - k) AS s(i)),
vote AS (SELECT r, label, grams, i, t.j, i - t.j AS diag FROM word JOIN t USING (k, g)),
line AS (SELECT DISTINCT r, label, diag FROM vote),
stepped AS (SELECT *, CASE WHEN diag - lag(diag) OVER (PARTITION BY r, label ORDER BY diag) <= {_license.SLACK} THEN 0 ELSE 1 END AS fresh FROM line),
span AS (SELECT *, sum(fresh) OVER (PARTITION BY r, label ORDER BY diag) AS part FROM stepped),
place AS (SELECT r, label, grams, part, j, list(DISTINCT i ORDER BY i) AS every FROM vote JOIN span USING (r, label, diag) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r, label, part ORDER BY j) AS n FROM place),
chain AS (SELECT r, label, grams, part, list_reduce(list_prepend([-1, 0], list(every ORDER BY n)),
  lambda s, x: CASE WHEN len(list_filter(x, lambda y: y > s[1])) > 0 THEN [list_min(list_filter(x, lambda y: y > s[1])), s[2] + 1] ELSE s END)[2] AS found FROM ranked GROUP BY ALL),
more AS (SELECT r, max(found / grams) AS cover, list(DISTINCT label) FILTER (found / grams >= {_license.LEAST}) AS m FROM chain GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(b), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b, []), coalesce(m, [])))), ','), '') AS labels,
  CASE WHEN b IS NOT NULL THEN 1.0 ELSE coalesce(cover, 0.0) END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN more USING (r)
"""


SQL["op8_license_scan"] = _license_sql()

SQL["op7_decontaminate"] = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s.i + 1 : s.i + least(10, len(w))], ' ') AS g FROM b, generate_series(0, greatest(0, len(w) - 10)) AS s(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
spot AS (SELECT r, s.i AS pos, n, array_to_string(w[s.i + 1 : s.i + n], ' ') AS g FROM d, sizes, generate_series(0, len(w) - n) AS s(i)),
occ AS (SELECT r, pos, n, item_id FROM spot JOIN win USING (n, g)),
hit AS (SELECT r, count(DISTINCT pos + k) AS n_hit FROM occ, generate_series(0, 9) AS s(k) WHERE k < n GROUP BY r),
item AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM occ GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN item USING (r)
"""
