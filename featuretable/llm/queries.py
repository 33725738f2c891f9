"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featuretable.llm import (
    context_tree,
    divergence,
    exact_dedup,
    language_id,
    licenses,
    line_dedup,
    packing,
    quality_classifier,
    quality_rules,
    sentencepiece,
    simhash,
    spelling,
    toxicity,
)
from featuretable.llm.joins import narrow

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def fold(parts: int) -> Column:
    """Remainder of the id's CRC-32 (of its text); a null id reads as an empty string, so every row has one."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % parts


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark: SparkSession, d: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, d, "documents")).select(
        "doc_id", *quality_rules.BASE, "base_failed", "kept", "perplexity"
    )


def op2(spark: SparkSession, d: str) -> DataFrame:
    """Trusted are the documents that ``labels`` marks as of good quality."""
    good = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("good_id"))
    docs = table(spark, d, "documents").join(narrow(good.distinct()), F.col("doc_id") == F.col("good_id"), "left")
    return quality_classifier.classify(docs, F.col("good_id").isNotNull())


def op3(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, d, "documents"))


def op4(spark: SparkSession, d: str) -> DataFrame:
    return line_dedup.decide(table(spark, d, "documents")).drop("row")


def op5(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan(table(spark, d, "documents")).drop("spans")


def op6(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.decide(table(spark, d, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op7(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    learning = toxicity.labelled_rows(docs, table(spark, d, "labels"), fold(5) != 0)
    return toxicity.score(docs, toxicity.fit(learning)).select(
        "doc_id",
        (fold(5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op8(spark: SparkSession, d: str) -> DataFrame:
    return language_id.identify(table(spark, d, "documents"), fold(3) != 1).select(
        "doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score", "rejected"
    )


def op9(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every text and whether decoding them gives the text back."""
    model = vocabulary(PIECES)
    ids = sentencepiece.encode(table(spark, d, "documents"), model, carry=("doc_id", "text"))
    back = sentencepiece.decode(ids, model, carry=("doc_id", "text", "ids"), name="decoded")
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.xxhash64("ids").alias("ids_hash"),
        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("exact"),
    )


def op10(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), vocabulary(TOKENIZER))


def op11(spark: SparkSession, d: str) -> DataFrame:
    return spelling.variants(table(spark, d, "documents"))


def op12(spark: SparkSession, d: str) -> DataFrame:
    return context_tree.score(table(spark, d, "documents"), fold(7) != 2)


def op13(spark: SparkSession, d: str) -> DataFrame:
    return divergence.audit(table(spark, d, "documents"))


OP6_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

# CRC-32 bit by bit; neighbours share a word with one code point less, at the same place or as a whole.
OP11_SQL = r"""
WITH runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
  FROM documents
), counted AS (SELECT run, id || ':' || run AS name, count(*) AS n FROM runs GROUP BY run, name),
hexed AS (SELECT run, n, hex(encode(name)) AS x FROM counted),
summed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_transform(range(length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT),
    lambda c, b: list_reduce(range(8), lambda s, i: xor(s >> 1, 3988292384 * (s & 1)), xor(c, b)), 4294967295)) AS h
  FROM hexed
), written AS (
  SELECT n, CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM summed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM written WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cuts AS (
  SELECT word, n, i, word[:i - 1] || word[i + 1:] AS cut FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word
), best AS (
  SELECT word, count(*) AS n_near, min(struct_pack(less := -near_n, near := near)) AS best FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 5 * w.n THEN best.near END AS form,
         CASE WHEN -best.less >= 5 * w.n THEN -best.less END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), chain AS (
  WITH RECURSIVE c AS (
    SELECT word, word AS reached, 0 AS steps FROM forms
    UNION ALL SELECT c.word, f.form, steps + 1 FROM c JOIN forms f ON c.reached = f.word WHERE f.form IS NOT NULL
  ) SELECT word, max_by(reached, steps) AS root FROM c GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN chain USING (word)
"""

OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), occurrences AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term FROM occurrences GROUP BY lang, term HAVING count(DISTINCT row) >= 3
), counts AS (
  SELECT lang, source, term, count(*) AS c FROM occurrences SEMI JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (SELECT DISTINCT lang, source FROM d), sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(c)::BIGINT AS total FROM counts GROUP BY lang, source),
whole AS (SELECT lang, sum(total)::BIGINT AS total FROM totals GROUP BY lang),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c,
         1 + (1000000000 * (coalesce(c, 0) + 1)) // (coalesce(total, 0) + v) AS p
  FROM groups g JOIN kept k USING (lang) JOIN sizes USING (lang)
  LEFT JOIN totals t ON g.lang = t.lang AND g.source = t.source
  LEFT JOIN counts n ON g.lang = n.lang AND g.source = n.source AND k.term = n.term
), q AS (
  SELECT lang, term, 1 + (1000000000 * (sum(c) + 1)::BIGINT) // (any_value(total) + any_value(v)) AS q
  FROM counts JOIN whole USING (lang) JOIN sizes USING (lang) GROUP BY lang, term
), distances AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN distances d ON a.lang = d.lang AND a.source = d.source AND b.source = d.item
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value
  FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (FROM pairs UNION ALL FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

# The learned models of the other operators, and packing, are tested by brute force and held-out rows.
QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1,
    "op2_quality_classifier": op2,
    "op3_simhash": op3,
    "op4_line_dedup": op4,
    "op5_license_scan": op5,
    "op6_exact_dedup": op6,
    "op7_toxicity": op7,
    "op8_language_id": op8,
    "op9_sentencepiece": op9,
    "op10_packing": op10,
    "op11_spelling_variants": op11,
    "op12_lm_scoring": op12,
    "op13_source_divergence": op13,
}
ORACLE: dict[str, str] = {
    "op6_exact_dedup": OP6_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op13_source_divergence": OP13_SQL,
}
