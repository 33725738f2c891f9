"""Quality rules: simple counts per text, then perplexity bands of each language.

The perplexity comes from a model of order 4 over real characters (``charlm``), counted by Spark over the
whole texts of the table and interpolated with modified Kneser-Ney discounts. It is broadcast as sorted hash
arrays while its n-grams, counted first, are at most ``charlm.HELD_GRAMS``; beyond, blocks of documents join their
distinct n-grams with the counts (``quality_classifier``), for the same scores.

A document has two scores: its log perplexity, and the same mean under the model's continuation counts
(order 3), where every distinct 4-gram counts once. Junk of one kind that fills many documents teaches
the first score its own patterns, however often they are repeated; the second hardly learns from repeats.

The bands of a language are Tukey's outer fences of each score of its documents that pass the base
rules: ``WIDTH`` interquartile ranges below the first and above the third quartile, and never nearer to
the median than ``LEAST`` (perplexity) or ``LEAST_NEW`` (continuation). A document is kept within both.
Quartiles are Spark's approximate percentiles over all documents.

Edge cases: a null or empty text has no word and fails the base rules; its perplexity is null. A null
language is a language of its own. Repeated rows are judged alike, each in a row of its own. An empty
table gives an empty result. Other columns of the table are ignored unless carried.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featuretable.functions.predicates import column
from featuretable.llm import charlm, quality_classifier
from featuretable.llm.joins import narrow
from featuretable.llm.texts import SPACE, SpanHash, map_texts, mixed, per_text, spans, text_bytes
from featuretable.sources.scratch import materialize

ORDER = 4
WIDTH = 3.0
LEAST = 0.25
LEAST_NEW = 0.1
MIN_WORDS = 50
MAX_REPEAT = 0.5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in BASE])
STATS = T.StructType(
    [*COUNTS, T.StructField("n_chars_scored", T.LongType())]
    + [T.StructField(n, T.DoubleType()) for n in ("log_perplexity", "log_continuation")]
)

# The characters that count as symbols.
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _again(keys: np.ndarray) -> np.ndarray:
    """Whether a key occurs twice or more."""
    held = np.sort(keys)
    twice = np.unique(held[1:][held[1:] == held[:-1]])
    if not twice.size:
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base columns of every text, from its bytes."""
    texts = len(offsets) - 1
    inside = ~SPACE[data]
    starts, ends, text_of = spans(inside, offsets)
    hashes = SpanHash(data)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    flags = np.zeros(len(data) + 1, np.int64)
    np.cumsum(SYMBOL[data], out=flags[1:])
    out = {
        "n_words": np.bincount(text_of, minlength=texts).astype(np.int64),
        "word_chars": per_text(points[ends] - points[starts], text_of, texts),
        "n_symbols": flags[offsets[1:]] - flags[offsets[:-1]],
    }

    words = hashes.of(starts, ends)
    covered = np.zeros(len(words), bool)
    if len(words) > 2:
        whole = text_of[2:] == text_of[:-2]
        window = mixed(words[:-2] * np.uint64(3) + mixed(words[1:-1] * np.uint64(5) + mixed(words[2:])))
        window = mixed(window + text_of[2:].astype(np.uint64))
        found = np.flatnonzero(whole)
        found = found[_again(window[found])]
        for k in range(3):
            covered[found + k] = True
    out["n_repeat_words"] = per_text(covered, text_of, texts)

    first, last, line_text = spans(data != 10, offsets)
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=filled[1:])
    worded = filled[last] > filled[first]
    first, last, line_text = first[worded], last[worded], line_text[worded]
    key = mixed(hashes.of(first, last) + line_text.astype(np.uint64))
    lines = np.bincount(line_text, minlength=texts)
    _, once = np.unique(key, return_index=True)
    out["n_dup_lines"] = lines - np.bincount(line_text[once], minlength=texts)
    return out


def measure(
    docs: DataFrame, text: str = "text", carry: Sequence[str] = ("doc_id",), field: str | None = None
) -> DataFrame:
    """``carry``, the base columns and both scores under a model of all texts of ``docs``.

    With ``field`` the text is that field of the struct column ``text``.
    """
    spark = docs.sparkSession
    whole = column(text) if field is None else column(text).getField(field)
    counted = materialize(charlm.gram_counts(docs, ORDER, whole), "gram_counts", rebalance=False)
    counts = charlm.collect_counts(counted)
    if counts is None:
        return measure_by_joins(docs, counted, text, carry, field)
    gram, n = counts.get(0, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    held = spark.sparkContext.broadcast(charlm.KneserNey(gram, n, ORDER))

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        data, offsets = text_bytes(batch.column(text))
        out = base_counts(data, offsets)
        code, ends = charlm.codes(data, offsets, ORDER)
        length = np.diff(ends)
        out["n_chars_scored"] = length
        made = {k: pa.array(v.astype(np.int64)) for k, v in out.items()}
        for name, order in (("log_perplexity", ORDER), ("log_continuation", ORDER - 1)):
            mean = -charlm.text_sums(held.value.score(code, order), ends) / np.maximum(length, 1)
            made[name] = pa.array(mean, pa.float64(), mask=length == 0)
        return made

    return map_texts(docs, work, STATS, text, carry=carry, field=field)


def measure_by_joins(
    docs: DataFrame, counts: DataFrame, text: str, carry: Sequence[str], field: str | None
) -> DataFrame:
    """As ``measure``, under a model of any size."""

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {k: pa.array(v.astype(np.int64)) for k, v in base_counts(*text_bytes(batch.column(text))).items()}

    based = map_texts(docs, work, COUNTS, text, carry=tuple(dict.fromkeys([*carry, text])), field=field)
    whole = column(text) if field is None else column(text).getField(field)
    carried = F.struct(*(column(c).alias(f"c{i}") for i, c in enumerate(carry))).alias("carried")
    scored = quality_classifier.both_scores(based.select(carried, *BASE, whole.cast("string").alias("text")), counts)
    back = (F.col("carried").getField(f"c{i}").alias(c) for i, c in enumerate(carry))
    return scored.select(*back, *STATS.fieldNames())


def base_failed() -> Column:
    words = F.col("n_words")
    return (words < MIN_WORDS) | (F.col("n_repeat_words") * 100 > words * int(100 * MAX_REPEAT))


def bands(measured: DataFrame, lang: str = "lang") -> DataFrame:
    """One row per language: ``lower`` and ``upper`` bound of the log perplexity, ``lower_new`` and
    ``upper_new`` of the continuation score."""
    scores = {"": ("log_perplexity", LEAST), "_new": ("log_continuation", LEAST_NEW)}
    passed = measured.filter(~base_failed() & F.col("log_perplexity").isNotNull())
    quartiles = [F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000).alias(f"q{k}") for k, (x, _) in scores.items()]
    found = passed.groupBy(column(lang).alias("band_lang")).agg(*quartiles)
    limits = []
    for k, (_, least) in scores.items():
        low, mid, high = (F.col(f"q{k}")[i] for i in range(3))
        reach = WIDTH * (high - low)
        limits.append(F.least(low - reach, mid - least).alias(f"lower{k}"))
        limits.append(F.greatest(high + reach, mid + least).alias(f"upper{k}"))
    return found.select("band_lang", *limits)


def judge(measured: DataFrame, limits: DataFrame, lang: str = "lang") -> DataFrame:
    """Adds ``base_failed``, ``perplexity``, ``kept``; ``limits`` has one row per language."""
    x = F.col("log_perplexity")
    within = x.between(F.col("lower"), F.col("upper"))
    within &= F.col("log_continuation").between(F.col("lower_new"), F.col("upper_new"))
    joined = measured.join(narrow(limits), column(lang).eqNullSafe(F.col("band_lang")), "left")
    return joined.withColumns(
        {
            "base_failed": base_failed(),
            "perplexity": F.exp(x),
            "kept": F.coalesce(~base_failed() & within, F.lit(False)),
        }
    ).drop("band_lang")


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """One row per document with its counts, perplexity, band and verdict."""
    names = {doc_id: "doc_id", lang: "lang"}
    source = docs.select(column(text).alias("text"), *(column(k).alias(v) for k, v in names.items()))
    measured = materialize(measure(source, carry=("doc_id", "lang")), "quality")
    return judge(measured, bands(measured))
