"""Language identification by character language models.

One interpolated modified Kneser-Ney model of order 3 over real characters (``charlm``) for each language,
counted by Spark over all learning texts and stored in sorted hash arrays: one hash array with the n-grams of all
languages and a row of log probabilities for each n-gram, a column for each language. It is broadcast while the
n-grams of all languages, counted first, are at most ``charlm.HELD_GRAMS`` over the number of languages (there is a
value for each pair); beyond, blocks of documents join their distinct n-grams with the counts of every language
(``quality_classifier``), for the same scores.

A text gets the language with the lowest cross-entropy per character. Whether that is a good enough
match is calibrated: a language accepts texts up to the ``ACCEPT`` quantile of the cross-entropy that its
own learning texts of ``SHORT`` characters or more have under it; above, or below ``MARGIN`` ahead of
the next language, the text is marked ``rejected``. The predicted language is given all the same.

Edge cases: a null, empty or letterless text gets ``und``, score 0, rejected. Ties go to the first
language in alphabetical order. Learning rows without a language are left out. With no learning row at
all every text gets ``und``. Repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featuretable.functions.predicates import column
from featuretable.llm import charlm, quality_classifier
from featuretable.llm.joins import narrow
from featuretable.llm.texts import map_texts, text_bytes
from featuretable.sources.scratch import materialize

ORDER = 3
SHORT = 40
ACCEPT = 0.999
MARGIN = 0.05
#: Sharpness of the score: characters that count as evidence.
EVIDENCE = 20.0
UNDECIDED = "und"

OUT = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("cross_entropy", T.DoubleType()),
        T.StructField("margin", T.DoubleType()),
        T.StructField("n_chars_scored", T.LongType()),
    ]
)


class Models:
    """The models of all languages behind one hash array."""

    def __init__(self, counts: dict[int, tuple[np.ndarray, np.ndarray]], names: list[str]):
        self.names = names
        self.models = [charlm.KneserNey(*counts[i], ORDER) for i in range(len(names))]
        seen = [gram for gram, _ in counts.values()]
        gram = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.uint64)
        rows = [m.score(gram) for m in self.models]
        self.joint = charlm.HashArrays(gram, np.stack(rows, 1) if rows else np.zeros((0, 0)))

    def entropy(self, code: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Cross-entropy per character: a row per language, a column per text."""
        at, there = self.joint.place(code)
        row = self.joint.values[np.minimum(at, max(0, len(self.joint.values) - 1))]
        new = np.flatnonzero(~there)
        if new.size:
            row[new] = np.stack([m.score(code[new]) for m in self.models], 1)
        total = charlm.text_sums(np.ascontiguousarray(row.T), ends)
        return -total / np.maximum(np.diff(ends), 1)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a text has a letter of any script."""
    lower = data | 32
    ascii_ = np.zeros(len(data) + 1, np.int64)
    np.cumsum((lower >= 97) & (lower <= 122) & (data < 128), out=ascii_[1:])
    found = ascii_[offsets[1:]] > ascii_[offsets[:-1]]
    for i in np.flatnonzero(~found):
        rest = data[offsets[i] : offsets[i + 1]]
        if (rest >= 128).any():
            found[i] = any(map(str.isalpha, set(rest.tobytes().decode("utf-8", "replace"))))
    return found


@dataclass(frozen=True)
class Counts:
    """Stored ``grp, gram, n`` of all languages, numbered in the order of ``names``: models too large to broadcast."""

    table: DataFrame
    names: list[str]


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang") -> Models | Counts:
    """Models of all languages in the rows where ``learn`` holds; the list of languages is small."""
    known = docs.filter(learn & column(lang).isNotNull())
    names = sorted(r[0] for r in known.select(column(lang)).distinct().collect())
    if not names:
        return Models({}, [])
    number = F.array_position(F.lit(names), column(lang)) - 1
    counted = materialize(charlm.gram_counts(known, ORDER, column(text), number), "gram_counts", rebalance=False)
    counts = charlm.collect_counts(counted, len(names))
    if counts is None:
        return Counts(counted, names)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return Models({i: counts.get(i, none) for i in range(len(names))}, names)


def decided(names: list[str], cost: np.ndarray, no: np.ndarray, length: np.ndarray) -> dict[str, pa.Array]:
    """The columns of ``OUT`` from the cross-entropies (a row per language) and the texts without a letter."""
    texts = len(length)
    best = np.argmin(cost, axis=0)
    least = cost[best, np.arange(texts)]
    share = np.exp(-EVIDENCE * (cost - least)).sum(axis=0)
    ranked = np.sort(cost, axis=0)
    ahead = ranked[1] - ranked[0] if len(names) > 1 else np.full(texts, np.inf)
    label = np.array(names, object)[best]
    label[no] = UNDECIDED
    return {
        "lang_pred": pa.array(label, pa.string()),
        "score": pa.array(np.where(no, 0.0, 1 / share)),
        "cross_entropy": pa.array(least, mask=no),
        "margin": pa.array(ahead, mask=no),
        "n_chars_scored": pa.array(length.astype(np.int64)),
    }


def score(docs: DataFrame, models: Models | Counts, text: str = "text", carry=("doc_id",)) -> DataFrame:
    if isinstance(models, Counts):
        return score_by_joins(docs, models, text, carry)
    held = docs.sparkSession.sparkContext.broadcast(models)

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        m = held.value
        data, offsets = text_bytes(batch.column(text))
        texts = len(offsets) - 1
        code, ends = charlm.codes(data, offsets, ORDER)
        if not m.names:
            und = {"lang_pred": [UNDECIDED] * texts, "score": [0.0] * texts}
            none = pa.nulls(texts, pa.float64())
            return {k: pa.array(v) for k, v in und.items()} | {
                "cross_entropy": none, "margin": none, "n_chars_scored": pa.array(np.diff(ends))
            }
        return decided(m.names, m.entropy(code, ends), ~has_letter(data, offsets), np.diff(ends))

    return map_texts(docs, work, OUT, text, carry=carry)


def score_by_joins(docs: DataFrame, counts: Counts, text: str, carry) -> DataFrame:
    """As ``score``, under models of any size."""
    names = counts.names

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"lettered": pa.array(has_letter(*text_bytes(batch.column(text))))}

    lettered = T.StructType([T.StructField("lettered", T.BooleanType())])
    marked = map_texts(docs, work, lettered, text, carry=tuple(dict.fromkeys([*carry, text])))
    carried = F.struct(*(column(c).alias(f"c{i}") for i, c in enumerate(carry))).alias("carried")
    rows = marked.select(carried, "lettered", F.lit("").alias("lang"), column(text).cast("string").alias("text"))
    stored = quality_classifier.blocks(rows, ORDER)
    asked = quality_classifier.asked_grams(stored).drop("lang")
    tables = quality_classifier.model(
        counts.table.select(F.element_at(F.lit(names), F.col("grp") + 1).alias("lang"), "gram", "n"), ORDER
    )
    every = asked.select("gram").distinct().select(F.explode(F.lit(names)).alias("lang"), "gram")
    known = quality_classifier.grams_scored(every, *tables, ORDER)
    empty = F.lit(-float(np.log(charlm.LETTERS)))  # a language whose texts are all empty
    back = asked.join(known.select("lang", "gram", F.coalesce("logp", empty).alias("logp")), "gram")

    def finish(batch, code, ends, found):
        value = [found[n].find(code)[0][:, 0] if n in found else np.zeros(len(code)) for n in names]
        cost = -charlm.text_sums(np.stack(value), ends) / np.maximum(np.diff(ends), 1)
        no = ~batch.column("lettered").to_numpy(zero_copy_only=False)
        return decided(names, cost, no, np.diff(ends))

    out = T.StructType([rows.schema["carried"], *OUT])
    scored = quality_classifier.met(stored, back.select("block", "lang", "gram", "logp"), ["logp"], out, ORDER, finish)
    kept = (F.col("carried").getField(f"c{i}").alias(c) for i, c in enumerate(carry))
    return scored.select(*kept, *OUT.fieldNames())


def identify(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """One row per document; ``learn`` says which rows the models and thresholds are made from."""
    source = docs.select(
        column(doc_id).alias("doc_id"), column(text).alias("text"), column(lang).alias("lang"),
        F.coalesce(learn, F.lit(False)).alias("learn"),
    )
    models = fit(source, F.col("learn"))
    scored = materialize(score(source, models, carry=("doc_id", "lang", "learn")), "language")
    own = (
        F.col("learn") & (F.col("lang") == F.col("lang_pred")) & (F.col("n_chars_scored") >= SHORT)
    )
    limits = (
        scored.filter(own)
        .groupBy(F.col("lang").alias("band_lang"))
        .agg(F.percentile_approx("cross_entropy", ACCEPT, 10_000).alias("limit"))
    )
    # One row per language meets any number of rows of a language in place.
    judged = scored.join(narrow(limits), F.col("lang_pred") == F.col("band_lang"), "left")
    fits = (F.col("cross_entropy") <= F.col("limit")) & (F.col("margin") >= MARGIN)
    return judged.withColumn("rejected", ~F.coalesce(fits, F.lit(False))).drop("band_lang")
