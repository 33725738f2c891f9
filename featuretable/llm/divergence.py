"""Source divergence audit: how far the word use of each source lies from the others of its language.

1. Texts are cut into terms and counted in chunks of ``RUN_BYTES``: occurrences and documents by term, language and
   source. A document lies in one chunk and has one language and source, so both numbers add up exactly.
2. One shuffle brings all rows of a term together. They are added up by source, and what the term has in its whole
   language (occurrences, documents) is read off the same rows. Rows of terms that are not kept end there.
3. A term of a language is kept if it stands in at least ``LEAST_DOCUMENTS`` of its documents.
4. With counts c of the kept terms, p = 1 + floor(SCALE (c + 1) / (N + V)) in every group and every language,
   and f(p, q) = floor((p - q)^2 / q). The divergence of two sources sums f over all kept terms. Terms that
   a source lacks all have the same p there, so the sum over them follows from the histogram of p in the other
   source, and rows meet only for terms that both have.

The size of a group bounds nothing that one task holds: all steps are aggregations, joins, and one window over the
sources of a term, whose rows Spark spills.

Edge cases: null text, lang and source read as ''; repeated rows are documents of their own; ids are not used.
A group without terms has its pairs, with value 0 where the language keeps no term. No rows give no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featuretable.functions.predicates import column
from featuretable.llm.texts import bounded_batches, slices, text_bytes
from featuretable.sources.scratch import materialize

LEAST_DOCUMENTS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
RUN_BYTES = 32 << 20
# Bytes of terms, A-Z as a-z: ASCII letters and all of other characters. What lies between terms is a space.
TERM_BYTES = np.full(256, 32, np.uint8)
TERM_BYTES[65:91] = TERM_BYTES[97:123] = np.arange(97, 123)
TERM_BYTES[128:] = np.arange(128, 256)


def chunk_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, df`` of ``lang, source, text`` rows without nulls.

    A row stands for a term of a group in one chunk of texts: its occurrences and its documents there.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            yield from _count(run)

    bounded_batches(docs.sparkSession)
    kind = "lang string, source string, term string, n long, df long"
    return docs.select("lang", "source", "text").mapInArrow(count, kind)


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Texts in runs of about ``RUN_BYTES``, or a single longer one."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in slices(batch, "text", RUN_BYTES):
            more = int(text_bytes(part.column("text"))[1][-1])
            if held and size + more > RUN_BYTES:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(part)
            size += more
    if held:
        yield pa.Table.from_batches(held)


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])


def _count(run: pa.Table) -> Iterator[pa.RecordBatch]:
    # What is no longer needed goes at once: a run is tens of megabytes, and each of these arrays as much again.
    data, offsets = text_bytes(run.column("text"))
    spaced = pa.LargeStringArray.from_buffers(run.num_rows, pa.py_buffer(offsets), pa.py_buffer(TERM_BYTES[data]))
    del data, offsets
    split = pc.ascii_split_whitespace(spaced)
    row, flat = pc.list_parent_indices(split).to_numpy().astype(np.int32), pc.list_flatten(split)
    del spaced, split
    worded = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # text that starts or ends between terms
    row, coded = row[worded], flat.filter(pa.array(worded)).dictionary_encode()
    del flat, worded
    if not len(row):
        return
    terms = coded.dictionary
    # Counts by document, then by group and term.
    cell = row.astype(np.int64)
    cell *= len(terms)
    cell += coded.indices.to_numpy()
    del row, coded
    cell.sort()
    at = _starts(cell)
    n = np.diff(at, append=len(cell))
    row, code = np.divmod(cell[at], len(terms))
    del cell
    lang, source = (run.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
    lang_of, source_of = (x.indices.to_numpy().astype(np.int64) for x in (lang, source))
    groups, group_of = np.unique(lang_of * len(source.dictionary) + source_of, return_inverse=True)
    key = group_of[row] * len(terms) + code
    del row, code
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = _starts(key)
    group, code = np.divmod(key[at], len(terms))
    n, df = np.add.reduceat(n, at), np.diff(at, append=len(key))
    del order, key, at
    for k in range(0, len(n), 20_000):
        part = slice(k, k + 20_000)
        of_lang, of_source = np.divmod(groups[group[part]], len(source.dictionary))
        yield pa.RecordBatch.from_arrays(
            [
                lang.dictionary.take(pa.array(of_lang)), source.dictionary.take(pa.array(of_source)),
                terms.take(pa.array(code[part])).cast(pa.string()), pa.array(n[part]), pa.array(df[part]),
            ],
            ["lang", "source", "term", "n", "df"],
        )
    pa.default_memory_pool().release_unused()


def chunk_terms(counts: DataFrame) -> DataFrame:
    """``lang, source, term, c, c_lang, df_lang, leads``: the terms of all chunks by group.

    Beside the occurrences in the group stand the occurrences and documents in the language; one row of each term
    of a language ``leads``. All rows of such a term meet in one shuffle, which serves all of these sums.
    """
    dealt = counts.repartition("lang", "term")
    cells = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("c"), F.sum("df").alias("df"))
    whole = Window.partitionBy("term", "lang")
    return cells.select(
        "lang", "source", "term", "c",
        F.sum("c").over(whole).alias("c_lang"), F.sum("df").over(whole).alias("df_lang"),
        (F.col("source") == F.min("source").over(whole)).alias("leads"),
    )


def kept_cells(chunks: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """The rows of terms in at least ``least`` documents of the language."""
    return chunks.filter(F.col("df_lang") >= least)


def kept_terms(chunks: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang, term`` of the terms in at least ``least`` documents of the language."""
    return kept_cells(chunks, least).filter("leads").select("lang", "term")


def _share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE (count + 1) / total), exact for any count."""
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", scaled, F.greatest(total, F.lit(1)).cast("decimal(20,0)"))


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    return rows.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank")
    )


def pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for every ordered pair of sources of a language."""
    a = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("pa0"), "v")
    b = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("pb0"))
    out = ["lang", F.col("a").alias("source"), F.col("b").alias("item")]
    back = ["lang", F.col("b").alias("source"), F.col("a").alias("item")]
    # All kept terms as if neither source had them.
    none = a.join(b, "lang").filter("a <> b").select(*out, (F.col("v") * _f("pa0", "pb0")).alias("value"))
    # What the terms of one source add to that, read off the histogram of their shares.
    steps = shares.groupBy("lang", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("pa0")).agg(
        F.count(F.lit(1)).alias("m")
    )
    alone = materialize(steps, "share_histograms").join(b, "lang").filter("a <> b")
    ahead = alone.select(*out, (F.col("m") * (_f("pa", "pb0") - _f("pa0", "pb0"))).alias("value"))
    behind = alone.select(*back, (F.col("m") * (_f("pb0", "pa") - _f("pb0", "pa0"))).alias("value"))
    # Terms that both have: the true value, less what the two lines above took for it.
    left = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("pa0"))
    right = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("pb0"))
    shared = left.join(right, ["lang", "term"]).filter("a < b")
    forth = _f("pa", "pb") - _f("pa", "pb0") - _f("pa0", "pb") + _f("pa0", "pb0")
    other = _f("pb", "pa") - _f("pb", "pa0") - _f("pb0", "pa") + _f("pb0", "pa0")
    both = shared.groupBy("lang", "a", "b").agg(F.sum(forth).alias("forth"), F.sum(other).alias("other"))
    both = materialize(both, "shared_terms")
    parts = [none, ahead, behind, both.select(*out, F.col("forth").alias("value")), both.select(*back, F.col("other").alias("value"))]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def small_sides_hashed(spark: SparkSession) -> None:
    """Let adaptive execution hash a join's side, instead of sorting both, where it has measured every partition as small."""
    name = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    if spark.conf.get(name) in ("0", "0b"):
        spark.conf.set(name, "64m")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: divergent pairs of sources, and terms a source overuses."""
    small_sides_hashed(docs.sparkSession)
    read = {"lang": lang, "source": source, "text": text}
    rows = docs.select(*(F.coalesce(column(c).cast("string"), F.lit("")).alias(n) for n, c in read.items()))
    found = materialize(kept_cells(chunk_terms(chunk_counts(rows))), "kept_counts", rebalance=False)
    totals = found.groupBy("lang", "source").agg(F.sum("c").alias("total"))
    sizes = kept_terms(found).groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    zero = F.lit(0).cast("long")
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.withColumns({"total": F.coalesce("total", zero), "v": F.coalesce("v", zero)})
    groups = groups.withColumn("whole", F.col("total") + F.col("v"))
    groups = materialize(groups.withColumn("p0", _share(zero, F.col("whole"))), "groups")
    langs = groups.groupBy("lang").agg((F.sum("total") + F.max("v")).alias("whole_lang"))
    wholes = groups.select("lang", "source", "whole", "p0").join(langs, "lang")
    shares = found.join(wholes, ["lang", "source"]).select(
        "lang", "source", "term", _share(F.col("c"), F.col("whole")).alias("p"), "p0",
        _share(F.col("c_lang"), F.col("whole_lang")).alias("q"),
    )
    shares = materialize(shares, "shares", rebalance=False)
    over = shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), _f("p", "q").alias("value"))
    return _ranked(pairs(groups, shares), "pair").unionByName(_ranked(over, "term").filter(F.col("rank") <= TOP_TERMS))
