"""Spelling variants: words within one edit of each other, by a walk of all words through one trie.

1. Words are counted over all texts, and those long and frequent enough are kept.
2. Their trie is an edge table: ``node, label, child``. Only the prefixes at which words part or end are
   nodes, so that a long word takes few steps; a node is named by a 64-bit hash of its prefix.
3. States (word, position, node, edits) start on the paths of their words. At each level all states meet the edges of
   their node in one join; a label may be passed as it is, or with one code point replaced, missing or too many if
   the state has no edit yet and has passed half of its word. Every word is walked forwards and backwards, so
   that one of the halves is as it should be; otherwise the edges near the root would take an edit of every word.
   A state that may not edit takes the edge that begins as the rest of its word does, and stays only if one follows.
4. A state with one edit that ends its word where another word ends makes the two neighbours; the pair is then
   compared, so that equal hashes of different prefixes can add no pair.
5. Forms point to more frequent words, so chains of forms are short; roots follow by pointer doubling.

Levels, edges and pairs are stored tables: a node that a large part of the words pass is split by
adaptive execution. No list of words, edges or pairs goes to a task as a whole or to the driver.

Edge cases: null and empty texts have no words; a null id reads as an empty string in the hash; repeated rows
count again; a word of any length takes as many levels as it has branching prefixes. No words give no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featuretable.functions.predicates import column
from featuretable.llm.texts import SpanHash, slices, text_bytes
from featuretable.sources.scratch import materialize

LEAST_LENGTH, LEAST_COUNT = 6, 5
# Maximal runs: a match takes all letters, and a shorter run has none. A word is never longer than its run.
RUN = f"[A-Za-z\\u00C0-\\u00FF]{{{LEAST_LENGTH},}}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLIP = 199
FORM_FACTOR = 5
BACK = "<"  # no letter
ROOT = int(SpanHash(np.zeros(1, np.uint8)).of(np.zeros(1, np.int64), np.zeros(1, np.int64)).astype(np.int64)[0])


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` of every letter run of enough code points: lower-cased, less one code point where the hash of id and run
    says so, and null if that leaves too few."""
    found = docs.select(
        F.coalesce(column(doc_id).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(column(text).cast("string"), F.lit(RUN), 0)).alias("run"),
    )
    run = F.col("run")
    ascii_only = F.length(run) == F.octet_length(run)
    found = found.select("id", F.when(ascii_only, F.lower(run)).otherwise(F.translate(run, UPPER, LOWER)).alias("run"))
    found = found.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = F.col("h") % F.length(run)
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return found.select(F.when(F.col("h") % SLIP != 0, run).when(F.length(run) > LEAST_LENGTH, cut).alias("word"))


def words(found: DataFrame) -> DataFrame:
    """``word, n`` of those with enough occurrences.

    Null counts nothing, so it goes with the rare words: a filter on the word would move below the hash of every run
    and make it twice.
    """
    return found.groupBy("word").agg(F.count("word").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def prefixes(vocabulary: DataFrame) -> DataFrame:
    """``word_id, at, node, next``: every prefix of every word by its hash, and the code point after it."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "word"):
                data, ends = text_bytes(part.column("word"))
                hashed = SpanHash(data)
                begins = np.flatnonzero((data & 0xC0) != 0x80)  # the first byte of every code point
                word = np.searchsorted(ends, begins, "right") - 1
                full = hashed.of(ends[:-1], ends[1:]).astype(np.int64)
                place = np.arange(len(begins)) - np.searchsorted(begins, ends[:-1])[word]
                stops = np.r_[begins[1:], len(data)]
                letter = pa.LargeStringArray.from_buffers(
                    len(begins), pa.py_buffer(np.r_[begins, stops[-1:]].astype(np.int64)), pa.py_buffer(data)
                )
                inner = hashed.of(ends[:-1][word], begins).astype(np.int64)
                length = np.bincount(word, minlength=part.num_rows)
                yield _prefix_batch(full[word], place, inner, letter.cast(pa.string()))
                yield _prefix_batch(full, length, full, pa.array([""] * part.num_rows, pa.string()))

    kind = "word_id long, at long, node long, next string"
    return vocabulary.select("word").mapInArrow(cut, kind)


def _prefix_batch(word_id: np.ndarray, at: np.ndarray, node: np.ndarray, after: pa.Array) -> pa.RecordBatch:
    columns = [pa.array(x.astype(np.int64)) for x in (word_id, at, node)]
    return pa.RecordBatch.from_arrays([*columns, after], ["word_id", "at", "node", "next"])


def trie(vocabulary: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges ``node, child, label, first, after, end_word, end_n``, ``word_id, word, n``, and ``word_id, path``.

    ``first`` is the label's first code point, ``after`` those of the labels that follow (an alphabet's worth at
    most), ``end_word`` the word that ends at the child, if one does. A path has the nodes of a word and where they are.
    """
    found = materialize(prefixes(vocabulary), "prefixes", rebalance=False)
    ids = found.filter("next = ''").select("word_id", F.col("at").alias("length"))
    parting = found.filter("at > 0").groupBy("node").agg(F.min("next").alias("a"), F.max("next").alias("b"))
    parting = materialize(parting.filter("a <> b OR a = ''").select("node"), "nodes")
    stops = found.filter("at > 0").join(parting, "node", "left_semi").select("word_id", "at", "node")
    starts = ids.select("word_id", F.lit(0).cast("long").alias("at"), F.lit(ROOT).alias("node"))
    after = F.struct("at", "node")
    path = stops.union(starts).groupBy("word_id").agg(F.sort_array(F.collect_list(after)).alias("path"))
    path = materialize(path, "paths", rebalance=False)
    step = F.expr("transform(sequence(1, size(path) - 1), i -> struct(path[i - 1] AS a, path[i] AS b))")
    steps = path.select("word_id", F.inline(step))
    of = F.struct("word_id", F.col("a.at").alias("start"), F.col("b.at").alias("stop"))
    edges = steps.groupBy(F.col("a.node").alias("node"), F.col("b.node").alias("child")).agg(F.min(of).alias("of"))
    edges = materialize(edges.select("node", "child", "of.*"), "edge_places")
    # The hash of a word is its node; two words of one hash (never seen) would share that node.
    named = materialize(_identified(vocabulary), "word_ids")
    label = F.substring("word", F.col("start") + 1, F.col("stop") - F.col("start"))
    labelled = edges.join(named, "word_id").select("node", "child", label.alias("label")).distinct()
    labelled = materialize(labelled.withColumn("first", F.substring("label", 1, 1)), "labels")
    after = labelled.groupBy(F.col("node").alias("child")).agg(F.concat_ws("", F.collect_set("first")).alias("after"))
    ends = named.select(F.col("word_id").alias("child"), F.col("word").alias("end_word"), F.col("n").alias("end_n"))
    full = labelled.join(ends, "child", "left").join(after, "child", "left")
    return materialize(full.withColumn("after", F.coalesce("after", F.lit(""))), "edges"), named, path


def _identified(vocabulary: DataFrame) -> DataFrame:
    def name(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "word"):
                data, ends = text_bytes(part.column("word"))
                own = SpanHash(data).of(ends[:-1], ends[1:]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), part.column("word"), part.column("n")], ["word_id", "word", "n"])

    return vocabulary.select("word", "n").mapInArrow(name, "word_id long, word string, n long")


def _moves() -> list[Column]:
    """The ways in which a state may pass a label and still end or go on: twice the code points used of its rest, and one
    more if it has an edit then; null where a way is closed."""
    rest, label, size = F.col("rest"), F.col("label"), F.length("label")
    fresh = (F.col("edits") == 0) & (F.col("keep") <= size)

    def open_end(used: Column) -> Column:
        # With its edit, a state needs the end of a word where its own ends, or an edge for its next code point.
        further = F.contains("after", F.substring(rest, used + 1, F.lit(1)))
        return F.when(F.length(rest) > used, further).otherwise((F.length(rest) == used) & F.col("end_word").isNotNull())

    def one_edit(used: Column) -> Column:
        return fresh & open_end(used) & (F.levenshtein(label, F.substring(rest, F.lit(1), used), 1) == 1)

    plain = rest.startswith(label) & ((F.col("edits") == 0) | open_end(size))
    edited = [F.when(one_edit(size + shift), (size + shift) * 2 + 1) for shift in (-1, 0, 1)]
    return [F.when(plain, size * 2 + F.col("edits")), *edited]


def level(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states one edge further; ``near`` and ``near_n`` where the word of a state is used up at a word's end."""
    free = (F.col("edits") == 0) & (F.col("keep") == 0)
    bound = states.filter(~free).withColumn("first", F.substring("rest", 1, 1))
    met = bound.join(edges, ["node", "first"]).unionByName(states.filter(free).join(edges, "node"))
    moved = met.withColumn("move", F.explode(F.array(*_moves()))).filter("move IS NOT NULL")
    used = F.shiftright("move", 1)
    return moved.select(
        "word_id", F.substring(F.col("rest"), used + 1, F.length("rest")).alias("rest"),
        F.greatest(F.col("keep") - used, F.lit(0)).alias("keep"),
        F.col("child").alias("node"), F.col("move").bitwiseAND(1).alias("edits"),
        F.col("end_word").alias("near"), F.col("end_n").alias("near_n"),
    )


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """``word, near, near_n``: every ordered pair of words at one edit.

    An edit leaves either the first half of a word as it is or the rest of it, so a state may edit only past the half:
    of the word, and of the word backwards (behind a mark, in the same trie). Few words share that much.
    """
    size = F.length("word")
    both = [
        F.struct(F.col("word").alias("word"), F.floor(size / 2).cast("int").alias("keep")),
        F.struct(F.concat(F.lit(BACK), F.reverse("word")).alias("word"), (size - F.floor(size / 2) + 1).cast("int").alias("keep")),
    ]
    walked = materialize(vocabulary.select("n", F.inline(F.array(*both))), "walked")
    edges, named, path = trie(walked.select("word", "n"))
    # Up to the half no state has an edit, so it is on the path of its own word: it starts at the last node there.
    start = named.join(walked.select("word", "keep"), "word").join(path, "word_id")
    start = start.withColumn("last", F.expr("element_at(filter(path, p -> p.at <= keep), -1)"))
    at = F.col("last.at").cast("int")
    states = start.select(
        "word_id", F.substring("word", at + 1, F.length("word")).alias("rest"), (F.col("keep") - at).alias("keep"),
        F.col("last.node").alias("node"), F.lit(0).alias("edits"),
    )
    states = materialize(states, "states")
    found = []
    while not states.isEmpty():
        moved = materialize(level(states, edges), "states", rebalance=False)
        found.append(moved.filter("edits = 1 AND rest = '' AND near IS NOT NULL").select("word_id", "near", "near_n"))
        states = moved.filter("edits = 0 OR rest <> ''").select("word_id", "rest", "keep", "node", "edits")
    if not found:
        return vocabulary.limit(0).select("word", F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = reduce(DataFrame.unionAll, found).join(named.select("word_id", "word"), "word_id")
    forward = [F.when(F.col(c).startswith(BACK), F.reverse(F.substring(c, 2, 1 << 30))).otherwise(F.col(c)).alias(c) for c in ("word", "near")]
    pairs = pairs.select(*forward, "near_n").distinct()
    return pairs.filter(F.levenshtein("word", "near", 1) == 1)


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form`` rows whose forms lead to no circle: pointers are doubled until none moves."""
    held = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = held.select(F.col("word").alias("root"), F.col("root").alias("next"))
        held = materialize(
            held.join(further, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ),
            "roots",
        )
        if held.filter("moved").isEmpty():
            return held.select("word", "root")
        held = held.select("word", "root")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every kept word."""
    vocabulary = materialize(words(runs(docs, doc_id, text)), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))  # strings are ordered by code points
    near = neighbours(vocabulary).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    near = materialize(near, "near_words")
    formed = vocabulary.join(near, "word", "left")
    is_form = -F.col("best.less") >= FORM_FACTOR * F.col("n")
    formed = formed.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"),
    )
    formed = materialize(formed, "forms")
    found = roots(formed.filter("form IS NOT NULL"))
    return formed.join(found, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
