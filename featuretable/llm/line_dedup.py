"""Line dedup by a deletion-neighbourhood join over words.

A line counts as its words (split at ASCII white space, A-Z in lower case). Two lines are near if at most
``BOUND`` = 1 word has to be inserted, deleted or replaced; lines of fewer than ``NEAR_WORDS`` words match
when equal only. A line goes if an equal or near line stands earlier, in the order of id, row and line
number, whether or not that one stays itself; the earliest stays. Lines without a word always stay.

1. All line occurrences are written once, as hashes; equal lines are reduced to their first place.
2. Filter by halves: of two near lines, one half of the words is equal. Only lines that share a hashed
   half (in its length class) with a different line go on; the filter loses no pair.
3. Their texts are fetched, and every variant with one word deleted is emitted as a hashed key, with the
   position of the gap. Lines with equal variants and equal gap differ in that word alone; a variant
   equal to a whole line says that this line lacks the word.
4. Equal variants are joined through the earliest line under each key, so a key with n lines gives n
   candidates and not n pairs. The words of each candidate pair are compared and true pairs kept; a line
   takes the earliest of its true partners.

Scale: every join is on hashes, one side of each is unique by key, sums come before shuffles.

Edge cases: null and empty texts have no line. Repeated rows are told apart by a row number given in
step 1; a null id comes before all others. Very long lines are lines like any other. An empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featuretable.functions.predicates import column
from featuretable.llm.texts import LOWER, SPACE, SpanHash, map_texts, mixed, spans, text_bytes
from featuretable.sources.scratch import materialize

BOUND = 1
NEAR_WORDS = 8

STEP = 0xD1B54A32D192ED03
_BACK = pow(STEP, -1, 1 << 64)


class Lines:
    """Words and lines of texts; any run of words of a line has a hash, with or without one word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = LOWER[data]
        inside = ~SPACE[data]
        self.data = data
        self.starts, self.ends, _ = spans(inside, offsets)
        first, last, text_of = spans(data != 10, offsets)
        breaks = np.append(0, np.cumsum(data == 10))
        number = breaks[first] - breaks[offsets[text_of]]
        begin, end = np.searchsorted(self.starts, first), np.searchsorted(self.starts, last)
        worded = end > begin
        self.begin, self.end = begin[worded], end[worded]
        self.number, self.text_of = number[worded], text_of[worded]
        words = SpanHash(data).of(self.starts, self.ends)
        n = len(words)
        self.power = self._powers(STEP, n)
        self.back = self._powers(_BACK, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * self.power[:n], out=self.sums[1:])

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n + 1, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, out=out)

    def raw(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.back[begin]

    def run(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words from ``begin`` to ``end``."""
        return mixed(self.raw(begin, end) + mixed((end - begin).astype(np.uint64)))

    def without(self, begin: np.ndarray, end: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Hash of the run without the word ``gap``; equals that of the run written so."""
        left = (self.sums[gap] - self.sums[begin]) * self.back[begin]
        right = (self.sums[end] - self.sums[gap + 1]) * self.back[begin + 1]
        return mixed(left + right + mixed((end - begin - 1).astype(np.uint64)))


def _half_keys(lines: Lines) -> np.ndarray:
    """Four keys per line: its first and its last half, as a line of its length and of one word less."""
    begin, end = lines.begin, lines.end
    keys = []
    for less in (0, 1):
        size = end - begin - less
        half = size // 2
        for tag, a, b in ((1, begin, begin + half), (2, end - (size - half), end)):
            keys.append(mixed(lines.run(a, b) + mixed(4 * size.astype(np.uint64) + np.uint64(tag))))
    return np.stack(keys, 1)


OCCURRENCE = T.StructType(
    [
        T.StructField(
            "lines",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("no", T.IntegerType()),
                        T.StructField("line", T.LongType()),
                        T.StructField("words", T.IntegerType()),
                        T.StructField("halves", T.ArrayType(T.LongType())),
                    ]
                )
            ),
        )
    ]
)


def _grouped(values: pa.Array, text_of: np.ndarray, texts: int) -> pa.Array:
    at = np.searchsorted(text_of, np.arange(texts + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), values)


def _fours(keys: np.ndarray) -> pa.Array:
    at = pa.array(np.arange(0, 4 * len(keys) + 1, 4, dtype=np.int32))
    return pa.ListArray.from_arrays(at, pa.array(keys.reshape(-1).view(np.int64)))


def occurrences(docs: DataFrame) -> DataFrame:
    """``doc_id, row, key, no, line, words, halves`` of every line with a word, stored; a text without
    lines has one row with nulls. ``key`` is a hash of the text."""

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        lines = Lines(*text_bytes(batch.column("text")))
        values = pa.StructArray.from_arrays(
            [
                pa.array(lines.number.astype(np.int32)),
                pa.array(lines.run(lines.begin, lines.end).view(np.int64)),
                pa.array((lines.end - lines.begin).astype(np.int32)),
                _fours(_half_keys(lines)),
            ],
            ["no", "line", "words", "halves"],
        )
        return {"lines": _grouped(values, lines.text_of, batch.num_rows)}

    keyed = docs.withColumn("key", F.xxhash64("text"))
    rows = map_texts(keyed, work, OCCURRENCE, carry=("doc_id", "key"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    exploded = rows.select("doc_id", "row", "key", F.explode_outer("lines").alias("l"))
    return materialize(exploded.select("doc_id", "row", "key", "l.*"), "lines")


def survivors(found: DataFrame) -> DataFrame:
    """``line, at, key`` of distinct lines that share a half with another one; ``at`` is the first place
    and ``key`` the hash of the text there."""
    keyed = found.filter(F.col("words") >= NEAR_WORDS - BOUND)
    place = F.min(F.struct("doc_id", "row", "no", "key")).alias("place")
    first = keyed.groupBy("line").agg(place, F.first("halves").alias("halves"))
    at = F.struct("place.doc_id", "place.row", "place.no").alias("at")
    first = materialize(first.select("line", at, "place.key", "halves"), "first_lines")
    halves = first.select("line", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("line").alias("lo"), F.max("line").alias("hi"))
    shared = shared.filter(F.col("lo") != F.col("hi")).select("half")
    lines = halves.join(shared, "half", "left_semi").select("line").distinct()
    return materialize(first.join(lines, "line", "left_semi").select("line", "at", "key"), "survivors")


VARIANT = T.StructType(
    [
        T.StructField(
            "found",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("line", T.LongType()),
                        T.StructField("words", T.StringType()),
                        T.StructField("gaps", T.ArrayType(T.LongType())),
                        T.StructField("lacks", T.ArrayType(T.LongType())),
                    ]
                )
            ),
        )
    ]
)


def wanted_lines(lines: DataFrame) -> DataFrame:
    """``id, text_key, wanted``: the lines asked of each text, so that a list is no longer than its text
    even where ids are null or repeated."""
    by = lines.groupBy(F.col("at.doc_id").alias("id"), F.col("key").alias("text_key"))
    return by.agg(F.collect_list("line").alias("wanted"))


def variants(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``line, words, gaps, lacks, at`` of the surviving lines, from the texts they first stand in.

    ``gaps`` are the keys of the line without one word and with the gap's place, ``lacks`` the hashes of
    the line without one word.
    """
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("text_key"))
    source = docs.join(wanted_lines(lines), same).select("text", "wanted")

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        lines = Lines(*text_bytes(batch.column("text")))
        keys = lines.run(lines.begin, lines.end).view(np.int64)
        want = batch.column("wanted")
        want_text = np.repeat(np.arange(batch.num_rows), want.value_lengths().to_numpy())
        asked = mixed(want.flatten().to_numpy().view(np.uint64) + want_text.astype(np.uint64))
        have = mixed(keys.view(np.uint64) + lines.text_of.astype(np.uint64))
        use = np.flatnonzero(np.isin(have, asked))
        begin, end = lines.begin[use], lines.end[use]
        size = end - begin
        done = np.cumsum(size)
        owner = np.repeat(np.arange(len(use)), size)
        within = np.arange(int(done[-1]) if len(done) else 0) - np.repeat(done - size, size)
        gap = begin[owner] + within
        lacks = lines.without(begin[owner], end[owner], gap)
        gaps = mixed(lacks + mixed((within + 1).astype(np.uint64)))
        at = pa.array(np.append(0, done).astype(np.int32))
        text = lines.data.tobytes()
        words = [
            b" ".join(text[lines.starts[w] : lines.ends[w]] for w in range(a, b)).decode("utf-8", "replace")
            for a, b in zip(begin.tolist(), end.tolist(), strict=True)
        ]
        values = pa.StructArray.from_arrays(
            [
                pa.array(keys[use]),
                pa.array(words, pa.string()),
                pa.ListArray.from_arrays(at, pa.array(gaps.view(np.int64))),
                pa.ListArray.from_arrays(at, pa.array(lacks.view(np.int64))),
            ],
            ["line", "words", "gaps", "lacks"],
        )
        return {"found": _grouped(values, lines.text_of[use], batch.num_rows)}

    made = map_texts(source, work, VARIANT, needs=("wanted",), carry=())
    rows = made.select(F.explode("found").alias("f")).select("f.*").dropDuplicates(["line"])
    return materialize(rows.join(lines.select("line", "at"), "line"), "variants")


def near_words(a: str, b: str) -> bool:
    """Whether at most one word has to be inserted, deleted or replaced."""
    x, y = (a, b) if len(a.split(" ")) >= len(b.split(" ")) else (b, a)
    x, y = x.split(" "), y.split(" ")
    if len(x) - len(y) > 1:
        return False
    i = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), len(y))
    return x[i + 1 :] == (y[i + 1 :] if len(x) == len(y) else y[i:])


def partners(rows: DataFrame) -> DataFrame:
    """``line, earliest``: the first place of the earliest other line that is truly near."""
    size = F.size("gaps")
    gaps = rows.filter(size >= NEAR_WORDS).select("line", "at", F.explode("gaps").alias("key"))
    first = gaps.groupBy("key").agg(F.min(F.struct("at", "line")).alias("best"), F.count("*").alias("n"))
    first = first.filter(F.col("n") > 1).select("key", "best")
    replaced = gaps.select("line", "key").join(first, "key").select("line", F.col("best.line").alias("other"))

    lacks = rows.filter(size > NEAR_WORDS).select("line", F.explode("lacks").alias("other"))
    shorter = rows.filter(size >= NEAR_WORDS).select(F.col("line").alias("whole"))
    lacking = lacks.join(shorter, F.col("other") == F.col("whole"), "left_semi")
    either = lacking.union(lacking.select(F.col("other").alias("line"), F.col("line").alias("other")))

    pairs = replaced.union(either).filter(F.col("line") != F.col("other")).distinct()
    pairs = materialize(pairs, "line_pairs")
    mine = rows.select("line", F.col("words").alias("w"), F.col("at").alias("a"))
    theirs = rows.select(F.col("line").alias("other"), F.col("words").alias("v"), F.col("at").alias("b"))
    both = pairs.join(mine, "line").join(theirs, "other").filter(F.col("b") < F.col("a"))
    place = rows.schema["at"].dataType

    def verify(batches):
        for batch in batches:
            near = [
                near_words(w, v)
                for w, v in zip(batch.column("w").to_pylist(), batch.column("v").to_pylist(), strict=True)
            ]
            yield batch.select(["line", "b"]).filter(pa.array(near, pa.bool_()))

    checked = both.select("line", "b", "w", "v").mapInArrow(
        verify, T.StructType([T.StructField("line", T.LongType()), T.StructField("b", place)])
    )
    return checked.groupBy("line").agg(F.min("b").alias("earliest"))


def decide(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, row, n_lines, n_equal, n_near, dropped``.

    ``dropped`` are the numbers (from 0) of the lines that go; ``n_equal`` of them repeat an earlier line
    and ``n_near`` are only near one.
    """
    source = docs.select(column(doc_id).alias("doc_id"), column(text).cast("string").alias("text"))
    found = occurrences(source)
    near = materialize(partners(variants(source, survivors(found))), "partners")
    lines = found.filter("line IS NOT NULL")
    place = F.min(F.struct("doc_id", "row", "no")).alias("first")
    first = lines.groupBy("line").agg(place, F.count(F.lit(1)).alias("n")).join(near, "line", "left")
    # Stored, so that the join below has plain sides and a very frequent line can be split.
    line = materialize(first.filter("n > 1 OR earliest IS NOT NULL").drop("n"), "repeated_lines")
    at = F.struct("doc_id", "row", "no")
    judged = found.select("doc_id", "row", "no", "line").join(line, "line", "left")
    judged = judged.withColumns(
        {"equal": F.coalesce(at > F.col("first"), F.lit(False)), "near": F.coalesce(at > F.col("earliest"), F.lit(False))}
    )
    gone = F.col("equal") | F.col("near")
    return judged.groupBy("doc_id", "row").agg(
        F.count("line").alias("n_lines"),
        F.count_if("equal").alias("n_equal"),
        F.count_if(~F.col("equal") & F.col("near")).alias("n_near"),
        F.array_sort(F.collect_list(F.when(gone, F.col("no")))).alias("dropped"),
    )


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the lines that go taken out of the text: one row for each row of ``docs``.

    Rows are numbered and stored first, so that a repeated or null id is told apart; of rows with equal ids the
    one with the smaller number is the earlier.
    """
    number = F.monotonically_increasing_id()
    numbered = docs.select(F.struct("*").alias("row"), column(text).alias("text"), F.struct(column(doc_id).alias("id"), number.alias("number")).alias("id"))
    stored = materialize(numbered, "numbered", rebalance=False)
    gone = decide(stored, "text", "id").filter(F.size("dropped") > 0)
    gone = gone.select(F.col("doc_id").getField("number").alias("number"), "dropped")
    joined = stored.select("row", F.col("id").getField("number").alias("number")).join(gone, "number", "left")
    whole = F.col("row").getField(text)
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    lines = F.filter(F.split(whole, "\n", -1), lambda _, i: ~F.array_contains(dropped, i))
    kept = F.when(whole.isNotNull(), F.array_join(lines, "\n"))
    return joined.select(F.col("row").withField(text, kept).alias("row")).select("row.*")
