"""Quality classifier: perplexity under a language model of trusted text, by sharded count joins.

1. Of the trusted documents one in ``HELD_OUT`` (by a hash of the text, so equal texts go together) only sets
   limits. The others give their character 4-grams (symbols of ``charlm``), by language; Spark counts them.
   In a language where all trusted texts fall to the limits, all of them give 4-grams too.
2. The interpolated modified Kneser-Ney model of each language is computed on the count tables by
   aggregations and joins on (language, n-gram): continuation counts, discounts, context totals, then
   probabilities from order 1 upwards.
3. All documents are encoded in blocks of about ``BLOCK_BYTES``. A block sends every distinct (language,
   n-gram) once, so what is shuffled is far less than the text. These are joined with the count model
   (left joins by order, with back-off weights where an n-gram is unknown).
4. The joined probabilities return to their block and meet its texts, compressed; each document gets
   its log perplexity. No model is broadcast or collected.
5. A text's score is its log perplexity less ``SLACK / sqrt(characters)``, the spread that a short text has
   by chance, so texts of all lengths count alike. A document is rejected where its score is above the limit
   of its language: the ``QUANTILE`` of the scores of held-out trusted texts, or that of the texts the model
   has learned from where this is greater (few or no held-out texts).

Edge cases: a null, empty or blank text has no perplexity and is not kept. Languages without trusted text
(null is a language of its own) have no model: perplexity null, kept, marked ``judged`` false; trusted texts may be
as short as they like. Repeated rows are judged alike. No trusted text at all leaves every document unjudged. Extra
columns are ignored.
"""

from __future__ import annotations

import bz2
import io
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featuretable.functions.predicates import column
from featuretable.llm import charlm
from featuretable.llm.joins import narrow
from featuretable.llm.texts import bounded_batches, slices, text_bytes
from featuretable.sources.scratch import materialize

ORDER = 4
BLOCK_BYTES = 32 << 20
QUANTILE = 0.999
HELD_OUT = 5
SLACK = 5.0
NONE = ""  # stands for a null language inside the joins
LEARNS, LIMITS = 1, 2  # parts of trusted rows


def trusted_counts(docs: DataFrame) -> DataFrame:
    """``lang, gram, n`` over the texts that the model learns from."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, charlm.Tally] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in dict.fromkeys(langs.tolist()):
                rows = batch.filter(pa.array(langs == lang))
                own = held.setdefault(lang, charlm.Tally())
                for part in slices(rows, "text"):
                    own.add(charlm.codes(*text_bytes(part.column("text")), ORDER)[0])
        for lang, own in held.items():
            code, n = own.total()
            for k in range(0, len(code), 100_000):
                some = code[k : k + 100_000].view(np.int64)
                counts = n[k : k + 100_000].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some)), pa.array(some), pa.array(counts)],
                    ["lang", "gram", "n"],
                )

    partial = docs.filter(F.col("part") == LEARNS).select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    return partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _tail(m: int) -> Column:
    return F.col("gram") if m == charlm.LONGEST else F.col("gram").bitwiseAND(F.lit(charlm.tail_mask(m)))


def _context(gram: Column) -> Column:
    low = F.shiftright(gram.bitwiseAND(F.lit((1 << charlm.LOW) - 1)), charlm.BITS)
    high = F.shiftleft(F.shiftrightunsigned(gram, charlm.LOW + charlm.UPPER), charlm.LOW)
    return low.bitwiseOR(high)


def model(counts: DataFrame, order: int = ORDER) -> tuple[dict[int, DataFrame], dict[int, DataFrame]]:
    """Per order: ``lang, gram, logp``, and per order the contexts' ``lang, gram, logw``."""
    levels = {order: counts}
    for m in range(order - 1, 0, -1):
        longer = levels[m + 1].select("lang", _tail(m).alias("gram"))
        levels[m] = longer.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))
    probabilities: dict[int, DataFrame] = {}
    weights: dict[int, DataFrame] = {}
    for m in range(1, order + 1):
        level = levels[m]
        n = F.col("n")
        seen = level.groupBy("lang").agg(*(F.count_if(n == k).alias(f"n{k}") for k in (1, 2, 3, 4)))
        n1, n2, n3, n4 = (F.col(f"n{k}").cast("double") for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        known = (n1 > 0) & (n2 > 0)
        clip = lambda d, top: F.least(F.greatest(d, F.lit(0.01)), F.lit(top))
        cuts = seen.select(
            F.col("lang"),
            F.when(known, clip(1 - 2 * y * n2 / n1, 1.0)).otherwise(0.5).alias("d1"),
            F.when(known, clip(2 - 3 * y * n3 / n2, 2.0)).otherwise(0.75).alias("d2"),
            F.when(known & (n3 > 0), clip(3 - 4 * y * n4 / n3, 3.0)).otherwise(0.75).alias("d3"),
        )
        cut = F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
        level = level.join(cuts, "lang").select("lang", "gram", "n", cut.alias("cut"), _context(F.col("gram")).alias("ctx"))
        totals = level.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.sum("cut").alias("free"))
        totals = totals.withColumn("weight", F.col("free") / F.col("total")).drop("free")
        level = level.join(totals, ["lang", "ctx"])
        if m == 1:
            level = level.withColumn("lower", F.lit(1.0 / charlm.LETTERS))
        else:
            below = probabilities[m - 1].select("lang", F.col("gram").alias("tail"), F.exp("logp").alias("lower"))
            level = level.withColumn("tail", _tail(m - 1)).join(below, ["lang", "tail"])
        p = (F.col("n") - F.col("cut")) / F.col("total") + F.col("weight") * F.col("lower")
        probabilities[m] = materialize(level.select("lang", "gram", F.log(p).alias("logp")), f"kn{m}", rebalance=False)
        weight = F.log(F.greatest("weight", F.lit(1e-30)))
        weights[m] = materialize(totals.select("lang", F.col("ctx").alias("gram"), weight.alias("logw")), f"knw{m}", rebalance=False)
    return probabilities, weights


def grams_scored(
    asked: DataFrame, probabilities: dict[int, DataFrame], weights: dict[int, DataFrame], order: int = ORDER
) -> DataFrame:
    """``lang, gram, logp, logp_new`` of distinct n-grams; null where the language has no model. ``logp_new`` is
    that of the last ``order - 1`` symbols by continuation counts."""
    found = asked
    for m in range(order, 0, -1):
        p = probabilities[m].select("lang", F.col("gram").alias(f"g{m}"), F.col("logp").alias(f"p{m}"))
        w = weights[m].select("lang", F.col("gram").alias(f"c{m}"), F.col("logw").alias(f"w{m}"))
        found = found.withColumns({f"g{m}": _tail(m), f"c{m}": _context(_tail(m))})
        found = found.join(p, ["lang", f"g{m}"], "left").join(w, ["lang", f"c{m}"], "left")
    logp = shorter = F.lit(-float(np.log(charlm.LETTERS)))
    for m in range(1, order + 1):
        shorter = logp
        logp = F.coalesce(F.col(f"p{m}"), F.coalesce(F.col(f"w{m}"), F.lit(0.0)) + shorter)
    modelled = F.col("w1").isNotNull()
    scores = (F.when(modelled, x).alias(n) for x, n in ((logp, "logp"), (shorter, "logp_new")))
    return found.select("lang", "gram", *scores)


def blocks(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``block, payload`` with the symbols and other columns of a run of documents, and ``block, lang, grams``;
    stored.

    Written once, so that block numbers agree in everything that follows. Symbols and n-grams are kept
    as planes of bytes, of which the upper ones are mostly zeros.
    """

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        names = ["block", "lang", "grams", "payload"]
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary()]
        held: dict[str, list[np.ndarray]] = {}
        kept: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, kept[0].schema) as stream:
                for b in kept:
                    stream.write_batch(b)
            rows = [(number, None, None, bz2.compress(sink.getvalue()))]  # the smallest of the usual ones for symbols
            for lang, parts in held.items():
                rows.append((number, lang, _planes(np.unique(np.concatenate(parts))), None))
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names
            )

        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                symbols, ends = charlm.letters(data, offsets)
                code = charlm.codes_of(symbols, ends, order)
                langs = np.array(part.column("lang").to_pylist(), object)
                owner = np.repeat(np.arange(part.num_rows), np.diff(ends))
                for lang in dict.fromkeys(langs.tolist()):
                    held.setdefault(lang, []).append(np.unique(code[(langs == lang)[owner]]))
                rows = part.drop_columns(["text"])
                for name, plane in (("low", symbols & 0xFF), ("high", symbols >> 8)):
                    at = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(plane.astype(np.uint8))]
                    rows = rows.append_column(name, pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, at))
                kept.append(rows)
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield from flush()
                    number, size, held, kept = number + 1, 0, {}, []
        if kept:
            yield from flush()

    kind = "block long, lang string, grams binary, payload binary"
    bounded_batches(docs.sparkSession)
    encoded = docs.mapInArrow(encode, kind)
    return materialize(encoded, "blocks", rebalance=False)  # blocks are of even size already


def _planes(code: np.ndarray) -> bytes:
    return code.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)


def unpacked(packed: DataFrame) -> DataFrame:
    """``block, lang, gram`` rows of the packed n-grams."""

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lang, grams in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                code = _from_planes(grams)
                for k in range(0, len(code), 100_000):
                    some = code[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), block)), pa.array([lang] * len(some)), pa.array(some)],
                        ["block", "lang", "gram"],
                    )

    return packed.mapInArrow(unpack, "block long, lang string, gram long")


Finish = Callable[[pa.RecordBatch, np.ndarray, np.ndarray, dict[str, charlm.HashArrays]], dict[str, pa.Array]]


def met(stored: DataFrame, back: DataFrame, values: Sequence[str], out: T.StructType, order: int, finish: Finish) -> DataFrame:
    """Columns ``out`` of every document: the ``values`` of the n-grams asked by a block meet its texts.

    ``back`` has ``block, lang, gram`` and the values; ``finish`` gets rows of a block, the n-gram of each
    character, the end of each text in them, and by language a hash array with a row of values for each n-gram.
    """
    names = out.fieldNames()

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        langs = pc.dictionary_encode(right.column("lang")).combine_chunks()
        if isinstance(langs, pa.ChunkedArray):  # of a table without rows
            langs = pa.array([], pa.string()).dictionary_encode()
        which = langs.indices.to_numpy()
        gram = right.column("gram").to_numpy().astype(np.uint64)
        value = np.stack([right.column(n).to_numpy() for n in values], 1)
        tables = {
            name: charlm.HashArrays(gram[which == i], value[which == i])
            for i, name in enumerate(langs.dictionary.to_pylist())
        }
        made = []
        for blob in left.column("payload").to_pylist():
            for batch in pa.ipc.open_stream(bz2.decompress(blob)):
                low, high = (batch.column(n) for n in ("low", "high"))
                ends = np.frombuffer(low.buffers()[1], np.int64, len(low) + 1)
                planes = (np.frombuffer(x.buffers()[2] or b"", np.uint8, int(ends[-1])) for x in (low, high))
                symbols, upper = (x.astype(np.uint16) for x in planes)
                code = charlm.codes_of(symbols | upper << 8, ends, order)
                found = finish(batch, code, ends, tables)
                columns = [found[n] if n in found else batch.column(n) for n in names]
                made.append(pa.RecordBatch.from_arrays(columns, names))
        return pa.Table.from_batches(made)

    payload = stored.filter("payload IS NOT NULL").select("block", "payload")
    return payload.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(meet, out)


def own_means(values: Sequence[str], columns: Sequence[str]) -> Finish:
    """Log perplexities of texts under the model of their own language, null where it has none."""

    def finish(batch, code, ends, tables):
        langs = np.array(batch.column("lang").to_pylist(), object)
        length = np.diff(ends)
        owner = np.repeat(np.arange(batch.num_rows), length)
        value = np.zeros((len(code), len(values)), np.float32)
        unknown = np.ones(batch.num_rows, bool)
        for name, table in tables.items():
            rows = langs == name
            unknown &= ~rows
            use = rows[owner]
            value[use] = table.find(code[use])[0]
        made = {"n_chars_scored": pa.array(length)}
        for i, name in enumerate(columns):
            mean = -charlm.text_sums(value[:, i], ends) / np.maximum(length, 1)
            made[name] = pa.array(mean, mask=unknown | (length == 0))
        return made

    return finish


def asked_grams(stored: DataFrame) -> DataFrame:
    """``block, lang, gram``: every n-gram of a block and language once."""
    return unpacked(stored.filter("grams IS NOT NULL").select("block", "lang", "grams"))


def scored_fields(docs: DataFrame, *names: str) -> T.StructType:
    """The columns of ``docs`` but for the text, the characters scored and the scores."""
    kept = [f for f in docs.schema if f.name != "text"]
    more = [T.StructField("n_chars_scored", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in names)]
    return T.StructType([*kept, *more])


def perplexities(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, part, n_chars_scored, log_perplexity`` of ``doc_id, lang, part, text`` rows."""
    stored = blocks(docs)
    asked = asked_grams(stored)
    counts = materialize(trusted_counts(docs), "trusted_counts", rebalance=False)  # each order of the model reads it
    known = grams_scored(asked.select("lang", "gram").distinct(), *model(counts)).drop("logp_new")
    back = asked.join(known.filter("logp IS NOT NULL"), ["lang", "gram"])
    out = scored_fields(docs, "log_perplexity")
    return met(stored, back, ["logp"], out, ORDER, own_means(["logp"], ["log_perplexity"]))


def both_scores(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """``docs`` (``text`` and any other columns) with ``n_chars_scored, log_perplexity, log_continuation`` in place
    of the text, under one model of ``gram, n`` counts."""
    docs = docs.withColumn("lang", F.lit(NONE))
    stored = blocks(docs)
    asked = asked_grams(stored)
    tables = model(counts.select(F.lit(NONE).alias("lang"), "gram", "n"))
    back = asked.join(grams_scored(asked.select("lang", "gram").distinct(), *tables), ["lang", "gram"])
    names, values = ["log_perplexity", "log_continuation"], ["logp", "logp_new"]
    return met(stored, back, values, scored_fields(docs, *names), ORDER, own_means(values, names)).drop("lang")


def parted(rows: DataFrame) -> DataFrame:
    """``doc_id, lang, part, text`` of ``doc_id, lang, trusted, text`` rows: ``LEARNS``, ``LIMITS``, or 0 if not trusted."""
    held = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0
    learning = rows.filter(F.col("trusted") & ~held & F.col("text").rlike(r"\S"))
    learning = learning.select(F.col("lang").alias("learned_lang")).distinct()
    told = rows.join(narrow(learning), F.col("lang") == F.col("learned_lang"), "left")
    limits = held & F.col("learned_lang").isNotNull()
    part = F.when(F.col("trusted") & limits, LIMITS).when(F.col("trusted"), LEARNS).otherwise(0)
    return told.select("doc_id", "lang", part.alias("part"), "text")


def verdicts(scored: DataFrame) -> DataFrame:
    """One row for each of ``doc_id, lang, part, n_chars_scored, log_perplexity``, with ``judged`` and ``kept``."""
    x, n = F.col("log_perplexity"), F.col("n_chars_scored")
    value = x - SLACK / F.sqrt(F.greatest(n, F.lit(1)))

    def limit(part: int) -> Column:
        return F.percentile_approx(F.when(F.col("part") == part, value), QUANTILE, 10_000)

    limits = (
        scored.filter((F.col("part") > 0) & x.isNotNull())
        .groupBy(F.col("lang").alias("limit_lang"))
        .agg(F.greatest(limit(LIMITS), limit(LEARNS)).alias("limit"))
    )
    judged = scored.join(narrow(limits), F.col("lang") == F.col("limit_lang"), "left")
    return judged.select(
        "doc_id",
        F.nullif("lang", F.lit(NONE)).alias("lang"),
        "n_chars_scored",
        F.exp(x).alias("perplexity"),
        (x.isNotNull() & F.col("limit").isNotNull()).alias("judged"),
        (F.coalesce(value <= F.col("limit"), F.lit(True)) & (n > 0)).alias("kept"),
    )


def classify(docs: DataFrame, trusted: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, lang, n_chars_scored, perplexity, judged, kept``."""
    rows = docs.select(
        column(doc_id).alias("doc_id"),
        F.coalesce(column(lang).cast("string"), F.lit(NONE)).alias("lang"),
        F.coalesce(trusted, F.lit(False)).alias("trusted"),
        column(text).cast("string").alias("text"),
    )
    return verdicts(materialize(perplexities(parted(rows)), "perplexities", rebalance=False))
