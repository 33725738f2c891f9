"""Language-model scores by context-tree weighting over bytes, beside a unigram base.

A text is its words (lower-cased A-Z) with one space between them and one end byte, so that both models
give the probability of the same token sequence. Every byte is eight binary decisions; a decision node is a
prefix of the byte's bits under a context of the 0 to ``DEPTH`` bytes before it (end bytes before the text).

1. Texts go in blocks. A block sends each distinct gram (context and byte) and each distinct word once, with its
   count in learning texts. Spark adds them up.
2. From the longest contexts upwards, the decisions of all grams give each node its zeros and ones, the
   Krichevsky-Trofimov probability of them, and the weighted probability: half of it plus half of the product of
   its children's. At ``DEPTH`` it is the estimate alone. Grams that agree in the ``TOP`` nearest context bytes
   are a subtree of bounded size, computed in one task in arrays; above, nodes are rows and levels are aggregations.
3. Downwards, a node gets the posterior weight that its path ends there, and so the mixture of the estimates of
   all depths on its path; what weight is left goes to the deepest node with data. That is the chance of a one.
4. A gram's log probability is the sum over its eight decisions, each at the deepest node that learning texts
   have reached (a decision they never reached is even). It returns to the blocks that asked, which sum it by text.

Of the model only the two shallowest levels (65,535 nodes at most) are broadcast, nothing is collected; a block is bounded by bytes and by distinct grams, or is one
longer text. Counts stay as they are while scoring: no text learns from itself beyond what it gave to the counts.

Edge cases: null, empty and blank texts have the end token alone; repeated rows count and are scored alike; without
learning texts every bit is even and the base has N = 0 and V = 0; no rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featuretable.functions.predicates import column
from featuretable.llm.texts import LOWER, SPACE, SpanHash, bounded_batches, mixed, slices, spans, text_bytes
from featuretable.sources.scratch import materialize

DEPTH = 5
TOP = 3
PART_ROWS = 300_000
END, BLANK = 10, 32
SLICE = 2 << 20
BLOCK_BYTES = 32 << 20
BLOCK_KEYS = 3_000_000
GRAM, WORD = 1, 2
LN10 = math.log(10.0)


def sequences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the token sequences of texts and the offset of each."""
    data = LOWER[data]
    inside = ~SPACE[data]
    starts, stops, owner = spans(inside, offsets)
    texts = len(offsets) - 1
    per_text = np.bincount(owner, minlength=texts)
    blank = per_text == 0
    size = np.bincount(owner, weights=stops - starts + 1, minlength=texts).astype(np.int64) + blank
    ends = np.r_[0, np.cumsum(size)]
    out = np.full(ends[-1], BLANK, np.uint8)
    before = np.arange(len(starts)) + np.cumsum(blank)[owner]  # separators and lone ends in front of a word
    out[np.arange(inside.sum()) + np.repeat(before, stops - starts)] = data[inside]
    out[ends[1:] - 1] = END
    return out, ends


def grams(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One number for each byte: the ``DEPTH`` bytes before it (nearest lowest), then the byte."""
    code = symbols.astype(np.int64)
    place = np.arange(len(symbols)) - np.repeat(ends[:-1], np.diff(ends))
    for back in range(1, DEPTH + 1):
        earlier = np.full(len(symbols), END, np.int64)
        earlier[back:] = symbols[:-back]
        earlier[place < back] = END
        code |= earlier << (8 * back)
    return code


def word_keys(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each token of the sequences, in order; the end token is the empty one.

    Each token stands before a separator: a word before a space, or before an end that then stands for itself too.
    """
    hashed = SpanHash(symbols)
    cuts = np.flatnonzero((symbols == BLANK) | (symbols == END))
    starts = np.r_[0, cuts[:-1] + 1]
    keys = hashed.of(starts, cuts).astype(np.int64)
    empty = hashed.of(np.zeros(1, np.int64), np.zeros(1, np.int64)).astype(np.int64)[0]
    last = symbols[cuts] == END
    worded = cuts > starts
    # A word at the end of its text is followed by the end token.
    times = 1 + (last & worded)
    out = np.repeat(keys, times)
    out[np.cumsum(times)[last] - 1] = empty
    return out


def tokens_per_text(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    blanks = np.r_[0, np.cumsum(symbols == BLANK)]
    return blanks[ends[1:]] - blanks[ends[:-1]] + 1 + (np.diff(ends) > 1)


class Counted:
    """Distinct keys with their counts in learning texts, merged whenever enough have come together."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.limit = 0

    def add(self, keys: np.ndarray, learn: np.ndarray) -> None:
        for part, weight in ((keys[learn], 1), (keys[~learn], 0)):
            found, n = np.unique(part, return_counts=True)
            self.parts.append((found, n * weight))
            self.size += len(found)
        if self.size > self.limit:
            self.parts = [self.total()]
            self.size = len(self.parts[0][0])
            self.limit = 2 * self.size + 500_000

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        return keys[first], np.add.reduceat(n, first) if len(first) else n


def _pack(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values, "<i8").tobytes(), "zstd", asbytes=True)


def _unpack(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, 8 * n, "zstd", asbytes=True), "<i8")


BLOCK_KIND = "block long, kind int, size long, keys binary, counts binary, payload binary"
BLOCK_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
BLOCK_NAMES = ["block", "kind", "size", "keys", "counts", "payload"]


def blocks(docs: DataFrame) -> DataFrame:
    """Stored blocks of ``doc_id, learn, text`` rows: their grams and words (as differences), and their sequences."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        held, kept, size = {GRAM: Counted(), WORD: Counted()}, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            sink = io.BytesIO()
            codec = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
            with pa.ipc.new_stream(sink, kept[0].schema, options=codec) as stream:
                for rows in kept:
                    stream.write_batch(rows)
            rows = [(number, 0, 0, None, None, sink.getvalue())]
            for kind, counted in held.items():
                keys, n = counted.total()
                rows.append((number, kind, len(keys), _pack(np.diff(keys, prepend=0)), _pack(n), None))
            columns = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), BLOCK_TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, BLOCK_NAMES)

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                symbols, ends = sequences(*text_bytes(part.column("text")))
                learn = part.column("learn").to_numpy(zero_copy_only=False)
                held[GRAM].add(grams(symbols, ends), np.repeat(learn, np.diff(ends)))
                held[WORD].add(word_keys(symbols, ends), np.repeat(learn, tokens_per_text(symbols, ends)))
                listed = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(symbols)]
                )
                kept.append(part.drop_columns(["text"]).append_column("symbols", listed))
                size += len(symbols)
                if size >= BLOCK_BYTES or held[GRAM].size >= BLOCK_KEYS:
                    yield from flush()
                    number += 1
                    held, kept, size = {GRAM: Counted(), WORD: Counted()}, [], 0
        if kept:
            yield from flush()

    bounded_batches(docs.sparkSession)
    encoded = docs.select("doc_id", "learn", "text").mapInArrow(encode, BLOCK_KIND)
    return materialize(encoded, "blocks", rebalance=False)  # block numbers have to stay


def asked(stored: DataFrame, kind: int) -> DataFrame:
    """``block, key, n`` rows of the packed keys."""

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, size, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, n = np.cumsum(_unpack(keys, size)), _unpack(counts, size)
                for k in range(0, size, 100_000):
                    some = key[k : k + 100_000]
                    columns = [np.full(len(some), block), some, n[k : k + 100_000]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "key", "n"])

    packed = stored.filter(F.col("kind") == kind).select("block", "size", "keys", "counts")
    return packed.mapInArrow(unpack, "block long, key long, n long")


def _part(name: str = "key") -> Column:
    """The ``TOP`` context bytes next to a gram's byte; what shares them is one subtree."""
    return F.shiftright(name, 8).bitwiseAND(F.lit((1 << 8 * TOP) - 1))


def _shorter(depth: int, node: str = "node") -> Column:
    """The same decision under the context of the last ``depth`` bytes."""
    return F.col(node).bitwiseAND(F.lit(_mask(depth)))


def _mask(depth: int) -> int:
    return (1 << 8 * (depth + 1)) - 1


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series at x + 8, taken back by the recurrence."""
    product = x.copy()
    for k in range(1, 8):
        product *= x + k
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def _estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of ``a`` zeros and ``b`` ones."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1) - math.log(math.pi)


def _weighted(a: np.ndarray, b: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability of inner nodes, and the posterior share of their own estimate."""
    own, split = _estimate(a, b) - math.log(2), below - math.log(2)
    weight = np.logaddexp(own, split)
    return weight, np.exp(own - weight)


class Subtrees:
    """Decisions of grams and their nodes from ``DEPTH`` up to ``TOP``, as arrays by depth.

    Grams without learning count have nodes as well, with zero counts, which weigh nothing.
    """

    def __init__(self, key: np.ndarray, n: np.ndarray):
        byte, context = key & 255, (key >> 8) << 8
        steps = np.arange(8)[:, None]
        self.bit = (byte >> (7 - steps)) & 1
        flat = context | (1 << steps) | (byte >> (8 - steps))
        self.up: dict[int, np.ndarray] = {}  # from each node (each decision, at the deepest) to its parent's place
        self.node, self.a, self.b, self.stop = {}, {}, {}, {}
        node, self.place = np.unique(flat, return_inverse=True)
        self.place = self.place.reshape(flat.shape)
        weights = np.broadcast_to(n.astype(np.float64), flat.shape)
        ones = np.bincount(self.place.ravel(), (weights * self.bit).ravel(), len(node))
        zeros = np.bincount(self.place.ravel(), (weights * (1 - self.bit)).ravel(), len(node))
        weight, stop = _estimate(zeros, ones), np.ones(len(node))
        for depth in range(DEPTH, TOP - 1, -1):
            self.node[depth], self.a[depth], self.b[depth], self.stop[depth] = node, zeros, ones, stop
            if depth > TOP:
                node, up = np.unique(node & _mask(depth - 1), return_inverse=True)
                self.up[depth] = up
                zeros, ones, below = (np.bincount(up, x, len(node)) for x in (zeros, ones, weight))
                weight, stop = _weighted(zeros, ones, below)
        self.weight = weight  # at TOP

    def scores(self, mixed: np.ndarray, left: np.ndarray, one: np.ndarray) -> np.ndarray:
        """Log probability of each gram's byte, from what the nodes at ``TOP`` inherit."""
        for depth in range(TOP, DEPTH + 1):
            if depth > TOP:
                mixed, left, one = (x[self.up[depth]] for x in (mixed, left, one))
            a, b, stop = self.a[depth], self.b[depth], self.stop[depth]
            own = (b + 0.5) / (a + b + 1)
            one = np.where(a + b > 0, mixed + left * own, one)
            mixed, left = mixed + left * stop * own, left * (1 - stop)
        chance = one[self.place]
        return np.log(np.where(self.bit == 1, chance, 1 - chance)).sum(axis=0)


def _by_part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in tables of about ``PART_ROWS`` that end where a part ends."""
    held: list[pa.RecordBatch] = []
    size, limit = 0, PART_ROWS
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= limit:
            table = pa.Table.from_batches(held)
            part = table.column("part").to_numpy()
            cut = int(np.searchsorted(part, part[-1]))
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            size = table.num_rows - cut
            limit = max(PART_ROWS, 2 * size)
    if held:
        yield pa.Table.from_batches(held)


def tops(counts: DataFrame) -> DataFrame:
    """``node, a, b, weight, stop`` at depth ``TOP`` of ``part, key, n`` rows."""

    def lift(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_part(batches):
            tree = Subtrees(table.column("key").to_numpy(), table.column("n").to_numpy())
            columns = [tree.node[TOP], tree.a[TOP], tree.b[TOP], tree.weight, tree.stop[TOP]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "a", "b", "weight", "stop"])

    rows = counts.repartition("part").sortWithinPartitions("part")
    return rows.mapInArrow(lift, "node long, a double, b double, weight double, stop double")


def _lifted(level: DataFrame, depth: int) -> DataFrame:
    """``node, a, b, weight, stop`` of the next level up."""
    up = level.groupBy(_shorter(depth).alias("node")).agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("weight").alias("below")
    )

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, below = (batch.column(n).to_numpy() for n in ("a", "b", "below"))
            made = [pa.array(x) for x in _weighted(a, b, below)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("node", "a", "b")), *made], ["node", "a", "b", "weight", "stop"])

    return up.mapInArrow(weigh, "node long, a double, b double, weight double, stop double")


def inherited(top: DataFrame) -> DataFrame:
    """``node, mixed, left, one`` for the nodes at ``TOP``: what shallower nodes say, and the weight they leave.

    ``one`` is the chance of a one if the node itself has no data: that of the deepest shallower node with data.
    """
    levels = {TOP: top.filter("a + b > 0")}
    for depth in range(TOP - 1, -1, -1):
        levels[depth] = materialize(_lifted(levels[depth + 1], depth), f"nodes{depth}")
    own = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1.0)
    above: DataFrame | None = None
    rows = top.select("node")
    for depth in range(TOP):
        level = levels[depth]
        if above is None:
            level = level.withColumns({"mixed": F.lit(0.0), "left": F.lit(1.0)})
        else:
            parents = above.select(F.col("node").alias("parent"), "mixed", "left")
            level = level.withColumn("parent", _shorter(depth - 1)).join(_bounded(parents, depth - 1), "parent")
        own_part = F.col("left") * F.col("stop") * own
        level = level.select(
            "node", (F.col("mixed") + F.col("left") * own).alias("one"), (F.col("mixed") + own_part).alias("mixed"),
            (F.col("left") * (1 - F.col("stop"))).alias("left"),
        )
        above = materialize(level, f"mixtures{depth}")
        named = above.select(F.col("node").alias(f"n{depth}"), *(F.col(c).alias(f"{c}{depth}") for c in ("one", "mixed", "left")))
        rows = rows.withColumn(f"n{depth}", _shorter(depth)).join(_bounded(named, depth), f"n{depth}", "left")
    deepest = [F.col(f"one{d}") for d in range(TOP - 1, -1, -1)]
    return rows.select(
        "node", F.coalesce(f"mixed{TOP - 1}", F.lit(0.0)).alias("mixed"), F.coalesce(f"left{TOP - 1}", F.lit(0.0)).alias("left"),
        F.coalesce(*deepest, F.lit(0.5)).alias("one"),
    )


def _bounded(level: DataFrame, depth: int) -> DataFrame:
    """A level of at most 255 * 256 ** depth nodes; the first two (65,280 rows at most) are broadcast."""
    return F.broadcast(level) if depth < 2 else level


def gram_scores(counts: DataFrame) -> DataFrame:
    """``key, value`` of all ``key, n`` rows: natural log of the chance of each gram's byte after its context.

    A part holds at most 256 ** (DEPTH - TOP + 1) grams, and tasks take parts one after the other.
    """
    rows = counts.select(_part().alias("part"), "key", "n")
    top = materialize(tops(rows), "tops", rebalance=False)
    none = F.lit(None)
    given = inherited(top).select(
        F.shiftright("node", 8).alias("part"), F.lit(0).alias("gram"), F.col("node").alias("key"),
        none.cast("long").alias("n"), "mixed", "left", "one",
    )
    empty = none.cast("double")
    asked_for = rows.select("part", F.lit(1).alias("gram"), "key", "n", empty, empty, empty)

    def lower(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_part(batches):
            gram = table.column("gram").to_numpy() == 1
            key, n = table.column("key").to_numpy()[gram], table.column("n").to_numpy()[gram]
            tree = Subtrees(key, n.astype(np.int64))
            nodes = table.column("key").to_numpy()[~gram]
            order = np.argsort(nodes)
            at = order[np.searchsorted(nodes, tree.node[TOP], sorter=order)]
            above = (table.column(c).to_numpy()[~gram][at] for c in ("mixed", "left", "one"))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(tree.scores(*above))], ["key", "value"])

    both = given.unionAll(asked_for).repartition("part").sortWithinPartitions("part")
    return both.mapInArrow(lower, "key long, value double")


class Found:
    """Values by key, for keys that are all there: the leading bits of a mixed key say where its search starts."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        spread = mixed(keys.view(np.uint64))
        order = np.argsort(spread)
        self.spread, self.values = spread[order], values[order]
        bits = max(4, len(keys).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.spread, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        wanted = mixed(keys.view(np.uint64))
        at = self.first[wanted >> self.shift]
        late = np.flatnonzero(self.spread[at] != wanted)
        while late.size:
            at[late] += 1
            late = late[self.spread[at[late]] != wanted[late]]
        return self.values[at]


def score(docs: DataFrame, learn: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of every row."""
    rows = docs.select(
        column(doc_id).alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), column(text).cast("string").alias("text")
    )
    stored = blocks(rows)
    added = F.sum("n").alias("n")
    gram_counts = materialize(asked(stored, GRAM).groupBy("key").agg(added), "gram_counts", rebalance=False)
    word_counts = materialize(asked(stored, WORD).groupBy("key").agg(added), "word_counts", rebalance=False)
    total, distinct = word_counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    scores = materialize(gram_scores(gram_counts), "gram_scores", rebalance=False)
    values = _answers(stored, GRAM, scores).unionAll(
        _answers(stored, WORD, word_counts.select("key", F.col("n").cast("double").alias("value")))
    )
    payload = stored.filter("kind = 0").select("block", "payload")
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = (
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double, bits_per_byte double"
    )

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        which, keys, value = (right.column(n).to_numpy() for n in ("kind", "key", "value"))
        of = {k: Found(keys[which == k], value[which == k]) for k in (GRAM, WORD)}
        made = []
        for blob in left.column("payload").to_pylist():
            for batch in pa.ipc.open_stream(blob):
                made.append(_scored(batch, of, total, distinct))
        return pa.Table.from_batches(made)

    return payload.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(meet, out)


def _answers(stored: DataFrame, kind: int, values: DataFrame) -> DataFrame:
    wanted = asked(stored, kind).select("block", "key")
    return wanted.join(values, "key").select("block", F.lit(kind).alias("kind"), "key", "value")


def _scored(batch: pa.RecordBatch, of: dict[int, Found], total: int, distinct: int) -> pa.RecordBatch:
    packed = batch.column("symbols")
    ends = np.frombuffer(packed.buffers()[1], np.int64, len(packed) + 1)
    symbols = np.frombuffer(packed.buffers()[2] or b"", np.uint8, int(ends[-1]))
    size = np.diff(ends)
    score = np.add.reduceat(of[GRAM](grams(symbols, ends)), ends[:-1]) / LN10
    count = of[WORD](word_keys(symbols, ends))
    tokens = tokens_per_text(symbols, ends)
    first = np.cumsum(tokens) - tokens
    base = np.add.reduceat(np.log10((count + 1) / (total + distinct + 1)), first)
    columns = [
        batch.column("doc_id"), pa.array(~batch.column("learn").to_numpy(zero_copy_only=False)),
        pa.array(tokens.astype(np.int64)), pa.array(np.add.reduceat((count > 0).astype(np.int64), first)),
        pa.array(np.full(len(size), total)), pa.array(base), pa.array(score),
        pa.array(-score * (LN10 / math.log(2)) / size),
    ]
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    return pa.RecordBatch.from_arrays(columns, names)
