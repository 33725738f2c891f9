"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

1. Every labelled learning text gives the set of its hashed character n-grams (3 to 5 symbols of the
   folded alphabet of ``charlm``, within ``1 << HASH_BITS`` slots). Spark counts texts with each slot, by
   label, over all labelled rows; a slot that n-grams of several orders hit counts once for a text, as in scoring.
2. Slot j has the ratio ``r_j = log((p_j + a) / P) - log((q_j + a) / Q)``. The ``FEATURES`` slots whose
   presence tells most (mutual information with the label) become features with the value ``r_j``
   where present.
3. A logistic regression on these features is fitted with an L2 penalty by Newton steps. The fit
   reads at most ``FIT_ROWS`` labelled rows (smallest hashes of the id, half from each label where
   there are as many), a documented bound; ratios and features come from all labelled rows.
   Rows are weighted so that each label has half of the weight, whatever the size of the table and of
   the sample: a score of one half is the same operating point for both.
4. Every text is scored; only its text is used.

Model sizes are fixed: slots and features do not grow with the corpus.

Edge cases: a null or empty text has no feature and gets the score of the intercept. Texts are read
whole. Null labels are ignored; documents labelled twice learn from each label. With one label only,
or none, every text gets the share of label 1 (one half if there is no label). Repeated rows are scored
alike; extra columns travel along if carried.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featuretable.functions.predicates import column
from featuretable.llm import charlm
from featuretable.llm.joins import narrow
from featuretable.llm.texts import bounded_batches, map_texts, slices, text_bytes

ORDERS = (3, 4, 5)
HASH_BITS = 20
FEATURES = 4096
SMOOTH = 1.0
FIT_ROWS = 20_000
PENALTY = 1.0
STEPS = 300

OUT = T.StructType([T.StructField("score", T.DoubleType())])


def slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot of every n-gram (a row for each order) and the offset of each text in them."""
    code, ends = charlm.grams(data, offsets, max(ORDERS))
    shift = np.uint32(32 - HASH_BITS)
    rows = []
    for m in ORDERS:
        part = code & np.uint32((1 << charlm.BITS * m) - 1)
        rows.append(((part + np.uint32(m << 29)) * np.uint32(0x85EBCA6B)) >> shift)
    return np.stack(rows), ends


def _pairs(found: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, slot) pairs over all orders."""
    text_of = np.repeat(np.arange(len(ends) - 1, dtype=np.uint64), np.diff(ends))
    key = np.unique((text_of << np.uint64(HASH_BITS)) | found.astype(np.uint64))
    return (key >> np.uint64(HASH_BITS)).astype(np.int64), (key & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64)


def slot_counts(labelled: DataFrame) -> DataFrame:
    """``slot, n0, n1``: labelled texts (``text``, ``y``) with each slot; slot -1 counts all texts."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 << HASH_BITS), np.uint32)
        texts = np.zeros(2, np.int64)
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                y = part.column("y").to_numpy()
                text_of, slot = _pairs(*slots(*text_bytes(part.column("text"))))
                for label in (0, 1):
                    some, n = np.unique(slot[y[text_of] == label], return_counts=True)
                    held[label][some] += n.astype(np.uint32)
                texts += np.bincount(y, minlength=2)
        some = np.flatnonzero(held.any(axis=0))
        slot = np.append(some, -1)
        counts = np.concatenate([held[:, some].astype(np.int64), texts[:, None]], axis=1)
        for k in range(0, len(slot), 100_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot[k : k + 100_000]), *(pa.array(c[k : k + 100_000]) for c in counts)],
                ["slot", "n0", "n1"],
            )

    bounded_batches(labelled.sparkSession)
    partial = labelled.select("text", "y").mapInArrow(count, "slot long, n0 long, n1 long")
    return partial.groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


class Model:
    """Slots of the features, their ratios, and a weight for each; ``bias`` alone without features."""

    def __init__(self, slot: np.ndarray, ratio: np.ndarray):
        self.slot, self.ratio = slot, ratio
        self.weights, self.bias = np.zeros(len(slot)), 0.0
        self.number = np.full(1 << HASH_BITS, -1, np.int16)
        self.number[slot] = np.arange(len(slot))

    def present(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, feature) pairs."""
        found, ends = slots(data, offsets)
        texts = len(ends) - 1
        keys = []
        for row in found:
            feature = self.number[row]
            hit = np.flatnonzero(feature >= 0)
            text_of = np.searchsorted(ends, hit, "right") - 1
            keys.append(text_of * FEATURES + feature[hit])
        key = np.unique(np.concatenate(keys)) if texts else np.zeros(0, np.int64)
        return key // FEATURES, key % FEATURES

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        text_of, feature = self.present(data, offsets)
        value = np.bincount(text_of, weights=(self.weights * self.ratio)[feature], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(value + self.bias, -30, 30)))


def choose(counts: pa.Table) -> tuple[Model, float]:
    """Model without weights, from slot counts (at most 2**HASH_BITS rows), and the share of label 1."""
    slot, n0, n1 = (counts.column(c).to_numpy().astype(np.float64) for c in ("slot", "n0", "n1"))
    whole = slot == -1
    t0, t1 = (float(n[whole].sum()) for n in (n0, n1))
    share = t1 / (t0 + t1) if t0 + t1 else 0.5
    slot, n0, n1 = slot[~whole].astype(np.int64), n0[~whole], n1[~whole]
    if not t0 or not t1:
        return Model(np.zeros(0, np.int64), np.zeros(0)), share
    p, q = (n1 + SMOOTH) / (t1 + 2 * SMOOTH), (n0 + SMOOTH) / (t0 + 2 * SMOOTH)
    any_ = share * p + (1 - share) * q
    gain = share * (p * np.log(p / any_) + (1 - p) * np.log((1 - p) / (1 - any_))) + (1 - share) * (
        q * np.log(q / any_) + (1 - q) * np.log((1 - q) / (1 - any_))
    )
    best = np.lexsort((slot, -gain))[:FEATURES]
    ratio = np.log((n1[best] + SMOOTH) / (n1.sum() + SMOOTH)) - np.log((n0[best] + SMOOTH) / (n0.sum() + SMOOTH))
    # The ratio of totals is the same for all slots; without it a slot tells by presence alone.
    ratio += np.log((n1.sum() + SMOOTH) / (t1 + SMOOTH)) - np.log((n0.sum() + SMOOTH) / (t0 + SMOOTH))
    return Model(slot[best], ratio), share


def solve(model: Model, rows: np.ndarray, features: np.ndarray, y: np.ndarray) -> None:
    """Set weights and bias by accelerated gradient steps on the penalised log loss, labels weighing alike."""
    value = model.ratio[features]
    n, m = len(y), len(model.ratio)
    if not n or y.min() == y.max():
        share = (y.sum() + 0.5) / (n + 1)
        model.bias = float(np.log(share / (1 - share)))
        return
    weight = n / 2 / np.bincount(y.astype(np.int64))[y.astype(np.int64)]
    squares = np.bincount(rows, weights=value**2, minlength=n)
    # A bound of the curvature: the largest eigenvalue by power iteration.
    v = np.ones(m + 1)
    for _ in range(15):
        z = weight * (np.bincount(rows, weights=value * v[features], minlength=n) + v[m])
        v = np.append(np.bincount(features, weights=value * z[rows], minlength=m), z.sum())
        top = np.linalg.norm(v)
        v /= top
    rate = 1 / (0.25 * max(top, (weight * (squares + 1)).max()) * 1.1 + PENALTY)
    w = np.zeros(m + 1)
    ahead, t = w, 1.0
    for _ in range(STEPS):
        z = np.bincount(rows, weights=value * ahead[features], minlength=n) + ahead[m]
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        slope = np.append(np.bincount(features, weights=value * error[rows], minlength=m), error.sum())
        slope[:m] += PENALTY * ahead[:m]
        after = ahead - rate * slope
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = after + (t - 1) / t_next * (after - w)
        w, t = after, t_next
    model.weights, model.bias = w[:m], float(w[m])


def fit(labelled: DataFrame, seed: str = "toxicity") -> Model:
    """Model of ``labelled`` rows ``doc_id, text, y`` (0 or 1)."""
    model, share = choose(slot_counts(labelled).toArrow())
    if not len(model.slot):
        share = min(max(share, 1e-6), 1 - 1e-6)
        model.bias = float(np.log(share / (1 - share)))
        return model
    held = labelled.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        data, offsets = text_bytes(batch.column("text"))
        text_of, feature = held.value.present(data, offsets)
        at = np.searchsorted(text_of, np.arange(len(offsets)))
        return {"features": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(feature.astype(np.int32)))}

    out = T.StructType([T.StructField("features", T.ArrayType(T.IntegerType()))])
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed))
    halves = [
        labelled.filter(F.col("y") == label).orderBy(order, "doc_id").limit(FIT_ROWS // 2)
        for label in (0, 1)
    ]
    ids = halves[0].select("doc_id").union(halves[1].select("doc_id"))
    some = labelled.join(F.broadcast(ids.distinct()), "doc_id", "left_semi")
    table = map_texts(some, work, out, carry=("y",)).toArrow().combine_chunks()
    listed = table.column("features").combine_chunks()
    if isinstance(listed, pa.ChunkedArray):
        listed = listed.chunk(0) if listed.num_chunks else pa.array([], pa.list_(pa.int32()))
    length = listed.value_lengths().to_numpy()
    rows = np.repeat(np.arange(len(length)), length)
    solve(model, rows, listed.flatten().to_numpy(), table.column("y").to_numpy().astype(np.float64))
    return model


def labelled_rows(docs: DataFrame, labels: DataFrame, learn, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """``doc_id, text, y`` of the documents with a label among the rows where ``learn`` holds."""
    marks = labels.select(column(doc_id).alias("doc_id"), column(label).cast("int").alias("y"))
    marks = marks.filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    source = docs.select(column(doc_id).alias("doc_id"), column(text).alias("text")).filter(learn)
    return source.join(narrow(marks), "doc_id")


def score(docs: DataFrame, model: Model, text: str = "text", carry: Sequence[str] = ("doc_id",), name: str = "score", field: str | None = None) -> DataFrame:
    """``carry`` and the score of every text (or of field ``field`` of a struct column)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {name: pa.array(held.value.score(*text_bytes(batch.column(text))))}

    return map_texts(docs, work, T.StructType([T.StructField(name, T.DoubleType())]), text, carry=carry, field=field)
