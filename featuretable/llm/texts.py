"""Texts as byte arrays: Arrow columns in, numpy arrays out, no loop over rows.

Tasks work on slices of an Arrow batch, so that their memory follows the slice and not the batch. A
single text longer than the slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featuretable.functions.predicates import column

SLICE_BYTES = 1 << 20
BATCH_ROWS = 2_000

# ASCII white space: space and the control characters 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
# ASCII letters of either case to lower case, all other bytes to themselves.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offset of each text in them; null is an empty text."""
    array = pc.fill_null(array.cast(pa.large_string()), "")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    _, at, data = array.buffers()
    if at is None or len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64, len(array) + 1, 8 * array.offset)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` rows where they are larger.

    The default of 10,000 rows is meant for short rows; of documents it is tens of megabytes, held
    several times over by the JVM and the Python worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def text_column(batch: pa.RecordBatch, name: str, field: str | None = None) -> pa.Array:
    """A text column, or the field of a struct column."""
    found = batch.column(name)
    return found if field is None else found.field(field)


def slices(
    batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES, field: str | None = None
) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``limit`` bytes of text, or a single longer text."""
    ends = text_bytes(text_column(batch, name, field))[1]
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(ends, ends[first] + limit, "right")) - 1
        last = max(last, first + 1)
        yield batch.slice(first, last - first)
        first = last


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each longest run of ``inside`` bytes within one text."""
    cut = np.zeros(len(inside) + 1, bool)
    cut[offsets] = True
    other = np.ones(len(inside) + 2, bool)
    np.logical_not(inside, out=other[1:-1])
    starts = np.flatnonzero(inside & (other[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside & (other[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def per_text(values: np.ndarray, text_of: np.ndarray, texts: int) -> np.ndarray:
    """Sum of ``values`` by text."""
    return np.bincount(text_of, weights=values, minlength=texts).astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHash:
    """64-bit hashes of any spans of a byte array: a polynomial by prefix sums, then mixed.

    The multiplier is odd, hence invertible modulo 2^64, and the hash of a span does not depend on
    where it stands.
    """

    BASE = 0x9E3779B97F4A7C55
    held: dict[int, np.ndarray] = {}  # powers for slices of the usual size, made once per process

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.back = self._powers(pow(self.BASE, -1, 1 << 64), n)
        self.sums = np.zeros(n + 1, np.uint64)
        terms = data.astype(np.uint64)
        terms += np.uint64(1)
        terms *= self._powers(self.BASE, n)[:n]
        np.cumsum(terms, out=self.sums[1:])

    @classmethod
    def _powers(cls, base: int, n: int) -> np.ndarray:
        held = cls.held.get(base)
        if held is not None and len(held) > n:
            return held
        out = np.full(max(n, SLICE_BYTES) + 1, base, np.uint64)
        out[0] = 1
        np.cumprod(out, out=out)
        if n <= SLICE_BYTES:
            cls.held[base] = out
        return out

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mixed(value + mixed((ends - starts).astype(np.uint64)))


def map_texts(
    docs: DataFrame,
    work: Callable[[pa.RecordBatch], dict[str, pa.Array] | None],
    outputs: T.StructType,
    text: str = "text",
    needs: Sequence[str] = (),
    carry: Sequence[str] = ("doc_id",),
    limit: int = SLICE_BYTES,
    start: Callable[[], object] | None = None,
    field: str | None = None,
) -> DataFrame:
    """Columns ``carry`` of ``docs`` and the ``outputs`` that ``work`` makes of each slice of rows.

    ``work`` gets a batch with ``text`` and ``needs`` (and what ``start`` returned, once for each
    task, if given). Columns travel by position, so names in ``docs`` cannot clash with ours. With
    ``field`` the text is that field of the struct column ``text``; ``work`` gets it as ``text``.
    """
    bounded_batches(docs.sparkSession)
    names = list(dict.fromkeys([*carry, text, *needs]))
    inner = [f"c{i}" for i in range(len(names))]
    source = docs.select([column(n).alias(i) for n, i in zip(names, inner, strict=True)])
    kept = inner[: len(carry)]
    schema = T.StructType(
        [source.schema[i] for i in kept]
        + [T.StructField(f"o{i}", f.dataType) for i, f in enumerate(outputs)]
    )
    wanted = [names.index(n) for n in (text, *needs)]
    text_at = f"c{names.index(text)}"
    labels = [text, *needs]
    fields = [f.name for f in outputs]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = () if start is None else (start(),)
        for batch in batches:
            for part in slices(batch, text_at, limit, field):
                given = [part.column(i) for i in wanted]
                given[0] = text_column(part, text_at, field)
                made = work(pa.RecordBatch.from_arrays(given, labels), *more)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(kept))] + [made[n] for n in fields],
                    [*kept, *(f"o{i}" for i in range(len(fields)))],
                )

    result = source.mapInArrow(run, schema)
    return result.select(
        [F.col(i).alias(n) for i, n in zip(kept, carry, strict=True)]
        + [F.col(f"o{i}").alias(n) for i, n in enumerate(fields)]
    )
