"""Character n-gram language models with modified Kneser-Ney smoothing in sorted hash arrays.

Models are over real characters (``letters``, ``codes``): 0 before a text's first character; 1-26 the letters
a-z of either case; 27 white space (a run counts once); 28 a digit; 29-43 ASCII punctuation and control
characters, by a fixed rule; from 44 all other characters of the basic plane, each a symbol of its own (Latin-1,
Greek and Cyrillic capitals as small letters); characters beyond that plane share its last 2,132 symbols.

An n-gram of up to four symbols is a number of 64 bits: the low 6 bits of its symbols, then the high 10 bits
of each, so n-grams of ASCII text are small numbers. What a model holds grows with the corpus. Up to
``HELD_GRAMS`` n-grams, by a count of them, it is collected and broadcast as sorted hash arrays; beyond, its users
join the counts instead (``quality_classifier``), with the same result.

``symbols`` and ``grams`` fold all characters to 64 symbols, others than ASCII by code point modulo 20: features
of classifiers, which hash them anyway.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featuretable.llm.texts import bounded_batches, slices, text_bytes

BITS = 6
SYMBOLS = 1 << BITS
GAP, DIGIT, OTHER, HIGH = 27, 28, 29, 44

#: Symbols of the models, and the longest n-gram that 64 bits hold.
LETTERS = 1 << 16
LONGEST = 4
LOW = LONGEST * BITS  # bits of the low parts of an n-gram's symbols; the high parts follow
UPPER = 16 - BITS
BEYOND = HIGH + 0x10000 - 128 - 0x800  # first symbol of characters beyond the basic plane

#: n-grams of a model that may be collected and broadcast: 28 bytes each in its arrays, 0.5 GB at most.
HELD_GRAMS = 1 << 24


def _ascii_table() -> np.ndarray:
    table = np.empty(256, np.uint8)
    for b in range(128):
        c = chr(b)
        if c.isalpha():
            table[b] = ord(c.lower()) - 96
        elif c.isdigit():
            table[b] = DIGIT
        elif c in " \t\n\v\f\r":
            table[b] = GAP
        else:
            table[b] = OTHER + b % (HIGH - OTHER)
    table[128:] = HIGH
    return table


ASCII = _ascii_table()


def _characters(
    data: np.ndarray, offsets: np.ndarray, kind: type, others: Callable[[np.ndarray], np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in a row, and the offset of each text in them; ``others`` says those of code
    points beyond ASCII."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[at]
    out = ASCII[first].astype(kind)
    many = np.flatnonzero(first >= 0xC0)
    if many.size:
        long = np.concatenate([data, np.zeros(3, np.uint8)])
        where, b0 = at[many], first[many].astype(np.uint32)
        b1, b2, b3 = (long[where + k].astype(np.uint32) & 63 for k in (1, 2, 3))
        point = np.where(
            b0 < 0xE0,
            ((b0 & 31) << 6) | b1,
            np.where(
                b0 < 0xF0,
                ((b0 & 15) << 12) | (b1 << 6) | b2,
                ((b0 & 7) << 18) | (b1 << 12) | (b2 << 6) | b3,
            ),
        )
        out[many] = others(point)
    gap = out == GAP
    again = np.zeros(len(out), bool)
    again[1:] = gap[1:] & gap[:-1]
    again[np.searchsorted(at, offsets[:-1])[offsets[:-1] < len(data)]] = False
    if again.any():
        at, out = at[~again], out[~again]
    return out, np.searchsorted(at, offsets)


def _folded(point: np.ndarray) -> np.ndarray:
    capital = (point >= 0xC0) & (point <= 0xDE) & (point != 0xD7)
    return HIGH + (point + np.uint32(32) * capital) % (SYMBOLS - HIGH)


def _own(point: np.ndarray) -> np.ndarray:
    capital = (point >= 0xC0) & (point <= 0xDE) & (point != 0xD7)
    capital |= (point >= 0x391) & (point <= 0x3A9) | (point >= 0x410) & (point <= 0x42F)
    point = point + np.uint32(32) * capital
    plane = HIGH + point - 128 - np.uint32(0x800) * (point >= 0xE000)  # no text has the surrogates
    return np.where(point < 0x10000, plane, BEYOND + point % (LETTERS - BEYOND))


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded symbols of all texts in a row, and the offset of each text in them."""
    return _characters(data, offsets, np.uint8, _folded)


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the models, of all texts in a row, and the offset of each text in them."""
    return _characters(data, offsets, np.uint16, _own)


def _padded(found: np.ndarray, ends: np.ndarray, lead: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with ``lead`` zeros before each text (and at the end), and where each symbol stands."""
    texts = len(ends) - 1
    place = np.arange(len(found)) + lead * np.repeat(np.arange(1, texts + 1), np.diff(ends))
    padded = np.zeros(len(found) + lead * texts + lead, kind)
    padded[place] = found
    return padded, place


def codes_of(found: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each symbol of texts given as ``letters``."""
    code = grams_of(found & (SYMBOLS - 1), ends, order).astype(np.uint64)
    upper = np.flatnonzero(found >= SYMBOLS)  # few, or all of a text in another script
    if not upper.size:
        return code
    text_end = np.repeat(ends[1:], np.diff(ends))[upper]
    part = (found[upper] >> BITS).astype(np.uint64)
    for back in range(order):
        within = upper + back < text_end
        code[upper[within] + back] |= part[within] << np.uint64(LOW + UPPER * back)
    return code


def codes(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram of ``letters`` that ends at each character, and the offset of each text in them."""
    found, ends = letters(data, offsets)
    return codes_of(found, ends, order), ends


def tail_mask(m: int) -> int:
    """The bits of an n-gram's last ``m`` symbols."""
    return ((1 << BITS * m) - 1) | (((1 << UPPER * m) - 1) << LOW)


def tail(code: np.ndarray, m: int) -> np.ndarray:
    """The last ``m`` symbols of each n-gram."""
    return code & np.uint64(tail_mask(m))


def context(code: np.ndarray) -> np.ndarray:
    """Each n-gram without its last symbol."""
    low = (code & np.uint64((1 << LOW) - 1)) >> np.uint64(BITS)
    return low | (code >> np.uint64(LOW + UPPER)) << np.uint64(LOW)


def after(before: int, last: np.ndarray) -> np.ndarray:
    """The n-grams of one context and each of the last symbols."""
    low = (before & ((1 << LOW) - 1)) << BITS & ((1 << LOW) - 1)
    high = (before >> LOW) << (LOW + UPPER)
    last = last.astype(np.uint64)
    own = (last & np.uint64(SYMBOLS - 1)) | (last >> np.uint64(BITS)) << np.uint64(LOW)
    return own | np.uint64(low | high)


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each symbol, as a number, and the offset of each text in them."""
    found, ends = symbols(data, offsets)
    return grams_of(found, ends, order), ends


def grams_of(found: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each symbol of texts given as folded symbols."""
    padded, place = _padded(found, ends, order - 1, np.uint32)
    code = padded.copy()
    for back in range(1, order):
        code[back:] |= padded[:-back] << np.uint32(BITS * back)
    return code[place]


def text_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each text (last axis: symbols)."""
    total = np.zeros((*values.shape[:-1], values.shape[-1] + 1))
    np.cumsum(values, axis=-1, out=total[..., 1:])
    return total[..., ends[1:]] - total[..., ends[:-1]]


class Tally:
    """Counts of n-grams as sorted arrays; what is added is merged in whenever enough has come together."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.limit = 0

    def add(self, code: np.ndarray) -> None:
        found, n = np.unique(code, return_counts=True)
        self.parts.append((found, n))
        self.size += len(found)
        if self.size > self.limit:
            found, n = self.total()
            self.parts = [(found, n)]
            self.size, self.limit = len(found), 2 * len(found) + 500_000

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams and their counts."""
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        code, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(code, kind="stable")
        code, n = code[order], n[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else order
        return code[first], np.add.reduceat(n, first) if len(code) else n


def gram_counts(docs: DataFrame, order: int, text: Column, group: Column | None = None) -> DataFrame:
    """``group, gram, n`` over whole texts: counted in each task, then summed by Spark.

    A task holds one tally for each group it meets and sends each n-gram once.
    """
    bounded_batches(docs.sparkSession)
    group = F.lit(0) if group is None else group
    source = docs.select(group.cast("int").alias("g"), text.cast("string").alias("t"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Tally] = {}
        for batch in batches:
            groups = batch.column("g").to_numpy(zero_copy_only=False)
            for g in np.unique(groups):
                rows = batch.filter(pa.array(groups == g))
                held = seen.setdefault(int(g), Tally())
                for part in slices(rows, "t"):
                    held.add(codes(*text_bytes(part.column("t")), order)[0])
        for g, held in seen.items():
            code, n = held.total()
            for k in range(0, len(code), 100_000):
                some = code[k : k + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(some), g, np.int32)),
                        pa.array(some),
                        pa.array(n[k : k + 100_000].astype(np.int64)),
                    ],
                    ["grp", "gram", "n"],
                )

    partial = source.mapInArrow(count, "grp int, gram long, n long")
    return partial.groupBy("grp", "gram").agg(F.sum("n").alias("n"))


def discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more, from the numbers of n-grams seen 1 to 4 times."""
    n1, n2, n3, n4 = (float(np.count_nonzero(counts == k)) for k in (1, 2, 3, 4))
    return discounts_from(n1, n2, n3, n4)


def discounts_from(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """Modified Kneser-Ney discounts; where a number is missing, half a count for each step."""
    if not n1 or not n2:
        return np.array([0.0, 0.5, 0.75, 0.75])
    y = n1 / (n1 + 2 * n2)
    d3 = 3 - 4 * y * n4 / n3 if n3 else 0.75
    found = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, d3])
    return np.clip(found, [0, 0.01, 0.01, 0.01], [0, 1, 2, 3])


def hashed(code: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers, so that no two n-grams share a hash."""
    return code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


class HashArrays:
    """n-grams as sorted hashes with one value (or one row of values) each.

    The leading bits of a hash say where its search starts; the hashes being spread evenly, it ends a
    few places on.
    """

    def __init__(self, code: np.ndarray, value: np.ndarray):
        keys = hashed(code)
        order = np.argsort(keys)
        self.values = value[order].astype(np.float32)
        self.keys = np.append(keys[order], np.uint64(0xFFFFFFFFFFFFFFFF))  # ends every search
        bits = min(24, max(4, len(keys).bit_length() + 1))
        self.shift = np.uint64(64 - bits)
        starts = np.arange(1 << bits, dtype=np.uint64) << self.shift
        self.first = np.searchsorted(keys[order], starts).astype(np.int32)

    def place(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each n-gram stands and whether it is there."""
        wanted = hashed(code)
        at = self.first[wanted >> self.shift]
        late = np.flatnonzero(self.keys[at] < wanted)
        while late.size:
            at[late] += 1
            late = late[self.keys[at[late]] < wanted[late]]
        return at, (self.keys[at] == wanted) & (at < len(self.values))

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value of each n-gram and whether it is there."""
        if not len(self.values):
            return np.zeros(len(code), np.float32), np.zeros(len(code), bool)
        at, there = self.place(code)
        return self.values[np.minimum(at, len(self.values) - 1)], there


class KneserNey:
    """Interpolated modified Kneser-Ney probabilities of the last symbol of an n-gram.

    ``gram, n`` are all n-grams of the highest order with their counts. Lower orders count distinct
    left neighbours. Below single symbols stands the uniform distribution, so every n-gram has a
    probability and those after any context sum to one.
    """

    def __init__(self, gram: np.ndarray, n: np.ndarray, order: int):
        self.order = order
        levels = [(np.asarray(gram).astype(np.uint64), np.asarray(n, np.int64))]
        for m in range(order - 1, 0, -1):
            code, counts = np.unique(tail(levels[-1][0], m), return_counts=True)
            levels.append((code, counts))
        self.logp: dict[int, HashArrays] = {}
        self.weight: dict[int, HashArrays] = {}
        below = None
        for m, (code, counts) in enumerate(reversed(levels), 1):
            if m == order:
                by = np.argsort(code)
                code, counts = code[by], counts[by]
            cut = discounts(counts)[np.minimum(counts, 3)]
            known, inverse = np.unique(context(code), return_inverse=True)
            total = np.bincount(inverse, weights=counts, minlength=len(known))
            free = np.bincount(inverse, weights=cut, minlength=len(known)) / np.maximum(total, 1)
            if below is None:
                lower = np.full(len(code), 1 / LETTERS)
            else:
                lower = below[1][np.searchsorted(below[0], tail(code, m - 1))]
            p = (counts - cut) / total[inverse] + free[inverse] * lower if len(code) else lower
            self.logp[m] = HashArrays(code, np.log(p))
            self.weight[m] = HashArrays(known, np.log(np.maximum(free, 1e-30)))
            below = (code, p)

    def score(self, gram: np.ndarray, order: int | None = None) -> np.ndarray:
        """Natural log of the probability of each n-gram's last symbol after the others.

        With a lower ``order``: by continuation counts, after the last ``order - 1`` symbols.
        """
        top = order or self.order
        gram = tail(gram, top)
        out, open_ = self.logp[top].find(gram)
        left = np.flatnonzero(~open_)
        out[left] = 0
        for m in range(top, 0, -1):
            if not left.size:
                return out
            part = tail(gram[left], m)
            if m < top:
                value, hit = self.logp[m].find(part)
                out[left[hit]] += value[hit]
                left, part = left[~hit], part[~hit]
            weight, known = self.weight[m].find(context(part))
            out[left[known]] += weight[known]
        out[left] -= np.float32(np.log(LETTERS))
        return out


def collect_counts(counts: DataFrame, values: int = 1) -> dict[int, tuple[np.ndarray, np.ndarray]] | None:
    """Counts by group on the driver, or none if there are more than ``HELD_GRAMS`` over the ``values`` that
    each n-gram will have; ``counts`` is stored."""
    if counts.count() * values > HELD_GRAMS:
        return None
    table = counts.toArrow()
    group, gram, n = (table.column(c).to_numpy() for c in ("grp", "gram", "n"))
    return {int(g): (gram[group == g].astype(np.uint64), n[group == g]) for g in np.unique(group)}
