"""Token packing: first-fit decreasing with a tournament tree, in randomised groups of documents.

1. Each document is tokenised whole (its words through the tokenizer, each distinct word once per
   worker) and ends with ``END_ID``. It is cut into full sequences and one rest.
2. Full pieces are sequences of their own. Rests go to random groups of about ``GROUP`` documents; a
   group is packed alone: pieces in decreasing length, each into the first open sequence with room,
   found by descending a tournament tree of free capacities. Random groups look alike, so
   padding per group is small and the groups are even, whatever the ids and sources are.

Pieces (numbers only) are written once before packing, so group numbers survive lost executors.

Edge cases: a null or empty text is the single token ``END_ID``. Repeated rows are packed each on its
own. Long texts give many full pieces. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featuretable.functions.predicates import column
from featuretable.llm.texts import LOWER, SPACE, SpanHash, bounded_batches, slices, spans, text_bytes
from featuretable.sources.scratch import materialize

LENGTH = 2048
END_ID = 1
GROUP = 4096
#: Distinct words a worker remembers; beyond, it starts anew.
REMEMBERED = 500_000
#: New words given to the tokenizer as one text.
JOINED = 128
# Letters, and marks that the tokenizer always parts from a letter before them.
CAPITAL = np.zeros(256, bool)
CAPITAL[65:91] = True
LETTER = CAPITAL.copy()
LETTER[97:123] = True
MARK = np.zeros(256, bool)
MARK[[ord(c) for c in '.,!?;:)"']] = True


class WordTokens:
    """Token ids of words, each distinct word tokenised once.

    Right for tokenizers that drop white space, ignore case, and never join across white space or from a
    letter to a mark; words are parted there and put in lower case, so that fewer are distinct. (Case is
    left alone where special tokens may stand, which do not ignore it, and before other than ASCII
    characters, which may combine with the letter.)

    New words of letters alone go to a byte-level tokenizer that marks the ends of words ``JOINED`` at a time, as a
    call and its result cost more than the merges of one word. Each ends in one such token; where the tokenizer
    cuts one of them further, there are more, and the words are given one by one.

    Word hashes are kept sorted beside the numbers of the words, whose ids lie in one array.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.final = self._final()
        self._clear()

    def _final(self) -> np.ndarray | None:
        """By id, whether a token ends a word; None if some byte has no such token."""
        from tokenizers.pre_tokenizers import ByteLevel

        mark, known = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        if not mark or any(letter + mark not in known for letter in ByteLevel.alphabet()):
            return None
        final = np.zeros(max(known.values()) + 1, bool)
        final[[i for token, i in known.items() if token.endswith(mark)]] = True
        return final

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.number = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.start = np.zeros(1, np.int64)

    def _each(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of all words in a row and the number of each, words given one by one."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return [np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))], [size]

    def _joined(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """As ``_each``, for words of letters, many of them as one text."""
        ids, sizes = [], []
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        found = self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for group, encoding in zip(groups, found, strict=True):
            own = np.array(encoding.ids, np.uint32)
            ends = np.flatnonzero(self.final[own])
            if len(ends) == len(group):
                ids.append(own)
                sizes.append(np.diff(ends, prepend=-1))
            else:
                own, size = self._each(group)
                ids += own
                sizes += size
        return ids, sizes

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        letters = np.fromiter((self.final is not None and w.isalpha() for w in words), bool, len(words))
        order = np.argsort(~letters, kind="stable")  # words of letters first
        held = int(letters.sum())
        ordered = [words[i] for i in order.tolist()]
        (ids, sizes), (more_ids, more_sizes) = self._joined(ordered[:held]), self._each(ordered[held:])
        number = np.empty(len(keys), np.int64)
        number[order] = np.arange(len(self.number), len(self.number) + len(keys))
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.number = np.insert(self.number, at, number)
        ends = self.start[-1] + np.cumsum(np.concatenate(sizes + more_sizes))
        self.start = np.concatenate([self.start, ends])
        self.ids = np.concatenate([self.ids, *ids, *more_ids])

    @staticmethod
    def _words(data: np.ndarray, offsets: np.ndarray):
        starts, ends, _ = spans(~SPACE[data], offsets)
        cuts = np.flatnonzero(LETTER[data[:-1]] & MARK[data[1:]]) + 1
        cuts = np.setdiff1d(cuts, offsets, assume_unique=True)
        starts, ends = np.sort(np.append(starts, cuts)), np.sort(np.append(ends, cuts))
        return starts, ends, np.searchsorted(offsets, starts, "right") - 1

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and the offset of each text in them."""
        raw = data.tobytes()
        if b"<|" not in raw:
            plain = CAPITAL[data] & (np.append(data[1:], 0) < 128)
            data = np.where(plain, LOWER[data], data)
            raw = data.tobytes()
        starts, ends, text_of = self._words(data, offsets)
        texts = len(offsets) - 1
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(texts + 1, np.int64)
        keys, at, inverse = np.unique(
            SpanHash(data).of(starts, ends), return_index=True, return_inverse=True
        )
        if len(self.keys) > REMEMBERED:
            self._clear()
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[place] != keys) if len(self.keys) else np.arange(len(keys))
        if new.size:
            first, last = starts[at[new]].tolist(), ends[at[new]].tolist()
            words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(first, last, strict=True)]
            self._learn(keys[new], words)
        number = self.number[np.searchsorted(self.keys, keys)][inverse]
        begin, length = self.start[number], self.start[number + 1] - self.start[number]
        done = np.cumsum(length)
        flat = np.arange(done[-1]) + np.repeat(begin - (done - length), length)
        last = np.searchsorted(text_of, np.arange(texts), "right")
        return self.ids[flat], np.concatenate([[0], np.concatenate([[0], done])[last]])


_held: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The worker's tokenizer with what it remembers, in the task's own thread: a task has one core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _held:
        _held[path] = WordTokens(path)
    return _held[path]


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens``: every document cut into pieces."""
    source = docs.select(column(doc_id).alias("doc_id"), column(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, ends = words.encode(*text_bytes(part.column("text")))
                rows, starts, lengths, crcs = [], [], [], []
                for i in range(part.num_rows):
                    own = np.append(ids[ends[i] : ends[i + 1]], np.uint32(END_ID)).astype("<u4")
                    for start in range(0, len(own), LENGTH):
                        some = own[start : start + LENGTH]
                        rows.append(i)
                        starts.append(start)
                        lengths.append(len(some))
                        crcs.append(zlib.crc32(some.tobytes()))
                total = np.diff(ends) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(rows, pa.int64())),
                        *(pa.array(v, pa.int64()) for v in (starts, lengths, crcs)),
                        pa.array(total[rows], pa.int64()),
                    ],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    bounded_batches(docs.sparkSession)
    return source.mapInArrow(
        cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    )


class FreeSpace:
    """Tournament tree over the free capacities of up to ``n`` sequences; each node has its maximum."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.most = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Take ``size`` from the first sequence with that much room; its number."""
        most, node = self.most, 1
        while node < self.leaves:
            node *= 2
            if most[node] < size:
                node += 1
        most[node] -= size
        found = node - self.leaves
        while node > 1:
            node //= 2
            best = most[2 * node] if most[2 * node] >= most[2 * node + 1] else most[2 * node + 1]
            if most[node] == best:
                break
            most[node] = best
        return found


def first_fit_decreasing(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every piece (no piece longer than ``capacity``)."""
    tree = FreeSpace(len(lengths), capacity)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: dict[int, int] = {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        b = tree.first_fit(size)
        bins[i], offsets[i] = b, used.get(b, 0)
        used[b] = used.get(b, 0) + size
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``. Odd ids are full pieces, even ids packed rests."""
    cut = pieces(docs, tokenizer, text, doc_id).withColumn("piece", F.monotonically_increasing_id())
    cut = materialize(cut, "pieces")
    kind = cut.schema["doc_id"].dataType.simpleString()
    full = cut.filter(F.col("length") == LENGTH)
    rests = cut.filter(F.col("length") < LENGTH)
    groups = max(1, -(-rests.count() // GROUP))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("piece", ignore_index=True)
        bins, offsets = first_fit_decreasing(group["length"].to_numpy())
        number = (group["grp"].to_numpy() << 20) + bins
        return group.drop(columns=["grp", "piece"]).assign(sequence_id=2 * number, offset=offsets)

    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    packed = (
        rests.withColumn("grp", F.pmod(F.xxhash64("piece"), F.lit(groups)))
        .groupBy("grp")
        .applyInPandas(
            place,
            f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
            "sequence_id long, offset long",
        )
    )
    alone = full.select(
        *columns, (2 * F.col("piece") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return alone.unionByName(packed)
