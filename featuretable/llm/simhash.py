"""SimHash near-duplicates through Golay-code keys.

Fingerprint: 64 bits over the XXH64 hashes of 4-word shingles, repeats included; a bit is set if it is
set in over half of them. Two documents link if their fingerprints differ in at most 4 bits.

Candidates: a fingerprint falls into three segments (23, 23 and 18 bits). The perfect Golay code
(23,12,7) gives a 23-bit word the numbers of its near codewords: the one within 3 bits, and, if that is
3 away, the five at 4 bits as well: 1 or 6 numbers. Two words at most 2 bits apart share at least one of
them (tested). At most 4 errors fall on three segments in one of two ways:

- no segment has more than 2: the numbers of all three segments form a common key (36 bits);
- one has 3 or 4, so that of the others one is free of errors and one has at most 1: the exact segment
  and the number of the other form a common key (30 or 35 bits), for each ordered pair.

Keys of distinct fingerprints are dealt to shards by hash, packed as arrays. In a shard the fingerprints
under each key are compared by their bits and give links that connect exactly what is within 4
bits of each other: pivots first, cross comparisons only between groups not yet joined. Links go through
``components``. Copies with one fingerprint count once, whatever their number.

Scale: keys are linear in the number of distinct fingerprints (181 each on average). Candidates that
share a key by chance are rare up to billions of fingerprints. The fingerprints under one key meet in one
task as 8 bytes each, distinct values. Under a key of the first kind they lie within a ball of a few bits. A key
of the second kind leaves its third segment free, so up to 2^18 or 2^23 times the words of one number could
share it; texts that differ in one segment of 18 or 23 bits only would have to be made for that.

Edge cases: a null, empty or wordless text has fingerprint zero and links like any other. Fewer than
four words are one shingle. Repeated rows and ids are one node. A null id takes part in its group but is no
candidate for the component's id; a component with null ids only has a null id. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featuretable.functions.predicates import column
from featuretable.llm.components import components
from featuretable.llm.joins import without
from featuretable.llm.texts import LOWER, SPACE, map_texts, mixed, spans, text_bytes
from featuretable.sources.scratch import materialize

WORDS = 4
SEED = 42
REACH = 4
#: Keys in a shard, about; a key and its fingerprint take 16 bytes.
SHARD_KEYS = 1_000_000
KEYS_EACH = 181

# Fixed value: the generator polynomial of the Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 23), (23, 23), (46, 18))


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprint of every text."""
    import xxhash

    texts = len(offsets) - 1
    out = np.zeros(texts, np.uint64)
    inside = ~SPACE[data]
    starts, ends, text_of = spans(inside, offsets)
    if not len(starts):
        return out
    # The words again, with one space after each.
    length = ends - starts
    begin = np.cumsum(length + 1) - length - 1
    joined = np.full(int(length.sum()) + len(starts), 32, np.uint8)
    joined[np.arange(int(length.sum())) + np.repeat(np.arange(len(starts)), length)] = LOWER[data[inside]]
    raw = joined.tobytes()
    first = np.searchsorted(text_of, np.arange(texts))
    words = np.bincount(text_of, minlength=texts)
    # Start words of shingles: all but the last three of a text, at least the first.
    number = np.arange(len(starts)) - first[text_of]
    head = np.flatnonzero((number == 0) | (number <= words[text_of] - WORDS))
    tail = np.minimum(head + WORDS, (first + words)[text_of[head]]) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(raw[a:b], SEED) for a, b in zip(begin[head].tolist(), (begin + length)[tail].tolist(), strict=True)),
        np.uint64, len(head),
    )
    owner = text_of[head]
    cuts = np.flatnonzero(np.diff(owner, prepend=-1))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    total = np.diff(np.append(cuts, len(head)))
    packed = np.packbits(2 * ones > total[:, None], axis=1, bitorder="little")
    out[owner[cuts]] = packed.reshape(-1).view(np.uint64)
    return out


class Golay:
    """Numbers of the codewords near a 23-bit word, from its syndrome."""

    def __init__(self) -> None:
        self.tables = [
            np.array([self._rest(b << 8 * k) for b in range(256)], np.uint32) for k in range(3)
        ]
        at = [[] for _ in range(2048)]
        for weight in range(5):
            for ones in combinations(range(23), weight):
                error = sum(1 << i for i in ones)
                held = at[self._rest(error)]
                if weight < 4 or held[0].bit_count() == 3:
                    held.append(error)
        self.count = np.array([len(h) for h in at])
        self.errors = np.array([h + [0] * (6 - len(h)) for h in at], np.uint32)

    @staticmethod
    def _rest(word: int) -> int:
        for i in range(23, 10, -1):
            if word >> i & 1:
                word ^= GENERATOR << (i - 11)
        return word

    def numbers(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Up to six numbers of each word, and how many of them count."""
        t = self.tables
        rest = t[0][words & 255] ^ t[1][(words >> 8) & 255] ^ t[2][words >> 16]
        return (words[:, None] ^ self.errors[rest]) >> np.uint32(11), self.count[rest]


def keys_of(prints: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """All keys and, beside each, the position of its fingerprint."""
    words = [
        ((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.uint32) for at, n in SEGMENTS
    ]
    near = [code.numbers(w) for w in words]
    keys, owner = [], []
    for i in range(6):
        for j in range(6):
            for k in range(6):
                use = np.flatnonzero((near[0][1] > i) & (near[1][1] > j) & (near[2][1] > k))
                a, b, c = (near[s][0][use, x].astype(np.uint64) for s, x in ((0, i), (1, j), (2, k)))
                keys.append((a << np.uint64(24)) | (b << np.uint64(12)) | c)
                owner.append(use)
    for kind, (s, t) in enumerate(permutations(range(3), 2), 1):
        for i in range(6):
            use = np.flatnonzero(near[t][1] > i)
            exact, number = words[s][use].astype(np.uint64), near[t][0][use, i].astype(np.uint64)
            keys.append(np.uint64(kind << 40) | (exact << np.uint64(12)) | number)
            owner.append(use)
    return mixed(np.concatenate(keys)), np.concatenate(owner)


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def connect(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links (positions) that connect exactly what chains of at most ``REACH`` bits connect.

    Pivot by pivot, what is near the pivot joins its group. Groups are then compared with each other
    where their pivots are near enough and no link joins them yet; the first close pair decides.
    """
    links: list[tuple[int, int]] = []
    free = np.arange(len(prints))
    groups: list[np.ndarray] = []
    while free.size:
        near = _distance(prints[free], prints[free[0]]) <= REACH
        groups.append(free[near])
        links.extend((int(free[0]), int(x)) for x in free[near][1:])
        free = free[~near]
    root = list(range(len(groups)))

    def find(g: int) -> int:
        while root[g] != g:
            root[g] = root[root[g]]
            g = root[g]
        return g

    pivots = prints[[g[0] for g in groups]]
    for g in range(1, len(groups)):
        close = np.flatnonzero(_distance(pivots[:g], pivots[g]) <= 3 * REACH)
        for h in close.tolist():
            if find(g) == find(h):
                continue
            small, large = sorted((groups[g], groups[h]), key=len)
            for x in small:
                hit = np.flatnonzero(_distance(prints[large], prints[x]) <= REACH)
                if hit.size:
                    links.append((int(x), int(large[hit[0]])))
                    root[find(g)] = find(h)
                    break
    return links


def _links(keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Distinct linked pairs of fingerprints of one shard."""
    order = np.lexsort((prints, keys))
    keys, prints = keys[order], prints[order]
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    ends = np.append(cuts[1:], len(keys))
    size = ends - cuts
    pairs = []
    two = cuts[size == 2]
    close = two[_distance(prints[two], prints[two + 1]) <= REACH]
    pairs.append(np.stack([prints[close], prints[close + 1]], 1))
    done = set()
    for a, b in zip(cuts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
        some = np.unique(prints[a:b])
        if (name := some.tobytes()) in done:  # the same fingerprints meet under many keys
            continue
        done.add(name)
        found = connect(some)
        if found:
            at = np.array(found)
            pairs.append(np.sort(np.stack([some[at[:, 0]], some[at[:, 1]]], 1), axis=1))
    return np.unique(np.concatenate(pairs), axis=0)


def links(prints: DataFrame) -> DataFrame:
    """Linked pairs ``a, b`` of distinct fingerprints (column ``fp``), enough to connect all."""
    shards = max(1, -(-prints.count() * KEYS_EACH // SHARD_KEYS))
    spark = prints.sparkSession

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for batch in batches:
            every = batch.column("fp").to_numpy().view(np.uint64)
            for first in range(0, len(every), 5_000):
                some = every[first : first + 5_000]
                keys, owner = keys_of(some, code)
                shard = (keys >> np.uint64(20)) % np.uint64(shards)
                order = np.argsort(shard, kind="stable")
                keys, owner, shard = keys[order], some[owner[order]], shard[order]
                cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
                ends = np.append(cuts[1:], len(shard))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard[cuts].astype(np.int64)),
                        *(
                            pa.array([v[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())
                            for v in (keys, owner)
                        ),
                    ],
                    ["shard", "keys", "prints"],
                )

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[bytes]] = [[], []]
        now = None

        def close() -> pa.RecordBatch:
            arrays = (np.frombuffer(b"".join(h), np.uint64) for h in held)
            found = _links(*arrays).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        for batch in batches:
            for shard, keys, owner in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if shard != now:
                    if now is not None:
                        yield close()
                    now, held = shard, [[], []]
                held[0].append(keys)
                held[1].append(owner)
        if now is not None:
            yield close()

    width = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = prints.select("fp").mapInArrow(deal, "shard long, keys binary, prints binary")
    met = dealt.repartition(width, "shard").sortWithinPartitions("shard")
    return met.mapInArrow(meet, "a long, b long").distinct()


OUT = T.StructType([T.StructField("fp", T.LongType())])


def fingerprint_table(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    source = docs.select(column(doc_id).alias("doc_id"), column(text).cast("string").alias("text"))

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"fp": pa.array(fingerprints(*text_bytes(batch.column("text"))).view(np.int64))}

    return materialize(map_texts(source, work, OUT, limit=1 << 20), "fingerprints")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``."""
    prints = fingerprint_table(docs, text, doc_id)
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = materialize(nodes, "nodes")
    found = materialize(components(links(nodes)), "components")
    rooted = nodes.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    member = rooted.select("fp", "root").join(smallest, "root").select(F.col("fp").alias("fp_"), "component_id")
    return prints.join(member, F.col("fp") == F.col("fp_")).select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, all columns; rows without id stay."""
    groups = near_duplicates(docs, text, doc_id).filter(F.col("doc_id") != F.col("component_id"))
    gone = materialize(groups.select(F.col("doc_id").alias("id")).distinct(), "gone")
    return without(docs, doc_id, gone)
