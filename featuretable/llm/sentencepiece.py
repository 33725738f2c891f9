"""SentencePiece encoding and decoding with batched numpy Viterbi.

Texts are cut before white space into units (with ``▁`` for a space), and each distinct unit of a slice is
encoded once. Units of equal length advance together: at every position, the substrings that end there
are looked up by hash among the sorted piece keys, for all units at once, and a vectorised maximum over
the start positions stores the backpointer. Backpointers are followed for all units at once, too.

- Unigram models: the maximum of the summed piece scores, as usual.
- BPE models: the highest score does not give the merges. Instead, a step from one piece to the next is
  allowed only if the two, joined, would be cut back into just these two. A cut is the one that the merges
  make if and only if all its neighbours are such pairs, and every prefix has one such cut, so the
  maximum (over start positions allowed) is unique and the result equals that of the merges. Whether
  a pair is allowed is found by merging its few characters, once per worker and pair.

Characters without a piece become the byte pieces of their UTF-8 form, or the unknown id where the model
has none. Models with a text normalisation of their own, or white-space trimming, are refused: both would
make decoding inexact.

Edge cases: null and empty texts have no ids. Decoding gives the text back exactly (tested), with bytes that
are no UTF-8 replaced. Repeated rows are encoded alike, extra columns ignored; texts are encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from featuretable.llm.texts import SpanHash, map_texts, mixed, spans, text_bytes

GAP = "▁"
#: Units a worker remembers; beyond, it starts anew.
REMEMBERED = 1_000_000
#: Ids decoded at a time (or a single longer list).
SLICE_IDS = 500_000
# Piece types of the model file format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def point_hash(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and inverse powers, by row, for hashes of any substring of rows of code points."""
    n = points.shape[1]
    base, back = SpanHash.BASE, pow(SpanHash.BASE, -1, 1 << 64)
    power = np.array([pow(base, k, 1 << 64) for k in range(n + 1)], np.uint64)
    inverse = np.array([pow(back, k, 1 << 64) for k in range(n + 1)], np.uint64)
    sums = np.zeros((len(points), n + 1), np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[:n], axis=1, out=sums[:, 1:])
    return sums, inverse


def substring(sums: np.ndarray, inverse: np.ndarray, a: int, b: int) -> np.ndarray:
    return mixed((sums[:, b] - sums[:, a]) * inverse[a] + mixed(np.uint64([b - a])))


@dataclass
class Vocabulary:
    """What a model file says."""

    pieces: list[str]
    scores: np.ndarray
    types: np.ndarray
    kind: int
    prefix: bool
    unknown: int

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("models that rewrite texts cannot be decoded exactly")
        if model.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models")
        types = np.array([p.type for p in model.pieces])
        return cls(
            [p.piece for p in model.pieces], np.array([p.score for p in model.pieces]), types,
            model.trainer_spec.model_type, rules.add_dummy_prefix, int(np.flatnonzero(types == UNKNOWN)[0]),
        )


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        usable = np.flatnonzero((v.types == NORMAL) | (v.types == USER))
        self.longest = max(len(v.pieces[i]) for i in usable)
        keys = np.zeros(len(usable), np.uint64)
        length = np.array([len(v.pieces[i]) for i in usable])
        for n in np.unique(length):
            own = np.flatnonzero(length == n)
            points = np.array([[ord(c) for c in v.pieces[usable[k]]] for k in own], np.uint64)
            keys[own] = substring(*point_hash(points), 0, int(n))
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], usable[order]
        bits = max(4, len(keys).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.keys = np.append(self.keys, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.number = {p: i for i, p in enumerate(v.pieces) if v.types[i] in (NORMAL, USER)}
        self.bytes = np.full(256, -1)
        for i in np.flatnonzero(v.types == BYTE):
            self.bytes[int(v.pieces[i][1:-1], 16)] = i
        self.low = float(v.scores[usable].min()) - 10.0
        # Pairs of pieces asked for so far, sorted, and whether they are allowed.
        self.pairs, self.pair_ok = np.zeros(0, np.int64), np.zeros(0, bool)
        self._forget()

    def _forget(self) -> None:
        """Start with no known unit: sorted hashes, the units' numbers, and all ids in one array."""
        self.known, self.unit = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    # -- the model's pieces

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """Piece id of each substring hash, -1 where there is none."""
        at = self.first[keys >> self.shift]
        late = np.flatnonzero(self.keys[at] < keys)
        while late.size:
            at[late] += 1
            late = late[self.keys[at[late]] < keys[late]]
        return np.where(self.keys[at] == keys, self.ids[np.minimum(at, len(self.ids) - 1)], -1)

    def merged(self, text: str) -> list[str]:
        """The merges of a BPE model on a few characters: best score first, leftmost among equals."""
        parts, scores = list(text), self.vocabulary.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.number.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or scores[k] > best):
                    best, at = scores[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _allowed(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two pieces stay as they are when joined; -1 is the start or a character without piece."""
        code = ((left + 1).astype(np.int64) << 32) | (right + 1)
        at = _place(self.pairs, code)
        unknown = self.pairs[at] != code if len(self.pairs) else np.ones(len(code), bool)
        if unknown.any():
            new = np.unique(code[unknown])
            answers = []
            for c in new.tolist():
                parts = [self.vocabulary.pieces[k - 1] for k in (c >> 32, c & 0xFFFFFFFF) if k]
                answers.append(self.merged("".join(parts)) == parts)
            where = np.searchsorted(self.pairs, new)
            self.pairs = np.insert(self.pairs, where, new)
            self.pair_ok = np.insert(self.pair_ok, where, answers)
            at = _place(self.pairs, code)
        return self.pair_ok[at]

    # -- Viterbi

    def _best(self, points: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backpointers and pieces by position, for units in rows of code points."""
        rows, n = points.shape
        sums, inverse = point_hash(points)
        total = np.full((rows, n + 1), -np.inf)
        total[:, 0] = 0
        back = np.zeros((rows, n + 1), np.int32)
        piece = np.full((rows, n + 1), -1, np.int64)
        bpe = self.vocabulary.kind == BPE
        scores = self.vocabulary.scores
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                # A prefix has one right last piece in a BPE model: once found, the row is done.
                open_ = np.isfinite(total[:, start]) & (length >= end)
                use = np.flatnonzero(open_ & (total[:, end] != 0) if bpe else open_)
                if not use.size:
                    continue
                own = self.probe(substring(sums[use], inverse, start, end))
                if start < end - 1:
                    use, own = use[own >= 0], own[own >= 0]
                if not use.size:
                    continue
                if bpe:
                    ok = self._allowed(piece[use, start], own)
                    use, own = use[ok], own[ok]
                    value = np.zeros(len(use))
                else:
                    value = total[use, start] + np.where(own >= 0, scores[own], self.low)
                better = value > total[use, end]
                use, own = use[better], own[better]
                total[use, end], back[use, end], piece[use, end] = value[better], start, own
        return back, piece

    def units(self, texts: list[str]) -> list[list[int]]:
        """Ids of units; those of equal length are encoded together, long ones filled up to a common
        length (what follows a position does not matter for the way there)."""
        by_length: dict[int, list[int]] = {}
        for i, t in enumerate(texts):
            n = len(t)
            by_length.setdefault(n if n <= 12 else 1 << (n - 1).bit_length(), []).append(i)
        made: list[list[int]] = [[] for _ in texts]
        for n, own in by_length.items():
            step = max(1, 2_000_000 // (n + 1))
            for k in range(0, len(own), step):
                places = own[k : k + step]
                some = [texts[i] for i in places]
                filled = "".join(t.ljust(n, "\0") for t in some)
                points = np.frombuffer(filled.encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n)
                length = np.array([len(t) for t in some])
                back, piece = self._best(points, length)
                at = length.copy()
                steps = []
                while (live := np.flatnonzero(at > 0)).size:
                    now = np.full(len(some), -2, np.int64)
                    now[live] = piece[live, at[live]]
                    odd = live[now[live] == -1]
                    now[odd] = -3 - points[odd, at[odd] - 1].astype(np.int64)
                    steps.append(now)
                    at[live] = back[live, at[live]]
                for i, row in zip(places, np.stack(steps[::-1], 1).tolist(), strict=True):
                    made[i] = [x for k in row if k != -2 for x in ([k] if k >= 0 else self._odd(-3 - k))]
        return made

    def _odd(self, point: int) -> list[int]:
        ids = [int(self.bytes[b]) for b in chr(point).encode("utf-8", "replace")]
        return [self.vocabulary.unknown] if min(ids) < 0 else ids

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and the offset of each text in them."""
        starts, ends, text_of = _unit_spans(data, offsets)
        texts = len(offsets) - 1
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(texts + 1, np.int64)
        head = np.zeros(len(starts), np.uint64)
        if self.vocabulary.prefix:
            head[np.flatnonzero(np.diff(text_of, prepend=-1))] = 1
        keys = mixed(SpanHash(data).of(starts, ends) + head)
        keys, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self._forget()
        new = np.arange(len(keys))
        if len(self.known):
            new = np.flatnonzero(self.known[_place(self.known, keys)] != keys)
        if new.size:
            raw = data.tobytes()
            found = self.units([
                GAP * int(head[i]) + raw[starts[i] : ends[i]].decode("utf-8", "replace").replace(" ", GAP)
                for i in at[new].tolist()
            ])
            first = len(self.known)
            where = np.searchsorted(self.known, keys[new])
            self.known = np.insert(self.known, where, keys[new])
            self.unit = np.insert(self.unit, where, np.arange(first, first + len(new)))
            stop = self.start[-1] + np.cumsum([len(f) for f in found])
            self.start = np.concatenate([self.start, stop.astype(np.int64)])
            fresh = np.fromiter(chain.from_iterable(found), np.int32, int(stop[-1] - self.start[first]))
            self.flat = np.concatenate([self.flat, fresh])
        unit = self.unit[_place(self.known, keys)][inverse]
        begin, size = self.start[unit], self.start[unit + 1] - self.start[unit]
        done = np.cumsum(size)
        ids = self.flat[np.arange(done[-1]) + np.repeat(begin - (done - size), size)]
        last = np.searchsorted(text_of, np.arange(texts), "right")
        return ids, np.concatenate([[0], np.append(0, done)[last]])


def _place(held: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted key stands in sorted keys, if it does."""
    return np.minimum(np.searchsorted(held, wanted), max(0, len(held) - 1))


def _unit_spans(data: np.ndarray, offsets: np.ndarray):
    """Units: a run of spaces with what follows up to the next space. No piece of letters crosses them."""
    starts, ends, text_of = spans(np.ones(len(data), bool), offsets)
    gap = data == 32
    begins = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
    first = np.union1d(starts, begins)
    owner = np.searchsorted(offsets, first, "right") - 1
    last = np.minimum(np.append(first[1:], len(data)), offsets[owner + 1])
    return first, last, owner


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self.prefix = v.prefix
        made = []
        for p, kind in zip(v.pieces, v.types.tolist(), strict=True):
            if kind == BYTE:
                made.append(bytes([int(p[1:-1], 16)]))
            elif kind == CONTROL:
                made.append(b"")
            elif kind == UNKNOWN:
                made.append(" ⁇ ".encode())
            else:
                made.append(p.replace(GAP, " ").encode())
        self.length = np.array([len(m) for m in made])
        self.begin = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(made), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of lists of ids, given in a row."""
        size = self.length[ids]
        done = np.append(0, np.cumsum(size))
        flat = np.arange(done[-1]) + np.repeat(self.begin[ids] - done[:-1], size)
        data = self.bytes[flat]
        ends = done[offsets]
        if self.prefix and len(data):  # the space put before the text goes
            drop = ends[:-1][ends[1:] > ends[:-1]]
            drop = drop[data[drop] == 32]
            data = np.delete(data, drop)
            ends = ends - np.searchsorted(drop, ends)
        texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data))
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:  # some bytes are no UTF-8: row by row
            raw = data.tobytes()
            rows = [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
            return pa.array(rows, pa.string())
        return texts.cast(pa.string())


_held: dict[tuple[str, str], Encoder | Decoder] = {}


def worker(path: str, kind: str) -> Encoder | Decoder:
    """The worker's encoder or decoder with what it remembers."""
    if (path, kind) not in _held:
        vocabulary = Vocabulary.read(path)
        _held[path, kind] = Encoder(vocabulary) if kind == "encoder" else Decoder(vocabulary)
    return _held[path, kind]


IDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])


def encode(docs: DataFrame, model: str, text: str = "text", carry=("doc_id",)) -> DataFrame:
    """``carry`` and ``ids``; ``model`` is a path that every worker can read."""

    def work(batch: pa.RecordBatch, encoder: Encoder) -> dict[str, pa.Array]:
        ids, ends = encoder.encode(*text_bytes(batch.column(text)))
        return {"ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))}

    return map_texts(docs, work, IDS, text, carry=carry, start=lambda: worker(model, "encoder"))


def decode(rows: DataFrame, model: str, ids: str = "ids", carry=("doc_id",), name: str = "text") -> DataFrame:
    """``carry`` and the text (column ``name``) of lists of ids; a null list gives an empty text."""
    names = list(dict.fromkeys([*carry, ids]))
    source = rows.select(*names)
    schema = T.StructType([source.schema[n] for n in carry] + [T.StructField(name, T.StringType())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = worker(model, "decoder")
        for batch in batches:
            first = 0
            length = pc.fill_null(pc.list_value_length(batch.column(ids)), 0).to_numpy()
            ends = np.append(0, np.cumsum(length))
            while first < batch.num_rows:
                last = int(np.searchsorted(ends, ends[first] + SLICE_IDS, "right")) - 1
                part = batch.slice(first, max(1, last - first))
                first += part.num_rows
                listed = part.column(ids).drop_null().flatten().to_numpy()
                own = ends[first - part.num_rows : first + 1]
                texts = decoder.decode(listed, own - own[0])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in carry), texts], [*carry, name]
                )

    return source.mapInArrow(work, schema)
