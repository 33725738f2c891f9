"""License scan: matching statistics on a generalised suffix automaton, chained to template spans.

The licence templates and the base phrases are token sequences of one generalised suffix automaton: each
state stands for token strings with the same occurrences in the templates. A file's tokens are streamed
through it; after each token the state and the length of the longest match that ends there (the
matching statistic) are known. Where a match cannot be prolonged and has ``LONG`` tokens or more, it is a
block. The blocks of a template are chained: rising in both the file and the template, at most ``GAP``
file tokens apart. The best chain's share of the template is its coverage; from ``COVERED`` on, the
file gets the template's label and the chain its span. A base phrase is found wherever the match that
ends there has the phrase as a suffix, which the state tells.

Tokens outside the templates' vocabulary end every match, so a file is streamed only where two or
more tokens of the vocabulary stand together; the others are found by a vectorised look-up.

The score is the best coverage of any template; a base phrase counts as covered whole.

Edge cases: a null or empty text has no words, no label and score 0. Ties between templates give both
labels; of equal chains the first in the file counts. Texts are read whole. Repeated rows are scanned
alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from featuretable.llm.texts import LOWER, SpanHash, map_texts, spans, text_bytes

LONG = 5
GAP = 24
COVERED = 0.5

# Base phrases and their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Characteristic passages of widespread licences and the label of each.
TEMPLATES = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software.",
    ),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, "
        "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "cc-by",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    (
        "cc-by-sa",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
)

# Word bytes: digits, small letters (after lower-casing) and everything beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True

SPAN = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("first", T.LongType()),
        T.StructField("last", T.LongType()),
        T.StructField("coverage", T.DoubleType()),
    ]
)
OUT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")]
    + [T.StructField(n, T.StringType()) for n in ("base_labels", "labels")]
    + [T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(SPAN))]
)


def lowered_words(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased bytes, and start, end and text number of every word."""
    data = LOWER[data]
    return data, *spans(WORD[data], offsets)


def split_words(text: str) -> list[bytes]:
    raw = np.frombuffer(text.encode(), np.uint8)
    data, starts, ends, _ = lowered_words(raw, np.array([0, len(raw)]))
    return [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]


@dataclass
class State:
    length: int
    link: int
    next: dict[int, int] = field(default_factory=dict)
    ends: dict[int, int] = field(default_factory=dict)  # template -> last token of its first occurrence
    phrases: list[int] = field(default_factory=list)  # base phrases that end what ends here


class Automaton:
    """Generalised suffix automaton of token sequences."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, base: dict[str, str] = BASE):
        self.base = [(split_words(p), label) for p, label in base.items()]
        self.labels = [label for label, _ in templates]
        sequences = [split_words(t) for _, t in templates]
        self.sizes = [len(s) for s in sequences]
        words = sorted({w for s in [*sequences, *(p for p, _ in self.base)] for w in s})
        number = {w: i for i, w in enumerate(words)}
        joined = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        keys = SpanHash(joined).of(np.append(0, ends[:-1]), ends)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

        self.states = [State(0, -1)]
        final = []
        for t, sequence in enumerate([*sequences, *(p for p, _ in self.base)]):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, number[word])
                self.states[last].ends.setdefault(t, at)
            final.append(last)
        by_length = sorted(range(1, len(self.states)), key=lambda s: -self.states[s].length)
        for s in by_length:
            link = self.states[s].link
            for t, at in self.states[s].ends.items():
                held = self.states[link].ends
                held[t] = min(held.get(t, at), at)
        for k in range(len(self.base)):
            self.states[final[len(sequences) + k]].phrases.append(k)
        for s in reversed(by_length):
            self.states[s].phrases = self.states[s].phrases + self.states[self.states[s].link].phrases

    def _extend(self, last: int, token: int) -> int:
        states = self.states
        if token in states[last].next:
            q = states[last].next[token]
            if states[q].length == states[last].length + 1:
                return q
            return self._clone(last, token, q)
        new = len(states)
        states.append(State(states[last].length + 1, 0))
        p = last
        while p >= 0 and token not in states[p].next:
            states[p].next[token] = new
            p = states[p].link
        if p >= 0:
            q = states[p].next[token]
            states[new].link = q if states[q].length == states[p].length + 1 else self._clone(p, token, q)
        return new

    def _clone(self, p: int, token: int, q: int) -> int:
        states = self.states
        new = len(states)
        states.append(State(states[p].length + 1, states[q].link, dict(states[q].next)))
        states[q].link = new
        while p >= 0 and states[p].next.get(token) == q:
            states[p].next[token] = new
            p = states[p].link
        return new

    def tokens(self, keys: np.ndarray) -> np.ndarray:
        """Vocabulary number of each word hash, -1 outside the vocabulary."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.order[at], -1)

    def stream(self, tokens: list[int], first: int):
        """Base phrases and blocks of a run of vocabulary tokens whose first is word ``first``."""
        states = self.states
        places, blocks = [], []
        state = length = 0
        before = (0, 0)
        for at, token in enumerate(tokens, first):
            while state and token not in states[state].next:
                state = states[state].link
                length = states[state].length
            state = states[state].next.get(token, 0)
            length = length + 1 if state else 0
            if before[1] >= LONG and length <= before[1]:
                blocks.append((at - before[1], before[1], before[0]))
            before = (state, length)
            for k in states[state].phrases:
                size = len(self.base[k][0])
                if length >= size:
                    places.append((at - size + 1, k))
        if before[1] >= LONG:
            blocks.append((first + len(tokens) - before[1], before[1], before[0]))
        return places, blocks

    def chains(self, blocks: list[tuple[int, int, int]]) -> dict[int, tuple[float, int, int]]:
        """Per template: coverage, first and last word of its best chain of blocks."""
        found: dict[int, tuple[float, int, int]] = {}
        per: dict[int, list[tuple[int, int, int]]] = {}
        for at, size, state in blocks:
            for t, end in self.states[state].ends.items():
                if t < len(self.labels):
                    per.setdefault(t, []).append((at, size, end - size + 1))
        for t, own in per.items():
            chain: list[tuple[int, int, int]] = []  # tokens so far, template end, first word
            for k, (at, size, where) in enumerate(own):
                best = (size, where + size, at)
                # Blocks further back than a chain can reach are not looked at.
                for j in range(k - 1, -1, -1):
                    before_at, before_size, _ = own[j]
                    if at - before_at - before_size > GAP + self.sizes[t]:
                        break
                    lapped = max(0, before_at + before_size - at, chain[j][1] - where)
                    if at - before_at - before_size > GAP or lapped >= size:
                        continue
                    if chain[j][0] + size - lapped > best[0]:
                        best = (chain[j][0] + size - lapped, where + size, chain[j][2])
                chain.append(best)
                share = min(1.0, best[0] / self.sizes[t])
                if share > found.get(t, (0.0,))[0]:
                    found[t] = (share, best[2], at + size - 1)
        return found


def scan(docs: DataFrame, text: str = "text", carry=("doc_id",), automaton: Automaton | None = None) -> DataFrame:
    """``carry`` and the findings of every text."""
    held = docs.sparkSession.sparkContext.broadcast(automaton or Automaton())

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        a = held.value
        data, starts, ends, text_of = lowered_words(*text_bytes(batch.column(text)))
        texts = batch.num_rows
        count = np.bincount(text_of, minlength=texts)
        first = np.append(0, np.cumsum(count))
        tokens = a.tokens(SpanHash(data).of(starts, ends))
        known = tokens >= 0
        pair = known[1:] & known[:-1] & (text_of[1:] == text_of[:-1])
        begin = np.flatnonzero(pair & ~np.append(False, pair[:-1]))
        end = np.flatnonzero(pair & ~np.append(pair[1:], False)) + 2
        per: dict[int, tuple[list, list]] = {}
        for b, e in zip(begin.tolist(), end.tolist(), strict=True):
            i = int(text_of[b])
            places, blocks = a.stream(tokens[b:e].tolist(), b - int(first[i]))
            if places or blocks:
                held_i = per.setdefault(i, ([], []))
                held_i[0].extend(places)
                held_i[1].extend(blocks)
        rows = {name: [None] * texts for name in ("first_word", "last_word")}
        rows |= {"n_base": [0] * texts, "base_labels": [""] * texts, "labels": [""] * texts}
        rows |= {"score": [0.0] * texts, "spans": [[] for _ in range(texts)]}
        for i, (places, blocks) in per.items():
            base = {a.base[k][1] for _, k in places}
            chains = a.chains(blocks)
            covered = {t: c for t, c in chains.items() if c[0] >= COVERED}
            if places:
                rows["first_word"][i] = min(p for p, _ in places)
                rows["last_word"][i] = max(p for p, _ in places)
            rows["n_base"][i] = len(places)
            rows["base_labels"][i] = ",".join(sorted(base))
            rows["labels"][i] = ",".join(sorted(base | {a.labels[t] for t in covered}))
            rows["score"][i] = 1.0 if places else max((c[0] for c in chains.values()), default=0.0)
            rows["spans"][i] = [
                {"label": a.labels[t], "first": c[1], "last": c[2], "coverage": c[0]}
                for t, c in sorted(covered.items())
            ]
        out = {"n_words": pa.array(count.astype(np.int64))}
        kinds = {f.name: f.dataType for f in OUT}
        for name, values in rows.items():
            if name == "spans":
                kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64())]))
            else:
                kind = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.DoubleType(): pa.float64()}[kinds[name]]
            out[name] = pa.array(values, kind)
        return out

    return map_texts(docs, work, OUT, text, carry=carry)
