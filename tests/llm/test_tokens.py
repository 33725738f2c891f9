from __future__ import annotations

import random
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from featuretable.llm import packing, queries, sentencepiece
from featuretable.llm.texts import text_bytes
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

WORDS = queries.vocabulary(queries.TOKENIZER)
PIECES = queries.vocabulary(queries.PIECES)


# -- packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORDS)


ODD = ["it's", "It'S.", "('s", "<|endoftext|>", "<|ENDOFTEXT|>x", "a.b", "H̱x", "İ.", "ΣΑΣ.", "a)́", "　", "été,", "梦.", "\x1c", "\x85", "’s", "ﬁ.", " ", "\n"]


def test_word_tokens_equal_the_tokenizer(tokenizer, docs):
    rng = random.Random(2)
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, 9))) for _ in range(1500)] + [None]
    texts += [r.text for r in docs.collect()]
    ids, ends = packing.WordTokens(WORDS).encode(*text_bytes(pa.array(texts, pa.string())))
    for i, text in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


class Counting:
    """A tokenizer that notes how many texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_new_words_of_letters_share_a_text(tokenizer):
    rng = random.Random(7)
    odd = ["İx", "ΣΑΣ", "Ǆa", "ﬁn", "ªb", "ŉc", "각", "ᄀ", "が", "ไ", "한글", "Жук", "ß", "ÀÉ", "梦梦", "𝐀b"]
    plain = ["".join(rng.choices("abcdéÀßñ", k=rng.randint(2, 12))) for _ in range(4000)]
    for words, most in ((plain, 200), (plain + odd * 3, 4300), (odd, 100), (["a1", "b-c"], 2), (["x"], 1)):
        tokens = packing.WordTokens(WORDS)
        tokens.tokenizer = Counting(tokens.tokenizer)
        for _ in range(2):  # the second time, words are remembered
            text = " ".join(rng.sample(words, len(words)))
            ids, ends = tokens.encode(*text_bytes(pa.array([text, None, text], pa.string())))
            want = tokenizer.encode(text, add_special_tokens=False).ids
            assert ids.tolist() == want * 2
            assert ends.tolist() == [0, len(want), len(want), 2 * len(want)]
        assert tokens.tokenizer.texts <= most


def check_packed(rows, texts, tokenizer):
    """``texts``: list of (doc_id, text), repeated rows included."""
    want = defaultdict(int)
    for doc_id, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for start in range(0, len(ids), 2048):
            part = ids[start : start + 2048]
            want[doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    got = defaultdict(int)
    sequences = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return sequences


def test_pack_covers_every_token_once(docs, tokenizer, spark, sf_dir):
    rows = queries.op10(spark, sf_dir).collect()
    sequences = check_packed(rows, [(r.doc_id, r.text) for r in docs.collect()], tokenizer)
    total = sum(r.length for r in rows)
    assert len(sequences) <= -(-total // 2048) + 2


def test_pack_edges(edges, nothing, tokenizer):
    rows = packing.pack(edges, WORDS).collect()
    check_packed(rows, [(r.doc_id, r.text) for r in edges.collect()], tokenizer)
    assert packing.pack(nothing, WORDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=40))
def test_first_fit_decreasing_equals_plain_search(lengths):
    lengths = np.array(lengths)
    bins, offsets = packing.first_fit_decreasing(lengths, 50)
    free, want = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        b = next((k for k, f in enumerate(free) if f >= lengths[i]), len(free))
        if b == len(free):
            free.append(50)
        want[int(i)] = (b, 50 - free[b])
        free[b] -= int(lengths[i])
    assert [(int(b), int(o)) for b, o in zip(bins, offsets, strict=True)] == [want[i] for i in range(len(lengths))]


# -- SentencePiece


@pytest.fixture(scope="module")
def library():
    import sentencepiece as spm

    return spm.SentencePieceProcessor(model_file=PIECES)


def encoded(encoder, texts):
    ids, ends = encoder.encode(*text_bytes(pa.array(texts, pa.string())))
    return [ids[ends[i] : ends[i + 1]].tolist() for i in range(len(texts))]


def test_bpe_equals_library_and_round_trips(library, docs):
    rng = random.Random(1)
    texts = ["", None, " ", "  a", "a  ", "a\n b", "\t x", "梦執 日本語", "    def f(x):\n        return x  ", "🙂🙂 ok", " " * 37 + "x"]
    texts += ["".join(rng.choices("abehtinrs  \n.,AEé梦", k=rng.randint(1, 40))) for _ in range(800)]
    texts += ["".join(chr(rng.randint(32, 0x9000)) for _ in range(12)) for _ in range(200)]
    texts += [r.text for r in docs.collect()]
    vocabulary = sentencepiece.Vocabulary.read(PIECES)
    encoder, decoder = sentencepiece.Encoder(vocabulary), sentencepiece.Decoder(vocabulary)
    made = encoded(encoder, texts)
    ends = np.append(0, np.cumsum([len(ids) for ids in made]))
    back = decoder.decode(np.array([i for ids in made for i in ids]), ends).to_pylist()
    for text, ids, again in zip(texts, made, back, strict=True):
        assert ids == library.encode(text or "")
        assert again == (text or "").replace("▁", " ")


def test_bytes_that_are_no_text_are_replaced(library):
    decoder = sentencepiece.Decoder(sentencepiece.Vocabulary.read(PIECES))
    rows = [[264, 3 + 0xFF, 287], [], [264, 287]]
    ends = np.array([0, 3, 3, 5])
    got = decoder.decode(np.array([i for r in rows for i in r]), ends).to_pylist()
    assert got == ["a\ufffd b", "", "a b"]


def test_unigram_maximum_equals_brute_force():
    pieces = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "cab"]
    scores = np.array([0, -3.0, -2.1, -2.3, -2.2, -3.1, -3.6, -5.9, -3.3, -4.7, -3.05, -6.01])
    types = np.array([2] + [1] * 11)
    vocabulary = sentencepiece.Vocabulary(pieces, scores, types, sentencepiece.UNIGRAM, True, 0)
    encoder = sentencepiece.Encoder(vocabulary)
    rng = random.Random(0)
    texts = ["".join(rng.choices("abcx", k=rng.randint(1, 8))) for _ in range(150)]

    def best(unit):
        found = None
        for n in range(len(unit)):
            for cuts in combinations(range(1, len(unit)), n):
                parts = [unit[a:b] for a, b in zip((0, *cuts), (*cuts, len(unit)), strict=True)]
                if all(p in pieces or len(p) == 1 for p in parts):
                    ids = [pieces.index(p) if p in pieces else 0 for p in parts]
                    value = sum(scores[i] if i else encoder.low for i in ids)
                    if found is None or value > found[0] + 1e-9:
                        found = (value, ids)
        return found

    for text, ids in zip(texts, encoded(encoder, texts), strict=True):
        value, _ = best("▁" + text)
        assert sum(scores[i] if i else encoder.low for i in ids) == pytest.approx(value)


def test_spark_round_trip(edges, nothing):
    ids = sentencepiece.encode(edges, PIECES, carry=("doc_id", "text"))
    rows = sentencepiece.decode(ids, PIECES, carry=("doc_id", "text"), name="back").collect()
    assert len(rows) == 10
    assert all(r.back == (r.text or "").replace("▁", " ") for r in rows)
    assert sentencepiece.encode(nothing, PIECES).count() == 0
