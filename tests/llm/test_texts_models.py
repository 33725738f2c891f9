from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from featuretable.llm import charlm, quality_classifier
from featuretable.llm.texts import SPACE, SpanHash, slices, spans, text_bytes

TEXTS = ["a bb  a", None, "", "\nx\n", "é  bb", "a bb"]


def test_spans_stop_at_text_ends():
    data, offsets = text_bytes(pa.array(TEXTS))
    starts, ends, text_of = spans(~SPACE[data], offsets)
    found = [(int(t), data[a:b].tobytes().decode()) for a, b, t in zip(starts, ends, text_of, strict=True)]
    assert found == [(i, w) for i, t in enumerate(TEXTS) for w in re.findall(r"\S+", t or "")]


def test_span_hash_depends_on_content_only():
    data, offsets = text_bytes(pa.array(TEXTS))
    starts, ends, _ = spans(~SPACE[data], offsets)
    words = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    keys = SpanHash(data).of(starts, ends).tolist()
    assert len({*zip(words, keys, strict=True)}) == len({*words}) == len({*keys})


def test_slices_keep_rows_and_bound_bytes():
    batch = pa.record_batch([pa.array(["x" * 10] * 7 + ["y" * 100] + [None, ""])], ["t"])
    parts = list(slices(batch, "t", 25))
    assert sum(p.num_rows for p in parts) == 10
    assert all(len(text_bytes(p.column(0))[0]) <= 25 or p.num_rows == 1 for p in parts)


def _grams(texts, order=3):
    return charlm.codes(*text_bytes(pa.array(texts)), order)


def test_grams_start_anew_with_each_text():
    both, ends = _grams(["abc  d", "", "xyz"])
    assert ends.tolist() == [0, 5, 5, 8]
    assert both.tolist() == _grams(["abc d"])[0].tolist() + _grams(["xyz"])[0].tolist()
    assert _grams(["É"])[0].tolist() == _grams(["é"])[0].tolist()


def test_probabilities_sum_to_one_and_fall_back():
    code, _ = _grams(["the cat sat on the mat and the rat ran", "then there were three"])
    gram, n = np.unique(code, return_counts=True)
    model = charlm.KneserNey(gram, n, 3)
    new = charlm.codes(*text_bytes(pa.array(["梦р"])), 2)[0][-1]
    for context in [int(charlm.context(code)[5]), int(new)]:
        every = charlm.after(context, np.arange(charlm.LETTERS))
        assert len(np.unique(every)) == charlm.LETTERS and set(charlm.context(every).tolist()) == {context}
        assert abs(np.exp(model.score(every).astype(float)).sum() - 1) < 1e-5


def _plain(texts, asked, order):
    """Interpolated modified Kneser-Ney by its definition, with dictionaries of tuples of characters."""

    def grams(t):
        shown = [None] * (order - 1) + list(re.sub(r"[\x20\x09-\x0D]+", " ", t.lower()))
        return [tuple(shown[i - order + 1 : i + 1]) for i in range(order - 1, len(shown))]

    counts = {}
    for t in texts:
        for g in grams(t):
            counts[g] = counts.get(g, 0) + 1
    levels = {order: counts}
    for m in range(order - 1, 0, -1):
        levels[m] = {}
        for g in levels[m + 1]:
            levels[m][g[1:]] = levels[m].get(g[1:], 0) + 1

    def p(g, m):
        if m == 0:
            return 1 / 65536
        level = levels[m]
        cuts = charlm.discounts(np.array(list(level.values())))
        own = {k: v for k, v in level.items() if k[:-1] == g[:-1]}
        lower = p(g[1:], m - 1)
        if not own:
            return lower
        total = sum(own.values())
        free = sum(cuts[min(v, 3)] for v in own.values()) / total
        c = level.get(g, 0)
        return max(0, c - cuts[min(c, 3)]) / total + free * lower

    return [np.log(p(g, order)) for g in grams(asked)]


def test_model_equals_definition():
    """Over ASCII, Cyrillic, Han and characters beyond the basic plane."""
    for order in (3, 4):
        texts = ["abracadabra abra", "cadabra", "абракадабра и абра", "春眠不觉晓 处处闻啼鸟 春眠", "é🙂 été 🙂é"]
        asked = "abra banana été абра кадабра 处处春眠 闻鸟 🙂é"
        gram, n = np.unique(_grams(texts, order)[0], return_counts=True)
        got = charlm.KneserNey(gram, n, order).score(_grams([asked], order)[0])
        assert np.allclose(got, _plain(texts, asked, order), atol=1e-5)


def test_numbers_of_ngrams_equal_brute_force():
    """The low 6 bits of each symbol, then the high 10 of each, the last symbol lowest; 0 before the text."""
    rng = random.Random(1)
    for order in (2, 3, 4) * 30:
        texts = ["".join(rng.choices("ab é梦🙂р\uffee", k=rng.randint(0, 9))) for _ in range(rng.randint(0, 6))]
        found, ends = charlm.letters(*text_bytes(pa.array(texts, pa.string())))
        want = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            shown = [0] * (order - 1) + found[a:b].tolist()
            for last in range(order - 1, len(shown)):
                gram = [shown[last - k] for k in range(order)]
                want.append(sum((x & 63) << 6 * k | (x >> 6) << 24 + 10 * k for k, x in enumerate(gram)))
        assert charlm.codes_of(found, ends, order).tolist() == want


def test_every_character_of_the_basic_plane_is_a_symbol_of_its_own():
    points = [p for p in range(128, 0x10000) if not 0xD800 <= p < 0xE000]
    found, _ = charlm.letters(*text_bytes(pa.array(["".join(map(chr, points))])))
    same = {p: p for p in points} | {p: ord(chr(p).lower()) for p in range(0xC0, 0xDF) if p != 0xD7}
    same |= {p: p + 32 for p in (*range(0x391, 0x3AA), *range(0x410, 0x430))}
    at = dict(zip(points, found.tolist(), strict=True))
    assert len(set(at.values())) == len(set(same.values())) and min(at.values()) >= charlm.HIGH
    assert all(at[p] == at[q] for p, q in same.items()) and max(at.values()) < charlm.BEYOND
    beyond, _ = charlm.letters(*text_bytes(pa.array(["🙂\U0010ffff"])))
    assert ((beyond >= charlm.BEYOND) & (beyond < charlm.LETTERS)).all()


def test_sharded_model_equals_array_model(spark):
    texts = ["abracadabra abra", "cadabra", "bananas and abracadabra", "a cat and a dog", "абракадабра 处处 \uffee\uffee\uffee"]
    rows = spark.createDataFrame([("x", t, quality_classifier.LEARNS) for t in texts], "lang string, text string, part int")
    counts = quality_classifier.trusted_counts(rows)
    asked = np.unique(_grams(["abra banana xylophone 77 абра 处鸟 \uffee\uffee\uffee\uffee"], 4)[0])
    table = spark.createDataFrame([("x", int(g)) for g in asked.view(np.int64)] + [("y", 5)], "lang string, gram long")
    found = quality_classifier.grams_scored(table, *quality_classifier.model(counts)).collect()
    got = {r.gram: r.logp for r in found if r.lang == "x"}
    gram, n = np.unique(_grams(texts, 4)[0], return_counts=True)
    want = charlm.KneserNey(gram, n, 4).score(asked)
    assert np.allclose([got[int(g)] for g in asked.view(np.int64)], want, atol=1e-4)
    assert (asked.view(np.int64) < 0).any()  # the upper half of the numbers is in use
    assert [r.logp for r in found if r.lang == "y"] == [None]
