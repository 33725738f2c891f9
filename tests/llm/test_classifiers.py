from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from featuretable.llm import charlm, language_id, queries, toxicity
from pyspark.sql import functions as F


def remainder(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


@pytest.fixture(scope="module")
def larger(spark):
    return spark, "/root/testdata/sf0.01"


def test_language_held_out(docs, spark, sf_dir):
    rows = queries.op8(spark, sf_dir).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert len(rows) == len(truth)
    assert all(r.held_out == (remainder(r.doc_id, 3) == 1) for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert sum(held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_score_is_the_plain_mean(spark):
    rows = [(1, "aaa bbb", "x"), (2, "aab abb", "x"), (3, "zzz yyy", "y"), (4, "abz", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language_id.fit(df, F.lit(True))
    assert models.names == ["x", "y"]
    got = {r.doc_id: r for r in language_id.score(df, models).collect()}
    for i, text, _ in rows:
        code, _ = charlm.codes(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), 3)
        costs = [-float(m.score(code).mean()) for m in models.models]
        assert got[i].cross_entropy == pytest.approx(min(costs), abs=1e-5)
        assert got[i].lang_pred == models.names[int(np.argmin(costs))]


def test_language_edges(edges, nothing):
    rows = language_id.identify(edges, F.lit(True)).collect()
    assert len(rows) == 10
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (1, 2, 4))
    assert by[5].lang_pred == "en" and by[6].lang_pred == "de"
    assert language_id.identify(nothing, F.lit(True)).count() == 0
    unlearned = language_id.identify(edges, F.lit(False)).collect()
    assert {r.lang_pred for r in unlearned} == {"und"}


def test_languages_that_share_a_script(spark):
    """Two languages in Cyrillic letters and two in Han characters, and noise of the letters of one."""
    rng = random.Random(4)
    words = {
        "ru": "это был большой дом у реки где жили старые люди и их дети".split(),
        "uk": "це був великий дім біля річки де жили старі люди та їхні діти".split(),
        "zh": "这是 河边 的 大房子 里面 住着 老人 和 他们 的 孩子".split(),
        "ja": "これは 川辺 の 大家 で 老人 と 子供 が 住んで いた".split(),
    }
    rows, i = [], 0
    for lang, w in words.items():
        for _ in range(60):
            rows.append((i, ("" if lang in ("zh", "ja") else " ").join(rng.choices(w, k=40)), lang))
            i += 1
    noise = list(" ".join(words["ru"] * 3))
    rng.shuffle(noise)
    rows.append((999, "".join(noise), None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(df, (F.col("doc_id") % 3 != 1) & (F.col("doc_id") < 999)).collect()}
    assert all(got[d].lang_pred == lang for d, _, lang in rows[:-1])
    assert got[999].rejected and sum(r.rejected for r in got.values() if r.learn) <= 4


def test_languages_by_joins_equal_those_by_broadcast(spark, edges, nothing, monkeypatch):
    """Models beyond the broadcast bound give the same result, edge cases included."""
    shown = ("doc_id", "lang", "lang_pred", "score", "cross_entropy", "margin", "n_chars_scored")
    more = [(20, "Это был большой дом", "ru"), (21, "这是大房子", "zh"), (22, None, "xx"), (23, "", "xx"), (24, "Это 大房子", None)]
    rows = edges.select("doc_id", "text", "lang").unionAll(spark.createDataFrame(more, "doc_id long, text string, lang string"))

    def got():
        models = language_id.fit(rows, F.lit(True))
        found = language_id.score(rows, models, carry=("doc_id", "lang")).select(*shown).collect()
        return isinstance(models, language_id.Counts), sorted((tuple(r) for r in found), key=lambda r: repr(r[:3]))

    (one, want), _ = got(), monkeypatch.setattr(charlm, "HELD_GRAMS", 0)
    two, have = got()
    assert (one, two) == (False, True) and len(have) == len(want) == 15
    for x, y in zip(have, want, strict=True):
        assert x[:3] == y[:3] and x[6] == y[6]
        assert x[3:6] == pytest.approx(y[3:6], abs=1e-4)
    assert language_id.identify(nothing, F.lit(True)).count() == 0


def test_foreign_text_is_rejected(spark):
    rng = random.Random(1)
    words = "the of and in house river green walks slowly under bright stone water".split()
    rows = [(i, " ".join(rng.choices(words, k=60)), "en") for i in range(50)]
    rows += [(100 + i, " ".join(rng.choices(["der", "die", "und", "ich", "nicht", "auch"], k=60)), "de") for i in range(50)]
    rows.append((999, "qxq zvj " * 20, None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(df, F.lit(True)).collect()}
    assert got[999].rejected
    assert sum(not got[i].rejected and got[i].lang_pred == lang for i, _, lang in rows[:-1]) >= 98


def test_toxicity_held_out(larger):
    spark, folder = larger
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.op7(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in marks]
    toxic = [r.score for r in held if marks[r.doc_id] == 1]
    clean = [r.score for r in held if marks[r.doc_id] == 0]
    ranks = np.mean([(t > c) + 0.5 * (t == c) for t in toxic for c in clean])
    assert ranks > 0.85


def _labelled(spark, n=200):
    rng = random.Random(7)
    words = "the of and in house river green walks slowly under bright stone water".split()
    rows = []
    for i in range(n):
        text = rng.choices(words, k=60)
        if i % 4 == 0:
            text[rng.randrange(60)] = rng.choice(["scumbag", "vermin"])
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, y int")


def test_toxicity_learns_words_and_scores_repeat(spark):
    model = toxicity.fit(_labelled(spark))
    tests = spark.createDataFrame([(1, "a quiet river " * 9), (2, "a quiet vermin river"), (3, "a quiet vermin river")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(tests, model).collect()}
    assert got[1] < 0.5 < got[2] == got[3]


def test_toxicity_verdict_does_not_depend_on_the_mix_of_the_sample():
    rng = np.random.default_rng(5)
    shared = rng.random((8000, 5)) < np.array([0.5, 0.4, 0.3, 0.3, 0.2])
    toxic = rng.random((8000, 5)) < np.array([0.5, 0.4, 0.5, 0.5, 0.6])

    def bias(n_clean, n_toxic):
        y = np.repeat([0.0, 1.0], [n_clean, n_toxic])
        rows, features = np.nonzero(np.concatenate([shared[:n_clean], toxic[:n_toxic]]))
        model = toxicity.Model(np.arange(5), np.array([0.0, 0.0, 0.5, 0.5, 1.0]))
        toxicity.solve(model, rows, features, y)
        return model.bias

    assert abs(bias(8000, 1000) - bias(4500, 4500)) < 0.3


def test_toxicity_recall_and_false_positives_at_one_half(spark, monkeypatch):
    folder = "/root/testdata/sf0.1"
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    for rows in (toxicity.FIT_ROWS, 700):  # the natural mix of labels, and as many of each
        monkeypatch.setattr(toxicity, "FIT_ROWS", rows)
        held = [r for r in queries.op7(spark, folder).filter("held_out").collect() if r.doc_id in marks]
        toxic = [r.predicted for r in held if marks[r.doc_id] == 1]
        clean = [r.predicted for r in held if marks[r.doc_id] == 0]
        assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.03 * len(clean)


def plain_slots(text):
    """Slots of a text of ASCII letters and single spaces, n-gram by n-gram; what comes before the text is 0."""
    raw = text.encode()
    found, _ = charlm.symbols(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    padded = [0] * 4 + found.tolist()
    out = set()
    for order in (3, 4, 5):
        for end in range(5, len(padded) + 1):
            code = 0
            for symbol in padded[end - order : end]:
                code = code << 6 | symbol
            out.add((((code + (order << 29)) & 0xFFFFFFFF) * 0x85EBCA6B & 0xFFFFFFFF) >> 12)
    return out


def test_slot_counts_equal_brute_force(spark):
    rows = _labelled(spark, 200)
    want = {-1: [0, 0]}
    for r in rows.collect():
        for s in plain_slots(r.text) | {-1}:
            want.setdefault(s, [0, 0])[r.y] += 1
    got = {r.slot: [r.n0, r.n1] for r in toxicity.slot_counts(rows).collect()}
    assert got == want


def test_a_slot_hit_by_two_orders_counts_once(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "HASH_BITS", 4)  # so that nearly every slot is hit by every order
    rows = _labelled(spark, 40)
    texts = np.array([30, 10])
    raw = [r.text.encode() for r in rows.collect()]
    found, ends = toxicity.slots(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    text_of, slot = toxicity._pairs(found, ends)
    assert len({*zip(text_of.tolist(), slot.tolist(), strict=True)}) == len(slot)
    assert np.bincount(slot).max() <= texts.sum()


def test_held_out_of_a_null_id_is_that_of_an_empty_string(edges):
    rows = edges.select("doc_id", (queries.fold(5) == 0).alias("toxic"), (queries.fold(3) == 1).alias("lang")).collect()
    for r in rows:
        key = "" if r.doc_id is None else r.doc_id
        assert r.toxic == (remainder(key, 5) == 0) and r.lang == (remainder(key, 3) == 1)


def test_toxicity_edges(spark, edges, nothing):
    model = toxicity.fit(_labelled(spark))
    rows = toxicity.score(edges, model).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[1] == by[2] == by[4]
    assert toxicity.score(nothing, model).count() == 0
    marks = spark.createDataFrame([(2, 1), (5, 1), (6, None), (None, 1)], "doc_id long, toxic int")
    one = toxicity.fit(toxicity.labelled_rows(edges, marks, F.lit(True)))
    assert all(r.score > 0.9 for r in toxicity.score(edges, one).collect())
    none = toxicity.fit(toxicity.labelled_rows(nothing, marks, F.lit(True)))
    assert all(r.score == 0.5 for r in toxicity.score(edges, none).collect())
