from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from featuretable.llm import charlm, quality_classifier, quality_rules
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    words = re.findall(WORD, text or "")
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len({*lines}), len(covered)


def check(rows, texts):
    for r in rows:
        want = brute(texts[r.doc_id])
        assert tuple(r[n] for n in quality_rules.BASE) == want, r.doc_id
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_counts_equal_brute_force(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = quality_rules.quality_rules(docs).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    passed = [r for r in rows if not r.base_failed]
    assert sum(r.kept for r in passed) > 0.85 * len(passed)


def test_bands_reject_gibberish_and_keep_prose(spark):
    rng = random.Random(3)
    words = "the of and in a house river green walks slowly under bright stone water people over every".split()
    prose = [(i, " ".join(rng.choices(words, k=90)), "en") for i in range(300)]
    noise = [(1000 + i, " ".join("".join(rng.choices("qxzjkvwy0%7", k=7)) for _ in range(90)), "en") for i in range(5)]
    rows = quality_rules.quality_rules(spark.createDataFrame(prose + noise, "doc_id long, text string, lang string"))
    kept = {r.doc_id for r in rows.filter("kept").collect()}
    assert not kept & {i for i, _, _ in noise}
    assert len(kept & {i for i, _, _ in prose}) >= 295


def test_scores_by_joins_equal_those_by_broadcast(edges, docs, nothing, monkeypatch):
    """A model beyond the broadcast bound gives the same result, edge cases included."""
    kept = ("doc_id", "text", "lang")
    rows = edges.select(*kept).unionAll(docs.select(*kept).limit(100))
    packed = rows.select(F.struct("doc_id", "text").alias("row"), "lang")

    def got():
        plain = quality_rules.measure(rows, carry=("doc_id", "lang")).collect()
        inner = quality_rules.measure(packed, text="row", field="text", carry=("row", "lang"))
        inner = inner.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("whole"), "*").drop("row").collect()
        return [sorted((tuple(r) for r in part), key=lambda r: repr(r[:4])) for part in (plain, inner)]

    want, _ = got(), monkeypatch.setattr(charlm, "HELD_GRAMS", 0)
    for have, due in zip(got(), want, strict=True):
        assert len(have) == len(due) == 110
        for x, y in zip(have, due, strict=True):
            assert x[:-2] == y[:-2]
            assert x[-2:] == pytest.approx(y[-2:], abs=1e-4)
    assert quality_rules.quality_rules(nothing).count() == 0


def test_bands_reject_noise_of_any_script(spark):
    """Letters of Cyrillic and Han prose in random order, in a language of its own each."""
    rng = random.Random(5)
    words = {
        "ru": "это был большой дом у реки где жили старые люди и их дети".split(),
        "zh": "这是 河边 的 大房子 里面 住着 老人 和 他们 的 孩子".split(),
    }
    rows = [(1000 * k + i, " ".join(rng.choices(w, k=90)), lang) for k, (lang, w) in enumerate(words.items()) for i in range(300)]
    for k, (lang, w) in enumerate(words.items()):
        used = sorted(set("".join(w)))
        rows += [(1000 * k + 900 + i, " ".join("".join(rng.choices(used, k=4)) for _ in range(90)), lang) for i in range(3)]
    kept = {r.doc_id for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).filter("kept").collect()}
    assert not [i for i in kept if i % 1000 >= 900]
    assert len(kept) >= 590


def test_bands_reject_labelled_junk_and_keep_good_text(spark):
    folder = "/root/testdata/sf0.1"
    marks = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    rows = quality_rules.quality_rules(spark.read.parquet(f"{folder}/documents.parquet")).join(marks, "doc_id")
    passed = rows.filter("NOT base_failed").groupBy("quality").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"))
    by = {r.quality: r for r in passed.collect()}
    assert by[0].n > 200 and by[0].kept <= 0.05 * by[0].n
    assert by[1].n > 3000 and by[1].kept >= 0.998 * by[1].n


def test_edges(edges, nothing):
    rows = quality_rules.quality_rules(edges).collect()
    assert len(rows) == 10
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    check([r for r in rows if r.doc_id is not None], {r.doc_id: r.text for r in edges.collect()})
    assert by[1].perplexity is None and by[2].perplexity is None and not by[1].kept
    assert quality_rules.quality_rules(nothing).count() == 0


def test_classifier(docs, labels):
    good = labels.filter("quality = 1").select("doc_id", F.lit(True).alias("good"))
    rows = quality_classifier.classify(docs.join(good, "doc_id", "left"), F.col("good")).collect()
    assert len(rows) == docs.count()
    marks = {r.doc_id: r.quality for r in labels.collect()}
    kept = [r.kept for r in rows if marks.get(r.doc_id) == 1]
    assert sum(kept) >= 0.97 * len(kept)
    bad = [r.kept for r in rows if marks.get(r.doc_id) == 0]
    assert sum(bad) <= 0.8 * len(bad)


def test_limits_and_verdicts_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        lang, part, n = rng.choice(["", "en", "de", "xx"]), rng.choice([0, 0, 1, 2]), rng.choice([0, 5, 80, 900])
        part = {"de": min(part, 1), "xx": 0}.get(lang, part)
        rows.append((i, lang, part, n, None if n == 0 or lang == "xx" else rng.gauss(2, 0.3)))
    kind = "doc_id long, lang string, part int, n_chars_scored long, log_perplexity double"
    got = {r.doc_id: r for r in quality_classifier.verdicts(spark.createDataFrame(rows, kind)).collect()}
    limit = {}
    for lang in ("", "en", "de"):
        for part in (1, 2):
            values = sorted(x - 5 / n**0.5 for _, a, b, n, x in rows if (a, b) == (lang, part) and x is not None)
            if values:
                limit[lang] = max(limit.get(lang, -9), values[math.ceil(0.999 * len(values)) - 1])
    for i, lang, _, n, x in rows:
        assert got[i].judged == (x is not None) and got[i].lang == (lang or None)
        assert got[i].kept == (n > 0 and (x is None or x - 5 / n**0.5 <= limit[lang]))


def test_short_trusted_texts_judge_their_language(spark):
    rng = random.Random(4)
    words = "the of and in house river green walks slowly under bright stone water".split()
    rows = [(i, " ".join(rng.choices(words, k=20)), "en", True) for i in range(200)]
    rows += [(500 + i, " ".join(rng.choices(words, k=20)), "en", False) for i in range(50)]
    rows += [(900 + i, "".join(rng.choices("zqxvkj#|$ ", k=110)), "en", False) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, good boolean")
    assert max(len(r[1]) for r in rows) < 200
    got = {r.doc_id: r for r in quality_classifier.classify(df, F.col("good")).collect()}
    assert all(r.judged for r in got.values())
    assert not any(got[900 + i].kept for i in range(20))
    assert sum(got[500 + i].kept for i in range(50)) >= 47


def test_every_language_with_trusted_text_learns(spark):
    rows = [(i, f"text number {i}", f"l{i}", True) for i in range(40)] + [(99, None, "l99", True), (98, "x", "l0", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, trusted boolean")
    parts = {r.doc_id: r.part for r in quality_classifier.parted(df).collect()}
    assert all(parts[i] == quality_classifier.LEARNS for i in range(40)) and parts[98] == 0 and len(parts) == 42
    many = spark.createDataFrame([(i, f"text number {i}", "en", True) for i in range(500)], df.schema)
    held = quality_classifier.parted(many).filter(F.col("part") == quality_classifier.LIMITS).count()
    assert 50 < held < 150


def test_classifier_edges(edges, nothing):
    rows = quality_classifier.classify(edges, F.col("doc_id") == 5).collect()
    assert len(rows) == 10
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[5].judged and by[5].kept
    assert not by[1].kept and not by[2].kept
    assert not by[6].judged and by[6].kept
    assert quality_classifier.classify(nothing, F.lit(True)).count() == 0
    none = quality_classifier.classify(edges, F.lit(False)).collect()
    assert not any(r.judged for r in none)
