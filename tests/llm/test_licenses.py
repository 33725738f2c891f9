from __future__ import annotations

import random
import re

from featuretable.llm import licenses

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base_brute(text):
    words = words_of(text)
    places = []
    for phrase, label in licenses.BASE.items():
        own = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    at = [i for i, _ in places]
    labels = ",".join(sorted({x for _, x in places}))
    return len(words), len(places), min(at, default=None), max(at, default=None), labels


def check(df, rows):
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, text in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_brute(text), i
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1
    return got


def test_base_equals_brute_force(docs):
    got = check(docs, [(r.doc_id, r.text) for r in docs.collect()])
    assert any(r.n_base for r in got.values())


def test_random_mixes_equal_brute_force(spark):
    rng = random.Random(4)
    parts = ["cc", "by", "CC", "BY-", "general", "public", "License", "GNU", "all", "rights", "reserved", "all rights", "x", "of", "the\n", "cc\nby", "Ébad", "9"]
    rows = [(i, " ".join(rng.choices(parts, k=rng.randint(0, 25)))) for i in range(400)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_templates_are_found_with_their_spans(spark):
    mit, apache = dict(licenses.TEMPLATES)["mit"], dict(licenses.TEMPLATES)["apache-2.0"]
    part = " ".join(words_of(mit)[:60]) + " something else here " + " ".join(words_of(mit)[60:])
    rows = [
        (1, "Some file header\n" + mit),
        (2, "x " * 50 + part.upper()),
        (3, apache + "\n\n" + mit),
        (4, " ".join(words_of(mit)[:12])),
        (5, "to any person and the software without any limitation to the rights of the copies"),
        (6, " ".join(reversed(words_of(mit)))),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(words_of(mit))
    assert got[1].labels == "mit" and got[1].score == 1.0
    assert [(s.label, s.first, s.last) for s in got[1].spans] == [("mit", 3, n + 2)]
    assert got[2].labels == "mit" and got[2].score > 0.95
    assert got[3].labels == "apache-2.0,mit"
    assert got[4].labels == "" and 0 < got[4].score < 0.5
    assert got[5].labels == "" and got[6].labels == ""


def test_matching_statistics_equal_brute_force():
    automaton = licenses.Automaton((("a", "a b c a b d e f g"), ("b", "c a b d x f g a b c a b")), {"a b": "p"})
    texts = ["a b c a b d e f g", "c a b d x f g", "b d e f a b c a b d x f g a b c"]
    whole = [licenses.split_words(t) for t in ("a b c a b d e f g", "c a b d x f g a b c a b")]
    vocabulary = sorted({w for s in whole for w in s})
    for text in texts:
        words = licenses.split_words(text)
        blocks = automaton.stream([vocabulary.index(w) for w in words], 0)[1]
        lengths = []
        for end in range(len(words)):
            lengths.append(max(k for k in range(end + 2) if k == 0 or any(
                words[end - k + 1 : end + 1] == s[i : i + k] for s in whole for i in range(len(s)))))
        want = {
            (e - n + 1, n) for e, n in enumerate(lengths)
            if n >= licenses.LONG and (e + 1 == len(words) or lengths[e + 1] <= n)
        }
        assert {(at, n) for at, n, _ in blocks} == want


def test_edges(edges, nothing):
    rows = licenses.scan(edges).collect()
    assert len(rows) == 10
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].n_words == by[2].n_words == 0 and by[1].first_word is None and by[1].labels == "" and by[1].score == 0
    assert by[5].n_words == 6 * 60_000 + 1
    assert licenses.scan(nothing).count() == 0
