from __future__ import annotations

import re
from collections import Counter, defaultdict

from featuretable.llm import divergence

TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows) -> set[tuple]:
    rows = [(lang or "", source or "", TERMS.findall((text or "").translate(ASCII_LOWER))) for lang, source, text in rows]
    documents, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in rows:
        documents[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in documents[lang].items() if n >= 3)

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // total for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, top in (("pair", pairs, None), ("term", terms, 200)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:top])}
    return out


def as_set(df) -> set[tuple]:
    found = [(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect()]
    assert len(set(found)) == len(found)
    return set(found)


ROWS = [
    ("en", "a", "The cat, the cat! the-cat sat"), ("en", "a", "The cat, the cat! the-cat sat"), ("en", "b", "cat sat cat(sat) THE"),
    ("en", "b", "a1 a2 a3 rare1"), ("en", "c", "rare2 x"), ("en", "c", "rare,"), ("en", "d", "12 345 -- !"), ("en", None, None),
    ("de", "a", "Über über ÜBER über"), ("de", "a", "über Über"), ("de", "b", "Über"), (None, None, "ein Wort ein Wort"),
    (None, "a", "ein Wort"), (None, "b", "ein Wort,ein Wort"), ("fr", "a", ""), ("fr", "b", "seul"),
    ("xx", "one", "nothing here three times"), ("en", "a", " ".join(f"w{i}z,w{i % 7}y" for i in range(3000))),
    ("en", "b", "-".join(f"n{i}" for i in range(3000))), ("en", "c", "n1 n2"), ("en", "c", "n1,n n"), ("en", "e", "a b\x1fc\x00d 梦🙂"),
    ("en", "e", "梦🙂 梦🙂x"), ("en", "f", "(梦🙂)\t梦🙂\x0b\x0c"),
]


def test_equals_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "lang string, source string, text string")
    found = as_set(divergence.audit(docs.repartition(5)))
    assert found == brute_force(ROWS)
    assert {len({r[1] for r in found if r[0] == lang and r[2] == "pair"}) for lang in ("fr", "xx")} == {0, 2}


def test_terms_of_rare_chunks_are_kept_by_distinct_documents(spark):
    same = [("en", "a", "odd1 odd2 odd3 odd4")]  # four chunks, one document
    three = [("en", "a", "new1"), ("en", "b", "new2 new3"), ("en", "b", "new2")]
    docs = spark.createDataFrame(same + three, "lang string, source string, text string")
    kept = divergence.kept_terms(divergence.chunk_terms(divergence.chunk_counts(docs))).collect()
    assert [(r.lang, r.term) for r in kept] == [("en", "new")]


def test_small_runs_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "lang string, source string, text string")
    monkeypatch.setattr(divergence, "RUN_BYTES", 40)
    assert as_set(divergence.audit(docs)) == brute_force(ROWS)


def test_edge_cases(edges, nothing):
    assert as_set(divergence.audit(edges)) == brute_force([(r.lang, r.source, r.text) for r in edges.collect()])
    assert divergence.audit(nothing).count() == 0


def test_counts_meet_in_one_shuffle(spark):
    texts = [("en", "a", "The the, (THE) 12 -- the-cat"), ("en", "a", "cat;"), ("en", "b", "cat Über über")]
    docs = spark.createDataFrame(texts, "lang string, source string, text string").coalesce(1)
    counts = divergence.chunk_counts(docs)
    found = {(r.lang, r.source, r.term, r.n, r.df) for r in counts.collect()}
    # One row per term of a group, however it was written.
    wanted = {("en", "a", "the", 4, 1), ("en", "a", "cat", 2, 2), ("en", "b", "cat", 1, 1), ("en", "b", "Über", 1, 1), ("en", "b", "über", 1, 1)}
    assert found == wanted and counts.count() == len(wanted)
    kept = divergence.kept_cells(divergence.chunk_terms(counts))
    assert kept._jdf.queryExecution().sparkPlan().toString().count("Exchange") == 1  # the one that is asked for
    assert kept._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1  # and no more to add up
    assert {(r.source, r.term, r.c, r.c_lang, r.df_lang, r.leads) for r in kept.collect()} == {
        ("a", "cat", 2, 3, 3, True), ("b", "cat", 1, 3, 3, False),
    }
