from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from featuretable.llm import context_tree, queries

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DEPTH = 5


def words_of(text) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))


def brute_force(texts: list, learn: list[bool]) -> list[tuple]:
    """Tokens, known ones, base score and score of each text, by a dictionary of all nodes."""
    tokens = [[*words_of(t), ""] for t in texts]
    coded = [(" ".join(t[:-1]) + "\n").encode() for t in tokens]

    def decisions(data):
        padded = b"\n" * DEPTH + data
        for p, x in enumerate(data):
            context = padded[p : p + DEPTH]
            for k in range(8):
                yield [(context[DEPTH - d :], (1 << k) | (x >> (8 - k))) for d in range(DEPTH + 1)], (x >> (7 - k)) & 1

    counts = defaultdict(lambda: [0, 0])
    for data, use in zip(coded, learn, strict=True):
        for nodes, bit in decisions(data) if use else ():
            for node in nodes:
                counts[node][bit] += 1
    weight, below, stop = {}, defaultdict(float), {}
    for depth in range(DEPTH, -1, -1):
        for (context, prefix), (a, b) in counts.items():
            if len(context) == depth:
                own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
                node = (context, prefix)
                if depth == DEPTH:
                    weight[node], stop[node] = own, 1.0
                else:
                    weight[node] = float(np.logaddexp(own, below[node])) - math.log(2)
                    stop[node] = math.exp(own - math.log(2) - weight[node])
                if depth:
                    below[context[1:], prefix] += weight[node]

    def chance(nodes, bit):
        known = [n for n in nodes if n in counts]
        p, left = 0.0 if known else 0.5, 1.0
        for n in known:
            share = 1.0 if n == known[-1] else stop[n]
            p += left * share * (counts[n][bit] + 0.5) / (sum(counts[n]) + 1)
            left *= 1 - share
        return p

    seen = Counter(t for own, use in zip(tokens, learn, strict=True) if use for t in own)
    total, distinct = sum(seen.values()), len(seen)
    out = []
    for own, data in zip(tokens, coded, strict=True):
        base = sum(math.log10((seen[t] + 1) / (total + distinct + 1)) for t in own)
        score = sum(math.log10(chance(nodes, bit)) for nodes, bit in decisions(data))
        out.append((len(own), sum(seen[t] > 0 for t in own), total, base, score))
    return out


def check(rows, texts, learn):
    want = brute_force(texts, learn)
    key = lambda r: tuple(round(x, 5) if isinstance(x, float) else x for x in r)
    mine = [(not r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows]
    theirs = [(use, *w) for use, w in zip(learn, want, strict=True)]
    assert len(mine) == len(theirs)
    for a, b in zip(sorted(mine, key=key), sorted(theirs, key=key), strict=True):
        assert a[:4] == b[:4]
        assert a[4:] == pytest.approx(b[4:], rel=1e-9, abs=1e-9)


TEXTS = [
    "The cat sat on the mat.\nThe cat  sat.", "the cat sat on the mat", "THE DOG sat\ton the log", "", None, " \r\n ",
    "Ünïcode ▁ é́ 梦 🙂 \x00 done", "zzzzzzzzzz", "the the the the the", "a", "the cat sat on the mat",
]


@pytest.mark.parametrize("held", [5, 100])
def test_equals_brute_force(spark, held):
    learn = [i % 7 != held % 7 if held < 100 else False for i in range(len(TEXTS))]
    docs = spark.createDataFrame(list(zip(range(len(TEXTS)), TEXTS, learn, strict=True)), "doc_id long, text string, use boolean")
    check(context_tree.score(docs.repartition(3), F.col("use")).collect(), TEXTS, learn)


def test_small_slices_and_blocks_change_nothing(spark, monkeypatch):
    learn = [i % 3 != 0 for i in range(len(TEXTS))]
    docs = spark.createDataFrame(list(zip(range(len(TEXTS)), TEXTS, learn, strict=True)), "doc_id long, text string, use boolean")
    monkeypatch.setattr(context_tree, "SLICE", 30)
    monkeypatch.setattr(context_tree, "BLOCK_BYTES", 50)
    monkeypatch.setattr(context_tree, "PART_ROWS", 20)
    check(context_tree.score(docs.coalesce(1), F.col("use")).collect(), TEXTS, learn)


def test_log_gamma():
    values = [0.5, 1.0, 1.5, 2.0, 7.5, 100.5, 1e6 + 0.5, 1e12]
    found = context_tree._log_gamma(np.array(values))
    assert found == pytest.approx([math.lgamma(x) for x in values], rel=1e-12, abs=1e-11)


def test_chances_of_all_bytes_sum_to_one(spark):
    """After any context, seen or not, the 256 bytes share one."""
    data, ends = context_tree.sequences(np.frombuffer(b"abracadabra abraxas", np.uint8), np.array([0, 19]))
    keys, n = np.unique(context_tree.grams(data, ends), return_counts=True)
    counts = spark.createDataFrame([(int(k), int(m)) for k, m in zip(keys, n, strict=True)], "key long, n long")
    contexts = [int(keys[3]) >> 8, int(keys[-1]) >> 8, int.from_bytes(b"zzbra", "big"), 0]
    asked = [((c << 8) | x, 0) for c in contexts for x in range(256)]
    new = spark.createDataFrame(asked, "key long, n long").join(counts, "key", "left_anti")
    found = context_tree.gram_scores(counts.union(new)).filter((F.col("key") / 256).cast("long").isin(contexts))
    sums = found.groupBy((F.col("key") / 256).cast("long")).agg(F.sum(F.exp("value")), F.count("*")).collect()
    assert len(sums) == 4
    for _, total, rows in sums:
        assert rows == 256 and total == pytest.approx(1.0, abs=1e-9)


def test_edge_cases(spark, edges, nothing):
    long = edges.filter("length(text) < 10000 OR text IS NULL")
    rows = long.collect()
    learn = [r.doc_id is not None for r in rows]
    found = context_tree.score(long, F.col("doc_id").isNotNull()).collect()
    check(found, [r.text for r in rows], learn)
    assert context_tree.score(edges, F.lit(None).cast("boolean")).count() == edges.count()
    assert context_tree.score(nothing, F.lit(True)).count() == 0


def test_query_separates_text_from_noise(spark, sf_dir):
    rows = queries.QUERIES["op12_lm_scoring"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.score < 0 and r.base_score < 0 and r.n_known <= r.n_tokens
