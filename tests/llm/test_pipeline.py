from __future__ import annotations

import __spark_entry__ as entry
import corpus_pipeline
from featuretable.llm import queries
from featuretable.sources.scratch import materialize


def test_stages_do_their_work(spark, docs, labels, sf_dir):
    from test_dedup import lower, print_of, roots_of

    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], sf_dir), name))
        if name != "packing":
            assert kept[-1].columns == docs.columns
            assert kept[-1].exceptAll(kept[-2]).count() == 0
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    texts = {r.doc_id: r.text for r in docs.collect()}
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    gone = ids[0] - ids[1]
    assert len(gone) and sum(marks.get(i, 1) for i in gone) == len(gone)
    assert ids[2] <= {i for i in ids[1] if len(texts[i].split()) >= 50}
    best = {}
    for i in ids[2]:
        best[lower(texts[i])] = max(i, best.get(lower(texts[i]), i))
    assert ids[3] == set(best.values())
    roots = roots_of([(i, print_of(texts[i])) for i in sorted(ids[3])])
    assert ids[4] == set(roots.values())
    assert ids[5] == ids[4]


def test_pipeline_edges(spark, edges, nothing, sf_dir):
    for frame in (edges, nothing):
        rows = frame
        for name, stage in corpus_pipeline.STAGES:
            rows = materialize(stage(spark, rows, sf_dir), name)
            assert name == "packing" or rows.columns == frame.columns


def test_registered():
    found = entry.queries()
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11))
    assert set(queries.QUERIES) | {"pipeline"} <= set(found)
    assert set(queries.ORACLE) <= set(entry.oracle_sql())


def test_oracles_agree(spark, sf_dir):
    from compare import connect, differences

    con = connect(sf_dir)
    for name, sql in queries.ORACLE.items():
        assert differences(queries.QUERIES[name](spark, sf_dir), con, sql) == []
