"""The pipeline's stages, and the queries with SQL."""

from collections import Counter

import corpus_pipeline
from tagmask.llm import queries
from tagmask.llm.common import read, written
from tests.llm.test_operators import DIR, brute_classes, check_packing, odd_rows
from tests.test_queries import compare


def test_sql(spark):
    for name, sql in queries.ORACLE_SQL.items():
        compare(spark, name, queries.QUERIES[name], sql)


def test_stages(spark):
    docs = start = read(spark, DIR, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DIR), f"test-{name}")
        kept[name] = docs
        if name != "packing":
            assert docs.columns == start.columns
    assert kept["language_id"].count() == start.count()
    before = [(r.doc_id, r.text) for r in kept["toxicity"].collect()]
    classes = brute_classes(before)
    assert sorted(r.doc_id for r in kept["near_duplicates"].collect()) == sorted(set(classes.values()))
    mixed = Counter(r.doc_id for r in kept["mixing"].collect())
    assert set(mixed) <= set(classes.values()) and max(mixed.values()) <= 2
    rows = kept["packing"].collect()
    check_packing(rows, 4096)
    assert Counter(r.doc_id for r in rows if r.piece == 0) == mixed
    assert sorted(map(tuple, corpus_pipeline.run(spark, DIR).select("doc_id", "piece", "length").collect())) == sorted((r.doc_id, r.piece, r.length) for r in rows)


def test_stages_on_odd_rows(spark):
    for frame in (odd_rows(spark), odd_rows(spark).limit(0)):
        docs = frame
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, DIR), f"odd-{name}")
        docs.count()
