"""The queries of the subpackage against their SQL, and the pipeline stage by stage."""

from collections import Counter

import pytest

import corpus_pipeline
from castflow.llm import common
from castflow.llm import queries as Q

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, duck, name):
    df = Q.queries()[name](spark, SMALL)
    found = duck.execute(Q.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    rows = lambda cols, rs: Counter(tuple(r[cols.index(n)] for n in sorted(names)) for r in rs)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, found.fetchall())


def test_all_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries()) == list(range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near duplicates", "decontamination", "packing"]
    out = corpus_pipeline.run(spark, SMALL)
    assert 0 < out.select("doc_id").distinct().count() < before
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), SMALL).columns == columns


def test_pipeline_on_odd_tables(spark, odd_docs):
    """All stages on nulls, repeats and clashing names, and on no rows at all; what goes, goes for its stage's reason."""
    for docs in (odd_docs, odd_docs.limit(0)):
        before = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.save(stage(spark, docs, SMALL), "stage")
            assert docs.columns == odd_docs.columns and docs.count() <= before, name
            before = docs.count()
            if name == "near duplicates":
                ids = {r.doc_id for r in docs.collect()}
                assert not ids or 5 in ids and not ids & {0, 1, 2, 3, 6, 7, 8}
        pieces = corpus_pipeline.pack(spark, docs, SMALL)
        assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_line_stage_drops_fragments_of_copies(spark):
    own = lambda i, n=24: " ".join(f"{chr(97 + i)}{j * 7919 % 1000}x" for j in range(n))
    near = own(0).replace("a919x", "other")
    texts = [f"{own(0)}\n{own(1)}", f"{own(0)}\n{own(1)}\nposted by someone", f"{near}\n{own(1)}.\nseen on monday", f"{own(0)}\n{own(2)}", "three plain words", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, SMALL).collect()}
    assert got == {0: texts[0], 3: own(2), 4: texts[4], 5: None}
