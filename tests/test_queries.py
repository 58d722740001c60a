"""Each query gives the rows of its SQL."""

from collections import Counter

import pytest

from castflow import queries as Q
SMALL = "/root/testdata/sf0.001"


def rows_of(names, rows):
    order = [names.index(n) for n in sorted(names)]
    return Counter(tuple(r[i] for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, duck, name):
    df = Q.queries()[name](spark, SMALL)
    found = duck.execute(Q.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, found.fetchall())


def test_flagship(spark):
    docs = Q.flagship(spark, SMALL).collect()
    assert len(docs) == 20 and all(d.markdown.startswith("# ") and "## 待确认" in d.markdown for d in docs)
