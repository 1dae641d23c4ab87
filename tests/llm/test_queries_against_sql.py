"""The corpus queries that have SQL give the rows of DuckDB on the smallest tables, and all of them give a row for each document, vector or piece."""

import pytest

from loomgrid.llm import queries
from tests.test_queries_against_sql import SF, duck, plain  # noqa: F401


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query(spark, duck, name):  # noqa: F811
    found = queries.QUERIES[name](spark, SF)
    cursor = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(found.columns)
    got = sorted(tuple(plain(r[c]) for c in sorted(names)) for r in found.collect())
    order = [names.index(c) for c in sorted(names)]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("op1_exact_top_k", "op9_best_fit_packing")])
def test_every_document_has_a_row(spark, duck, name):  # noqa: F811
    assert queries.QUERIES[name](spark, SF).count() == duck.execute("SELECT count(*) FROM documents").fetchone()[0]
