"""Every registered query gives the rows of DuckDB on the smallest tables, or those of a version by force where SQL cannot say it."""

import difflib
import math
import os
from collections import defaultdict
from decimal import Decimal

import duckdb
import pytest

from loomgrid.operators import formulas
from loomgrid.plans import MODULES
from loomgrid.plans.views import WITH_PASSES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {name: (q, m.SQL.get(name)) for m in MODULES for name, q in m.QUERIES.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, (float, Decimal)):
        return f"{float(value):.5f}"
    return str(value)


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def distance(a, b):
    table = [[float(i + j) if not i * j else 0.0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (0 if x == y else 1 - ratio(x, y)))
    return table[-1][-1]


def grid_similarities(duck):
    sides = []
    for p in ("p1", "p2"):
        cells = defaultdict(list)
        for doc, row, value in duck.execute(f"{WITH_PASSES} SELECT doc_id, row_ix, raw_value FROM {p} ORDER BY doc_id, row_ix, col_ix").fetchall():
            cells[doc].append(f"{row}:{value}")
        sides.append(cells)
    for doc in sides[0].keys() | sides[1].keys():
        a, b = (x.get(doc, []) for x in sides)
        yield {"doc_id": doc, "similarity": round(max(0.0, 1 - distance(a, b) / max(len(a), len(b))), 6)}


def sequence_ratios(duck):
    for key, name, kind in duck.execute("SELECT p_partkey, p_name, p_type FROM part").fetchall():
        yield {"p_partkey": key, "ratio": round(ratio(name, f"{kind} {name}"), 6)}


def formula_spans(duck):
    extra = ["AUC0-inf = 12", "n! / (k!)", "sum(i=1..n) x_i", "dC/dt = -k C", "p < 0.05", "x^2 + 1", "lim x->0 f(x)", "C(5, 2) = 10"]
    for doc, text in duck.execute("SELECT doc_id, text FROM documents").fetchall():
        for f in formulas.spans_of(f"{text} {extra[doc % 8]}"):
            yield {"doc_id": doc, **f}


BY_FORCE = {"j12_j13_sequence_similarity": grid_similarities, "i5_sequence_ratio": sequence_ratios, "i14_i16_formulas": formula_spans}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    query, sql = QUERIES[name]
    found = query(spark, SF)
    rows = sorted(tuple(plain(r[c]) for c in sorted(found.columns)) for r in found.collect())
    if sql is None:
        assert rows == sorted(tuple(plain(r[c]) for c in sorted(found.columns)) for r in BY_FORCE[name](duck))
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(found.columns) == sorted(names)
    order = [names.index(c) for c in sorted(names)]
    want = sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
    assert rows == want
