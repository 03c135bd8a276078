"""Every registered query with SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from pageloom.plans import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def norm(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return f"{float(x):.5f}"
    return str(x.replace(tzinfo=None)) if hasattr(x, "tzinfo") else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def readability(duck):
    """Sentence by sentence in plain Python."""
    from pageloom.functions import language

    for i, t in duck.execute("select item_id, text from benchmark").fetchall():
        f, g = language.fluency(t), language.grammaticality(t)
        yield {"doc_id": i, "fluency": round(f, 6), "grammaticality": round(g, 6), "plausibility": round(0.6 * f + 0.4 * g if f or g else 0.0, 6)}


def page_blocks(duck):
    """Pages one by one in plain Python."""
    from pageloom.functions import layout

    pages = {}
    for page, n, q, disc, tax in duck.execute("select l_orderkey, l_linenumber, l_quantity, l_discount, l_tax from lineitem").fetchall():
        pages.setdefault(page, []).append((n, [q, disc * 700, q + 20 + tax * 400, disc * 700 + 12], disc * 10))
    for page, rows in pages.items():
        words = [{"text": f"w{n}", "bbox": b, "confidence": c} for n, b, c in sorted(rows)]
        for b in layout.reading_order(layout.blocks_of(words, 612.0, 792.0), 612.0):
            yield {"page_id": page, "order": b["order"], "column": b["column"], "text": b["text"], "words": len(b["words"])}


#: Queries that SQL can't express are held against plain loops.
PLAIN = {"readability": readability, "page_blocks": page_blocks}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())
    if name not in SQL:
        assert got == sorted(tuple(norm(r[c]) for c in cols) for r in PLAIN[name](duck))
        return
    r = duck.execute(SQL[name])
    at = [[c[0] for c in r.description].index(c) for c in cols]
    assert got == sorted(tuple(norm(row[i]) for i in at) for row in r.fetchall())


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
