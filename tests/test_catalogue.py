import os

import duckdb
import pytest

DATA = os.environ.get("CAIRN_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "documents events labels lineitem pages"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _names():
    from cairn.plans import QUERIES

    return sorted(QUERIES)


def _rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else "~" if v is None else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", _names())
def test_query(spark, duck, name):
    from cairn.plans import ORACLES, QUERIES

    df = QUERIES[name](spark, DATA)
    got = _rows([tuple(r) for r in df.collect()], df.columns)
    if name not in ORACLES:
        assert got
        return
    res = duck.execute(ORACLES[name])
    columns = [c[0] for c in res.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(res.fetchall(), columns) == got


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """The test tables with empty and null texts among the documents and empty pages."""
    d = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN doc_id % 9 = 2 THEN '' WHEN doc_id % 11 <> 3 THEN text END AS text) FROM '{DATA}/documents.parquet') TO '{d}/documents.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN page_id % 9 <> 2 THEN html ELSE '' END AS html) FROM '{DATA}/pages.parquet') TO '{d}/pages.parquet' (FORMAT parquet)")
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return str(d), con


@pytest.mark.parametrize("name", ["q02_put_info", "q09_reassemble", "q25_rebuild_complete", "q26_verify", "q28_cdc_roundtrip", "q42_mime_sniff"])
def test_texts_without_bytes(spark, odd, name):
    from cairn.plans import ORACLES, QUERIES

    df = QUERIES[name](spark, odd[0])
    res = odd[1].execute(ORACLES[name])
    columns = [c[0] for c in res.description]
    assert _rows(res.fetchall(), columns) == _rows([tuple(r) for r in df.collect()], df.columns)


def test_ranges_prune_columns_and_push_filters(spark):
    from cairn.plans import QUERIES

    plan = QUERIES["q15_latest_version"](spark, DATA)._jdf.queryExecution().toString()
    assert "ReadSchema" in plan or "PushedFilters" in plan
    top = QUERIES["q14_list_page"](spark, DATA)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in top
