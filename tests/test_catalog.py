import os

import duckdb
import pytest

from tests.compare import connect, same
from veridoc.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, con, name):
    same(catalog.QUERIES[name](spark, FOLDER), con, catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_subpackage(monkeypatch):
    """Whatever keeps it from being imported, a library of its own included."""
    import sys

    import __spark_entry__ as entry

    for name in [n for n in sys.modules if n.startswith("veridoc.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    import veridoc

    monkeypatch.delattr(veridoc, "llm", raising=False)
    assert set(entry.queries()) == set(catalog.QUERIES) and set(entry.oracle_sql()) == set(catalog.ORACLE)


@pytest.mark.parametrize("name", ["html_content_text", "html_sections"])
def test_html_query_equals_sql_where_references_are_cut(spark, tmp_path, name):
    """A heading cut within its last reference; references that lack their semicolon, or that no list has."""
    heads = ["One &amp;&amp;&amp", "Two &am", "Three &quo", "Four &middot; &copy &quot;x&quot", "AT&T &notit; R&D; &amp;copy; &#38", "plain &"]
    page = "<html><head><title>{0}</title></head><body><nav>menu</nav><article><h1>{0}</h1><p>{0}\nmore of it, &ampand on &copy;</p></article></body></html>"
    rows = [(k, f"https://h.example.org/{k}", page.format(h)) for k, h in enumerate(heads)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    same(catalog.QUERIES[name](spark, str(tmp_path)), con, catalog.ORACLE[name])
