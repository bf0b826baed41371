"""Every registered query of the library's own operators against its SQL in DuckDB, over the smallest test tables."""

import numbers
import os

import duckdb
import pandas as pd
import pytest

from trailmark.plans import change_queries, insight_queries, linkage_queries, list_queries, metric_queries, source_queries  # noqa: F401  (they register)
from trailmark.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    plain = lambda v: None if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else round(float(v), 6) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, small, con):
    got = QUERIES[name](spark, small).toPandas()
    if name in ORACLE_SQL:
        want = con.sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_optional_subpackage(tmp_path):
    """The entry imports and lists its queries where the training-text modules are missing."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "trailmark", tmp_path / "trailmark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'a02_total' in n and not any(x.startswith('op') or x == 'pipeline' for x in n)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}).returncode == 0


def test_bodies_are_whole(spark, tmp_path):
    html = "<p>" + "é word " * 40_000 + "end</p>"
    spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    (got,) = QUERIES["s10_retained_bodies"](spark, str(tmp_path)).collect()
    assert got["body_text"].rstrip().endswith("end") and got["body_text"].count("word") == 40_000 and not got["truncated"]
    text = "é word " * 5000 + "end"
    spark.createDataFrame([(5, text, "a")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["s11_whole_bodies"](spark, str(tmp_path)).collect() == [("5", text)]


def test_bodies_are_cut_at_a_given_byte(spark):
    from trailmark.sources.mail import decoded

    df = spark.sql("SELECT base64(encode('abcdé', 'UTF-8')) AS data")
    assert df.select(*[decoded(df["data"], n).alias(f"b{n}") for n in (4, 5, 6)]).first() == ("abcd", "abcd", "abcdé")
