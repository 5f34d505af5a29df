import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

SMALL, ROOT = "/root/testdata/sf0.001", os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
duckdb = pytest.importorskip("duckdb")


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_twins_agree(spark):
    from maskwell.plans import catalogue

    con = duckdb.connect()
    for name in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    for name in ("span_to_words", "doc_limits", "image_metrics", "cohort_summary", "stream_prefix_metrics", "png_redact_roundtrip"):
        got = catalogue.queries()[name](spark, SMALL)
        want = con.execute(catalogue.oracle_sql()[name])
        cols = [d[0] for d in want.description]
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(map(key, got.select(cols).collect())) == sorted(map(key, want.fetchall())), name


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_works_without_the_subpackage(tmp_path):
    import shutil

    for name in ("maskwell", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'span_to_words' in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
