"""Every query of the news engine against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from plumbline.plans import catalogue
from verify import rows

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([d[0] for d in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_known_counts(spark):
    """Clusters of the smallest table: 190 articles, 136 founders."""
    d = QUERIES["leader_clusters"](spark, SF)
    assert (d.count(), d.where("id = leader").count()) == (190, 136)


def test_entry_imports_without_the_training_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "plumbline", tmp_path / "plumbline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), set(e.oracle_sql()) <= set(q))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    assert out.stdout.split()[1:] == ["False", "True"], out.stderr
