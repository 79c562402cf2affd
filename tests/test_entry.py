import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_imports_without_the_llm_folders(tmp_path):
    for name in ("__spark_entry__.py", "routegraph"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "routegraph" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 30 and out[1:] == ["False", "False"]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_graph_queries_equal_their_sql(spark):
    from routegraph.plans.queries import ORACLES, QUERIES

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, str(DATA))
        want = db.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(got.columns) == sorted(columns), name
        assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.fetchall())), name
