import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from mosaiq import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = ["classify_nn_cosine", "label_pairing", "cooccurrence_multi_lag", "sliding_windows_partial", "kde1d", "nmf_update_h", "word_label_mi", "joint_angles"]


@pytest.mark.parametrize("name", CHOSEN)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    got = registry.QUERIES[name](spark, FOLDER)
    want = con.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    key = lambda rows: sorted(tuple((v is None, round(v, 5) + 0.0 if isinstance(v, float) else v) for v in r) for r in rows)
    a, b = key(tuple(r[c] for c in order) for r in got.collect()), key(tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert [v for _, v in x] == pytest.approx([v for _, v in y], abs=2e-5) if all(isinstance(v, (int, float)) for _, v in x) else x == y


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_queries_are_known_without_a_session():
    """Importing the entry makes no column, which would need one."""
    found = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], capture_output=True, text=True, cwd=Path(__file__).resolve().parent.parent)
    assert int(found.stdout) >= len(registry.QUERIES), found.stderr
