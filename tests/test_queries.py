import math

import duckdb
import pytest

from paperloom import queries_docs, queries_io, queries_more, queries_snapshot, queries_values  # noqa: F401
from paperloom.queries import QUERIES, SQL

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, D)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    assert got
    if name in SQL:
        result = con.execute(SQL[name])
        found = [c[0] for c in result.description]
        assert sorted(found) == names
        want = sorted((tuple(plain(r[found.index(c)]) for c in names) for r in result.fetchall()), key=repr)
        assert got == want


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    import pathlib
    import re
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parent.parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert said.returncode == 0 and int(said.stdout) == len(QUERIES), said.stderr
    for p in (root / "paperloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"paperloom\.llm|from paperloom import llm", p.read_text()), p


@pytest.mark.parametrize("name", ["sort_year_desc_all", "sort_missing_last_all"])
def test_sorts_return_every_document(spark, name):
    sf = "/root/testdata/sf0.01"
    df = QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.orderBy("position").collect()]
    want = duckdb.connect().execute(SQL[name].replace("documents", f"'{sf}/documents.parquet'")).fetchall()
    assert got == sorted(want, key=lambda r: r[-1]) and len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got[-1][1] in ("unknown", "")  # what is missing comes last, and comes
