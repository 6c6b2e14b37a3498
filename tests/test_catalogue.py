"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

from quarry.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(pdf):
    return sorted(map(str, pdf[sorted(pdf.columns)].astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_whole_results_are_registered(spark, sf, duck):
    """Every term, position and lineitem column, not those of one or two terms."""
    n = duck.execute(ORACLES["text_postings_all"]).df()
    assert n["term"].nunique() > 100 and n["tf"].max() > 1
    assert len(duck.execute(ORACLES["text_tfidf_all"]).df()) == len(n)
    assert QUERIES["describe_all"](spark, sf).count() == len(duck.execute("DESCRIBE lineitem").df())


def test_the_rest_stands_without_the_training_data_part():
    """With quarry.llm and the pipeline out of reach, the entry lists the engine's queries alone."""
    import subprocess
    import sys
    from pathlib import Path

    code = """
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("quarry.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
from quarry.plans.catalogue import QUERIES, ORACLES
assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(ORACLES)
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1]).returncode == 0
