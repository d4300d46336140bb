"""Every query against its SQL twin in DuckDB at sf0.001, and that the rest works without the llm subpackage."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry_points
from lamina.functions import stemmer
from lamina.operators import sampler
from lamina.plans import oracles, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def canon(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(repr([list(r[i]) if isinstance(r[i], list | tuple) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    assert got[1]
    if name in oracles.ORACLE_SQL:
        r = duck.execute(oracles.ORACLE_SQL[name])
        assert got == canon([d[0] for d in r.description], r.fetchall())


def test_porter_stems_has_every_term(spark):
    stems = {r["term"]: r["stem"] for r in queries.porter_stems(spark, SF).collect()}
    assert set(stems) == {r["term"] for r in queries.vocabulary(spark, SF).select("term").collect()}
    assert any(not t.isascii() for t in stems) and all(stems[t] == stemmer.stem(t) for t in stems)


def test_sampler_queries_and_defaults():
    whole, own = sampler.Settings(), queries._settings()
    assert (whole.iterations, whole.warm_up, whole.trace_every) == (100_000, 10_000, 1_000)
    assert (own.iterations, own.warm_up, own.round) == (2_000, 200, 500)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_without_llm(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/lamina", tmp_path / "lamina", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, timeout=120)


@pytest.mark.parametrize("name", "dcm_weighted skewed_kl segment_gradient segment_logprob best_cut dcm_gradient dcm_document".split())
def test_sums_over_terms_write_no_words(spark, monkeypatch, name):
    """What asks for sums over a document's terms neither writes nor shuffles its words: rows after the counts are fewer than terms."""
    monkeypatch.setattr(queries, "bucketed", None)
    df = queries.QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() and "MapInArrow" in plan and "Join" not in plan and "term#" not in plan


@pytest.mark.parametrize("name", ["dictionary_round_trip", "vector_projections"])
def test_ids_are_read_where_they_are_made(spark, monkeypatch, name):
    """Encoded documents are neither written nor joined with a dictionary, and their arrays aren't sorted again."""
    monkeypatch.setattr(queries, "bucketed", None)
    df = queries.QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() and "Join" not in plan and "array_sort" not in plan and "Generate" not in plan
