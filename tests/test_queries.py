"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from palaver.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(rows):
    def value(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return v
        return round(float(v), 6) if not math.isnan(float(v)) else None

    return sorted(repr(tuple(map(value, r))) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, db, name):
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = df.select(*cols).collect()
    want = db.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    assert plain(rows) == plain([tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall()])
    assert rows or name == "fts_scoped"


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_else_imports_the_training_data_folder():
    root = Path(queries.__file__).parent.parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"\bllm\b", f.read_text(encoding="utf-8")), f


@pytest.mark.parametrize("name", ["graph_subgraph_nodes", "graph_subgraph_edges", "graph_assignees", "index_counts", "graph_nodes", "graph_edges"])
def test_sentences_are_cut_once_in_queries_that_use_entities_repeatedly(spark, sf_dir, name):
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "row_number" not in plan


def test_a_text_is_folded_once_for_all_keywords(spark, sf_dir):
    plan = entry.queries()["evidence_classes"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
