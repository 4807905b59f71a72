"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from elutra import oracles, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events embeddings labels".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(frame):
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        frame[c] = frame[c].astype(float).round(5) + 0.0 if frame[c].dtype.kind in "fiu" else frame[c].astype(str)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", ["profile_network", "normalize_profiles", "corr_pairs", "sliding_corr", "qvalue", "fdr_filter", "replicate_outer", "neighbours", "wd_score", "mcl_prune", "dense_ids", "explode_lists", "scan_matrix", "scan_matrix_legacy", "assemble_features", "decoy_sample", "pair_ids", "wd_cutoff", "mcl_grid", "mcl_clusters", "connected_parts", "condition_corr_pairs", "condition_specificity", "pi0_smoother"])
def test_query_equals_sql(spark, db, name):
    got, want = plain(queries.QUERIES[name](spark, SF).toPandas()), plain(db.execute(oracles.SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_every_sql_has_a_query():
    assert set(oracles.SQL) <= set(queries.QUERIES)


def test_entry_imports_without_the_corpus_part():
    """In an interpreter that can find neither the corpus operators nor their pipeline."""
    code = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[:2] == ['elutra', 'llm'] or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as entry
from elutra import queries
assert set(entry.queries()) == set(queries.QUERIES) and set(entry.oracle_sql()) <= set(queries.QUERIES)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent, timeout=120)
