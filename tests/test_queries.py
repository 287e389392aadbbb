"""Registered plans against their SQL on the smallest tables."""

import os

import pytest

from quaero.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = [
    "bm25_topk", "dense_topk", "rrf_fusion", "metrics_by_subset", "error_categories", "coverage_diff", "normalize_qa", "validation_report", "dataset_stats", "last_wins_dedup", "resume_pending",
    "duplicate_keys", "candidate_union", "lookup_by_pair", "reconcile_rows", "reconcile_counts", "positional_audit", "pack_budget", "marker_spans", "visibility_audit", "run_summary", "error_class", "range_plan", "corpus_fingerprint",
]


def key(row):
    return tuple(str(round(float(v), 5)) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v) for v in row)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", CHOSEN)
def test_plan_equals_sql(spark, name):
    import duckdb

    base = duckdb.connect()
    for t in TABLES:
        base.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    expected = base.sql(catalog.SQL[name])
    columns = sorted(expected.columns)
    found = catalog.QUERIES[name](spark, SF)
    assert sorted(found.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    rows = base.sql(f"SELECT {quoted} FROM ({catalog.SQL[name]})").fetchall()
    assert sorted(map(key, (tuple(r) for r in found.select(*columns).collect()))) == sorted(map(key, rows))


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(catalog.QUERIES) > 60
    if os.path.isdir(SF):
        assert e.entry(spark).count() > 0
