"""Registered queries against their SQL on an independent engine."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = ["token_quality_labels", "row_filter", "text_sources", "token_sources", "sparsify_topk", "semi_and_missing", "coactivation_basket", "decoder_neighbors", "feature_inspection", "histogram", "clean_texts", "mixed_corpus", "row_filter_options", "axis_profiles", "single_component", "preset_mix", "jsonl_round_trip", "profile", "preview", "text_dataset", "position_context"]


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return f"{x:.6f}" if isinstance(x, float) else str(x)


def compare(spark, data, name):
    got = entry.queries()[name](spark, data)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    order = sorted(names)
    assert order == sorted(got.columns)
    want = sorted([cell(dict(zip(names, r))[c]) for c in order] for r in cur.fetchall())
    assert sorted([cell(r[c]) for c in order] for r in got.collect()) == want


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, data, name):
    compare(spark, data, name)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
