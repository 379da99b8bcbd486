"""Every registered query of the engine gives the rows of its DuckDB oracle on the small tables."""

import math
import os
import pathlib

import duckdb
import pytest

import factlake.queries  # noqa: F401
from factlake.registry import ORACLES, QUERIES

#: Queries that SQL can't express, and the tests that compare their values with plain Python.
TESTED = {
    "a6_ingest_documents": "test_chunks_and_ingest", "a7_chunk_text": "test_chunks_and_ingest", "a24_hash_embed": "test_hash_embedding", "e2_segment_events": "test_event_segmentation",
    "g23_approx_total": "test_approximate_totals", "h4_claims": "test_claims_against_a_simulation", "h7_lease_spans": "test_leases", "h16_handoffs": "test_handoff_chains",
    "v2_vector_topk_cells": "test_recall_of_approximate_neighbours", "v2_vector_topk_codes": "test_codes_read_few_vectors", "v6_hybrid_search": "test_hybrid_search_is_both_arms_fused", "v18_render_context": "test_render_context",
}


def test_every_query_has_an_oracle_or_a_test():
    code = "".join(p.read_text() for p in pathlib.Path(__file__).parent.glob("*.py"))
    assert {*QUERIES} - {*ORACLES} == {*TESTED}
    assert all(f"def {name}(" in code for name in TESTED.values())


DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return str([plain(x) for x in v]) if isinstance(v, list) else v


@pytest.mark.skipif(not os.path.isdir(DIR), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(str(plain(v)) for v in r) for r in df.select(*columns).collect())
    if name in ORACLES:
        rel = duck.sql(ORACLES[name])
        assert sorted(rel.columns) == columns
        assert got == sorted(tuple(str(plain(v)) for v in r) for r in rel.select(*(f'"{c}"' for c in columns)).fetchall())
