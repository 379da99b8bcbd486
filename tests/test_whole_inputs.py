"""Registered queries take all rows and whole texts of their tables."""

import pyarrow as pa
import pyarrow.parquet as pq

from factlake.queries import episodes, joins
from factlake.queries import text as text_queries


def test_long_documents_give_constraints(spark, tmp_path):
    text = "plain words go on. " * 300 + "The last one SHALL count."
    pq.write_table(pa.table({"doc_id": [1], "text": [text], "lang": ["en"], "source": ["a"], "n_chars": [len(text)]}), tmp_path / "documents.parquet")
    found = {r["statement"] for r in episodes.a11_ingest_constraints(spark, str(tmp_path)).collect()}
    assert found == {"The last one SHALL count.", "It MUST hold.", "You may not know.", "Code SHALL NOT fail!"}


def test_whole_pages_are_wrapped(spark, tmp_path):
    pq.write_table(pa.table({"page_id": [1], "url": ["http://a/"], "html": ["<p>" + "x" * 500 + "</p>"]}), tmp_path / "pages.parquet")
    found = text_queries.f21_peer_envelope(spark, str(tmp_path)).first()["envelope"]
    assert found == '<peer_memory author="http://a/" trust="untrusted">&lt;p&gt;' + "x" * 500 + "&lt;/p&gt;</peer_memory>"


def test_all_orders_count_for_entity_clusters(spark, tmp_path):
    pq.write_table(pa.table({"l_suppkey": [7] * 12 + [8] * 11, "l_orderkey": [*range(1, 13), *range(1, 12)]}), tmp_path / "lineitem.parquet")
    found = [(r["entity"], list(r["memories"])) for r in joins.j17_entity_clusters(spark, str(tmp_path)).collect()]
    assert found == [(7, list(range(1, 13)))]
