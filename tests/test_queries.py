"""Registered queries next to their SQL on the smallest data set."""

from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not mounted")

# the remaining queries are checked on sf0.01 by tests/compare.py
QUICK = (
    "hash_ids", "title_partition", "chunk_parse", "chunk_partition_stats", "title_first_wins", "text_windows", "titled_passages", "incremental_upsert",
    "split_by_position", "encode_md5", "answer_scores", "list_answer_metrics", "passage_entity_weights", "graph_edges", "entity_degree_idf_score",
    "dense_passages", "spread_weights", "ranked_passages", "global_subgraph_capped", "fused_vectors", "diverse_picks", "knn_rows_with_prior",
    "federated_average", "graph_convolution", "alignment_loss",
)


@pytest.fixture(scope="module")
def con():
    connection = connect(SF)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, con, name):
    rows, _, _, problem = compare(spark, con, SF, queries()[name], oracle_sql()[name])
    assert problem is None and rows > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["client_id", "node_id", "deg_s", "deg_p", "score"] and df.count() > 0
