import sys
from pathlib import Path

import pytest

for folder in (Path(__file__).resolve().parents[1], Path(__file__).resolve().parent):
    sys.path.insert(0, str(folder))


@pytest.fixture(scope="session")
def spark():
    from loomgraph.session import build_session

    session = build_session("loomgraph-tests", "local[8]", spark__sql__shuffle__partitions=4, spark__driver__memory="6g", spark__ui__enabled="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def toy(spark):
    """Three entities, two sentences, two passages (ids 0-6) with seven undirected links."""
    types = [0, 0, 0, 1, 1, 2, 2]
    nodes = spark.createDataFrame([(0, i, t, f"n{i}") for i, t in enumerate(types)], "client_id int, node_id bigint, node_type int, text string")
    half = [(3, 0), (3, 1), (4, 1), (4, 2), (5, 0), (5, 1), (6, 2)]
    edges = spark.createDataFrame([(0, a, b, 0 if types[a] == 1 else 1) for a, b in half] + [(0, b, a, 0 if types[a] == 1 else 1) for a, b in half],
                                  "client_id int, src bigint, dst bigint, edge_type int")
    return nodes, edges
