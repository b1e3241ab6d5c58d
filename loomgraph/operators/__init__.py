"""DataFrame operators: graph construction, retrieval, condensation, aggregation."""
