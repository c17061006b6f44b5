"""Every query with SQL gives the rows of that SQL on the smallest tables."""

from __future__ import annotations

import pytest

from graphloom.queries import registries
from tests.compare import compare

CASES = [(n, r.queries[n], s) for r in registries() for n, s in r.sql.items()]


@pytest.mark.parametrize("name,query,sql", CASES, ids=[c[0] for c in CASES])
def test_oracle(spark, con, data, name, query, sql):
    assert compare(spark, con, query, sql, data) == ""


@pytest.mark.parametrize("name", ["components_whole", "dfs_preorder", "betweenness_seeds", "modularity_communities", "resolve_entities", "chunk_sentences", "graphml_export", "method_catalog", "retrieve_hybrid_new"])
def test_rows_only(spark, data, name):
    query = next(r.queries[name] for r in registries() if name in r.queries)
    df = query(spark, data)
    assert df.columns and df.count() > 0
