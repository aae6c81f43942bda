"""Every registered query of the core library against its SQL on DuckDB, at the smallest scale."""

import hashlib
import os

import duckdb
import pytest

from weftgraph.plans import catalogue, formats, inventory  # noqa: F401

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test data")


def normal(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str([normal(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = sorted(tuple(map(normal, r)) for r in df.select(*cols).collect())
    rel = duck.sql(catalogue.ORACLES[name])
    assert sorted(rel.columns) == cols
    want = sorted(tuple(map(normal, r)) for r in duck.sql(f"SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({catalogue.ORACLES[name]})").fetchall())
    assert got == want


def shares(df, *keys):
    """Rows, and that no two agree in all keys and no key is null."""
    rows = df.select(*keys).collect()
    assert rows and len(set(rows)) == len(rows) and all(v is not None for r in rows for v in r)
    return rows


def seed_of(cluster):
    return int.from_bytes(hashlib.blake2b(f"42:{cluster}".encode(), digest_size=4).digest(), "little") % (2**31 - 1)


CHECKS = {
    "alg1_diagonals_whole": lambda df: shares(df, "query", "target"),
    "alg4_top_targets": lambda df: shares(df, "query", "target") and df.filter("similarity < 27 OR similarity > 100 OR rank > 5").isEmpty() or pytest.fail("ranks or similarities"),
    "fn12_cluster_seeds": lambda df: all(r["seed"] == seed_of(r["cluster"]) for r in df.collect()) or pytest.fail("a seed"),
    "graph5_shortest_link": lambda df: [r["step"] for r in df.orderBy("step").collect()] == list(range(df.count())) or pytest.fail("steps"),
    "graph11_communities": lambda df: shares(df, "node"),
    "graph12_refined_communities": lambda df: shares(df, "node"),
    "son13_signal_calls": lambda df: shares(df, "query_id", "hit_id"),
}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_other_queries_hold_their_invariants(spark, name):
    df = catalogue.QUERIES[name](spark, D)
    if name in CHECKS:
        CHECKS[name](df)
    else:
        assert df.count() > 0
