"""Every query of the catalog against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from evenkeel.plans import assess, catalog, chains, collector, control, decisions, logs, manifests, nomination, records, shadow, streams

SF = "/root/testdata/sf0.001"
QUERIES = {**catalog.queries(), **control.queries(), **assess.queries(), **nomination.queries(), **records.queries(), **chains.queries(), **decisions.queries(), **streams.queries(), **collector.queries(), **manifests.queries(), **shadow.queries(), **logs.queries()}
ORACLES = {**catalog.oracle_sql(), **control.oracle_sql(), **assess.oracle_sql(), **nomination.oracle_sql(), **records.oracle_sql(), **chains.oracle_sql(), **decisions.oracle_sql(), **streams.oracle_sql(), **collector.oracle_sql(), **manifests.oracle_sql(), **shadow.oracle_sql(), **logs.oracle_sql()}
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rel = duck.execute(ORACLES[name])
    names = [c[0] for c in rel.description]
    want = rel.fetchall()
    order = sorted(names)
    assert sorted(got.columns) == order
    a = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in want), key=repr)
    assert a == b
