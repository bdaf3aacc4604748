"""Every registered query of the engine against its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from evalquarry.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    rel = duck.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()]
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_flagship_has_a_curve_per_source(spark):
    import __spark_entry__

    got = {(r.source, r.k) for r in __spark_entry__.entry(spark).collect()}
    most = max(k for _, k in got)
    assert {k for s, k in got if s == "overall"} == set(range(1, most + 1)) and {s for s, _ in got} >= {"F", "O", "overall"}
