"""Every registered query of the library against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from tallyweave.plans import registry
from tallyweave.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if hasattr(v, "asDict"):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(rows) > 0
        return
    cursor = duck.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in cursor.fetchall())
    assert sorted(repr([plain(r[c]) for c in sorted(names)]) for r in rows) == expected


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 11
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_what_patterns_need_stands_in_every_match():
    import random
    import re

    from tallyweave.operators import textscan as X

    rng = random.Random(6)
    bits = ["MD5", "SHA1", "DES", "3DES", "RC2", "RC4", "ARC4", "RSA", "ECDsa", "ECDH", "DSA", "MD4", ".Create", "Managed", "CryptoServiceProvider", "Triple", "Server", "Data Source", "Password", "pwd", "=", ":", " ", '"', "'", "abc", "api_key", "SECRET-KEY", "token", "Integrated Security", "\n", ".", "md5", "server"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 9)))
        for p in (*X.ALGORITHMS, *X.SECRETS, X.ASSIGNED_SECRET):
            if re.search(p.regex, text):
                assert any(n in text for n in p.needs), (p.name, text)
