"""Every query that has SQL gives the SQL's rows; every other one gives rows."""

import pytest

from kindred.plans import channels, decisions, features, flagship, relations, texts

ALL = {n: (f, c.oracles.get(n)) for c in (decisions.C, texts.C, features.C, relations.C, channels.C) for n, f in c.queries.items()} | {"resolve_entities": (flagship.resolve, flagship.ORACLE)}


def key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(name, spark, data, duck):
    f, sql = ALL[name]
    df = f(spark, data)
    got = sorted((tuple(r) for r in df.collect()), key=key)
    if sql is None:
        assert got
        return
    cur = duck.execute(sql)
    assert df.columns == [x[0] for x in cur.description]
    want = sorted(cur.fetchall(), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6)
