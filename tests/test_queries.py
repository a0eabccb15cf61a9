"""Every registered query against its check SQL on the smallest tables.

The queries are many and small, so they run a few at a time.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import oracle
import pytest

import __spark_entry__ as entry
from galley.plans import assets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outcomes(spark):
    duck = oracle.connect(SF)
    fns, sqls = entry.queries(), entry.oracle_sql()
    assets.chunks(spark, SF)

    def one(name: str) -> dict:
        try:
            if name in sqls:
                return oracle.compare(spark, duck.cursor(), name, fns[name], sqls[name], SF)
            return {"ok": fns[name](spark, SF).count() > 0}
        except Exception as e:  # reported by the test of this query
            return {"ok": False, "why": repr(e)[:2000]}

    with ThreadPoolExecutor(6) as pool:
        return dict(zip(fns, pool.map(one, fns)))


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(outcomes, name):
    assert outcomes[name]["ok"], outcomes[name]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.agg({"score": "max"}).first()[0] == 1.0
