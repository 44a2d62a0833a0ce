"""Every query against its DuckDB twin, over the whole smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="the driver's tables are not here")
_SQL = entry.oracle_sql()
_GROUPS = sorted({n.split("_")[0].rstrip("0123456789") for n in _SQL})


@pytest.mark.parametrize("group", _GROUPS)
def test_twins(spark, group):
    con, queries, bad = duck(SF), entry.queries(), {}
    for n, sql in _SQL.items():
        if n.split("_")[0].rstrip("0123456789") == group:
            _, a, b = compare(queries[n](spark, SF), con, sql)
            if a or b:
                bad[n] = (a[:2], b[:2])
            spark.catalog.clearCache()
    assert not bad
