"""Every registered query against its DuckDB oracle on the smallest tables."""
import math

import pytest

import __spark_entry__ as E

from conftest import SF_SMALL

ORACLES = E.oracle_sql()
NAMES = [n for n in E.queries() if n in ORACLES]


def _norm(v):
    import pandas as pd
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return 0.0 if v == 0 else round(v, 9)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(df, cols):
    out = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False)]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def test_every_query_registered_has_a_callable():
    qs = E.queries()
    assert len(qs) >= 50
    assert set(ORACLES) <= set(qs)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["rx_type", "link_state", "n_obs", "mean_d3d", "mean_los_theta",
                          "mean_excess_delay_ns", "mean_path_loss"]


TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "float": "FLOAT"}
FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin",
             "FlatMapGroupsInPandas", "MapInPandas")


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [op for op in FORBIDDEN if op in plan], f"{name}: Python/cross-product node in plan"
    rel = duck.sql(ORACLES[name])
    otypes = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    stypes = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    assert stypes == otypes
    sdf = df.toPandas()
    odf = duck.execute(ORACLES[name]).df()
    assert sorted(sdf.columns) == sorted(odf.columns)
    cols = sorted(sdf.columns)
    a, b = _rows(sdf, cols), _rows(odf, cols)
    assert len(a) == len(b)
    assert a == b
