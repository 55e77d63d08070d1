"""The fact join runs once a query and carries only what is used."""

import datetime

import numpy as np
import pytest
from pyspark.sql import DataFrame

from factorlab.operators import library_als as LA
from factorlab.plans import models as M
from factorlab.plans import parsing as P
from factorlab.sources import text as X


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """lineitem, orders, customer and part of 12 users and 15 items, every third row there twice."""
    out, rng = str(tmp_path_factory.mktemp("tables")), np.random.default_rng(3)
    orders = [(o, int(rng.integers(1, 13))) for o in range(60)]
    start = datetime.datetime(1995, 1, 1)
    lines = [(o, int(rng.integers(1, 16)), 1, n, float(rng.integers(1, 51)), float(n + 10 * o),
              start + datetime.timedelta(days=int(rng.integers(0, 50)))) for o, _ in orders for n in range(4)]
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{out}/{name}.parquet")
    save(lines + lines[::3], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
         "l_extendedprice double, l_shipdate timestamp_ntz", "lineitem")
    save(orders, "o_orderkey bigint, o_custkey bigint", "orders")
    save([(c,) for c in range(1, 13)], "c_custkey bigint", "customer")
    save([(p, f"part {p}") for p in range(1, 16)], "p_partkey bigint, p_name string", "part")
    return out


def _plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_write_readback_joins_once(spark, small, monkeypatch):
    plans, write = [], X.write_table

    def seen(df, *a, **kw):
        plans.append(_plan(df))
        return write(df, *a, **kw)

    monkeypatch.setattr(X, "write_table", seen)
    got = {r["bucket"]: (r["n"], r["rating"], r["first_key"]) for r in P.q_write_readback(spark, small).collect()}
    assert len(plans) == 3 and not any("Join" in p for p in plans)
    want: dict = {}
    for r in M.T.inter(spark, small).collect():
        n, s, k = want.get(r["bucket"], (0, 0.0, r["row_key"]))
        want[r["bucket"]] = (n + 1, s + r["rating"], min(k, r["row_key"]))
    assert got == want


@pytest.mark.parametrize("query, step", [("q_implicit_als", "train_implicit"), ("q_implicit_als", "predict_pairs"),
                                         ("q_recommend_als", "train_explicit"), ("q_predict_pairs", "predict_pairs")])
def test_library_models_read_written_rows(spark, small, monkeypatch, query, step):
    """Every use of the play counts and the personal ratings would otherwise run the fact join again."""
    plans, real = [], getattr(LA, step)

    def seen(*a, **kw):
        plans.extend(_plan(x) for x in a if isinstance(x, DataFrame))
        return real(*a, **kw)

    monkeypatch.setattr(LA, step, seen)
    assert M.QUERIES[query](spark, small).count() > 0
    assert plans and not any("l_orderkey" in p for p in plans)


def test_personal_of_written_rows(spark, small):
    rows = M._rated(spark, small)
    assert sorted(M.T.personal(spark, small, rows).collect()) == sorted(M.T.personal(spark, small).collect())


def test_splits_carry_only_what_is_asked(spark, small):
    train, val, test = M._splits(spark, small)
    assert train.columns == ["user_id", "item_id", "rating", "bucket"]
    assert train.count() + val.count() + test.count() == 320
    assert "row_key" in M._splits(spark, small, "row_key")[2].columns
