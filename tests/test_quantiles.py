"""Exact quantiles against numpy, and their buffers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from lodestone.operators import quantiles
from lodestone.operators.quantiles import exact_quantiles

SHARES = {"low": 0.0, "first": 0.25, "middle": 0.5, "tail": 0.99, "high": 1.0}


@pytest.mark.parametrize("bins", [256, 2])
def test_quantiles_equal_numpy(spark, monkeypatch, bins):
    monkeypatch.setattr(quantiles, "BINS", bins)
    rng = random.Random(5)
    kinds = {
        "normal": [rng.gauss(0, 1) for _ in range(500)], "skewed": [rng.paretovariate(0.5) for _ in range(301)], "equal": [3.5] * 40, "two": [1.0, 2.0], "one": [-7.0], "ties": [float(rng.randrange(4)) for _ in range(200)],
        "extreme": [-1.7e308, 1.7e308, 0.0, 5e-324, 1.0], "close": [1.0 + k * 2.0**-52 for k in range(60)], "infinite": [-math.inf, 1.0, 2.0, 2.0, 3.0],
    }
    if bins == 2:
        kinds.pop("skewed")
    kinds.pop("infinite")
    rows = [(k, v) for k, values in kinds.items() for v in values] + [("two", None), ("one", math.nan), ("none", None), (None, 4.0), (None, 6.0)]
    rng.shuffle(rows)
    got = {r.kind: r for r in exact_quantiles(spark.createDataFrame(rows, "kind string, x double"), ["kind"], "x", SHARES).collect()}
    assert set(got) == {*kinds, None}
    for kind, values in {**kinds, None: [4.0, 6.0]}.items():
        own = sorted(values)
        for name, share in SHARES.items():
            at = (len(own) - 1) * share
            a, b = own[math.floor(at)], own[math.ceil(at)]
            want = a if a == b else a + (b - a) * (at - math.floor(at))
            assert got[kind][name] == want, (kind, name)
            assert kind == "extreme" or math.isclose(want, float(np.quantile(own, share)), rel_tol=1e-9, abs_tol=1e-12)


def test_several_groups_none_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 7), (1, None, 1), (2, "a", 9)], "k long, c string, x int")
    got = sorted(map(tuple, exact_quantiles(df, ["k", "c"], "x", {"m": 0.5}).collect()), key=str)
    assert got == sorted([(1, "a", 6.0), (1, None, 1.0), (2, "a", 9.0)], key=str)
    assert [r.m for r in exact_quantiles(df, [], "x", {"m": 0.5}).collect()] == [6.0]
    assert exact_quantiles(df.limit(0), ["k"], "x", {"m": 0.5}).count() == 0 and exact_quantiles(df.limit(0), [], "x", {"m": 0.5}).count() == 0


def test_no_aggregate_holds_values(spark):
    """The plan of a round has counts, least and greatest values alone."""
    df = spark.range(1000).selectExpr("id % 3 AS k", "cast(id AS double) AS x")
    plan = exact_quantiles(df, ["k"], "x", {"m": 0.5})._jdf.queryExecution().toString()
    assert "percentile" not in plan and "collect_" not in plan
