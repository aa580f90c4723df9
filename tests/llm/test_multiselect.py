"""Percentiles against plain sorting, and day results combined."""

import bisect
import datetime
import math
import random

import pytest

from kilnspan.llm import multiselect

DDL = "layer int, day date, q1 double, q3 double, metric string, v int"
DAYS = [datetime.date(2025, 3, d) for d in (1, 2, 3)] + [None]


def table(n, seed):
    rng = random.Random(seed)
    draw = lambda: rng.choice([rng.uniform(-1, 1), rng.gauss(0.3, 0.1), 0.25, 0.25, 1.0, -1.0, None, math.nan, math.inf, -9.0, 40.0, -0.0])
    return [(rng.choice([0, 0, 0, 1, 2, None]), rng.choice(DAYS), draw(), 0.5 if rng.random() < 0.9 else draw(), "m", 1) for _ in range(n)]


def good(v):
    return v is not None and -1 <= v <= 1


def rank(vs, p):
    return sorted(vs)[max(1, -(-p * len(vs) // 100)) - 1]


@pytest.mark.parametrize("finish", [4096, 20])
def test_percentiles(spark, finish):
    rows = table(1500, 3)
    df = spark.createDataFrame(rows, DDL).repartition(5)
    got = {(r.layer, r.day, r.all_parts, r.metric): (r.n, r.p25, r.p50, r.p75, r.p99) for r in multiselect.percentiles(df, ["q1", "q3"], "layer", "day", finish=finish).collect()}
    want = {}
    for i, m in ((2, "q1"), (3, "q3")):
        for layer in {r[0] for r in rows}:
            for day in (*DAYS, "all"):
                vs = [r[i] for r in rows if r[0] == layer and (day == "all" or r[1] == day) and good(r[i])]
                if vs:
                    want[layer, None if day == "all" else day, day == "all", m] = (len(vs), *[rank(vs, p) for p in (25, 50, 75, 99)])
    assert got == want


@pytest.mark.parametrize("m", [8, 50])
def test_days_combine(spark, m):
    rows = table(2500, 4)
    df = spark.createDataFrame(rows, DDL)
    days = multiselect.summarise(df, ["q1", "q3"], ["layer", "day"], m=m, finish=64)
    for r in multiselect.combine(days, ["layer"]).collect():
        vs = sorted(x[2 if r.metric == "q1" else 3] for x in rows if x[0] == r.layer and good(x[2 if r.metric == "q1" else 3]))
        assert r.n == len(vs) and r.rank_error <= len(vs) / m + 2 * len(DAYS) + 4
        for p in (25, 50, 75, 99):
            k = -(-p * len(vs) // 100)
            low, high = bisect.bisect_left(vs, r[f"p{p}"]) + 1, bisect.bisect_right(vs, r[f"p{p}"])
            assert low <= high and max(low - k, k - high, 0) <= r.rank_error
    # parts of parts: summaries of two days and of the others combine as well as all four at once
    assert {tuple(r) for r in multiselect.combine(days, ["layer"]).collect()} == {tuple(r) for r in multiselect.combine(days.where("day is null").unionByName(days.where("day is not null")), ["layer"]).collect()}


def test_edges(spark):
    empty = spark.createDataFrame([], DDL)
    assert multiselect.percentiles(empty, ["q1"], "layer", "day").count() == 0
    one = spark.createDataFrame([(1, None, 0.5, None, "m", 1)], DDL)
    r = multiselect.percentiles(one, ["q1", "q3"], "layer", "day").where("all_parts").first()
    assert (r.n, r.p25, r.p50, r.p75, r.p99) == (1, 0.5, 0.5, 0.5, 0.5)
    constant = spark.createDataFrame([(1, None, 0.25, None, "m", 1)] * 300, DDL)
    assert multiselect.percentiles(constant, ["q1"], "layer", "day", finish=10).where("all_parts").first().p99 == 0.25
