"""Mixing: shares, caps, order, and windows already drawn."""

import math
import random

import numpy as np
import pytest

from kilnspan.llm import mixing
from tests.helpers import from_spark, from_sql

ROWS = "row_id bigint, dataset_id int, target_token_count bigint, __h string"
DEC = "run_id string, decision_id bigint, effective_training_iteration bigint, weights array<double>, produced_at_unix_ns bigint, positions int"
SRC = "dataset_id int, source string, record_count bigint, max_repeats int"
WIN = "run_id string, window_id bigint, decision_id bigint, weights array<double>, dataset_index array<int>, dataset_sample_index array<bigint>, target string"


def tables(spark, rows, decisions, sources):
    return spark.createDataFrame(rows, ROWS), spark.createDataFrame(decisions, DEC), spark.createDataFrame(sources, SRC)


SOURCES = [(0, "a", 10, 1), (1, "b", 10, 4), (2, "c", 10, 3)]


def many(n=3000, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice([0, 0, 0, 0, 1, 2, 9, None]), rng.choice([0, None, 5, 50, 400]), "h") for i in range(n)]
    return [r for r in rows if r[1] != 2 or r[0] % 3 == 0]


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 100)
    rows = many()
    decisions = [("r", 1, 1, [0.2, 0.2, 0.6], 1, 0), ("r", 2, 51, [1.0, 0.0, 0.0], 1, 0), ("r", 3, 101, [math.nan, 1.0, 1.0], 1, 0), ("r", 4, 101, [20.0, 60.0, 20.0], 1, 0)]
    schedule, report = mixing.mix(*tables(spark, rows, decisions, SOURCES))
    out, shares = schedule.collect(), {r.dataset_id: r for r in report.collect()}
    want = np.mean([[0.2, 0.2, 0.6], [1, 0, 0], [0.2, 0.6, 0.2]], axis=0)
    total = sum(r.tokens for r in out)
    for d in range(3):
        assert shares[d].target_share == pytest.approx(want[d], abs=2e-3) and shares[d].actual_share == pytest.approx(want[d], abs=0.01)
        assert shares[d].repeats <= SOURCES[d][3]
    assert max(shares[d].repeats / SOURCES[d][3] for d in range(3)) == 1  # as large as the caps allow
    assert [r.position for r in out] == sorted(r.position for r in out) and all(0 <= r.position <= 1 for r in out)
    size = {r[0]: r[2] for r in rows}
    assert all(r.tokens == size[r.row_id] > 0 for r in out) and len({(r.row_id, r.copy) for r in out}) == len(out)
    for a, b, w in ((0, 1 / 3, [0.2, 0.2, 0.6]), (1 / 3, 2 / 3, [1, 0, 0]), (2 / 3, 1.01, [0.2, 0.6, 0.2])):
        part = [r for r in out if a <= r.position < b]
        n = sum(r.tokens for r in part)
        assert n == pytest.approx(total / 3, rel=0.03)
        assert [sum(r.tokens for r in part if r.dataset_id == d) / n for d in range(3)] == pytest.approx(w, abs=0.03)


def test_more_than_the_caps_allow(spark):
    rows = many(600)
    _, report = mixing.mix(*tables(spark, rows, [("r", 1, 1, [1.0, 1.0, 1.0], 1, 0)], SOURCES), total_tokens=10**7)
    for r in report.collect():
        assert r.repeats == SOURCES[r.dataset_id][3] and r.tokens == r.pool_tokens * r.repeats
    order = [r.row_id for r in mixing.mix(*tables(spark, rows, [], SOURCES))[0].collect()]
    assert order == [r.row_id for r in mixing.mix(*tables(spark, rows[::-1], [], SOURCES))[0].collect()]  # no matter how rows lie


def test_empty(spark):
    schedule, report = mixing.mix(*tables(spark, [], [], SOURCES))
    assert schedule.count() == 0 and {r.actual_share for r in report.collect()} == {0.0}
    schedule, report = mixing.mix(*tables(spark, many(50), [], []))
    assert schedule.count() == 0 and report.count() == 0


def test_windows(spark, tmp_path):
    rng = random.Random(6)
    ok = [0.5, 0.3, 0.2]
    windows = [
        ("r", 1, 1, ok, [0, 0, 0, 0, 0, 1, 1, 1, 2, 2], [0, 1, 2, 3, 4, 0, 1, 2, 0, 1], "t"),  # in order
        ("r", 2, 1, ok, [0] * 10, list(range(10)), "t"),  # shares, never drawn
        ("r", 3, 7, None, [0, 1], [0, 0], "t"),  # no decision either
        ("r", 4, 1, [1.0, None, 1.0], [0, 1, 2, 2, 9, None], [3, 13, 1, 1, 0, 0], "t"),  # falls back to the decision
        ("r", 5, 1, [50.0, 30.0, 20.0], [0, 0, 0, 0, 0, 1, 1, 1, 2, 2], [0, 10, 2, 3, 4, 0, 1, 2, 0, 1], "t"),  # record 0 twice
        ("r", 6, 2, [math.inf, 1.0, 1.0], [2, 2, 2, 2], [1, 11, 21, 31], "t"),  # its decision is unusable; four repeats
        ("r", 7, 1, [0.0, 0.0, 0.0], [0], [0], "t"), ("r", 8, 1, ok, [], [], "t"), ("r", 9, 1, ok, None, None, "t"),
        (None, None, None, ok, [1], [1], "t"),
    ]
    windows += [windows[1]]
    for i in range(100, 160):
        d = [rng.randrange(4) for _ in range(30)]
        windows.append(("q", i, i, [rng.random() for _ in range(rng.choice([3, 3, 2]))], d, [rng.randrange(40) for _ in d], "t"))
    decisions = [("r", 1, 1, ok, 1, 0), ("r", 1, 1, ok, 1, 0), ("r", 2, 1, [-1.0, 1.0, 1.0], 1, 0)] + [("q", i, 1, [0.2, 0.2, 0.6], 5, 0) for i in range(100, 150)]
    tabs = {"selection_windows": spark.createDataFrame(windows, WIN), "loss_slope_mixture_decisions": spark.createDataFrame(decisions, DEC), "mixture_sources": spark.createDataFrame(SOURCES, SRC)}
    found = mixing.judge_windows(*tabs.values())
    got = {(r.run_id, r.window_id, r.dataset_id, r.fault) for r in found.collect()}
    assert {x for x in got if x[0] == "r"} == {
        ("r", 2, 0, "share"), ("r", 2, 1, "share"), ("r", 2, 2, "share"), ("r", 4, 0, "share"), ("r", 4, 2, "share"), ("r", 5, 0, "repeats"), ("r", 6, 2, "repeats"),
    } | ({("r", 4, 1, "share")} if abs(0.25 - 0.3) > 0.05 else set())
    for name, df in tabs.items():
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    from kilnspan.llm.sql import P1_FOUND

    assert from_spark(found) == from_sql(str(tmp_path), P1_FOUND)
    assert mixing.judge_windows(*[df.limit(0) for df in tabs.values()]).count() == 0


def test_every_decision_counts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 700)
    sources = [(0, "a", 10, 1), (1, "b", 10, 1)]
    n = 5000  # far more changes than a grid of 1,024 steps would show
    decisions = [("r", i, 1 + 50 * i, [1.0 - i % 2, 1.0 * (i % 2)], 1, 0) for i in range(n)]
    rows = [(i, i % 2, 7, "h") for i in range(6000)]
    schedule, report = mixing.mix(*tables(spark, rows, decisions, sources))
    out = schedule.collect()
    assert len(out) == 6000 and {(r.dataset_id, r.target_share, r.tokens) for r in report.collect()} == {(0, 0.5, 21000), (1, 0.5, 21000)}
    off = [r for r in out if int(r.position * n + 1e-6) % 2 != r.dataset_id]
    assert not off, f"{len(off)} of {len(out)} rows train under a decision that gives their source nothing"


def test_schedule_against_plain_integration(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 60)
    rng, n = random.Random(3), 3
    runs = {"p": [1, 8, 20, 21, 90], "q": [15, 16, 40], "s": [300, 310, 333], "one": [50]}  # nothing holds from 160 to 299
    runs["p"] += list(range(91, 160))
    decisions = [(run, i, a, [rng.choice([0.0, 1.0, rng.random()]) for _ in range(n - 1)] + [0.5], 1, 0) for run, at in runs.items() for i, a in enumerate(at)]
    spans = []
    for run in runs:
        mine = [(d[2], np.array(d[3]) / sum(d[3])) for d in decisions if d[0] == run]
        ends = [a for a, _ in mine[1:]] + [mine[-1][0] + (mine[-1][0] - mine[-2][0] if len(mine) > 1 else 1)]
        spans += [(a, b, w) for (a, w), b in zip(mine, ends, strict=True)]
    mean = sum((b - a) * w for a, b, w in spans) / sum(b - a for a, b, _ in spans)
    low, high = min(a for a, _, _ in spans), max(b for _, b, _ in spans)
    curve = np.zeros((high - low + 1, n))
    for t in range(low, high):
        now = [w for a, b, w in spans if a <= t < b]
        curve[t - low + 1] = curve[t - low] + (np.mean(now, axis=0) if now else mean) / (high - low)
    segments = mixing.demand_segments(spark.createDataFrame(decisions, DEC), n).collect()
    grid = np.linspace(0, 1, high - low + 1)
    for s in segments:
        assert [s.c0, s.c1] == pytest.approx([np.interp(t, grid, curve[:, s.i]) for t in (s.t0, s.t1)], abs=1e-12)
    for i in range(n):
        assert max(s.c1 for s in segments if s.i == i) == pytest.approx(curve[-1, i], abs=1e-12)
    rows = [(k, k % 3, 1 + k % 5, "h") for k in range(900)]
    schedule, _ = mixing.mix(*tables(spark, rows, decisions, [(d, "x", 1, 9) for d in range(n)]), total_tokens=5000)
    for d in range(n):
        mine = [r for r in schedule.collect() if r.dataset_id == d]
        offsets = np.cumsum([0] + [r.tokens for r in mine])[:-1] / 5000
        assert np.interp([r.position for r in mine], grid, curve[:, d]) == pytest.approx(offsets, abs=1e-9)
