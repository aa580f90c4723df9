"""Orphan references, lambda views and seen-bitmaps: edge cases and batch by batch."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilnspan.operators import lambda_views, orphans, seen

H = lambda_views.HOUR_NS
RAW = "row_id bigint, model_id string, act_name string, direction string, phase string, global_batch_id bigint, dp_rank int, microbatch_id int, sample_index int, layer_no int, shard_rank int, token_start bigint, token_end bigint, attempt_id int, invocation_id int, dataset_id int, value bigint, received_unix_ns bigint, deleted_unix_ns bigint, valid_until string"
CATALOG = "act_name string, added_unix_ns bigint, removed_unix_ns bigint, keys string"


def raw(row_id, model="m", act="loss", direction="fwd", phase="train", gid=1, attempt=0, invocation=0, dataset=0, value=1, at=100, deleted=None, microbatch=0):
    return (row_id, model, act, direction, phase, gid, 0, microbatch, 0, -1, 0, 0, 1, attempt, invocation, dataset, value, at, deleted, "x")


def status(row_id, **k):
    return raw(row_id, act=k.pop("act", "iteration_attempt_status"), direction="iter", dataset=-1, **k)


def found(spark, floats, ints, catalog):
    f, i, c = spark.createDataFrame(floats, RAW), spark.createDataFrame(ints, RAW), spark.createDataFrame(catalog, CATALOG)
    return {(r.src_table[11:], r.row_id, r.ref, r.reason) for r in orphans.telemetry_orphans(f, i, c).collect()}


def test_orphans(spark):
    catalog = [("loss", 5, None, "k"), ("gone", 5, 90, "k"), ("iteration_attempt_status", 500, None, "k"), ("back", 1, 10, ""), ("back", 20, None, "")]
    ints = [status(1), status(2, gid=2, deleted=7), status(3, gid=3, act="\tITERATION_attempt_status "), raw(4, act="gone", at=89), status(9, gid=9, invocation=1)]
    floats = [
        raw(1, model=" M ", act="LOSS "), raw(2, gid=2), raw(3, gid=3), raw(4, gid=4), raw(5, gid=0), raw(6, gid=4, phase="valid"), raw(7, gid=4, attempt=None),
        raw(8, act="gone", at=89), raw(9, act="gone", at=90), raw(10, act=None), raw(11, act="back", at=15), raw(12, model=None), raw(13, gid=9), raw(14, act="gone", at=None),
    ]
    want = {("float", 2, "attempt", "deleted"), ("float", 4, "attempt", "missing"), ("float", 9, "act_name", "deleted"), ("float", 10, "act_name", "missing"), ("float", 12, "attempt", "missing"), ("float", 13, "attempt", "missing")}
    assert found(spark, floats, ints, catalog) == want
    assert found(spark, [], [], []) == set()
    assert len(found(spark, [raw(1)], [], [])) == 2  # without parents every reference is one
    assert found(spark, [raw(1), raw(1)], [status(1), status(1)], catalog) == set()


def test_orphans_beyond_the_broadcast_bound(spark, monkeypatch):
    floats = [raw(i, gid=i % 7) for i in range(200)]
    ints = [status(1000 + i, gid=i) for i in range(1, 4)]
    catalog = [("loss", 1, None, "k"), ("iteration_attempt_status", 1, None, "k")]
    small = found(spark, floats, ints, catalog)
    monkeypatch.setattr(orphans, "small_side", lambda df: df)
    assert found(spark, floats, ints, catalog) == small and len(small) == sum(i % 7 in (4, 5, 6) for i in range(200))


DAY = 86_400_000_000_000


def states_of(spark, floats, ints, catalog):
    got = orphans.reference_states(spark.createDataFrame(floats, RAW), spark.createDataFrame(ints, RAW), spark.createDataFrame(catalog, CATALOG)).collect()
    assert len({(r.src_table, r.ref, r.state, r.day) for r in got}) == len(got)
    return {(r.src_table[11:], r.ref, r.state, r.day and (r.day - datetime.date(1970, 1, 1)).days): (r["keys"], r.references) for r in got}


def test_states_at_each_reference_s_own_time(spark):
    catalog = [("loss", 1, None, "k"), ("gone", 5, 90, "k"), ("iteration_attempt_status", 1, None, "k")]
    ints = [status(1, gid=1, at=50)]
    floats = [raw(1, at=10), raw(2, at=20), raw(3, at=60), raw(4, at=DAY), raw(5, at=None), raw(6, gid=0, act="gone", at=4), raw(7, gid=0, act="gone", at=89), raw(8, gid=0, act="gone", at=90)]
    assert states_of(spark, floats, ints, catalog) == {
        ("float", "attempt", "late", 0): (1, 2), ("float", "attempt", "met", 0): (1, 1), ("float", "attempt", "met", 1): (1, 1), ("float", "attempt", "met", None): (1, 1),
        ("float", "act_name", "met", 0): (2, 4), ("float", "act_name", "met", 1): (1, 1), ("float", "act_name", "met", None): (1, 1),
        ("float", "act_name", "late", 0): (1, 1), ("float", "act_name", "deleted", 0): (1, 1), ("int", "act_name", "met", 0): (1, 1),
    }


def test_states_between_two_spells(spark):
    """A name that was removed and added again: in the gap it is late, and never counts as dangling."""
    catalog = [("back", 1, 10, ""), ("back", 20, None, ""), ("back", 22, 30, ""), ("gone", 1, 10, ""), ("gone", 5, 12, ""), ("gone", 12, 14, ""), ("never", 9, 3, "")]
    floats = [raw(i, gid=0, act=a, at=t) for i, (a, t) in enumerate([("back", 0), ("back", 5), ("back", 15), ("back", 25), ("back", None), ("gone", 13), ("gone", 14), ("gone", 11), ("never", 2), ("never", 5)])]
    got = {}
    for (_, _, state, _), (_, n) in states_of(spark, floats, [], catalog).items():
        got[state] = got.get(state, 0) + n
    assert got == {"late": 3, "met": 5, "deleted": 2}
    assert found(spark, floats, [], catalog) == {("float", 6, "act_name", "deleted"), ("float", 9, "act_name", "deleted")}


@pytest.mark.parametrize("broadcast", [True, False])
def test_states_by_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(orphans, "small_side", lambda df: df)
    rng = random.Random(8)
    at = lambda: rng.choice([None, *[rng.randrange(3 * DAY) for _ in range(9)]])
    catalog = [("loss", DAY, None, ""), ("gone", DAY // 2, 2 * DAY + 7, ""), ("never", 2 * DAY, DAY, "")]
    acts = ["loss", "gone", "never", " GONE", "other", None]
    floats = [raw(i, act=rng.choice(acts), gid=rng.choice([0, 1, 1, 1, 1, 2, 3, 4]), at=at()) for i in range(400)]
    ints = [raw(i, act=rng.choice(acts), gid=rng.choice([1, 2, 4]), at=at()) for i in range(200)]
    ints += [status(900, gid=1, at=DAY + 5), status(901, gid=2, at=9, deleted=9), status(902, gid=3, at=2 * DAY), status(903, gid=3, at=DAY * 3 // 2)]
    # key -> (valid from, valid until)
    attempts, names = {1: (DAY + 5, None), 3: (DAY * 3 // 2, None), 2: (None, -1)}, {a: (f, u) for a, f, u, _ in catalog}

    def judge(parent, t):
        if parent is None:
            return "missing"
        if parent[1] is not None and (parent[1] == -1 or t is not None and t >= parent[1]):
            return "deleted"
        return "late" if t is not None and parent[0] > t else "met"

    want = {}
    for table, rows in (("float", floats), ("int", ints)):
        for r in rows:
            name, gid, t = r[2] and r[2].strip().lower(), r[5], r[17]
            links = [("act_name", name, names.get(name))]
            if gid != 0 and name != "iteration_attempt_status":
                links.append(("attempt", gid, attempts.get(gid)))
            for ref, key, parent in links:
                want.setdefault((table, ref, judge(parent, t), None if t is None else t // DAY), []).append(key)
    assert states_of(spark, floats, ints, catalog) == {k: (len(set(v)), len(v)) for k, v in want.items()}


def test_admit(spark):
    t = 1_741_042_559_965_815_126
    hour_end = t - t % H + H
    rows = [
        (1, t, t + 1), (2, t, hour_end - 1), (3, t, hour_end), (4, t, t + lambda_views.CUTOFF_NS), (5, t, t + lambda_views.CUTOFF_NS + 1), (6, None, t), (7, 0, t), (8, -5, t),
        (9, t // 10**9, hour_end), (10, t // 10**6, t), (11, t // 10**3, hour_end), (12, t + 10**15, t), (13, t, None), (14, 2**62, t),
    ]
    df = spark.createDataFrame(rows, "row_id bigint, processed_at_unix_ns bigint, received_at_unix_ns bigint")
    got = {r.row_id: r.verdict for r in lambda_views.admit(df).collect()}
    assert got == {1: "on_time", 2: "on_time", 3: "correcting", 4: "correcting", 5: "dropped", 6: None, 7: None, 8: None, 9: "correcting", 10: "on_time", 11: "correcting", 12: "on_time", 13: "on_time", 14: "on_time"}


LOG = "row_id bigint, run_id string, dataset_id int, training_iteration_id bigint, status string, processed_at_unix_ns bigint, received_at_unix_ns bigint, verdict_note string"


def events(n, seed):
    rng = random.Random(seed)
    base = 1_741_042_800_000_000_000
    out = []
    for i in range(n):
        at = base + rng.randrange(40) * H // 4
        late = rng.choice([1, H // 2, 2 * H, 5 * H, 7 * H, 30 * H])
        out.append((i, rng.choice(["a", "b", None]), rng.choice([0, 1, None]), rng.randrange(12), rng.choice(["COMPLETE", " incomplete", "Complete", "other", None]), rng.choice([at, at // 10**6, at // 10**9, None, 0]), at + late, "n"))
    return out


def brute(rows):
    last = {}
    for r in rows:
        p = r[5]
        if p is None or p <= 0:
            continue
        ev = p * (10**9 if p < 10**11 else 10**6 if p < 10**14 else 1)
        if r[6] - ev > lambda_views.CUTOFF_NS:
            continue
        k = r[1:4]
        if k not in last or (r[6], r[0]) > last[k][0]:
            last[k] = ((r[6], r[0]), r[1], ev - ev % H, (r[4] or "").strip().lower())
    out = {}
    for _, run, hour, status_ in last.values():
        if status_ in lambda_views.STATUSES:
            c = out.setdefault((run, hour), [0, 0])
            c[lambda_views.STATUSES.index(status_)] += 1
    return {k: tuple(v) for k, v in out.items()}


def counts(df):
    return {(r.run_id, r.period_start_ns): (r.complete, r.incomplete) for r in df.collect()}


def test_views_batch_by_batch(spark, tmp_path):
    rows = sorted(events(300, 4), key=lambda r: r[6])
    view = lambda_views.LambdaView(spark, str(tmp_path / "v"))
    assert view.serve().count() == 0
    seen_rows = []
    for number, at in enumerate(range(0, 300, 60)):
        batch = rows[at : at + 60]
        seen_rows += batch
        view.take(spark.createDataFrame(batch, LOG), number)
        view.take(spark.createDataFrame(batch, LOG), number)  # offered twice
        if number == 1:
            provisional = counts(view.serve())
            assert sum(map(sum, provisional.values())) >= sum(map(sum, brute(seen_rows).values()))
        view.recompute(batch[-1][6])
        assert counts(view.serve()) == brute(seen_rows)
    assert counts(lambda_views.recount(spark.createDataFrame(rows, LOG))) == brute(rows)
    assert lambda_views.recount(spark.createDataFrame([], LOG)).count() == 0


def messages(n, seed, hot=0.4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if rng.random() < hot:
            out.append(raw(i, model=rng.choice(["m", "M", " m"]), microbatch=rng.choice([None, -1])))
        else:
            out.append(raw(i, model=rng.choice(["m", "x", None]), act=rng.choice(["a", "A ", None]), gid=rng.choice([1, 10**9, 3, None]), attempt=rng.choice([0, 1, None]), microbatch=rng.randrange(4)))
    return out


def key(r):
    n = lambda s: None if s is None else s.strip().lower()
    return (n(r[1]), n(r[2]), *r[3:7], -1 if r[7] is None else r[7], *r[8:15])


def brute_repeats(rows):
    first = {}
    for r in sorted(rows, key=lambda r: r[0]):
        first.setdefault(key(r), r[0])
    return sorted(r[0] for r in rows if first[key(r)] != r[0])


@pytest.mark.parametrize("stretch", [7, 10**6])
def test_repeats(spark, monkeypatch, stretch):
    monkeypatch.setattr(seen, "STRETCH", stretch)
    monkeypatch.setattr(seen, "SHARD_ROWS", 100)
    rows = messages(600, 2)
    df = seen.message_rows(spark.createDataFrame(rows, RAW).repartition(5))
    assert sorted(r.row_id for r in seen.repeats(df).collect()) == brute_repeats(rows)


def test_repeats_edges(spark):
    assert seen.repeats(seen.message_rows(spark.createDataFrame([], RAW))).count() == 0
    same = [raw(5), raw(5), raw(9)]
    assert sorted(r.row_id for r in seen.repeats(seen.message_rows(spark.createDataFrame(same, RAW))).collect()) == [5, 9]


def test_seen_store_over_batches(spark, tmp_path):
    rows = messages(240, 8)
    store = seen.SeenStore(spark, str(tmp_path / "s"), shards=3)
    kept = []
    for number in range(3):
        part = [r[:5] + (None if r[5] is None else r[5] * (number + 1),) + r[6:] if number == 2 and r[0] % 5 == 0 else r for r in rows[number * 80 : number * 80 + 80]]
        rows[number * 80 : number * 80 + 80] = part
        kept += [r.row_id for r in store.take(seen.message_rows(spark.createDataFrame(part, RAW)), number).collect()]
        told = sorted(r.row_id for r in store.take(seen.message_rows(spark.createDataFrame(part, RAW)), number).collect())
        assert told == sorted(kept[-len(told) :])  # offered again: the same answer, nothing taken twice
    assert sorted(kept) == sorted({r[0] for r in rows} - set(brute_repeats(rows)))
    assert seen.SeenStore(spark, str(tmp_path / "s"), shards=3).taken == [0, 1, 2]


def test_seen_store_out_of_order_growing_and_compacting(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(seen, "COMPACT_AFTER", 2)
    monkeypatch.setattr(seen, "SHARD_ROWS", 40)
    store, met, whole = seen.SeenStore(spark, str(tmp_path / "s")), set(), []
    for n, number in enumerate([5, 2, 9, 0, 7, 1]):
        part = [raw(1000 * number + i, gid=i % 23 + (10 ** (3 * (n // 2)) if i % 3 else 0), microbatch=i % 2) for i in range(60)]
        got = sorted(r.row_id for r in seen.SeenStore(spark, str(tmp_path / "s")).take(seen.message_rows(spark.createDataFrame(part, RAW)), number).collect())
        want = []
        for r in part:
            if key(r) not in met:
                met.add(key(r))
                want.append(r[0])
        assert got == sorted(want), number
        whole.append(store._published()[-1]["whole"])
    assert store.taken == [5, 2, 9, 0, 7, 1] and store._published()[-1]["ids"] == len(met) and not all(whole)
    assert len([p for p in (tmp_path / "s").glob("batch-*/bits")]) < 6
    with pytest.raises(ValueError, match="first deliveries"):
        store.take(seen.message_rows(spark.createDataFrame([], RAW)), 5, repeats=True)


def test_a_batch_that_fails_before_it_is_published_counts_for_nothing(spark, tmp_path, monkeypatch):
    store = seen.SeenStore(spark, str(tmp_path / "s"))
    rows = seen.message_rows(spark.createDataFrame([raw(1), raw(2, gid=2)], RAW))
    monkeypatch.setattr(seen.SeenStore, "_clear", lambda *_: None)
    monkeypatch.setattr(store, "spark", _Failing(spark))
    with pytest.raises(RuntimeError, match="lost"):
        store.take(rows, 0)
    assert seen.SeenStore(spark, str(tmp_path / "s")).taken == []
    store.spark = spark
    assert sorted(r.row_id for r in store.take(rows, 0).collect()) == [1, 2]


class _Failing:
    """A session that is lost when the row that publishes is made."""

    def __init__(self, spark):
        self.spark = spark

    def __getattr__(self, name):
        return getattr(self.spark, name)

    def createDataFrame(self, rows, schema):  # noqa: N802
        if schema == seen._TAKEN:
            raise RuntimeError("lost")
        return self.spark.createDataFrame(rows, schema)


def test_stream_batches_run_again(spark, tmp_path):
    from kilnspan.streaming.counts import into_seen

    take = into_seen(seen.SeenStore(spark, str(tmp_path / "s")), seen.message_rows, str(tmp_path / "sink"))
    batch = spark.createDataFrame([raw(1), raw(2), raw(3, gid=3)], RAW)
    for number in (0, 0, 1, 0):
        take(batch, number)
        assert sorted(r.row_id for r in spark.read.parquet(str(tmp_path / "sink" / "batch=0")).collect()) == [1, 3]
    assert spark.read.parquet(str(tmp_path / "sink" / "batch=1")).count() == 0


def test_views_reopened_recomputed_twice_and_out_of_order(spark, tmp_path):
    rows = sorted(events(200, 6), key=lambda r: r[6])
    at = str(tmp_path / "v")
    open_view = lambda: lambda_views.LambdaView(spark, at)
    open_view().take(spark.createDataFrame(rows[60:120], LOG), 2)
    open_view().take(spark.createDataFrame(rows[:60], LOG), 1)
    for _ in range(3):  # a scheduled recompute in a quiet time
        open_view().recompute(rows[119][6])
        assert counts(open_view().serve()) == brute(rows[:120])
    open_view().take(spark.createDataFrame(rows[150:], LOG), 3)
    open_view().take(spark.createDataFrame(rows[120:150], LOG), 0)
    assert open_view().taken == [2, 1, 3, 0]
    open_view().recompute(1 << 62)
    assert counts(open_view().serve()) == brute(rows)
    open_view().recompute(0)  # time never goes back
    assert counts(open_view().serve()) == brute(rows)
    got = {r.row_id: r.outcome for r in open_view().outcomes().collect()}
    want = {r.row_id: r.verdict for r in lambda_views.admit(spark.createDataFrame(rows, LOG)).collect() if r.verdict in ("dropped", "correcting")}
    assert got == want


def test_view_that_fails_before_it_publishes(spark, tmp_path, monkeypatch):
    rows = events(50, 9)
    view = lambda_views.LambdaView(spark, str(tmp_path / "v"))
    view.take(spark.createDataFrame(rows[:30], LOG), 0)
    view.recompute(0)
    before = counts(view.serve())
    with monkeypatch.context() as m:
        m.setattr(lambda_views.LambdaView, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        for step in (lambda: view.take(spark.createDataFrame(rows[30:], LOG), 1), lambda: view.recompute(1 << 62)):
            with pytest.raises(RuntimeError, match="lost"):
                step()
    assert counts(view.serve()) == before and view.taken == [0]
    view.take(spark.createDataFrame(rows[30:], LOG), 1)
    view.recompute(1 << 62)
    assert counts(view.serve()) == brute(rows)


def test_layout_and_containers(spark):
    df = spark.createDataFrame([(None, -5, 2**62), (3, None, -(2**62)), (7, 9, 0)], "a bigint, b int, c bigint")
    layout = seen.Layout.of(df, ["a", "b", "c"])
    back = df.select(*layout.pack()).select(*layout.unpack())
    assert sorted(map(repr, back.select("a", "b", "c").collect())) == sorted(map(repr, df.withColumn("b", F.col("b").cast("bigint")).collect()))
    for bits in (np.array([0, 65535]), np.arange(0, 65536, 3), np.arange(5000)):
        assert (seen.unpack_bits(seen.pack_bits(bits)) == bits).all()
    assert len(seen.pack_bits(np.arange(60000))) == 8193
