"""Streams against their batch counterparts."""

import shutil
import time

import pytest
from pyspark.sql import functions as F

from kilnspan.operators import lambda_views, loss_slope, seen
from kilnspan.plans import tools
from kilnspan.sources import audit
from kilnspan.streaming import controller, counts
from tests.test_upkeep import LOG, RAW, brute, brute_repeats, events, messages
from tests.test_upkeep import counts as as_counts


def samples(omit=()):
    rows = []
    for it in range(1, 5):
        for d in (0, 1):
            for k in (0, 1):
                use = 1 if (it, d) in omit else d
                rows.append(("r", it, None, 1 - d if (it, d) in omit else use, it * 10 + d * 2 + k, 5.0 - it * (d + 1) * 0.5 + k, 1 + k))
        rows.append(("r", it, True, None, None, None, None))
    return rows


def run_stream(spark, tmp_path, files, expected=4, sink=None):
    source = tmp_path / "in"
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, controller.SAMPLE_SCHEMA).coalesce(1).write.parquet(str(source / f"{n}"))
    stream = spark.readStream.schema(controller.SAMPLE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
    out = controller.complete_iterations(stream, expected, [0, 1])
    writer = out.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
    q = writer.foreachBatch(sink).start()
    q.awaitTermination(120)
    if q.exception():
        raise q.exception()


SETTINGS = loss_slope.Settings(2, 2, 0.5, 0.1)


def make_batches(spark):
    rows = samples()
    df = spark.createDataFrame([r for r in rows if r[4] is not None], controller.SAMPLE_SCHEMA)
    grid = df.select("run_id", "training_iteration_id").distinct().withColumn("dataset_id", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows, loss_slope.iteration_losses(df, grid)


def decisions(df):
    return sorted((r.run_id, r.decision_id, r.decision_type, r.effective_training_iteration, tuple(round(w, 12) for w in r.weights)) for r in df.collect())


def test_online_equals_batch(spark, tmp_path):
    rows, want = make_batches(spark)
    files = [rows[10:15], rows[0:7], rows[15:], rows[7:10]]  # out of order
    online = controller.OnlineControl(spark, str(tmp_path / "out"), SETTINGS)
    run_stream(spark, tmp_path, files, sink=online)
    online.close()
    got = spark.read.parquet(str(tmp_path / "out/audit/iteration_metrics")).drop("batch")
    fix = lambda x: sorted((r.run_id, r.training_iteration_id, r.dataset_id, r.status, r.sample_count, r.target_token_count, round(r.loss_value, 9)) for r in x.collect())
    assert fix(got) == fix(want) and got.count() == 8
    indicators = loss_slope.window_indicators(want, 2, 2)
    batch = loss_slope.decisions_made(loss_slope.decide(indicators, SETTINGS))
    assert decisions(online.store.all()) == decisions(batch) and batch.count() == 1
    for table, n in (("window_indicators", 4), ("realized_mixture", 8), ("mixture_decisions", 1)):
        assert spark.read.parquet(str(tmp_path / f"out/audit/{table}")).count() == n
    record = online.snapshot("r", 4)
    assert record["last_window_id"] == 2
    again = controller.resume(spark, SETTINGS, [record]).first()
    assert again.last_window_id == 2 and list(again.weights) == list(record["weights"])
    for other in ({**record, "eta": 2.0}, {k: v for k, v in record.items() if k != "eta"}, {**record, "more": 1}):
        with pytest.raises(ValueError):
            controller.resume(spark, SETTINGS, [other])
    with pytest.raises(ValueError):
        online.snapshot("r", 3)
    with pytest.raises(RuntimeError, match="beyond"):
        online.snapshot("r", 2)
    with pytest.raises(TimeoutError):
        online.snapshot("r", 6)
    with pytest.raises(ValueError):
        controller.require_new_run(spark, str(tmp_path / "out"), "r")
    controller.require_new_run(spark, str(tmp_path / "out"), "other")
    assert online.store.get("r", 2).decision_id == 1 and online.store.get("r", 9, wait_s=0.1) is None
    assert sorted(r.outcome for r in spark.read.parquet(str(tmp_path / "out/audit/decision_requests")).collect()) == ["served", "timeout"]


def test_online_control_goes_on_after_a_restart(spark, tmp_path, monkeypatch):
    _, metrics = make_batches(spark)
    part = lambda *its: metrics.where(F.col("training_iteration_id").isin(*its))
    folder = str(tmp_path / "out")
    first = controller.OnlineControl(spark, folder, SETTINGS)
    first(part(2), 0)  # waits for iteration 1
    assert first.standing().count() == 0
    with monkeypatch.context() as m:
        m.setattr(controller.DecisionStore, "publish", lambda *_: (_ for _ in ()).throw(OSError("disk full")))
        with pytest.raises(OSError):
            first(part(1), 1)
    first.close()
    second = controller.OnlineControl(spark, folder, SETTINGS)
    second(part(1), 1)  # run again
    second(part(1), 1)  # and once more: it counts already
    assert second.standing().first().last_window_id == 1
    second.close()
    shutil.rmtree(f"{folder}/audit/iteration_metrics/batch=1")  # as if it had ended before its thread wrote this
    third = controller.OnlineControl(spark, folder, SETTINGS)
    third(part(4, 3), 2)
    third.close()
    want = loss_slope.decisions_made(loss_slope.decide(loss_slope.window_indicators(metrics, 2, 2), SETTINGS))
    assert decisions(third.store.all()) == decisions(want)
    assert third.standing().first().last_window_id == 2
    assert spark.read.parquet(f"{folder}/audit/iteration_metrics").count() == 8
    with pytest.raises(ValueError, match="conflicting"):
        third.store.publish(want.withColumn("reason", F.lit("x")))


def test_audit_failures_come_back(tmp_path):
    writer, done = audit.AuditWriter(), []
    writer.submit(lambda: done.append(1))
    writer.flush()
    writer.submit(lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        for _ in range(1000):
            writer.submit(lambda: done.append(2))
            time.sleep(0.01)
    assert done[0] == 1
    for synchronous in (True, False):
        path = str(tmp_path / f"windows-{synchronous}.jsonl")
        log = audit.WindowLog(path, synchronous)
        rows = list(loss_slope.drawn_windows(7, [(1, [1, 1]), (2, [1, 3])], 4, 2))
        log.append(rows)
        log.append(rows[:1])
        log.close()
        with open(path, "a") as f:
            f.write('{"torn')
        log = audit.WindowLog(path, synchronous)
        assert [r["window_id"] for r in log.read()] == [1, 2]
        with pytest.raises(ValueError):
            log.append([{**rows[0], "decision_id": 9}])
        log.close()


def test_duplicates_are_errors(spark, tmp_path):
    rows = samples()
    with pytest.raises(Exception, match="duplicate sample"):
        run_stream(spark, tmp_path, [rows[:3], rows[:1]], sink=lambda b, n: b.count())


def test_deadline_holds_however_busy_the_stream(spark, tmp_path):
    rows = samples()
    source = tmp_path / "in"
    write = lambda n, part: spark.createDataFrame(part, controller.SAMPLE_SCHEMA).coalesce(1).write.parquet(str(source / str(n)))
    write(0, [rows[0], rows[4]])  # iteration 1 accepted, with one sample of four
    stream = spark.readStream.schema(controller.SAMPLE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
    out = controller.complete_iterations(stream, 4, [0, 1], deadline_ms=4000)
    q = out.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").foreachBatch(lambda b, n: b.count()).start()
    try:
        until = time.monotonic() + 90
        for n in range(1, 400):
            if not q.isActive or time.monotonic() > until:
                break
            write(n, [("r", 2, None, 0, 100_000 + n, 1.0, 1)] if n <= 3 else [("other", n, None, 0, n, 1.0, 1)])
            time.sleep(0.3)
        assert q.exception() is not None and "incomplete 4000 ms after" in str(q.exception())
    finally:
        q.stop()


def test_command_line(spark, tmp_path, capsys):
    rows = samples()
    for n, part in enumerate((rows[10:], rows[:10])):
        spark.createDataFrame(part, controller.SAMPLE_SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    args = ["control", "--samples", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--window-iterations", "2", "--total-windows", "2", "--expected-samples", "4", "--eta", "0.5", "--uniform-smoothing", "0.1", "--dataset", "0", "--dataset", "1", "--once"]
    assert tools.main(args) == {"r": 2} and '"r": 2' in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "out/audit/mixture_decisions")).count() == 1
    with pytest.raises(TimeoutError):
        tools.main([*args[:2], str(tmp_path / "none"), *args[3:], "--startup-s", "0.2"])


def test_startup_timeout(spark, tmp_path):
    controller.wait_ready(spark, [str(tmp_path)], 1)
    with pytest.raises(TimeoutError):
        controller.wait_ready(spark, [str(tmp_path / "nothing")], 0.3, 0.1)


def test_streamed_views_and_messages(spark, tmp_path):
    rows = sorted(events(120, 9), key=lambda r: r[6])
    for n in range(3):
        spark.createDataFrame(rows[n * 40 : n * 40 + 40], LOG).coalesce(1).write.parquet(str(tmp_path / f"e/{n}"))
    view = lambda_views.LambdaView(spark, str(tmp_path / "v"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e/*"))
    stream.writeStream.foreachBatch(counts.into_views(view, 2)).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination(120)
    view.recompute(1 << 62)
    assert as_counts(view.serve()) == brute(rows)
    msgs = messages(90, 3)
    for n in range(3):
        spark.createDataFrame(msgs[n * 30 : n * 30 + 30], RAW).coalesce(1).write.parquet(str(tmp_path / f"m/{n}"))
    store = seen.SeenStore(spark, str(tmp_path / "s"), shards=2)
    stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "m/*"))
    stream.writeStream.foreachBatch(counts.into_seen(store, seen.message_rows, str(tmp_path / "kept"))).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination(120)
    kept = spark.read.parquet(str(tmp_path / "kept")).count()
    assert kept == len({r[0] for r in msgs}) - len(brute_repeats(msgs))


def test_watermarked_counts(spark):
    got = counts.provisional_counts(spark.createDataFrame(events(50, 1), LOG))
    assert set(got.columns) == {"run_id", "w", "rows"}
