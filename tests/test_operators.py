"""Operators on small inputs with known results."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilnspan import checks
from kilnspan.functions import arrays
from kilnspan.operators import asof, attempts, contribution, experts, lineage, logs, loss_slope, pathways, ranks, reconstruct, router, scalars, segments, topology, transports
from kilnspan.schema import COORDINATES, STATUS_IDENTITY, SchemaMismatch, require_schema
from kilnspan.sources import jsonl, records, sinks

NAMES = [n for n, _ in COORDINATES]
DDL = ", ".join(f"{n} {t.simpleString()}" for n, t in COORDINATES)


def row(value, **k):
    base = dict(model_id="m", act_name="a", direction="fwd", phase="train", global_batch_id=1, dp_rank=0, microbatch_id=0, sample_index=0, layer_no=-1, shard_rank=0, token_start=0, token_end=4, attempt_id=0, invocation_id=0, dataset_id=0)
    base.update(k)
    return (*[base[n] for n in NAMES], value)


def floats(spark, *rows):
    return spark.createDataFrame(list(rows), DDL + ", value double")


def ints(spark, *rows):
    return spark.createDataFrame(list(rows), DDL + ", value bigint")


def status(value, **k):
    return row(value, act_name="iteration_attempt_status", direction="iter", **{**STATUS_IDENTITY, **k})


def test_payload_without_status(spark):
    represented = attempts.represented_iterations(floats(spark, row(1.0), row(1.0, global_batch_id=2)))
    resolved = attempts.resolve(attempts.status_rows(ints(spark, status(1))))
    with pytest.raises(checks.DataError, match=r"no accepted attempt status: \[2\]"):
        attempts.require_status(represented, resolved)


def test_attempt_rules(spark):
    good = ints(spark, status(0), status(1, attempt_id=1), status(-1, global_batch_id=2))
    assert [tuple(r) for r in attempts.accepted_attempts(good).collect()] == [("m", 1, 1)]
    for bad in (ints(spark, status(1), status(1, attempt_id=1)), ints(spark, status(0)), ints(spark, status(5)), ints(spark, status(1, dp_rank=3))):
        with pytest.raises(checks.DataError):
            attempts.accepted_attempts(bad)
    assert not any(r[3] or r[4] or r[5] for r in attempts.iteration_ends(attempts.status_rows(good)).collect())


def test_visibility_and_reader(spark):
    payload = floats(spark, row(1.0), row(2.0, attempt_id=1), row(3.0, phase="valid", attempt_id=7), row(4.0, global_batch_id=0), row(5.0, attempt_id=1, invocation_id=1, sample_index=1))
    marks = ints(spark, status(0), status(1, attempt_id=1))
    reader = records.TrainingReader({"raw_scalar_float": payload, "raw_scalar_int": marks})
    values = lambda df: [r.value for r in df.collect()]
    assert sorted(values(reader.scalars(["m", "a"]))) == [2.0, 3.0, 4.0]
    assert len(values(reader.raw_scalars(["m"]))) == 5
    assert sorted(values(reader.scalars(["m", "a", "fwd", "train"], all_invocations=True))) == [2.0, 4.0, 5.0]
    assert not reader.ready()
    with pytest.raises(ValueError):
        records.by_prefix(payload, [])
    with pytest.raises(ValueError):
        records.require_identifier("x; drop")
    with pytest.raises(SchemaMismatch):
        require_schema(payload, "raw_scalar_int")


def test_weighted_loss(spark):
    losses = floats(spark, row(2.0), row(4.0, sample_index=1))
    counts = ints(spark, row(1), row(3, sample_index=1))
    assert scalars.weighted_loss(scalars.pair_losses(losses, counts)).first().metric_value == 3.5
    with pytest.raises(checks.DataError, match="Duplicate lm_per_sample_loss raw row"):
        scalars.pair_losses(losses.union(losses), counts)
    with pytest.raises(checks.DataError, match="pair"):
        scalars.pair_losses(losses, ints(spark, row(1)))
    with pytest.raises(checks.DataError):
        scalars.weighted_loss(scalars.pair_losses(losses, ints(spark, row(0), row(0, sample_index=1))))
    grad = floats(spark, row(3.5, act_name="grad_norm", direction="iter", **{k: v for k, v in STATUS_IDENTITY.items()}))
    assert scalars.direct_scalar(grad, "grad_norm").first().metric_value == 3.5
    with pytest.raises(checks.DataError):
        scalars.direct_scalar(floats(spark, row(math.nan, act_name="grad_norm", **STATUS_IDENTITY)), "grad_norm")


def test_expert_load(spark):
    vec = lambda *v: spark.createDataFrame([("m", "train", 1, 0, list(v))], "model_id string, phase string, global_batch_id bigint, layer_no int, counts array<bigint>")
    pre, post = (experts.sum_vectors(vec(*v), experts.SLICE) for v in ((6, 2), (4, 0)))
    load = experts.expert_load(pre, post)
    assert {(r.load_kind, r.expert_id): r.token_count for r in load.collect()} == {("pre_drop", 0): 6, ("pre_drop", 1): 2, ("post_drop", 0): 4, ("post_drop", 1): 0, ("dropped", 0): 2, ("dropped", 1): 2}
    s = experts.load_summary(load).first()
    assert (s.active_expert_count, s.dead_expert_count, s.load_cv, s.max_load_share, s.drop_rate) == (1, 1, 1.0, 1.0, 0.5)
    with pytest.raises(checks.DataError):
        experts.expert_load(post, pre)
    e = spark.createDataFrame([("m", "train", 1, 0, 0.5), ("m", "train", 1, 0, 1.5)], "model_id string, phase string, global_batch_id bigint, layer_no int, value double")
    assert experts.router_entropy(e, expected_samples=2).first().entropy_mean == 1.0


def test_arrays(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    lit = lambda *v, t="double": F.array(*[F.lit(x).cast(t) for x in v])
    assert get(arrays.pathway_tokens(lit(0.1, 0.5, 0.3, 0.1, t="float"), 0.7)) == [1, 2]
    assert get(arrays.pathway_tokens(lit(0.25, 0.25, 0.25, 0.25, t="float"), 0.7)) == [0, 1, 2]
    assert get(arrays.pathway_sequence(F.array(lit(3, 1, t="int"), lit(2, t="int")))) == [3, 1, 1_000_001, 2]
    assert get(arrays.cosine(lit(1, 0), lit(1, 1))) == pytest.approx(1 / math.sqrt(2))
    with pytest.raises(Exception, match="zero norm"):
        get(arrays.cosine(lit(0, 0), lit(1, 1)))
    assert get(arrays.top_k(lit(1, 5, 5, 2), 3)[1]) == [1, 2, 3]
    with pytest.raises(ValueError):
        arrays.top_k(lit(1), True)
    assert ranks.linear_percentiles(one.select(F.lit(1).alias("g"), F.explode(lit(1, 2, 4, 8)).alias("v")), ["g"], "v", [0.25, 0.5, 0.75]).first().q == [1.75, 3.0, 5.0]
    new = get(arrays.updated_mixture(lit(0.5, 0.5), lit(0.1, 0.4), F.lit(2.0), F.lit(0.5)))
    z = [0.5 * math.exp(0.2), 0.5 * math.exp(0.8)]
    assert new == pytest.approx([0.5 * x / sum(z) + 0.25 for x in z])
    eye = [[1.0, 0.0], [0.0, 1.0]]
    c = one.select(F.array(*[lit(*v) for v in (*eye, eye[0])]).alias("v")).select(arrays.consistency(F.col("v"), 1e-6)).first()[0]
    assert c == pytest.approx(1.0)
    for name, dtype in (("torch.float32", "<f4"), ("half", "<f2"), ("int64", "<i8"), ("bool", "?")):
        assert arrays.decode_bytes(name, [2, 1], np.array([1, 0], dtype=dtype).tobytes()).tolist() == [1.0, 0.0]
    bf = (np.array([0.8], dtype=np.float32).view(np.uint32) >> 16).astype("<u2").tobytes()
    assert arrays.decode_bytes("bfloat16", [1], bf)[0] == pytest.approx(0.8, rel=1e-2)
    with pytest.raises(ValueError):
        arrays.decode_bytes("float32", [3], b"\0" * 8)


def test_levenshtein():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice([1, 2, 1_000_001, 7]) for _ in range(rng.randrange(9))] for _ in range(2))
        assert arrays.levenshtein(a, b) == plain(a, b)


def test_windows(spark):
    sequences = [(1,), (1, 1_000_001, 2), (3, 1_000_001, 2), (1, 2), (4,)]
    rng = random.Random(5)
    rows = [(i, 0, float(i), list(rng.choice(sequences))) for i in range(1, 22) for _ in range(2)]
    df = spark.createDataFrame(rows, "global_batch_id bigint, dataset_id int, score double, pathway array<int>")
    its = df.select("global_batch_id")
    d = {(r.window_size_iterations, r.window_end_iteration): r for r in pathways.window_distances(df, its, [1, 20]).collect()}
    s = {(r.window_size_iterations, r.window_end_iteration): r for r in pathways.window_consistency(df, its, [1, 20]).collect()}
    assert len(d) == len(s) == 42
    assert (d[20, 1].effective_window_size_iterations, d[20, 1].sample_count, d[20, 1].pair_count) == (1, 2, 1)
    assert (d[20, 20].window_start_iteration, d[20, 20].sample_count, d[20, 20].pair_count) == (1, 40, 780)
    assert (d[20, 21].window_start_iteration, d[20, 21].sample_count, d[20, 21].pair_count) == (2, 40, 780)
    inside = [r[3] for r in rows if 2 <= r[0] <= 21]
    total = sum(arrays.levenshtein(a, b) for i, a in enumerate(inside) for b in inside[i + 1 :])
    assert d[20, 21].pathway_edit_distance_sum == total and d[20, 21].mean_pathway_edit_distance == total / 780
    assert s[20, 21].consistency_sum == sum(r[2] for r in rows if r[0] >= 2)


def test_distances_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [("m", "train", it, 0, s % 2, [rng.randrange(6) for _ in range(rng.randrange(5))]) for it in range(1, 5) for s in range(12)]
    df = spark.createDataFrame(rows, "model_id string, phase string, global_batch_id bigint, sample_index int, dataset_id int, pathway array<int>")
    run = lambda: sorted(map(tuple, pathways.window_distances(df, df.select("global_batch_id"), [1, 3]).collect()))
    whole = run()
    monkeypatch.setattr(pathways, "PAIR_BLOCK", 2)
    assert run() == whole and len(whole) == 16


def test_window_datasets_apart(spark):
    rows = [(0 + 1, 0, 1.0, [1]), (1, 1, 1.0, [1]), (2, 0, 1.0, [2])]
    df = spark.createDataFrame(rows, "global_batch_id bigint, dataset_id int, score double, pathway array<int>")
    got = {(r.window_end_iteration, r.dataset_id): (r.pair_count, r.mean_pathway_edit_distance) for r in pathways.window_distances(df, df.select("global_batch_id"), [2]).collect()}
    assert got == {(1, 0): (0, None), (1, 1): (0, None), (2, 0): (1, 1.0), (2, 1): (0, None)}


def test_assemble_samples(spark):
    cols = "model_id string, phase string, global_batch_id bigint, dp_rank int, microbatch_id int, sample_index int, layer_no int, dataset_id int, probs array<float>"
    ok = [("m", "train", 1, 0, 0, 0, layer, 3, [0.5, 0.5]) for layer in (1, 0)]
    assert pathways.pathways(pathways.assemble_samples(spark.createDataFrame(ok, cols), 2), 0.5).first().pathway == [0, 1_000_001, 0]
    with pytest.raises(checks.DataError):
        pathways.assemble_samples(spark.createDataFrame([ok[0], (*ok[1][:7], 4, ok[1][8])], cols), 2)
    samples = pathways.assemble_samples(spark.createDataFrame(ok, cols), 2).withColumn("state_id", F.lit(0))
    states = spark.createDataFrame([(0, 0, [1.0, 0.0, 0.0, 1.0]), (0, 1, [1.0, 1.0, 1.0, 1.0])], "state_id int, layer_no int, weights array<double>")
    assert pathways.sample_consistency(samples, states, 0.0).first().score == pytest.approx(0.0)


@pytest.mark.parametrize("lanes", [1, 3])
def test_asof(spark, lanes):
    facts = spark.createDataFrame([(k, t) for k in ("a", None) for t in (0, 1, 2, 5, 9)] + [("b", 1), ("a", None)], "k string, t bigint")
    states = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("a", 4, "z"), ("a", 4, "w"), (None, 3, "n"), ("a", None, "q")], "k string, t bigint, v string")
    got = {(r.k, r.t): (r.state_t, r.v) for r in asof.latest_before(facts, states, "t", ["k"], ["v"], lanes=lanes).collect()}
    assert got[("a", 0)] == (None, None) and got[("a", 1)] == (0, "x") and got[("a", 2)] == (1, "y") and got[("a", 5)] == (4, "z") and got[("a", 9)] == (4, "z")
    assert got[(None, 2)] == (None, None) and got[(None, 5)] == (3, "n") and got[("b", 1)] == (None, None) and got[("a", None)] == (None, None)
    with pytest.raises(checks.DataError):
        asof.latest_before(facts, states, "t", ["k"], ["v"], required=True)


def test_router(spark):
    logits = [[[0.0, 1.0], [2.0, 0.0]], [[1.0, 1.0], [0.0, 3.0]], [[5.0, 0.0], [1.0, 0.0]]]  # [seq][batch][expert]
    df = spark.createDataFrame([(1, logits)], "id int, logits array<array<array<double>>>")
    samples = router.to_batch_major(df, "logits").select("id", "sample_index", F.posexplode("logits").alias("seq", "logits"))
    samples = samples.withColumn("valid_count", F.when(F.col("sample_index") == 0, 2).otherwise(1))
    soft = lambda x: (np.exp(x) / np.exp(x).sum()).tolist()
    got = {(r.sample_index, r.expert_id): r.prob for r in router.mean_probs(samples, ["id", "sample_index"]).collect()}
    want = np.mean([soft(np.array([0.0, 1.0])), soft(np.array([1.0, 1.0]))], axis=0)
    assert [got[0, 0], got[0, 1]] == pytest.approx(want.tolist()) and [got[1, 0], got[1, 1]] == pytest.approx(soft(np.array([2.0, 0.0])))
    empty = router.mean_probs(samples.withColumn("valid_count", F.lit(0)), ["id", "sample_index"], score="sigmoid")
    assert {r.prob for r in empty.collect()} == {0.0}
    packed = spark.createDataFrame([([[0.8, 0.2], [0.4, 0.6], [9.0, 9.0], [0.7, 0.3], [0.5, 0.5]], [0, 3, 5], [2, 5, 5])], "probs array<array<double>>, starts array<int>, ends array<int>")
    r = router.segment_means(packed).first()
    assert np.allclose(r.segments, [[0.6, 0.4], [0.6, 0.4], [0.0, 0.0]]) and r.active_count == 2
    routed = [[1, 0, 1], [0, 1, 0], [0, 1, 1], [1, 1, 1], [1, 1, 1], [1, 0, 0]]
    rows = spark.createDataFrame([(i, [2, 1], m) for i, m in enumerate(routed)], "row int, valid array<int>, routed array<int>")
    got = {(r.sample_index, r.expert_id): r.token_count for r in router.routed_counts(rows, [], 2, 3).collect()}
    assert [got[0, e] for e in range(3)] == [1, 1, 2] and [got[1, e] for e in range(3)] == [0, 1, 0]
    losses = spark.createDataFrame([([1.0, 3.0, 100.0], [1, 1, 0]), ([2.0, 4.0, 6.0], [1, 0, 1])], "losses array<double>, mask array<int>")
    assert [(r.loss, r.token_count) for r in router.sample_losses(losses).collect()] == [(2.0, 2), (4.0, 2)]
    seg = spark.createDataFrame([([1.0, 3.0, 100.0, 5.0, 7.0, 200.0], [1, 1, 0, 1, 0, 0], [0, 3, 5, 5], [2, 5, 5, 5])], "losses array<double>, mask array<int>, starts array<int>, ends array<int>")
    r = router.segment_losses(seg).first()
    assert [tuple(x) for x in r.segments] == [(2.0, 2), (5.0, 1), (0.0, 0), (0.0, 0)] and r.active_count == 2


def test_loss_slope(spark):
    s = [(it, 0, it * 10 + k, v, n) for it in (1, 2, 3) for k, (v, n) in enumerate([(4.0 - it - 1, 1), (4.0 - it + 1 / 3, 3), (100.0, 0)])]
    s += [(1, 1, 1, 1.0, 2), (3, 1, 3, 1.0, 2)]
    samples = spark.createDataFrame([("r", *x) for x in s], "run_id string, training_iteration_id bigint, dataset_id int, sample bigint, loss double, tokens bigint")
    grid = spark.range(1, 4).select(F.lit("r").alias("run_id"), F.col("id").alias("training_iteration_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("dataset_id"))
    m = loss_slope.iteration_losses(samples, grid)
    first = m.where("dataset_id = 0 and training_iteration_id = 1").first()
    assert first.loss_value == pytest.approx(3.0) and (first.sample_count, first.positive_loss_sample_count, first.target_token_count) == (3, 2, 4)
    ind = {r.dataset_id: r for r in loss_slope.window_indicators(m, 3).collect()}
    assert ind[0].loss_slope == pytest.approx(-1.0) and ind[0].indicator == pytest.approx(1.0) and ind[0].status == "COMPLETE"
    assert ind[1].incomplete_reason == "missing_loss_iterations=2" and ind[1].loss_slope is None
    d = loss_slope.decisions_made(loss_slope.decide(loss_slope.window_indicators(m, 3), loss_slope.Settings(3, 2, 2.0, 0.5))).first()
    assert d.decision_type == "HOLD_INCOMPLETE" and list(d.weights) == [0.5, 0.5] and d.effective_training_iteration == 4 and d.reason == "dataset=1:missing_loss_iterations=2"


def test_decisions(spark):
    ddl = "run_id string, dataset_id int, window_id bigint, status string, incomplete_reason string, indicator double"
    s = loss_slope.Settings(5, 2, 2.0, 0.5)
    ok = lambda w, d, i: ("r", d, w, "COMPLETE", "", i)
    one = spark.createDataFrame([ok(1, 1, 0.4), ok(1, 0, 0.1)], ddl)
    two = spark.createDataFrame([ok(2, 0, 0.0), ok(2, 1, 0.0)], ddl)
    after = loss_slope.decide(one, s)
    made = loss_slope.decisions_made(after).first()
    z = [0.5 * math.exp(0.2), 0.5 * math.exp(0.8)]
    assert list(made.weights) == pytest.approx([0.5 * x / sum(z) + 0.25 for x in z]) and (made.decision_type, made.effective_window_id, made.effective_training_iteration) == ("UPDATE", 2, 6)
    # window by window as well as all at once
    end = loss_slope.decide(two, s, after.drop("made")).first()
    whole = loss_slope.decide(one.union(two), s).first()
    assert (end.weights, end.last_window_id, end.next_decision_id, len(end.made)) == (whole.weights, 2, 2, 0) and len(whole.made) == 1
    begun = loss_slope.first_standing(spark, {"r": {1: 3, 0: 1}})
    assert list(begun.first().weights) == [0.25, 0.75]
    record = s.record(begun.first().asDict())
    assert s.standing(record)["weights"] == [0.25, 0.75]
    with pytest.raises(ValueError):
        loss_slope.Settings(5, 2, 2.5, 0.5).standing(record)
    for bad in (two, one.union(one.withColumn("window_id", F.lit(3).cast("bigint")))):
        with pytest.raises(Exception, match="a window is missing"):
            loss_slope.decide(bad, s).collect()
    with pytest.raises(Exception, match="do not cover"):
        loss_slope.decide(one.where("dataset_id = 0"), s, begun).collect()
    assert loss_slope.decide(one.limit(0), s).count() == 0


def test_drawn_windows():
    w = list(loss_slope.drawn_windows(42, [(1, [0.4, 0.6]), (2, [2, 3])], 4, 2))
    assert w[0]["dataset_index"] + w[1]["dataset_index"] == random.Random(42).choices(range(2), weights=[0.4, 0.6], k=8)
    assert sum(w[1]["counters_after"]) == 8 and w[1]["first_training_iteration"] == 3
    for bad in ([(1, [])], [(1, [1, 0])], [(1, [1, 1]), (2, [1])]):
        with pytest.raises(ValueError):
            list(loss_slope.drawn_windows(1, bad, 4, 2))


def test_sample_lookup(spark):
    w = list(loss_slope.drawn_windows(1, [(1, [0.5, 0.5])] * 2, 4, 2))
    df = spark.createDataFrame([("r", x["window_id"], x["first_training_iteration"], x["dataset_index"], x["dataset_sample_index"], x["counters_after"]) for x in w], "run_id string, window_id bigint, first_training_iteration bigint, dataset_index array<int>, dataset_sample_index array<bigint>, counters_after array<bigint>")
    got = {r["index"]: (r.dataset_id, r.record) for r in loss_slope.sample_lookup(spark.range(8).select(F.col("id").alias("index")), df, 4, [3, 2]).collect()}
    for i in range(8):
        d, k = w[i // 4]["dataset_index"][i % 4], w[i // 4]["dataset_sample_index"][i % 4]
        assert got[i] == (d, k % [3, 2][d])
    assert loss_slope.running_samples(df).where("sample <> expected").count() == 0
    assert lineage.counter_breaks(df).count() == 0


def test_conversations(spark, tmp_path):
    roles = ["system", "user", "assistant"] * 3
    df = spark.createDataFrame([(roles,), (["user", "system", "user"],), ([],)], "roles array<string>")
    assert [r.n for r in df.select(segments.count_conversations(F.col("roles")).alias("n")).collect()] == [3, 2, 0]
    r = spark.createDataFrame([([(0, 3), (5, 8)],)], "ranges array<struct<start:int,end:int>>")
    p = r.select(segments.padded_ranges(F.col("ranges"), 4).alias("p"))
    assert (p.first().p.starts, p.first().p.ends) == ([0, 5, 8, 8], [3, 8, 8, 8])
    assert p.select(segments.active_lengths(F.col("p.starts"), F.col("p.ends")).alias("n")).first().n == [3, 3]
    with pytest.raises(Exception, match="ranges"):
        r.select(segments.padded_ranges(F.col("ranges"), 1)).collect()
    one = '{"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]}'
    three = '{"messages": [' + ", ".join('{"role": "system", "content": "s"}' for _ in range(3)) + "]}"
    (tmp_path / "a.jsonl").write_text(one + "\n" + one + "\n")
    (tmp_path / "b.jsonl").write_text(three + "\n")
    lines = jsonl.read_lines(spark, jsonl.input_paths(spark, [str(tmp_path / "*.jsonl")]))
    roles_of = lines.select("file", "line", F.transform("record.messages", lambda m: m["role"]).alias("roles"))
    whole = segments.conversation_bound(roles_of).where("file is null").first()
    assert (whole.rows, whole.max_conversations, whole.first_line) == (3, 3, 1) and whole.first_file.endswith("b.jsonl")
    (tmp_path / "c.jsonl").write_text(one + "\n\n" + one)
    with pytest.raises(checks.DataError, match="blank"):
        jsonl.read_lines(spark, [str(tmp_path / "c.jsonl")])


def test_transports(spark):
    payload = spark.createDataFrame([(10, [4, 2], [4, 9], [[1.0] * 3, [2.0] * 3], 2, 3)], "token_start bigint, valid array<int>, datasets array<int>, values array<array<double>>, attempt_id int, invocation_id int")
    rows = transports.identity_rows(payload).orderBy("sample_index").collect()
    assert [(r.token_end, r.dataset_id, len(r["values"]), r.attempt_id, r.invocation_id) for r in rows] == [(14, 4, 3, 2, 3), (12, 9, 3, 2, 3)]
    assert transports.prefix_strip(payload.withColumn("active_count", F.lit(1))).count() == 1
    m = spark.createDataFrame([([[1, 10], [2, 20], [3, 30]], [3, 1])], "v array<array<int>>, n array<int>")
    packed = m.select("n", transports.seq_prefix_pack(F.col("v"), F.col("n")).alias("p"))
    assert packed.first().p == [1, 2, 3, 10]
    assert packed.select(transports.seq_prefix_unpack(F.col("p"), F.col("n")).alias("u")).first().u == [[1, 2, 3], [10]]
    s = spark.createDataFrame([([1, 2, 3, 4, 5], [0, 3, 5], [2, 5, 5], [7, 8, 9])], "values array<int>, starts array<int>, ends array<int>, datasets array<int>")
    assert s.select(transports.segmented_pack(F.col("values"), F.col("starts"), F.col("ends")).alias("p")).first().p == [1, 2, 4, 5]
    assert [(r.sample_index, r.dataset_id, r["values"]) for r in transports.segmented_rows(s).orderBy("sample_index").collect()] == [(0, 7, [1, 2]), (1, 8, [4, 5])]
    b = spark.createDataFrame([("m", 5, "valid", 0, "entry", 1), ("m", 5, "valid", 0, "exit", 3), ("m", 9, "test", 0, "entry", 1)], "model_id string, training_iteration_id bigint, phase string, eval_index int, boundary_type string, next_global_batch_id bigint")
    assert transports.boundary_rows(b).count() == 3
    with pytest.raises(checks.DataError):
        transports.boundary_rows(b.withColumn("phase", F.lit("train")))
    assert transports.expected_rows(10, 4, 2, 5, 1) == {"train": 80, "valid": 24, "test": 8}


def manifest(**k):
    base = dict(model_id="m", tp_groups=[(0,), (1,)], pp_groups=[(0,), (1,)], cp_groups=[(0,), (1,)], dp_groups=[(0, 1)], ep_groups=[(0, 1)], etp_groups=[(0,), (1,)], expert_dp_groups=[(0,), (1,)], dispatch_groups=[(0, 1)], layer_stage={3: 0}, local_experts=[(0, 1), (2, 3)], top_k=2)
    return topology.Manifest(**{**base, **k})


EX = ("m", "train", 7, 0, 0, 3, "fwd")
EXD = "model_id string, phase string, global_batch_id bigint, attempt_id int, microbatch_id int, layer_no int, direction string"


def captures(spark, ids, weights, maps, packed):
    pair = EXD + ", shard_rank int, dp_rank int, sample_index int, token_start bigint, token_end bigint, dataset_id int, matrix "
    return (
        spark.createDataFrame([(*EX, *r) for r in ids], pair + "array<array<int>>"),
        spark.createDataFrame([(*EX, *r) for r in weights], pair + "array<array<double>>"),
        spark.createDataFrame([(*EX, *r) for r in maps], EXD + ", shard_rank int, flat_map array<bigint>"),
        spark.createDataFrame([(*EX, *r) for r in packed], EXD + ", shard_rank int, rows array<array<double>>"),
    )


def ep2(spark):
    at = lambda rank, m: (rank, rank, 0, 0, 2, 10, m)
    return captures(
        spark,
        [at(0, [[0, 2], [1, 3]]), at(1, [[2, 3], [0, 1]])],
        [at(0, [[0.6, 0.4], [0.7, 0.3]]), at(1, [[0.8, 0.2], [0.55, 0.45]])],
        [(0, [0, 1, 0, 1]), (1, [1, 1, 0, 0])],
        [(0, [[1.0, 2.0], [121.0, 122.0], [21.0, 22.0], [131.0, 132.0]]), (1, [[11.0, 12.0], [101.0, 102.0], [31.0, 32.0], [111.0, 112.0]])],
    )


def test_reconstruct_two_expert_ranks(spark):
    tokens = reconstruct.token_table(reconstruct.reconstruct(*ep2(spark), manifest()))
    got = {(r.dp_rank, r.token_index): r.combined for r in tokens.collect()}
    assert got == {(0, 0): [12.0, 14.0], (0, 1): [52.0, 54.0], (1, 0): [212.0, 214.0], (1, 1): [252.0, 254.0]}
    ids, weights, maps, packed = ep2(spark)
    with pytest.raises(checks.DataError):
        reconstruct.reconstruct(ids, weights, maps.withColumn("flat_map", F.reverse("flat_map")), packed, manifest())
    with pytest.raises(checks.DataError):
        reconstruct.reconstruct(ids, weights, maps, packed.withColumn("rows", F.slice("rows", 1, 3)), manifest())
    with pytest.raises(topology.TopologyError):
        reconstruct.reconstruct(ids, weights, maps, packed, manifest(padded=True))


def test_reconstruct_sequence_and_expert_tensor_parallel(spark):
    topo = manifest(tp_groups=[(0, 1)], dp_groups=[(0,), (1,)], ep_groups=[(0,), (1,)], etp_groups=[(0, 1)], local_experts=[(0, 1)], layer_stage={3: 0}, top_k=1, sequence_parallel=True)
    by_sample = ([[0], [1]], [[1], [0]])
    rows = [(rank, 0, s, 0, 4, 10 + s, by_sample[s]) for rank in (0, 1) for s in (0, 1)]
    ones = [(*r[:6], [[1.0], [1.0]]) for r in rows]
    maps = [(rank, [0, 3, 1, 2]) for rank in (0, 1)]
    packed = [(0, [[float(i)] for i in range(1, 9)]), (1, [[100.0 * i] for i in range(1, 9)])]
    ids, weights, m, p = captures(spark, rows, ones, maps, packed)
    tokens = reconstruct.token_table(reconstruct.reconstruct(ids, weights, m, p, topo)).orderBy("dataset_id", "sample_index", "token_index").collect()
    assert [r.combined[0] for r in tokens] == [101.0, 606.0, 303.0, 808.0, 505.0, 202.0, 707.0, 404.0]
    with pytest.raises(checks.DataError, match="Duplicate inverse-map row"):
        reconstruct.reconstruct(ids, weights, m.union(m.limit(1)), p, topo)


def test_contribution(spark, tmp_path):
    t = lambda w, o: (5, [(i, a, b) for i, (a, b) in enumerate(zip(w, o, strict=True))], [sum(x) for x in zip(*o, strict=True)])
    rows = [t([0.9, 0.1], [[1.0, 0.0], [0.0, 2.0]]), t([0.5, 0.5], [[1.0, 0.0], [0.0, 1.0]]), t([0.2, 0.8], [[0.0, 0.0], [3.0, 0.0]]), t([0.5, 0.5], [[2.0, 0.0], [2.0, 0.0]])]
    df = spark.createDataFrame(rows, "layer_no int, slots array<struct<slot:int,weight:double,output:array<double>>>, combined array<double>")
    r = contribution.contribution_report(df).first()
    assert (r.valid_token_count, r.magnitude_tie_token_count, r.top_weight_tie_token_count, list(r.router_rank_dominance_counts)) == (4, 2, 2, [1, 1])
    s = 1 / math.sqrt(5)
    assert [r.top_route_alignment_q1, r.top_route_alignment_median, r.top_route_alignment_q3] == pytest.approx([0.75 * s + 0.25, (s + 1) / 2, 0.25 * s + 0.75])
    seen = spark.createDataFrame([(g, layer, mb) for g in range(1, 4) for layer in (0, 1) for mb in (0, 1) if (g, layer) != (2, 1)] + [(9, 0, 0)], "global_batch_id bigint, layer_no int, microbatch_id int")
    gaps = contribution.grid_gaps(seen, [1, 2, 3], [0, 1], 2)
    assert {(x.global_batch_id, x.layer_no, x.problem) for x in gaps.collect()} == {(2, 1, "missing"), (9, 0, "extra")}
    report = contribution.contribution_report(df)
    with pytest.raises(checks.DataError):
        contribution.write_report(report, tmp_path, contribution.validation_record(df.withColumn("global_batch_id", F.lit(1)), gaps, "m"))
    assert (tmp_path / "contribution.csv").read_text().splitlines()[1].startswith('5,4,2,"[1,1]",2,')


def test_topology(tmp_path):
    full = manifest()
    parts = [
        dict(global_rank=r, tp_group=[r], pp_group=[r], cp_group=[r], dp_group=[0, 1], ep_group=[0, 1], etp_group=[r], expert_dp_group=[r], dispatch_group=[0, 1], layers=[3], local_experts=[[0, 1], [2, 3]][r], model_id="m", top_k=2)
        for r in (1, 0)
    ]
    assert topology.assemble(parts) == full
    path = tmp_path / "m.json"
    topology.write_once(path, full)
    topology.write_once(path, full)
    assert topology.Manifest.from_json(path.read_text()) == full
    with pytest.raises(topology.TopologyError):
        topology.write_once(path, manifest(top_k=1))
    for bad in ([(0, 1), (1,)], [(0,), (0, 1)], [(0,)], []):
        with pytest.raises(topology.TopologyError):
            topology.partition(bad, "g", {0, 1})


def test_logs(spark):
    df = spark.createDataFrame([(0, float(x)) for x in range(1, 22)], "k int, ms double")
    s = logs.timing_stats(df, ["k"], "ms").first()
    want = sorted(range(1, 22))[round(0.95 * 20)]
    assert (s.mean, s.p50, s.p95) == (11.0, 11.0, float(want))
    assert df.groupBy("k").agg(logs.nearest_rank(F.col("ms"), 0.95).alias("x")).first().x == want
    assert logs.throughput(4, 10, 16, 2.0) == {"samples_per_second": 20.0, "tokens_per_second": 320.0}
    assert logs.markdown_table([{"a": 1, "b": 0.5}]).splitlines()[2] == "| 1 | 0.5000 |"


def test_log_formats(spark, tmp_path):
    lines = ["x", "evaluate .......: (1.5, 20.25)", *["y"] * 6, " validation loss at iteration 5 on validation set | z", "evaluate ....: (2, 30)", "validation loss at iteration 5 on test set", "evaluate ...: (3, 4)", *["y"] * 7, "validation loss at iteration 9 on test set",
             "[Rank 0] memory (MB) | allocated: 1 | max allocated: 7.5 | reserved: 2 | max reserved: 9.25", "[Rank 1] memory (MB) | allocated: 1 | max allocated: 8 | reserved: 2 | max reserved: 3", "evaluate .: (1, 2)"]
    df = logs.log_lines(spark.createDataFrame([(1, "\n".join(lines)), (2, ""), (3, None)], "doc_id int, text string"))
    timers = logs.eval_timers(df)
    assert [(r.block, r.phase, r.min_ms, r.max_ms) for r in timers.orderBy("line_no").collect()] == [(0, "valid", 1.5, 20.25), (1, "test", 2.0, 30.0), (2, "unknown", 3.0, 4.0)]
    assert logs.warmed(timers).count() == 2
    assert [tuple(r) for r in logs.memory_peaks(df).collect()] == [(1, 8.0, 9.25)]
    table = logs.write_summary(timers.select("block", "max_ms"), str(tmp_path / "s"), ["block"])
    assert table.splitlines()[2] == "| 0 | 20.2500 |" and spark.read.json(str(tmp_path / "s")).count() == 3


def test_percentiles_of_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 1, 1, 2]), rng.choice([0.5, 0.5, 0.5, rng.random(), None])) for _ in range(500)] + [(3, 0.25)] * 40 + [(4, None)]
    got = {r.g: r.q for r in ranks.linear_percentiles(spark.createDataFrame(rows, "g int, v double").repartition(7), ["g"], "v", [0.0, 0.25, 0.5, 0.99, 1.0]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        vs = sorted(v for h, v in rows if h == g and v is not None)
        if vs:
            want[g] = [vs[int(x)] + (x - int(x)) * (vs[min(int(x) + 1, len(vs) - 1)] - vs[int(x)]) for x in (f * (len(vs) - 1) for f in (0.0, 0.25, 0.5, 0.99, 1.0))]
    assert set(got) == set(want) and all(got[g] == pytest.approx(want[g]) for g in want)
    assert ranks.linear_percentiles(spark.createDataFrame([], "g int, v double"), ["g"], "v", [0.5]).count() == 0


def test_lines_of_files_read_in_blocks(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        for name, n in (("a", 60), ("b", 1), ("c", 200)):
            (tmp_path / f"{name}.jsonl").write_text("\n".join(f'{{"messages": [{{"role": "r{i}", "content": "{"x" * (i % 37)}"}}]}}' for i in range(1, n + 1)) + ("\n" if name != "b" else ""))
        lines = jsonl.read_lines(spark, jsonl.input_paths(spark, [str(tmp_path / "*.jsonl")]))
        got = {(r.file.rsplit("/", 1)[1], r.line, r.record.messages[0].role) for r in lines.collect()}
        assert got == {(f"{name}.jsonl", i, f"r{i}") for name, n in (("a", 60), ("b", 1), ("c", 200)) for i in range(1, n + 1)}
        assert spark.read.text(str(tmp_path / "c.jsonl")).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    with pytest.raises(FileNotFoundError):
        jsonl.input_paths(spark, [str(tmp_path / "*.nothing")])


def test_lineage(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 6, 9), ("b", 2, 5), ("c", 1, 3), ("c", 5, 6)], "run_id string, valid_start bigint, valid_end bigint")
    assert {r.run_id for r in lineage.lineage_gaps(df).collect()} == {"b", "c"}
    assert lineage.digest({"b": 1, "a": [1, 2]}) == lineage.digest({"a": [1, 2], "b": 1})
    h = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (2, None)], "iteration int, hash string")
    assert [r.iteration for r in lineage.disagreeing(h, ["iteration"]).collect()] == [2]
    assert lineage.window_position(7, 5) == (2, 2)


def test_sinks(spark, tmp_path):
    make = lambda model, n, v: spark.createDataFrame([(model, "r", "train", i, i, "x", v) for i in range(n)], "model_id string, run_name string, phase string, training_iteration_id bigint, global_batch_id bigint, metric_name string, metric_value double")
    folder = str(tmp_path)
    sinks.create_tables(spark, folder, ["training_scalar"])
    run = lambda model: {"model_id": model, "run_name": "r", "phase": "train"}
    assert sinks.replace_run(make("a", 3, 1.0), folder, "training_scalar", run("a")) == 3
    assert sinks.replace_run(make("b", 2, 1.0), folder, "training_scalar", run("b")) == 2
    assert sinks.replace_run(make("a", 1, 2.0), folder, "training_scalar", run("a")) == 1
    assert sinks.replace_run(make("x/y=z", 2, 2.0), folder, "training_scalar", run("x/y=z")) == 2
    assert sinks.replace_run(make("x/y=z", 0, 2.0), folder, "training_scalar", run("x/y=z")) == 0  # a run without rows has none left
    with pytest.raises(checks.DataError, match="not of the run"):
        sinks.replace_run(make("a", 1, 2.0), folder, "training_scalar", run("b"))
    back = spark.read.parquet(f"{folder}/training_scalar")
    assert {(r.model_id, r.metric_value) for r in back.collect()} == {("a", 2.0), ("b", 1.0)} and back.count() == 3
    jsonl.export(make("a", 5, 1.0), f"{folder}/dump", ["training_iteration_id"], 2)
    assert spark.read.json(f"{folder}/dump").count() == 5
