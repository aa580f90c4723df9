"""From raw tables to all derived tables, and the command lines."""

import json

import numpy as np
import pytest

from kilnspan import captures, sql
from kilnspan.checks import DataError
from kilnspan.operators import topology
from kilnspan.plans import materialize, tools
from kilnspan.schema import TABLES
from tests.test_operators import DDL, EX, floats, ints, manifest, row, status

RAW_DDL = DDL + ", dtype string, shape array<bigint>, bytes binary"
ITER = dict(direction="iter", dp_rank=-1, microbatch_id=-1, sample_index=-1, shard_rank=-1, token_start=0, token_end=1, dataset_id=-1)


def tensor(values, dtype="<f4", name="torch.float32", **k):
    a = np.array(values, dtype=dtype)
    return (*row(None, **k)[:-1], name, list(a.shape), a.tobytes())


def tables(spark, folder):
    its = (1, 2)
    f = [row(float(i + s), act_name="lm_per_sample_loss", global_batch_id=i, sample_index=s) for i in its for s in (0, 1)]
    f += [row(0.5 * i, act_name="grad_norm", global_batch_id=i, **ITER) for i in its]
    f += [row(0.5 + s, act_name="router_token_entropy_mean", global_batch_id=i, sample_index=s, layer_no=la) for i in its for s in (0, 1) for la in (0, 1)]
    n = [row(1 + 2 * s, act_name="lm_per_sample_loss_token_count", global_batch_id=i, sample_index=s) for i in its for s in (0, 1)] + [status(1, global_batch_id=i) for i in its]
    raw = []
    for i in its:
        for la in (0, 1):
            raw += [tensor([6, 2], "<i8", "int64", act_name="pre_drop_token_count", global_batch_id=i, layer_no=la), tensor([4, 0], "<i8", "int64", act_name="post_drop_token_count", global_batch_id=i, layer_no=la)]
            raw += [tensor([0.8, 0.2], act_name="router_probs_mean", global_batch_id=i, layer_no=la, sample_index=s) for s in (0, 1)]
    raw += [tensor([[1, 0], [0, 1]], act_name="router_projection_weight", global_batch_id=i, layer_no=la, **ITER) for i in (0, 1) for la in (0, 1)]
    out = {"raw_scalar_float": floats(spark, *f), "raw_scalar_int": ints(spark, *n), "raw": spark.createDataFrame(raw, RAW_DDL)}
    for name, df in out.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return out


def test_all_derived_tables(spark, tmp_path):
    tables(spark, tmp_path)
    args = ["--raw", str(tmp_path), "--out", str(tmp_path / "out"), "--model-id", "m", "--run-name", "r", "--expected-iterations", "2", "--layers", "2", "--experts", "2", "--hidden", "2", "--window", "1", "--window", "2"]
    assert materialize.main(args) == {"training_scalar": 4, "router_entropy": 4, "expert_load": 24, "expert_load_summary": 4, "pathway_consistency": 4, "pathway_edit_distance": 4}
    read = lambda t: spark.read.schema(TABLES[t]).parquet(str(tmp_path / "out" / t))
    loss = read("training_scalar").where("metric_name = 'lm_loss_iteration' and training_iteration_id = 1").first()
    assert loss.metric_value == pytest.approx((1 * 1 + 2 * 3) / 4)
    s = read("expert_load_summary").first()
    assert (s.active_expert_count, s.dead_expert_count, s.load_cv, s.max_load_share, s.drop_rate) == (1, 1, 1.0, 1.0, 0.5)
    d = {(r.window_size_iterations, r.window_end_iteration): r for r in read("pathway_edit_distance").collect()}
    assert (d[2, 2].sample_count, d[2, 2].pair_count, d[2, 2].pathway_edit_distance_sum) == (4, 6, 0.0)
    assert read("pathway_consistency").first().mean_pathway_consistency == pytest.approx(0.0, abs=1e-5)
    assert materialize.main(args)["training_scalar"] == 4  # replaces the run
    with pytest.raises(DataError):
        materialize.main([*args[:8], "--expected-iterations", "3"])
    for bad in (["--window", "0"], ["--window", "2"]):
        with pytest.raises(SystemExit):
            materialize.main([*args[:8], *bad])
    assert "raw" in sql.register(spark, str(tmp_path))
    assert spark.sql("select count(*) n, max(size(decode_tensor(dtype, shape, bytes))) k from raw").first().k == 4
    assert tools.main(["dump", "--raw", str(tmp_path), "--out", str(tmp_path / "dump"), "--model-id", "m", "--table", "raw", "--table", "raw_scalar_int"]) == {"raw": 20, "raw_scalar_int": 6}
    told = lambda at: json.loads(spark.read.text(str(tmp_path / at / "dump_manifest")).first().value)["rows"]
    assert told("dump")["raw"] == 20
    tools.main(["dump", "--raw", str(tmp_path), "--out", str(tmp_path / "apart"), "--model-id", "m", "--table", "raw", "--payloads"])
    assert told("apart") == {"raw": 20}
    kept, rows = spark.read.parquet(str(tmp_path / "apart/raw_payloads")), spark.read.json(str(tmp_path / "apart/raw"))
    assert "bytes" not in rows.columns and rows.join(kept, "payload_sha256").where("payload_bytes = octet_length(bytes)").count() == 20


def test_contribution_from_raw_rows(spark, tmp_path):
    base = dict(zip(("model_id", "phase", "global_batch_id", "attempt_id", "microbatch_id", "layer_no", "direction"), EX, strict=True))
    per = dict(dp_rank=-1, sample_index=-1, token_start=-1, token_end=-1, dataset_id=-1)
    rows = []
    for rank, i, w, m, p in (
        (0, [[0, 2], [1, 3]], [[0.6, 0.4], [0.7, 0.3]], [0, 1, 0, 1], [[1, 2], [121, 122], [21, 22], [131, 132]]),
        (1, [[2, 3], [0, 1]], [[0.8, 0.2], [0.55, 0.45]], [1, 1, 0, 0], [[11, 12], [101, 102], [31, 32], [111, 112]]),
    ):
        at = dict(base, shard_rank=rank, dp_rank=rank, token_start=0, token_end=2, dataset_id=10)
        rows += [tensor(i, "<i8", "int64", act_name="router_topk_expert_ids", **at), tensor(w, act_name="router_topk_weights", **at)]
        rows += [tensor(m, "<i8", "int64", act_name="moe_inverse_map", **{**at, **per}), tensor(p, act_name="moe_packed_weighted_output", **{**at, **per})]
    spark.createDataFrame(rows, RAW_DDL).write.parquet(str(tmp_path / "raw.parquet"))
    ints(spark, status(1, global_batch_id=7)).write.parquet(str(tmp_path / "raw_scalar_int.parquet"))
    topology.write_once(tmp_path / "m.json", manifest())
    args = ["contribution", "--raw", str(tmp_path), "--out", str(tmp_path / "out"), "--manifest", str(tmp_path / "m.json"), "--steps", "1", "--layer", "3"]
    record = tools.main([*args, "--microbatches", "1"])
    assert record["status"] == "passed" and record["valid_token_count"] == 4
    assert (tmp_path / "out/contribution.csv").read_text().splitlines()[1].startswith("3,4,0,")
    with pytest.raises(DataError):
        tools.main([*args, "--microbatches", "2"])
    assert json.loads((tmp_path / "out/validation.json").read_text())["status"] == "failed"


def test_bound_tool(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"messages": [{"role": "system", "content": "s"}, {"role": "system", "content": "t"}]}\n')
    assert tools.main(["bound", str(tmp_path / "*.jsonl")])["max_conversations"] == 2


def test_captures(spark, monkeypatch):
    assert captures.parse_selection(None) == {"router-summary"}
    with pytest.raises(ValueError):
        captures.parse_selection("a,,b")
    names = {c.act_name for c in captures.selected_captures({"loss-summary"})}
    assert names == {"lm_per_sample_loss", "lm_per_sample_loss_token_count", "iteration_attempt_status"}
    with pytest.raises(ValueError):
        captures.selected_captures({"nothing"})
    ranks = spark.createDataFrame([(r, r % 2, r // 4, r // 2 % 2, 0, 0) for r in range(8)], "rank int, tp int, pp int, dp int, ep int, cp int")
    measures = [
        ("whole", "REPLICATED", "EVERY_LAYER", 0, None, False), ("halves", "TP_SHARDED", "EVERY_LAYER", 0, None, False), ("all", "GLOBAL_RANK_SHARDED", "EVERY_LAYER", 0, None, False),
        ("first", "REPLICATED", "NO_LAYER_FIRST_PP", -1, None, False), ("last", "REPLICATED", "NO_LAYER_LAST_PP", -1, None, True), ("set", "DP_SHARDED", "LAYER_SET", 3, [-1], False), ("other", "REPLICATED", "LAYER_SET", 2, [0, -1], False),
    ]
    got = {}
    for r in captures.emitting_ranks(spark.createDataFrame(measures, captures.MEASURES), ranks, 4).collect():
        got.setdefault(r.act_name, set()).add(r["rank"])
    assert got == {"whole": {0, 2, 4, 6}, "halves": set(range(8)), "all": set(range(8)), "first": {0, 2}, "last": {4}, "set": {0, 2, 4, 6}}
    for bad in (("x", "SPREAD", "EVERY_LAYER", 0, None, False), ("x", "REPLICATED", "LAYER_SET", 0, None, False), ("x", "REPLICATED", "EVERY_LAYER", 0, [1], False), ("x", "REPLICATED", "LAYER_SET", 0, [4], False)):
        with pytest.raises(DataError):
            captures.emitting_ranks(spark.createDataFrame([bad], captures.MEASURES), ranks, 4)
    assert captures.replay_settings({"a", "b"}, "a", "b") == {"a": False, "b": True}
    for bad in (("a", "a"), ("c", ""), ("grad-norm", None)):
        with pytest.raises(ValueError):
            captures.replay_settings({"a", "grad-norm"}, *bad)
    assert captures.dataset_modes("auto", {"train": 3})["train"] == "dynamic" and captures.dataset_modes("auto")["test"] == "constant-zero"
    assert captures.dataset_modes("auto", {"valid": 3}, direct_validation=True)["valid"] == "constant-zero" and captures.dataset_modes("train=dynamic", per_sample=False)["train"] == "constant-zero"
    assert captures.dataset_modes("train=dynamic,valid=constant-zero,test=dynamic")["test"] == "dynamic"
    for bad in ("train=dynamic", "train=x,valid=dynamic,test=dynamic", "train=dynamic,train=dynamic,test=dynamic", "", "train,valid,test"):
        with pytest.raises(ValueError):
            captures.dataset_modes(bad)
    assert captures.required_metadata("PER_SAMPLE", False, "SEGMENTED_PACK", True) == {"valid_count", "dataset_id"}
    assert captures.resolve_shape(["s", 3, "actual_token_packed"], {"s": 2}) == (2, 3, -1) and captures.row_bytes((5, 2, 3), 4) == 24
    with pytest.raises(KeyError):
        captures.resolve_shape(["q"], {})
    monkeypatch.setenv("X_SETTING", "7")
    assert captures.setting(None, {}, "x", "X_SETTING", 1, int) == 7 and captures.setting(None, {"x": 3}, "x", "X_SETTING", 1, int) == 3
    assert captures.catalogue_table(spark).count() == 18
