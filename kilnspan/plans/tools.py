"""Command lines: ``python -m kilnspan.plans.tools bound|dump|contribution|control ...``"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import attempts, contribution, reconstruct, segments, topology
from ..operators.loss_slope import Settings
from ..schema import KEY
from ..sources import jsonl, tensors
from ..streaming import controller


def bound(spark: SparkSession, patterns: list[str]) -> dict:
    """Most conversations in a row over files of JSON lines, and where first."""
    lines = jsonl.read_lines(spark, jsonl.input_paths(spark, patterns))
    roles = lines.select("file", "line", F.transform("record.messages", lambda m: m["role"]).alias("roles"))
    return segments.conversation_bound(roles).where("file is null").first().asDict()


def dump(spark: SparkSession, folder: str, tables: list[str], out: str, model_id: str, payloads: bool = False) -> dict:
    """A model's rows of the tables as JSON lines in key order, with a manifest of counts.

    ``payloads``: tensor bytes go to files of their own (a table by SHA-256, equal payloads
    once), and rows name the hash and length instead of holding them as base64.
    """
    counts = {}
    for t in tables:
        rows = spark.read.parquet(f"{folder}/{t}.parquet").where(F.col("model_id") == model_id)
        order = [k for k in KEY if k in rows.columns]
        if payloads and "bytes" in rows.columns:
            held = rows.withColumn("payload_sha256", F.sha2("bytes", 256))
            held.groupBy("payload_sha256").agg(F.first("bytes").alias("bytes")).write.mode("overwrite").parquet(f"{out}/{t}_payloads")
            rows = held.withColumn("payload_bytes", F.octet_length("bytes")).drop("bytes")
        jsonl.export(rows, f"{out}/{t}", order)
        counts[t] = spark.read.text(f"{out}/{t}").count()
    manifest = json.dumps({"model_id": model_id, "rows": counts}, sort_keys=True)
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/dump_manifest")
    return counts


def control(spark: SparkSession, samples: str, out: str, settings: Settings, datasets: list[int], expected_samples: int, deadline_s: float | None, startup_s: float, once: bool) -> dict:
    """Online control over a folder of sample files: iterations in order, decisions and audit tables in ``out``."""
    controller.wait_ready(spark, [samples], startup_s)
    sink = controller.OnlineControl(spark, out, settings)
    stream = spark.readStream.schema(controller.SAMPLE_SCHEMA).parquet(f"{samples}/*")
    done = controller.complete_iterations(stream, expected_samples, datasets, int(deadline_s * 1000) if deadline_s else None)
    writer = done.writeStream.option("checkpointLocation", f"{out}/stream").foreachBatch(sink)
    query = (writer.trigger(availableNow=True) if once else writer).start()
    try:
        query.awaitTermination()
    finally:
        sink.close()
    return {r["run_id"]: r["last_window_id"] for r in sink.standing().collect()}


def contribution_run(spark: SparkSession, folder: str, manifest: str, out: str, steps: int, layers: list[int], microbatches: int) -> dict:
    """Reconstruct a run's executions and write its contribution report and validation."""
    topo = topology.Manifest.from_json(Path(manifest).read_text())
    mine = F.col("model_id") == topo.model_id
    read = lambda t: spark.read.parquet(f"{folder}/{t}.parquet").where(mine)
    accepted = attempts.accepted_attempts(read("raw_scalar_int"))
    shaped = tensors.primary_forward(read("raw"), accepted)
    routes = reconstruct.reconstruct(shaped["ids"], shaped["weights"], shaped["maps"], shaped["packed"], topo)
    tokens = reconstruct.token_table(routes)
    first = tokens.agg(F.min("global_batch_id")).first()[0] or 1
    gaps = contribution.grid_gaps(tokens.select("global_batch_id", "layer_no", "microbatch_id").distinct(), range(first, first + steps), layers, microbatches)
    record = contribution.validation_record(tokens, gaps, topo.model_id)
    contribution.write_report(contribution.contribution_report(tokens), out, record)
    return record


def main(argv: list[str] | None = None) -> dict:
    """Run one tool; prints its summary as JSON."""
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(dest="tool", required=True)
    b = sub.add_parser("bound")
    b.add_argument("patterns", nargs="+")
    d = sub.add_parser("dump")
    for name in ("--raw", "--out", "--model-id"):
        d.add_argument(name, required=True)
    d.add_argument("--table", action="append", required=True)
    d.add_argument("--payloads", action="store_true")
    o = sub.add_parser("control")
    for name in ("--samples", "--out"):
        o.add_argument(name, required=True)
    for name, kind in (("--window-iterations", int), ("--total-windows", int), ("--expected-samples", int), ("--eta", float), ("--uniform-smoothing", float)):
        o.add_argument(name, type=kind, required=True)
    o.add_argument("--dataset", type=int, action="append", required=True)
    o.add_argument("--deadline-s", type=float)
    o.add_argument("--startup-s", type=float, default=60.0)
    o.add_argument("--once", action="store_true", help="take what is there and stop")
    c = sub.add_parser("contribution")
    for name in ("--raw", "--out", "--manifest"):
        c.add_argument(name, required=True)
    c.add_argument("--steps", type=int, required=True)
    c.add_argument("--layer", type=int, action="append", required=True)
    c.add_argument("--microbatches", type=int, required=True)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.tool == "bound":
        out = bound(spark, a.patterns)
    elif a.tool == "dump":
        out = dump(spark, a.raw, a.table, a.out, a.model_id, a.payloads)
    elif a.tool == "control":
        settings = Settings(a.window_iterations, a.total_windows, a.eta, a.uniform_smoothing)
        out = control(spark, a.samples, a.out, settings, a.dataset, a.expected_samples, a.deadline_s, a.startup_s, a.once)
    else:
        out = contribution_run(spark, a.raw, a.manifest, a.out, a.steps, a.layer, a.microbatches)
    print(json.dumps(out, sort_keys=True, default=str))
    return out


if __name__ == "__main__":
    main()
