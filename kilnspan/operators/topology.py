"""Parallel topology: assembling, checking and storing the manifest, and its lookup tables."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUPS = ("tp_groups", "pp_groups", "cp_groups", "dp_groups", "ep_groups", "etp_groups", "expert_dp_groups", "dispatch_groups")


class TopologyError(ValueError):
    """Ranks do not form one consistent topology."""


def partition(groups: Sequence[Sequence[int]], name: str, ranks: set[int] | None = None) -> tuple[tuple[int, ...], ...]:
    """Distinct groups in order; every rank once, all groups of one size, all ranks covered."""
    out = tuple(sorted({tuple(map(int, g)) for g in groups}))
    members = [r for g in out for r in g]
    if not members or any(not g for g in out):
        raise TopologyError(f"{name}: empty group")
    if len(set(members)) != len(members):
        raise TopologyError(f"{name}: a rank occurs twice")
    if len({len(g) for g in out}) != 1:
        raise TopologyError(f"{name}: group sizes differ")
    if ranks is not None and set(members) != ranks:
        raise TopologyError(f"{name}: does not cover the ranks")
    return out


@dataclass(frozen=True)
class Manifest:
    """One run's topology; small, so it lives on the driver and is broadcast as lookup tables."""

    model_id: str
    tp_groups: tuple
    pp_groups: tuple
    cp_groups: tuple
    dp_groups: tuple
    ep_groups: tuple
    etp_groups: tuple
    expert_dp_groups: tuple
    dispatch_groups: tuple
    layer_stage: Mapping[int, int]
    local_experts: tuple
    top_k: int
    sequence_parallel: bool = False
    dispatcher_type: str = "alltoall"
    permutation_mode: str = "non_fused"
    dropless: bool = True
    padded: bool = False
    extra: Mapping = field(default_factory=dict)

    def __post_init__(self) -> None:
        ranks = {r for g in self.tp_groups for r in g}
        for name in GROUPS:
            object.__setattr__(self, name, partition(getattr(self, name), name, ranks))
        experts = sorted(e for order in self.local_experts for e in order)
        if experts != list(range(len(experts))) or len(self.local_experts) != len(self.ep_groups[0]):
            raise TopologyError("local experts do not partition the experts over the EP ranks")
        object.__setattr__(self, "local_experts", tuple(tuple(o) for o in self.local_experts))
        object.__setattr__(self, "layer_stage", {int(k): int(v) for k, v in self.layer_stage.items()})

    def to_json(self) -> str:
        """Canonical text: sorted keys."""
        return json.dumps(asdict(self), sort_keys=True, indent=1)

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        return cls(**json.loads(text))

    def require_supported(self) -> None:
        """Reconstruction needs CP 1, all-to-all dispatch, unfused permutation, dropless and unpadded routing."""
        if len(self.cp_groups[0]) != 1 or self.dispatcher_type != "alltoall" or self.permutation_mode != "non_fused" or not self.dropless or self.padded:
            raise TopologyError("unsupported topology for reconstruction")

    def rank_table(self, spark: SparkSession) -> DataFrame:
        """One row per rank: its place in each kind of group, and its stage."""
        place = {name: {r: (g, i) for g, group in enumerate(getattr(self, name)) for i, r in enumerate(group)} for name in GROUPS}
        rows = []
        for r in sorted(place["tp_groups"]):
            rows.append((r, *[x for name in GROUPS for x in place[name][r]], len(self.tp_groups[0])))
        columns = "rank int, " + ", ".join(f"{n[:-7]}_group int, {n[:-7]}_rank int" for n in GROUPS) + ", tp_size int"
        return spark.createDataFrame(rows, columns)

    def expert_table(self, spark: SparkSession) -> DataFrame:
        """One row per expert: its EP rank and local position."""
        return spark.createDataFrame([(e, r, i) for r, order in enumerate(self.local_experts) for i, e in enumerate(order)], "expert_id int, dest_ep_rank int, expert_pos int")

    def layer_table(self, spark: SparkSession) -> DataFrame:
        """One row per layer: its pipeline stage."""
        return spark.createDataFrame(sorted(self.layer_stage.items()), "layer_no int, pp_stage int")


def assemble(fragments: Sequence[Mapping]) -> Manifest:
    """One manifest from each rank's view: its groups, layers, expert order and common settings."""
    if not fragments:
        raise TopologyError("no fragments")
    ranks = [int(f["global_rank"]) for f in fragments]
    if len(set(ranks)) != len(ranks):
        raise TopologyError("two fragments of one rank")

    def common(name: str):
        values = {json.dumps(f[name]) for f in fragments if name in f}
        if len(values) != 1:
            raise TopologyError(f"ranks disagree on {name}")
        return json.loads(values.pop())

    groups = {name: partition([f[name[:-1]] for f in fragments], name, set(ranks)) for name in GROUPS}
    stages: dict[int, int] = {}
    orders: dict[int, tuple] = {}
    for f in fragments:
        stage = list(f["pp_group"]).index(f["global_rank"])
        for layer in f["layers"]:
            if stages.setdefault(int(layer), stage) != stage:
                raise TopologyError(f"ranks disagree on layer {layer}")
        ep = list(f["ep_group"]).index(f["global_rank"])
        if f.get("local_experts") is not None and orders.setdefault(ep, tuple(f["local_experts"])) != tuple(f["local_experts"]):
            raise TopologyError(f"ranks disagree on the experts of EP rank {ep}")
    if set(orders) != set(range(len(groups["ep_groups"][0]))):
        raise TopologyError("an EP rank's experts are unknown")
    settings = {n: common(n) for n in ("model_id", "top_k", "sequence_parallel", "dispatcher_type", "permutation_mode", "dropless", "padded") if any(n in f for f in fragments)}
    return Manifest(**groups, layer_stage=stages, local_experts=tuple(orders[i] for i in range(len(orders))), **settings)


def write_once(path: str | Path, manifest: Manifest) -> None:
    """Store a manifest in one step; the same content again is fine, other content is an error."""
    path, text = Path(path), manifest.to_json()
    if path.exists():
        if path.read_text() != text:
            raise TopologyError(f"{path} holds another manifest")
        return
    fd, temporary = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(fd, "w") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, path)


def grid_coordinates(rank: Column, sizes: Mapping[str, int]) -> list[Column]:
    """A rank's coordinate in each dimension of a grid, the first dimension varying fastest."""
    out, stride = [], 1
    for name, size in sizes.items():
        out.append((F.floor(rank / stride) % size).cast("int").alias(name))
        stride *= size
    return out
