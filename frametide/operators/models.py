"""Model-backed features as pluggable row functions: a model is a loader that a task runs once, and a kernel over batches.

No weights are part of this engine. Whatever detects, segments or scores is injected, as ``load``; the relational parts (sampling before, tracking
and filtering behind a model) are operators of their own and do not depend on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Model:
    """``load()`` gives ``kernel(row: dict) -> list of tuples`` under ``schema``; it runs once in a task, on the executor."""

    name: str
    load: Callable[[], Callable[[dict], list[tuple]]]
    inputs: tuple[str, ...]
    schema: str
    stub: bool = False


def infer(df: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """The keys of each row with each of the rows that the model gives for it. A row that the model fails on becomes one with a status and nulls, so that one bad frame does not end the job."""
    added = StructType.fromDDL(model.schema)
    kind = StructType([df.schema[k] for k in keys] + StructType.fromDDL("status string").fields + added.fields)
    arrow, width = to_arrow_schema(kind), len(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = None
        for batch in batches:
            kernel = kernel or model.load()
            out = []
            for row in batch.to_pylist():
                head = tuple(row[k] for k in keys)
                try:
                    out += [(*head, "ok", *values) for values in kernel(row)]
                except (ValueError, ArithmeticError) as error:
                    out.append((*head, f"failed: {error}", *[None] * width))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return df.select(*keys, *[c for c in model.inputs if c not in keys]).mapInArrow(run, kind)


def silent_vad(probability: float = 0.05) -> Model:
    """Stand-in for a speech model: one low probability for every window."""
    return Model("silero", lambda: lambda row: [(probability,)], ("samples",), "score double", True)


def threshold_matte(offset: float = 0.0) -> Model:
    """Stand-in for a matting model: pixels above the image's mean (plus an offset) are foreground."""

    def load() -> Callable[[dict], list[tuple]]:
        def kernel(row: dict) -> list[tuple]:
            grey = np.array(row["grey"], dtype=float)
            if not len(grey):
                raise ValueError("empty image")
            return [(np.where(grey > grey.mean() + offset, 255, 0).tolist(),)]

        return kernel

    return Model("modnet", load, ("grey",), "alpha array<int>", True)


def bright_boxes(width: int, least: int) -> Model:
    """Stand-in for a detector: the box around each bright region, scored by its mean level."""

    def load() -> Callable[[dict], list[tuple]]:
        from frametide.operators.images import regions_of

        def kernel(row: dict) -> list[tuple]:
            grid = np.array(row["grey"], dtype=float).reshape(-1, width)
            labels, out = regions_of(grid >= least), []
            for k in range(1, labels.max() + 1):
                ys, xs = np.nonzero(labels == k)
                out.append((k - 1, xs.min() / width, ys.min() / len(grid), (xs.max() - xs.min() + 1) / width, (ys.max() - ys.min() + 1) / len(grid), float(grid[ys, xs].mean() / 255)))
            return out

        return kernel

    return Model("yolox", load, ("grey",), "det int, x double, y double, w double, h double, score double", True)


def untracked(regions: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Detections of a still image as regions: a label, a box and a score, but no track."""
    return regions.where("status = 'ok'").select(*keys, F.lit(label).alias("label"), F.struct("x", "y", "w", "h").alias("box"), "score", F.lit("raw_model").alias("score_type"))


def compatible(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(model, tensor, fault): whether a model's tensors are there with the rank and type that are wanted; a null dimension count or type is not looked at. Both: (model, tensor, rank, dtype)."""
    f = found.select("model", "tensor", F.col("rank").alias("_rank"), F.col("dtype").alias("_dtype"))
    rows = wanted.join(f, ["model", "tensor"], "left")
    fault = F.when(F.col("_dtype").isNull(), "missing").when(F.col("rank") != F.col("_rank"), "rank").when(F.col("dtype") != F.col("_dtype"), "dtype")
    return rows.select("model", "tensor", fault.alias("fault"))


def beat_outcome(enabled: Column, loaded: Column, seconds: Column, most: float, fault: Column) -> Column:
    """Status of the neural beats of a source: not asked for, not there, too long, invalid, or completed."""
    return F.when(~enabled, "not_requested").when(~loaded, "unavailable").when(seconds > most, "limit_exceeded").when(fault.isNotNull(), "failed").otherwise("completed")


def readiness(models: DataFrame, stub_allowed: bool) -> DataFrame:
    """(ready, blockers) of a runtime: every required model must be loaded, and none may be a stub unless stubs are allowed. ``models``: (name, required, loaded, stub)."""
    bad = F.when(F.col("required") & ~F.col("loaded"), F.concat(F.lit("not loaded: "), "name")).when(F.col("loaded") & F.col("stub") & F.lit(not stub_allowed), F.concat(F.lit("stub: "), "name"))
    return models.agg(F.sort_array(F.collect_list(bad)).alias("blockers")).select((F.size("blockers") == 0).alias("ready"), "blockers")
