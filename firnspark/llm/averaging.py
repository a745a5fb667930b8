"""Averages of what tasks make of one model, each by steps over its own rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A model's numbers lie in lines of ``WIDE``; ``PART`` lines of all tasks meet in one.
WIDE, PART = 16, 1024
#: Rows of a task in a pass, and the most tasks; each has the whole model.
ROWS, TASKS = 2000, 256
MOVES = "model int, part int, block int, lines binary, weights binary, change binary"


def blocks(rows: int) -> int:
    """Into how many tasks ``rows`` rows are dealt, whatever the cluster."""
    return max(1, min(TASKS, -(-rows // ROWS)))


def flat(arrays: list[np.ndarray]) -> np.ndarray:
    """All numbers in lines of ``WIDE``; each array begins a line."""
    return np.concatenate([np.pad(a.astype(np.float32).ravel(), (0, -a.size % WIDE)) for a in arrays]).reshape(-1, WIDE)


def shaped(lines: np.ndarray, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    """Copies of the arrays, with these shapes, of which ``flat`` has made ``lines``."""
    out, at = [], 0
    for shape in shapes:
        n = math.prod(shape)
        out.append(lines[at : at - (-n // WIDE)].ravel()[:n].reshape(shape).astype(np.float32))
        at -= -n // WIDE
    return out


def moves(model: int, block: int, change: np.ndarray, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How far a task's rows have moved the lines of a model; those without a weight have not been touched."""
    for part in range(-(-len(change) // PART)):
        lines = np.flatnonzero(weights[part * PART : (part + 1) * PART]) + part * PART
        if len(lines):
            data = [lines.astype(np.int32), weights[lines].astype(np.float32), change[lines].astype(np.float32)]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([x], pa.int32()) for x in (model, part, block)), *(pa.array([x.tobytes()], pa.binary()) for x in data)],
                names=["model", "part", "block", "lines", "weights", "change"],
            )


def _mean(table: pa.Table) -> pa.Table:
    """Mean by weight of each line, added up in the order of the blocks."""
    part = table["part"][0].as_py()
    total, weight = np.zeros((PART, WIDE)), np.zeros(PART)
    for row in table.sort_by("block").to_pylist():
        at = np.frombuffer(row["lines"], np.int32) - part * PART
        w = np.frombuffer(row["weights"], np.float32).astype(float)
        total[at] += np.frombuffer(row["change"], np.float32).reshape(-1, WIDE) * w[:, None]
        weight[at] += w
    at = np.flatnonzero(weight)
    data = [(at + part * PART).astype(np.int32), (total[at] / weight[at, None]).astype(np.float32)]
    return pa.table([table["model"][:1], *(pa.array([x.tobytes()], pa.binary()) for x in data)], names=["model", "lines", "change"])


def move(models: list[np.ndarray], made: DataFrame) -> None:
    """Move each model's lines by the means of what tasks have ``made`` of them. A model has a fixed size, and so has what reaches the driver."""
    got = made.groupBy("model", "part").applyInArrow(_mean, "model int, lines binary, change binary").collect()
    for r in got:
        models[r.model][np.frombuffer(bytes(r.lines), np.int32)] += np.frombuffer(bytes(r.change), np.float32).reshape(-1, WIDE)
