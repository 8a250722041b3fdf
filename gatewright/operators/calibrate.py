"""Temperature scaling: the loss over a grid of temperatures, and the fit."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S

LOW, HIGH, STEPS = 0.05, 10.0, 200


def grid(low: float = LOW, high: float = HIGH, steps: int = STEPS) -> list[float]:
    """Temperatures evenly spaced in their logarithm."""
    if not 0 < low < high or steps < 2:
        raise ValueError("the grid needs 0 < low < high and two steps at least")
    a, b = math.log(low), math.log(high)
    return [math.exp(a + (b - a) * i / (steps - 1)) for i in range(steps)]


def check_examples(scored: DataFrame) -> None:
    """Every calibration case must have a gold label among its candidates."""
    bad = scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gold").isNull() | S.probability_of("scores", "gold").isNull()).alias("bad")).first()
    if not bad["n"] or bad["bad"]:
        raise ValueError(f"{bad['n']} calibration cases, {bad['bad']} without a usable gold label")


def _sums(temperatures: np.ndarray):
    """For each batch, the summed loss at each temperature; the loss of a case is capped by the floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(len(temperatures)), 0
        cap = -math.log(S.FLOOR)
        for b in batches:
            keep = b.filter(pa.compute.and_(pa.compute.is_valid(b.column(1)), pa.compute.is_valid(b.column(0))))
            lists = keep.column(0)
            sizes = pa.compute.list_value_length(lists).to_numpy()
            for k in np.unique(sizes):
                at = np.flatnonzero(sizes == k)
                part = lists.take(pa.array(at))
                logits = np.log(np.maximum(part.flatten().to_numpy(zero_copy_only=False).reshape(-1, k), S.FLOOR))
                gold = np.log(np.maximum(keep.column(1).take(pa.array(at)).to_numpy(zero_copy_only=False), S.FLOOR))
                top = logits.max(1, keepdims=True)
                for i, t in enumerate(temperatures):
                    loss = np.log(np.exp((logits - top) / t).sum(1)) - (gold - top[:, 0]) / t
                    total[i] += np.minimum(loss, cap).sum()
                count += len(at)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(temperatures), dtype=np.int64)), pa.array(total), pa.array(np.full(len(temperatures), count, np.int64))], names=["step", "loss", "n"])

    return run


def nll_curve(scored: DataFrame, temperatures: list[float] | None = None) -> DataFrame:
    """(step, temperature, nll): mean multiclass loss of the gold labels at each temperature.

    A task sums the losses of its rows for all temperatures at once, so what is shuffled is one
    row for each temperature and task, and rows are never multiplied by the grid.
    """
    ts = grid() if temperatures is None else [float(t) for t in temperatures]
    if any(not t > 0 for t in ts):
        raise ValueError("temperatures must be positive")
    rows = scored.select(F.transform("scores", lambda s: s["probability"]).alias("p"), S.probability_of("scores", "gold").alias("g"))
    sums = rows.mapInArrow(_sums(np.array(ts)), "step long, loss double, n long")
    named = F.element_at(F.array(*map(F.lit, ts)), (F.col("step") + 1).cast("int"))
    return sums.groupBy("step").agg((F.sum("loss") / F.sum("n")).alias("nll")).select("step", named.alias("temperature"), "nll")


def fit_temperature(scored: DataFrame, low: float = LOW, high: float = HIGH, steps: int = STEPS) -> DataFrame:
    """(temperature, nll_before, nll_after): the first grid point of least loss; before is T = 1."""
    curve = nll_curve(scored, [*grid(low, high, steps), 1.0])
    before = curve.where(F.col("step") == steps).select(F.col("nll").alias("nll_before"))
    best = curve.where(F.col("step") < steps).orderBy(F.round("nll", 12), "step").limit(1)
    return best.select("temperature", F.col("nll").alias("nll_after")).crossJoin(F.broadcast(before)).select("temperature", "nll_before", "nll_after")


def calibrated(scored: DataFrame, temperature: float) -> DataFrame:
    """The same cases with scaled scores; everything else is kept."""
    return scored.withColumn("scores", S.temperature_scaled("scores", temperature))
