"""Linear models trained by passes over the rows: SGD, perceptron, passive-aggressive.

Rows are dealt by a hash of their id into a fixed number of shards and ordered
by another hash inside them, so neither partitions nor cores change a model.
In an epoch every shard makes one pass in mini-batches from the shared weights;
the shards' results are averaged, weighted by row count, in Spark.  The model is
the average over the epochs since the loss last improved clearly.  The driver
holds one weight vector.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonelens.functions.arrays import matrix
from clonelens.models.base import Linear

# The learners' default settings.
SGD_ALPHA = 1e-4
PA_STEP_BOUND = 1.0
PERCEPTRON_RATE = 1.0
MAX_EPOCHS = 1000
TOLERANCE = 1e-3
PATIENCE = 5  # epochs without a better loss before training ends
SHARDS = 16
BATCH = 32


def _sgd_rate(step: float) -> float:
    """The 'optimal' schedule for the hinge loss: 1 / (alpha * (t0 + t))."""
    first = np.sqrt(1.0 / np.sqrt(SGD_ALPHA))
    return 1.0 / (SGD_ALPHA * (1.0 / (first * SGD_ALPHA) + step))


def one_step(kind: str, z: np.ndarray, sign: np.ndarray, w: np.ndarray, step: float) -> tuple[np.ndarray, float]:
    """(weights, loss) after one mini-batch; ``z`` has a leading one for the bias, labels are +1 and -1."""
    margin = sign * (z @ w)
    if kind == "perceptron":
        loss, missed = np.maximum(0.0, -margin).sum(), margin <= 0.0
        return w + PERCEPTRON_RATE * ((sign * missed) @ z) / len(z), float(loss)
    lack = np.maximum(0.0, 1.0 - margin)
    if kind == "sgd":
        rate = _sgd_rate(step)
        shrunk = w * np.concatenate([[1.0], np.full(len(w) - 1, max(0.0, 1.0 - rate * SGD_ALPHA))])
        return shrunk + rate * ((sign * (lack > 0.0)) @ z) / len(z), float(lack.sum())
    size = np.minimum(PA_STEP_BOUND, lack / (z * z).sum(axis=1))  # passive-aggressive
    return w + ((sign * size) @ z) / len(z), float(lack.sum())


@dataclass
class Online:
    """``kind`` is 'sgd', 'perceptron' or 'passive_aggressive'."""

    kind: str
    max_epochs: int = MAX_EPOCHS
    tolerance: float = TOLERANCE
    seed: int = 42

    def fit(self, train: DataFrame) -> Linear:
        size = train.select(F.size("x")).first()[0]
        shard = F.pmod(F.xxhash64(F.lit(self.seed), "row_id"), F.lit(SHARDS)).cast("int")
        rows = train.select(shard.alias("shard"), F.xxhash64(F.lit(self.seed + 1), "row_id").alias("at"), "row_id", "x", "label")
        # kept sorted between the epochs; a lost executor's part is dealt anew from ``train``
        rows = rows.repartition("shard").sortWithinPartitions("shard", "at", "row_id").drop("at", "row_id")
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._train(rows, size)
        finally:
            rows.unpersist()

    def _train(self, rows: DataFrame, size: int) -> Linear:
        weights, best, stale, done = np.zeros(size + 1), np.inf, 0, 0.0
        total, epochs = np.zeros(size + 1), 0
        for _ in range(self.max_epochs):
            weights, loss, seen = self._epoch(rows, weights, done)
            done += seen / SHARDS / BATCH
            if loss > best - self.tolerance:
                stale += 1
            else:
                stale, total, epochs = 0, np.zeros(size + 1), 0
            total, epochs = total + weights, epochs + 1
            best = min(best, loss)
            if stale >= PATIENCE:
                break
        else:
            warnings.warn(f"{self.kind}: the loss still fell after {self.max_epochs} epochs", stacklevel=2)
        mean = total / max(epochs, 1)
        return Linear(list(mean[1:]), float(mean[0]))

    def _epoch(self, rows: DataFrame, start: np.ndarray, done: float) -> tuple[np.ndarray, float, int]:
        """(weights, mean loss, rows) after one pass; ``done`` mini-batches came before."""
        kind = self.kind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, w, step, lost, seen = None, start, done, 0.0, 0
            waiting: list[tuple[np.ndarray, np.ndarray]] = []

            def learn(x: np.ndarray, y: np.ndarray) -> None:
                nonlocal w, step, lost, seen
                w, loss = one_step(kind, np.column_stack([np.ones(len(x)), x]), y, w, step)
                step, lost, seen = step + 1.0, lost + loss, seen + len(x)

            def flush(all_of_it: bool) -> None:
                """Learn from whole mini-batches; their limits do not depend on the incoming batches."""
                if not waiting:
                    return
                x, y = (np.concatenate(c) for c in zip(*waiting))
                waiting.clear()
                whole = len(x) if all_of_it else len(x) // BATCH * BATCH
                for at in range(0, whole, BATCH):
                    learn(x[at : min(at + BATCH, whole)], y[at : min(at + BATCH, whole)])
                if whole < len(x):
                    waiting.append((x[whole:], y[whole:]))

            def result() -> pa.RecordBatch:
                numbers = np.concatenate([w * seen, [lost, seen]])
                return pa.RecordBatch.from_arrays([pa.array(np.arange(len(numbers)), pa.int32()), pa.array(numbers)], names=["at", "v"])

            for batch in batches:
                if not batch.num_rows:
                    continue
                x, shards = matrix(batch.column("x")), batch.column("shard").to_numpy()
                y = np.where(batch.column("label").to_numpy() == 1, 1.0, -1.0)
                cuts = np.flatnonzero(shards[1:] != shards[:-1]) + 1
                for at, to in zip([0, *cuts], [*cuts, len(shards)]):
                    if shards[at] != shard:
                        if shard is not None:
                            flush(True)
                            yield result()
                        shard, w, step, lost, seen = shards[at], start, done, 0.0, 0
                    waiting.append((x[at:to], y[at:to]))
                    flush(False)
            if shard is not None:
                flush(True)
                yield result()

        # at most one vector per shard; summed in the order of the values, so that reruns agree
        parts = rows.mapInArrow(run, "at int, v double").groupBy("at").agg(F.array_sort(F.collect_list("v")).alias("v"))
        sums = np.zeros(len(start) + 2)
        for row in parts.collect():
            sums[row["at"]] = sum(row["v"])
        seen = max(sums[-1], 1.0)
        return sums[:-2] / seen, float(sums[-2] / seen), int(sums[-1])
