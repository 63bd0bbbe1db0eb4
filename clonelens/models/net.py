"""A small neural net trained by full-batch Adam.

Each epoch is one pass: tasks add up the gradient of their rows, Spark adds the
tasks' sums, the driver moves the weights.  Dropout masks come from a hash of the
row id, unit and epoch, so neither partitions nor reruns change the model beyond
the rounding of sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonelens.functions.arrays import ROWS, added_up, matrix, row_sums
from clonelens.models.base import score_table

# The net's form and Adam's default settings.
HIDDEN = (128, 64)
DROPOUT = 0.5
EPOCHS = 50
STEP = 1024  # rows a task handles at once
RATE, BETAS, EPSILON = 1e-3, (0.9, 0.999), 1e-8


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of every number (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _kept(ids: np.ndarray, width: int, salt: int) -> np.ndarray:
    """(rows, width): 0 for dropped units, 1 / (1 - DROPOUT) for the others."""
    unit = _mixed(np.arange(1, width + 1, dtype=np.uint64) + np.uint64(salt << 20))
    drawn = _mixed(ids.view(np.uint64)[:, None] ^ unit[None, :]) >> np.uint64(11)
    return (drawn >= np.uint64(int(DROPOUT * (1 << 53)))) / (1.0 - DROPOUT)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of at most ``STEP`` rows, so that masks and layers stay small however large an Arrow batch is."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            yield batch.slice(at, STEP)


@dataclass
class Layers:
    """Weight matrices with the bias as their last row."""

    weights: list[np.ndarray]

    @classmethod
    def drawn(cls, size: int, seed: int) -> Layers:
        rng = np.random.default_rng(seed)
        sizes = [size, *HIDDEN, 2]
        return cls([rng.uniform(-1, 1, (a + 1, b)) / np.sqrt(a) for a, b in zip(sizes, sizes[1:])])

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights])

    def like(self, flat: np.ndarray) -> Layers:
        cuts = np.cumsum([w.size for w in self.weights])[:-1]
        return Layers([part.reshape(w.shape) for part, w in zip(np.split(flat, cuts), self.weights)])

    def forward(self, x: np.ndarray, masks: list[np.ndarray] | None = None) -> tuple[list[np.ndarray], np.ndarray]:
        """(inputs of the layers, probability of each class)."""
        inputs, at = [], x
        for i, w in enumerate(self.weights):
            inputs.append(at)
            at = at @ w[:-1] + w[-1]
            if i < len(HIDDEN):
                at = np.maximum(at, 0.0)
                at = at * masks[i] if masks else at
        at = np.exp(at - at.max(axis=1, keepdims=True))
        return inputs, at / at.sum(axis=1, keepdims=True)

    def gradient(self, x: np.ndarray, label: np.ndarray, masks: list[np.ndarray] | None) -> np.ndarray:
        """Summed gradient of the cross entropy, flat."""
        inputs, share = self.forward(x, masks)
        back = share
        back[np.arange(len(label)), label] -= 1.0
        out = []
        for i in reversed(range(len(self.weights))):
            out.append(np.vstack([inputs[i].T @ back, back.sum(axis=0)]))
            if i:
                back = back @ self.weights[i][:-1].T * (inputs[i] > 0.0)
                back = back * masks[i - 1] if masks else back
        return np.concatenate([g.ravel() for g in reversed(out)])


@dataclass
class SmallNet:
    """Two hidden layers with ReLU and dropout, softmax and cross entropy."""

    epochs: int = EPOCHS
    seed: int = 42

    def fit(self, train: DataFrame) -> FittedNet:
        size = train.select(F.size("x")).first()[0]
        rows = train.select(F.xxhash64("row_id").alias("at"), "x", "label")
        n = rows.count()
        layers = Layers.drawn(size, self.seed)
        flat = layers.flat()
        first, second = np.zeros_like(flat), np.zeros_like(flat)
        for epoch in range(1, self.epochs + 1):
            slope = self._gradient(rows, layers.like(flat), epoch) / n
            first = BETAS[0] * first + (1 - BETAS[0]) * slope
            second = BETAS[1] * second + (1 - BETAS[1]) * slope**2
            step = first / (1 - BETAS[0] ** epoch) / (np.sqrt(second / (1 - BETAS[1] ** epoch)) + EPSILON)
            flat = flat - RATE * step
        return FittedNet(layers.like(flat))

    def _gradient(self, rows: DataFrame, layers: Layers, epoch: int) -> np.ndarray:
        seed, size = self.seed, layers.flat().size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in _steps(batches):
                ids = batch.column("at").to_numpy()
                masks = [_kept(ids, width, seed + epoch * 8 + i) for i, width in enumerate(HIDDEN)]
                total += layers.gradient(matrix(batch.column("x")), (batch.column("label").to_numpy() == 1).astype(int), masks)
            yield row_sums(total[None, :])

        return added_up(rows.mapInArrow(run, ROWS), 1, size)[0]


@dataclass
class FittedNet:
    layers: Layers

    def score(self, rows: DataFrame) -> DataFrame:
        layers = self.layers

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _steps(batches):
                share = layers.forward(matrix(batch.column("x")))[1][:, 1]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(share)], names=["row_id", "label", "__s"])

        scored = rows.select("row_id", "label", "x").mapInArrow(run, "row_id bigint, label bigint, __s double")
        return score_table(scored, F.col("__s"), F.col("__s") > 0.5)
