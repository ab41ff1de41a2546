"""Training of Spark ML's multilayer perceptron with the passes over the rows in numpy.

The network is that of ``pyspark.ml`` (sigmoid layers, softmax with cross entropy, its
layout of the weights, its initial weights), and so is the method, L-BFGS over all rows.
Spark partitions the rows; a task folds its blocks into one loss and gradient with matrix
products, where Spark ML's own trainer calls a function for each number.  The driver holds
weights, one gradient for each task and ``MEMORY`` pairs of both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

MEMORY = 10
TOLERANCE = 1e-6
SLICE = 2048  # rows whose layers stay in a core's cache
SUFFICIENT, CURVATURE, TRIALS = 1e-4, 0.9, 20


def row_blocks(inputs: DataFrame) -> DataFrame:
    """The rows of ``inputs`` (features, label) as cached blocks of 32-bit floats, one for each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(i) for i in range(2))
            if len(y):
                numbers = x.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([numbers.tobytes()], pa.binary()), pa.array([y.to_numpy().astype(np.int32).tobytes()], pa.binary())], names=["x", "y"]
                )

    rows = inputs.select(vector_to_array("features", "float32").alias("x"), F.col("label").cast("int").alias("y"))
    return rows.mapInArrow(run, "x binary, y binary").persist(StorageLevel.MEMORY_AND_DISK)


def loss_and_gradient(blocks: DataFrame, layers: list[int], weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean cross entropy over all rows and its gradient, in one pass."""
    at, places = 0, []
    for n_in, n_out in zip(layers, layers[1:]):
        places.append((at, at + n_in * n_out, at + n_in * n_out + n_out, n_in, n_out))
        at = places[-1][2]
    size = SLICE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = weights.astype(np.float32)
        nets = [(small[a:b].reshape(n, m), small[b:c]) for a, b, c, n, m in places]
        gradient, loss, rows = np.zeros(len(weights)), 0.0, 0
        for batch in batches:
            for x_bytes, y_bytes in zip(batch.column(0), batch.column(1)):
                labels = np.frombuffer(y_bytes.as_buffer(), np.int32)
                data = np.frombuffer(x_bytes.as_buffer(), np.float32).reshape(len(labels), -1)
                for begin in range(0, len(labels), size):
                    x, y = data[begin : begin + size], labels[begin : begin + size]
                    outs = [x]
                    for w, b in nets[:-1]:
                        z = outs[-1] @ w
                        z += b
                        np.negative(z, out=z)
                        with np.errstate(over="ignore"):  # an infinite exponential is a sigmoid of zero
                            np.exp(z, out=z)
                        z += np.float32(1)
                        np.reciprocal(z, out=z)
                        outs.append(z)
                    z = np.ascontiguousarray((outs[-1] @ nets[-1][0] + nets[-1][1]).T)  # one row for each class
                    z -= z.max(axis=0)
                    places_of_y = y, np.arange(len(y))
                    loss -= float(z[places_of_y].sum(dtype=np.float64))
                    np.exp(z, out=z)
                    total = z.sum(axis=0)
                    loss += float(np.log(total).sum(dtype=np.float64))
                    z /= total
                    z[places_of_y] -= np.float32(1)
                    z = np.ascontiguousarray(z.T)
                    ones = np.ones(len(y), dtype=np.float32)
                    for k in range(len(nets) - 1, -1, -1):
                        a, b, c, _, _ = places[k]
                        gradient[a:b] += (outs[k].T @ z).ravel()
                        gradient[b:c] += ones @ z
                        if k:
                            z = z @ nets[k][0].T
                            z *= outs[k]
                            z *= np.float32(1) - outs[k]
                    rows += len(y)
        yield pa.RecordBatch.from_arrays([pa.array([np.append(gradient, [loss, rows]).tobytes()], pa.binary())], names=["part"])

    parts = [np.frombuffer(r[0]) for r in blocks.mapInArrow(run, "part binary").collect()]
    total = np.sum(parts, axis=0) if parts else np.zeros(len(weights) + 2)
    rows = max(total[-1], 1.0)
    return total[-2] / rows, total[:-2] / rows


def direction(gradient: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The two loops of L-BFGS over the last steps and changes of the gradient."""
    q, factors = gradient.copy(), []
    for s, y in reversed(pairs):
        factors.append(s @ q / (s @ y))
        q -= factors[-1] * y
    if pairs:
        s, y = pairs[-1]
        q *= s @ y / (y @ y)
    for (s, y), factor in zip(pairs, reversed(factors)):
        q += (factor - y @ q / (s @ y)) * s
    return -q


def minimise(cost: Callable[[np.ndarray], tuple[float, np.ndarray]], weights: np.ndarray, rounds: int) -> np.ndarray:
    """``rounds`` steps of L-BFGS, fewer where the cost no longer falls; steps meet the weak Wolfe conditions."""
    value, gradient = cost(weights)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way = direction(gradient, pairs)
        slope = float(way @ gradient)
        if slope >= 0:  # no longer a descent
            break
        step = 1.0 if pairs else 1.0 / max(float(np.linalg.norm(gradient)), 1e-12)
        low, high, found = 0.0, np.inf, None
        for _ in range(TRIALS):
            tried = weights + step * way
            new_value, new_gradient = cost(tried)
            if not new_value <= value + SUFFICIENT * step * slope:
                high = step
            else:
                found = tried, new_value, new_gradient
                if float(new_gradient @ way) >= CURVATURE * slope:
                    break
                low = step
            step = 2 * low if high == np.inf else (low + high) / 2
        if found is None:
            break
        s, y = found[0] - weights, found[2] - gradient
        if s @ y > 0:
            pairs = [*pairs, (s, y)][-MEMORY:]
        gained = value - found[1]
        weights, value, gradient = found
        if gained <= TOLERANCE * max(abs(value), TOLERANCE):
            break
    return weights
