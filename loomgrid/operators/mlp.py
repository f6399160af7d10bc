"""A multilayer perceptron trained by mini-batch gradient descent on encoded batches.

`Mlp` holds the weights on the driver and computes with any batch that offers `times` and `transposed_times`. The
relational functions express the same steps on cells, for plans and checks. Order of a training step: errors at the
output, then for each layer from the last its weights are updated first, and errors pass through the updated
weights. Steps divide by the batch's own number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import sigmoid
from .codecs import Dense, codec
from .linalg import matmul


class Mlp:
    """Layers of weights (m x n) and offsets (n). Hidden layers are sigmoid; the last is softmax if it has several outputs
    and is not the first."""

    def __init__(self, sizes: list[int], rate: float, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.rate = rate
        self.weights = [rng.standard_normal((a, b)) for a, b in zip(sizes, sizes[1:])]
        self.offsets = [rng.standard_normal(b) for b in sizes[1:]]

    @property
    def outputs(self) -> int:
        return self.weights[-1].shape[1]

    def forward(self, batch: object) -> list[np.ndarray]:
        """The outputs of every layer."""
        out: list[np.ndarray] = []
        for i, (w, b) in enumerate(zip(self.weights, self.offsets)):
            z = (batch.times(w) if i == 0 else out[-1] @ w) + b
            if i == len(self.weights) - 1 and i > 0 and self.outputs > 1:
                e = np.exp(z - z.max(axis=1, keepdims=True))
                out.append(e / e.sum(axis=1, keepdims=True))
            else:
                out.append(1 / (1 + np.exp(-z)))
        return out

    def errors(self, predicted: np.ndarray, labels: np.ndarray) -> np.ndarray:
        target = labels[:, None] if self.outputs == 1 else labels[:, None] == np.arange(self.outputs)
        return predicted - target

    def step(self, batch: object, labels: np.ndarray) -> None:
        if not len(labels):
            return
        out = self.forward(batch)
        err = self.errors(out[-1], labels)
        rate = self.rate / len(labels)
        for i in reversed(range(len(self.weights))):
            gradient = batch.transposed_times(err) if i == 0 else out[i - 1].T @ err
            self.weights[i] = self.weights[i] - rate * gradient
            self.offsets[i] = self.offsets[i] - rate * err.sum(axis=0)
            if i > 0:
                err = (err @ self.weights[i].T) * out[i - 1] * (1 - out[i - 1])

    def loss(self, batch: object, labels: np.ndarray) -> float:
        """Half the squared error, per row and output."""
        err = self.errors(self.forward(batch)[-1], labels)
        return float((0.5 * err**2).sum() / len(labels) / self.outputs)

    def accuracy(self, batch: object, labels: np.ndarray) -> float:
        """The share of right answers; of equal outputs the first counts, a single output of exactly one half is wrong."""
        p = self.forward(batch)[-1]
        if self.outputs == 1:
            return float(np.mean(((p[:, 0] > 0.5) & (labels == 1)) | ((p[:, 0] < 0.5) & (labels == 0))))
        return float(np.mean(p.argmax(axis=1) == labels))


def gradients(batches: DataFrame, name: str, model: Mlp) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """One gradient over many batches at once, for batches larger than a machine: partial sums are made where the batches
    are and added by Spark, a row for each weight. Errors pass through the weights as they were."""
    sent = batches.sparkSession.sparkContext.broadcast(model)
    cls = codec(name)

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total, rows = sent.value, None, 0
        for b in it:
            for payload, labels in zip(b.column("payload").to_pylist(), b.column("labels").to_pylist()):
                x, y = cls.read(payload), np.array(labels)
                out = m.forward(x)
                err = m.errors(out[-1], y)
                parts = []
                for i in reversed(range(len(m.weights))):
                    g = x.transposed_times(err) if i == 0 else out[i - 1].T @ err
                    parts.append(np.concatenate([g.reshape(-1), err.sum(axis=0)]))
                    if i > 0:
                        err = (err @ m.weights[i].T) * out[i - 1] * (1 - out[i - 1])
                flat = np.concatenate(parts[::-1])
                total = flat if total is None else total + flat
                rows += len(y)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total) + 1)), pa.array(np.append(total, rows))], ["i", "g"])

    sums = batches.select("payload", "labels").mapInArrow(part, "i long, g double").groupBy("i").agg(F.sum("g").alias("g"))
    flat = sums.orderBy("i").toPandas()["g"].to_numpy()  # as many rows as the model has weights
    rows, at, dw, db = int(flat[-1]), 0, [], []
    for w in model.weights:
        dw.append(flat[at : at + w.size].reshape(w.shape))
        db.append(flat[at + w.size : at + w.size + w.shape[1]])
        at += w.size + w.shape[1]
    return dw, db, rows


def evaluate(batches: DataFrame, name: str, models: list[Mlp]) -> list[tuple[float, float]]:
    """Loss and accuracy of each model over all rows of the batches; partial sums are made where the batches are."""
    sent = batches.sparkSession.sparkContext.broadcast(models)
    cls = codec(name)

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, right, rows = np.zeros(len(sent.value)), np.zeros(len(sent.value), np.int64), 0
        for b in it:
            for payload, labels in zip(b.column("payload").to_pylist(), b.column("labels").to_pylist()):
                x, y = cls.read(payload), np.array(labels)
                if len(y):
                    loss += [m.loss(x, y) * len(y) for m in sent.value]
                    right += [round(m.accuracy(x, y) * len(y)) for m in sent.value]
                    rows += len(y)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(loss))), pa.array(loss), pa.array(right), pa.array(np.full(len(loss), rows))], ["i", "loss", "right", "n"])

    sums = batches.select("payload", "labels").mapInArrow(part, "i long, loss double, right long, n long").groupBy("i").agg((F.sum("loss") / F.sum("n")).alias("loss"), (F.sum("right") / F.sum("n")).alias("accuracy"))
    return [(r["loss"], r["accuracy"]) for r in sums.orderBy("i").collect()]  # a row for each model


def layer(cells: DataFrame, rows: DataFrame, weights: DataFrame, offsets: DataFrame, width: int) -> DataFrame:
    """row_id, k, z: a layer's inputs to its units. weights: col, k, b; offsets: k, o."""
    z = matmul(cells, rows, weights, width).join(F.broadcast(offsets), "k")
    return z.select("row_id", "k", (F.col("y") + F.col("o")).alias("z"))


def hidden(z: DataFrame) -> DataFrame:
    return z.select("row_id", "k", sigmoid(F.col("z")).alias("out"))


def softmax(z: DataFrame) -> DataFrame:
    row = Window.partitionBy("row_id")
    e = z.withColumn("e", F.exp(F.col("z") - F.max("z").over(row)))
    return e.select("row_id", "k", (F.col("e") / F.sum("e").over(row)).alias("out"))


def as_cells(outputs: DataFrame) -> DataFrame:
    return outputs.select("row_id", F.col("k").alias("col"), F.col("out").alias("val"))


def output_errors(outputs: DataFrame, labels: DataFrame, single: bool = False) -> DataFrame:
    """row_id, k, err. labels: row_id, label."""
    target = F.col("label").cast("double") if single else (F.col("label") == F.col("k")).cast("double")
    return outputs.join(labels, "row_id").select("row_id", "k", (F.col("out") - target).alias("err"))


def weight_gradient(left: DataFrame, errors: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """col, k, g: the sums of left outputs times errors, for each group of the errors. left: row_id, col, val."""
    return left.join(errors, "row_id").groupBy(*by, "col", "k").agg(F.sum(F.col("val") * F.col("err")).alias("g"))


def offset_gradient(errors: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return errors.groupBy(*by, "k").agg(F.sum("err").alias("g"))


def updated(weights: DataFrame, gradient: DataFrame, keys: list[str], value: str, rate: float, rows: int | Column) -> DataFrame:
    """rows: their number, or a column of the weights."""
    new = F.col(value) - F.coalesce("g", F.lit(0.0)) * (F.lit(rate) / rows)
    return weights.join(gradient, keys, "left").select(*keys, new.alias(value))


def back(errors: DataFrame, weights: DataFrame, left: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """row_id, k, err of the layer before: errors through the weights, of their group, times out (1 - out). left: row_id, k, out."""
    passed = errors.join(weights, [*by, "k"]).groupBy(*by, "row_id", F.col("col").alias("k")).agg(F.sum(F.col("err") * F.col("b")).alias("e"))
    return passed.join(left, ["row_id", "k"]).select(*by, "row_id", "k", (F.col("e") * F.col("out") * (1 - F.col("out"))).alias("err"))


def loss(errors: DataFrame, rows: int | Column, outputs: int) -> DataFrame:
    return errors.agg((F.sum(0.5 * F.col("err") * F.col("err")) / rows / outputs).alias("loss"))


def accuracy(outputs: DataFrame, labels: DataFrame) -> DataFrame:
    """The share of rows whose largest output, of equal ones the first, is their label."""
    best = outputs.groupBy("row_id").agg(F.max_by("k", F.struct("out", -F.col("k"))).alias("k"))
    return best.join(labels, "row_id").agg(F.avg((F.col("k") == F.col("label")).cast("double")).alias("accuracy"))


def dense_batch(x: np.ndarray) -> Dense:
    return Dense(np.asarray(x, float))
