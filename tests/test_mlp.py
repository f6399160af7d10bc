"""The perceptron: order of a step, losses, streams, and sums over many batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.operators.codecs import Dense, codec, encode
from loomgrid.operators.mlp import Mlp, gradients
from loomgrid.plans import jobs
from loomgrid.streaming.training import train_on_stream


def test_step_updates_before_passing_errors_back():
    rng = np.random.default_rng(1)
    x, y = rng.random((6, 4)), np.array([0, 1, 2, 0, 1, 2])
    m = Mlp([4, 3, 3], 0.5, seed=2)
    w1, w2, b1, b2 = m.weights[0].copy(), m.weights[1].copy(), m.offsets[0].copy(), m.offsets[1].copy()
    m.step(Dense(x), y)
    h = 1 / (1 + np.exp(-(x @ w1 + b1)))
    z = h @ w2 + b2
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    err = p - np.eye(3)[y]
    new2 = w2 - h.T @ err * 0.5 / 6
    err1 = (err @ new2.T) * h * (1 - h)
    assert np.allclose(m.weights[1], new2) and np.allclose(m.offsets[1], b2 - err.sum(0) * 0.5 / 6)
    assert np.allclose(m.weights[0], w1 - x.T @ err1 * 0.5 / 6) and np.allclose(m.offsets[0], b1 - err1.sum(0) * 0.5 / 6)


def test_single_output_and_ties():
    m = Mlp([1, 1], 0.1)
    m.weights, m.offsets = [np.array([[0.0]])], [np.array([0.0])]
    assert m.accuracy(Dense(np.ones((2, 1))), np.array([0, 1])) == 0.0  # exactly one half is wrong
    m = Mlp([1, 2, 2], 0.1)
    m.weights, m.offsets = [np.zeros((1, 2)), np.zeros((2, 2))], [np.zeros(2), np.zeros(2)]
    assert m.accuracy(Dense(np.ones((2, 1))), np.array([0, 1])) == 0.5  # of equal outputs the first counts
    assert m.loss(Dense(np.ones((2, 1))), np.array([0, 1])) == pytest.approx(0.125)


def data(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 200)
    x = (rng.random((200, 6)) < 0.3 + 0.4 * y[:, None] * (np.arange(6) < 3)).astype(float)
    rows = [(i, int(y[i]), [(j, 1.0) for j in range(6) if x[i, j]]) for i in range(200)]
    return spark.createDataFrame(rows, "row_id long, label int, cells array<struct<col:int,val:double>>"), x, y


@pytest.mark.parametrize("name", ["toc", "csr", "snappy"])
def test_training_lowers_the_loss(spark, name):
    rows, x, y = data(spark)
    made = jobs.generate(rows, jobs.GenerateConfig(format=name, batch_size=25, batches_per_shard=4, scale=0.0, num_cols=6)).cache()
    config = jobs.TrainConfig(format=name, hidden=(4,), outputs=2, num_cols=6, epochs=15, rate=2.0, seed=3)
    _, log = jobs.train(made, config, test=(x, y))
    assert [t.batches for t in log] == [4, 4] * 15
    fresh = Mlp([6, 4, 2], 2.0, seed=3).loss(Dense(x), y)
    assert log[-1].loss < log[0].loss < fresh and log[-1].accuracy > log[0].accuracy + 0.1 and log[0].total_s >= log[0].train_s


def test_formats_that_cannot_train(spark):
    with pytest.raises(ValueError, match="can't be trained"):
        jobs.train(spark.range(0), jobs.TrainConfig(format="logicalfoc"))


def test_gradients_over_many_batches(spark):
    rows, x, y = data(spark)
    made = jobs.generate(rows, jobs.GenerateConfig(format="toc", batch_size=30, scale=0.0, num_cols=6))
    m = Mlp([6, 4, 2], 0.1, seed=1)
    dw, db, n = gradients(made, "toc", m)
    out = m.forward(Dense(x))
    err = m.errors(out[-1], y)
    hid = (err @ m.weights[1].T) * out[0] * (1 - out[0])
    assert n == 200 and np.allclose(dw[1], out[0].T @ err) and np.allclose(dw[0], x.T @ hid) and np.allclose(db[0], hid.sum(0))


def test_testing_on_encoded_batches(spark, monkeypatch):
    rows, x, y = data(spark)
    made = jobs.generate(rows, jobs.GenerateConfig(format="toc", batch_size=30, batches_per_shard=3, scale=0.0, num_cols=6)).cache()
    monkeypatch.setattr(jobs, "EVALUATED", 4)
    config = jobs.TrainConfig(format="toc", hidden=(4,), outputs=2, num_cols=6, epochs=2, rate=2.0, seed=3)
    (_, log), (_, plain) = (jobs.train(made, config, test=t) for t in (made, (x, y)))
    assert len(log) == 6 and np.allclose([t.loss for t in log], [t.loss for t in plain]) and np.allclose([t.accuracy for t in log], [t.accuracy for t in plain])


def test_stream_equals_batch(spark, tmp_path):
    rows, x, y = data(spark)
    made = jobs.generate(rows, jobs.GenerateConfig(format="toc", batch_size=50, scale=0.0, num_cols=6)).coalesce(1)
    made.select("batch_id", "payload", "labels").write.parquet(str(tmp_path / "in"))
    m, n = Mlp([6, 3, 2], 0.5, seed=1), Mlp([6, 3, 2], 0.5, seed=1)
    stream = spark.readStream.schema("batch_id long, payload binary, labels array<int>").parquet(str(tmp_path / "in"))
    train_on_stream(stream, "toc", m, str(tmp_path / "check")).awaitTermination()
    for i in range(0, 200, 50):
        n.step(codec("mat").read(encode("mat", [[(j, x[r, j]) for j in range(6)] for r in range(i, i + 50)], 6)), y[i : i + 50])
    assert all(np.allclose(a, b) for a, b in zip(m.weights, n.weights))


def test_sweep(spark, tmp_path):
    rows, _, _ = data(spark)
    log = jobs.sweep(rows, str(tmp_path / "s"), jobs.GenerateConfig(batch_size=100, scale=0.0, num_cols=6), jobs.TrainConfig(hidden=(3,), outputs=2, num_cols=6, epochs=1), formats=("toc", "mat"))
    assert {k: len(v) for k, v in log.items()} == {"toc": 1, "mat": 1}
    assert rows.where(F.col("label") > 1).count() == 0
