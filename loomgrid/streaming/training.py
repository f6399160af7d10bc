"""Training on a stream of encoded batches: each micro-batch's batches are trained on in order of batch_id."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.codecs import codec
from ..operators.mlp import Mlp
from ..tables import discard, materialise


def train_on_stream(batches: DataFrame, name: str, model: Mlp, checkpoint: str) -> StreamingQuery:
    """Train model on a streaming DataFrame of (batch_id, payload, labels) until what is there is used up.

    A micro-batch is stored before it is drawn from; one that gives other than its stored number of batches fails.
    """
    cls = codec(name)

    def step(some: DataFrame, number: int) -> None:
        stored = materialise(some.select("batch_id", "payload", "labels"))
        expected, drawn = stored.count(), 0
        for row in stored.orderBy("batch_id").select("payload", "labels").toLocalIterator():
            model.step(cls.read(bytes(row["payload"])), np.array(row["labels"]))
            drawn += 1
        if drawn != expected:
            raise RuntimeError(f"micro-batch {number} gave {drawn} of {expected} batches")
        discard(stored)

    return batches.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
