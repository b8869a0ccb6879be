"""Small networks with reverse-mode gradients in numpy: what a class's score depends on, token by token, pixel by pixel.

A network is a list of layers; each keeps what its backward pass needs. Rows come in Arrow batches and are
worked on as arrays, so a batch is a few matrix products.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Embedding:
    """ids (rows x length) to vectors (rows x length x width); ids beyond the table have that of id ``unknown``."""

    table: np.ndarray
    unknown: int = 1

    def forward(self, ids, mask):
        ids = ids.astype(np.int64)
        return self.table[np.where((ids >= 0) & (ids < len(self.table)), ids, self.unknown)]


@dataclass
class Dense:
    """x @ weights + bias, then tanh if asked for, on the last axis."""

    weights: np.ndarray
    bias: np.ndarray
    tanh: bool = False
    out: np.ndarray = field(default=None, repr=False)

    def forward(self, x, mask):
        self.out = x @ self.weights + self.bias
        if self.tanh:
            self.out = np.tanh(self.out)
        return self.out

    def backward(self, grad):
        return (grad * (1 - self.out**2) if self.tanh else grad) @ self.weights.T


@dataclass
class MeanPool:
    """The mean over the positions that the mask keeps; none gives zeros."""

    mask: np.ndarray = field(default=None, repr=False)

    def forward(self, x, mask):
        self.mask = mask[:, :, None] / np.maximum(mask.sum(1), 1)[:, None, None]
        return (x * self.mask).sum(1)

    def backward(self, grad):
        return grad[:, None, :] * self.mask


@dataclass
class Network:
    """Layers from inputs to class scores. With an Embedding first, inputs are ids and gradients those of the vectors."""

    layers: list
    width: int
    scale: float = 1.0

    @property
    def tokens(self) -> bool:
        return isinstance(self.layers[0], Embedding)

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        for layer in self.layers:
            x = layer.forward(x, mask)
        return x

    def gradient(self, target: np.ndarray) -> np.ndarray:
        """Of the target class's score of each row of the last ``scores``: by vector (rows x length x width) or by input."""
        grad = np.zeros_like(self.layers[-1].out)
        grad[np.arange(len(target)), target] = 1.0
        for layer in reversed(self.layers[1:] if self.tokens else self.layers):
            grad = layer.backward(grad)
        return grad

    def importance(self, target: np.ndarray) -> np.ndarray:
        """The L2 norm of each token's gradient, or the absolute value of each input's, times ``scale``."""
        g = self.gradient(target)
        return self.scale * (np.sqrt((g * g).sum(-1)) if self.tokens else np.abs(g))


def gradient_saliency(df: DataFrame, network: Network, inputs: str, key: str, target: str = "pred", segments: str | None = None) -> DataFrame:
    """(key, pred, saliency) of rows whose array column ``inputs`` goes through the network.

    Rows are cut or zero-padded to the network's width; saliency has as many values as the row had inputs (the width at
    most). ``segments`` is an array that is 1 where a token counts; without it all of a row's own inputs do. ``target`` is
    'pred', or a column with the class to explain (the predicted one where it is null or no class). Null rows are empty.
    """
    import pyarrow as pa

    kind = df.schema[key].dataType.simpleString()
    values, marks = F.col(inputs).cast("array<double>"), F.col(segments).cast("array<double>") if segments else F.lit(None).cast("array<double>")
    goal = F.lit(None).cast("long") if target == "pred" else F.col(target).cast("long")
    width = network.width

    def matrix(lists):
        sizes = np.array([0 if x is None else min(len(x), width) for x in lists])
        out = np.zeros((len(lists), width))
        for i, x in enumerate(lists):
            out[i, : sizes[i]] = np.array(x[: sizes[i]] if x is not None else [], np.float64)
        return np.nan_to_num(out), sizes

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, sizes = matrix(b.column(1).to_pylist())
            mask = (np.arange(width) < sizes[:, None]).astype(np.float64)
            if segments:
                mask = mask * matrix(b.column(2).to_pylist())[0]
            s = network.scores(x, mask)
            pred = s.argmax(1)
            asked = np.array([p if g is None or not 0 <= g < s.shape[1] else g for g, p in zip(b.column(3).to_pylist(), pred.tolist(), strict=True)])
            found = network.importance(asked)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(found[np.arange(width) < sizes[:, None]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.int64()), lists], names=[key, "pred", "saliency"])

    rows = df.select(key, values.alias("x"), marks.alias("m"), goal.alias("g"))
    return rows.mapInArrow(run, f"`{key}` {kind}, pred long, saliency array<double>")
