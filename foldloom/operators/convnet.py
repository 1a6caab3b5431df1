"""Convolutional scorers with weights: layers as rows of a catalogue, a forward pass in NumPy.

A layer is a row (model, weight, layer, kernel, bias, activation): kernel[o][i][j] weighs channel i at sample t + j - (size - 1) // 2 for output channel o; outside
a window there are zeros. Activations are relu, sigmoid and none. A catalogue of published weights has kilobytes to some megabytes a
weight; the layers of the weights asked for are collected, sent to each worker once, and made into a scorer there once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "model string, weight string, layer int, kernel array<array<array<double>>>, bias array<double>, activation string"
ACTIVATIONS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"none": lambda x: x, "relu": lambda x: np.maximum(x, 0), "sigmoid": lambda x: 1 / (1 + np.exp(-x))}
Layer = tuple[np.ndarray, np.ndarray, str]


def convolved(x: np.ndarray, kernel: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """(batch, in, sample) to (batch, out, sample), as one product over unfolded windows."""
    size = kernel.shape[2]
    left = (size - 1) // 2
    padded = np.pad(x, ((0, 0), (0, 0), (left, size - 1 - left)))
    frames = np.lib.stride_tricks.sliding_window_view(padded, size, axis=2)
    return np.einsum("bits,ois->bot", frames, kernel, optimize=True) + bias[:, None]


def forward(x: np.ndarray, layers: Sequence[Layer]) -> np.ndarray:
    for kernel, bias, activation in layers:
        x = ACTIVATIONS[activation](convolved(x, kernel, bias))
    return x


def loaded(catalogue: DataFrame, model: str, weights: Sequence[str]) -> dict[str, list[Layer]]:
    """The layers of the weights asked for, in order."""
    rows = catalogue.where((F.col("model") == model) & F.col("weight").isin(list(weights))).orderBy("weight", "layer").collect()
    out: dict[str, list[Layer]] = {}
    for r in rows:
        if r["activation"] not in ACTIVATIONS:
            raise ValueError(f"activation must be one of {', '.join(ACTIVATIONS)}")
        out.setdefault(r["weight"], []).append((np.array(r["kernel"], float), np.array(r["bias"], float), r["activation"]))
    missing = set(weights) - set(out)
    if missing:
        raise ValueError(f"no weights {', '.join(sorted(missing))} of {model}")
    for name, layers in out.items():
        for (k, b, _), (following, _, _) in zip(layers, layers[1:] + [(layers[-1][0].transpose(1, 0, 2), None, None)], strict=True):
            if k.shape[0] != len(b) or k.shape[0] != following.shape[1]:
                raise ValueError(f"the layers of {name} don't fit each other")
    return out


def scores(catalogue: DataFrame, model: str, weight: str, normalize: bool = True, batch_size: int = 128) -> Callable[[str], Column]:
    """A column function from a tensor column (component x sample) to the scores (label x sample) by one weight; for batch or stream.

    normalize: each component of a window loses its mean and is divided by its largest absolute value first.
    """
    layers = catalogue.sparkSession.sparkContext.broadcast(loaded(catalogue, model, [weight])[weight])

    @F.pandas_udf("array<array<double>>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = layers.value
        for rows in batches:
            out: list[list] = []
            for at in range(0, len(rows), batch_size):
                x = np.stack([np.stack([np.asarray(c, float) for c in t]) for t in rows.iloc[at : at + batch_size]])
                if normalize:
                    x = x - x.mean(axis=2, keepdims=True)
                    x = x / np.maximum(np.abs(x).max(axis=2, keepdims=True), 1e-12)
                out += forward(x, held).tolist()
            yield pd.Series(out, dtype=object)

    return score
