"""Scoring of windows by models: batches of tensors in, one probability series a label and a weight out.

A scorer is any function from an array (batch, component, sample) to an array (batch, label, sample). Windows keep their fold:
the summed fold of their components, blinded at the edges.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Scorer = Callable[[np.ndarray], np.ndarray]


def energy_ratio(nsta: int, nlta: int) -> Scorer:
    """A deterministic scorer with the labels Detection, P and S: the ratio r of trailing energies as r / (1 + r), of all components,
    the first, and the others.
    """

    def ratio(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        total = np.concatenate([np.zeros((len(x), 1)), np.cumsum(x * x, axis=1)], axis=1)
        k = np.arange(1, x.shape[1] + 1)
        mean = lambda n: (total[:, k] - total[:, np.maximum(k - n, 0)]) / np.minimum(k, n)
        r = mean(nsta) / (mean(nlta) + 1e-12)
        return r / (1 + r)

    def score(batch: np.ndarray) -> np.ndarray:
        first, others = ratio(batch[:, 0]), [ratio(batch[:, c]) for c in range(1, batch.shape[1])]
        second = np.mean(others, axis=0) if others else first
        return np.stack([np.maximum(first, second), first, second], axis=1)

    return score


def predict(tensors: DataFrame, scorers: Mapping[str, Scorer], labels: Sequence[str], model: str, by: Sequence[str] = ("instrument", "k"), batch_size: int = 128) -> DataFrame:
    """by, label, model, weight, values for each window, weight and label. Each batch is built once for all weights."""
    kinds = ", ".join(f"`{c}` {tensors.schema[c].dataType.simpleString()}" for c in by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch_size):
                part = rows.iloc[at : at + batch_size]
                stacked = np.stack([np.stack([np.asarray(c, np.float32) for c in t]) for t in part["tensor"]])
                for weight, scorer in scorers.items():
                    out = scorer(stacked)
                    for k, label in enumerate(labels):
                        yield part[list(by)].assign(label=label, model=model, weight=weight, values=[v.astype(float) for v in out[:, k]])

    return tensors.select(*by, "tensor").mapInPandas(run, f"{kinds}, label string, model string, weight string, values array<double>")


def scores(scorer: Scorer, batch_size: int = 128) -> Callable[[str], Column]:
    """A column function from a tensor column to the scores (label x sample) of its window, for batch or stream."""

    @F.pandas_udf("array<array<double>>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            out = []
            for at in range(0, len(rows), batch_size):
                stacked = np.stack([np.stack([np.asarray(c, np.float32) for c in t]) for t in rows.iloc[at : at + batch_size]])
                out += [x.astype(float).tolist() for x in scorer(stacked)]
            yield pd.Series(out, dtype=object)

    return score


def to_series(predicted: DataFrame, folds: DataFrame, length: int, blinding: int, first: str = "first", by: Sequence[str] = ("instrument", "k")) -> DataFrame:
    """Samples (id, idx, value, fold) of predictions: id is instrument + first letter of the label + model and weight.

    folds gives `first`, the sample number of a window's start, and fold, its summed folds in order.
    """
    rows = predicted.join(folds, list(by)).select(
        F.concat_ws(".", F.concat("instrument", F.substring("label", 1, 1)), "model", "weight").alias("id"), first, F.posexplode(F.arrays_zip("values", "fold")).alias("at", "x")
    )
    edge = (F.col("at") < blinding) | (F.col("at") >= length - blinding)
    return rows.select("id", (F.col(first) + F.col("at")).alias("idx"), F.col("x.values").alias("value"), F.when(edge, 0.0).otherwise(F.col("x.fold")).alias("fold"))


#: fixed values: the names of the published weights of each model
CATALOGUE = {
    "EQTransformer": ("ethz", "geofon", "instance", "iquique", "lendb", "neic", "obs", "original", "original_nonconservative", "pnw", "scedc", "stead"),
    "PhaseNet": ("diting", "ethz", "geofon", "instance", "iquique", "lendb", "neic", "obs", "original", "scedc", "stead"),
}


def catalogue(spark: SparkSession) -> DataFrame:
    """model and weight of each published weight; a table of fixed size."""
    return spark.createDataFrame([(m, w) for m, weights in CATALOGUE.items() for w in weights], "model string, weight string")


def window_parameters(in_samples: int, blinding: int | None = None, overlap: int | None = None, defaults: tuple[int, int] = (0, 0)) -> dict[str, int]:
    """A model's blinding (at most half a window) and overlap (less than a window), given or by default; gaps between windows warn."""
    blinding, overlap = (d if v is None else v for v, d in zip((blinding, overlap), defaults, strict=True))
    if not 0 <= blinding <= in_samples / 2 or int(blinding) != blinding:
        raise ValueError("blinding must be a whole number of at most half a window")
    if not 0 <= overlap < in_samples or int(overlap) != overlap:
        raise ValueError("overlap must be a whole number below the window's length")
    check_blinding(overlap, blinding)
    return {"in_samples": in_samples, "blinding": int(blinding), "overlap": int(overlap), "step": in_samples - int(overlap)}


def check_blinding(overlap: int, blinding: int) -> None:
    """Windows must overlap by both blinded edges at least, or samples are lost between them."""
    if overlap < 2 * blinding:
        warnings.warn(f"an overlap of {overlap} samples leaves gaps between windows blinded by {blinding} on each side", stacklevel=2)
