"""Places where a series changes: the least Akaike criterion of two models, before and after.

`variance_places` takes the variance of the samples on both sides (Maeda, 1985), as running sums. `ar_places` takes the errors of two autoregressive models
(Takanami and Kitagawa, 1988): one solved by Levinson and Durbin from the samples at the beginning of a span, one from those at its end. The place is the first sample
of the part after. Spans are triggers and what lies around them, so each is bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: variances below this count as this
LEAST = 1e-10


def variance_places(inside: DataFrame, by: Sequence[str] = ("id", "on"), margin: int = 2) -> DataFrame:
    """by, place, aic: where k ln(var before) + (n - k - 1) ln(var after) is least, with at least `margin` samples on both sides; ties to the first place."""
    live = inside.where("value is not null")
    whole, before = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    v = F.col("value") - F.col("mid_")
    centred = live.withColumn("mid_", F.avg("value").over(whole))  # variances of small numbers lose less
    summed = centred.select(
        *by, "idx", F.count("*").over(whole).alias("n"), F.count("*").over(before).alias("k"), F.sum(v).over(before).alias("s"), F.sum(v * v).over(before).alias("q"), F.sum(v).over(whole).alias("s_all"), F.sum(v * v).over(whole).alias("q_all")
    )
    var = lambda s, q, n: F.greatest(q / n - (s / n) * (s / n), F.lit(LEAST))
    after = F.col("n") - F.col("k")
    aic = F.col("k") * F.log(var(F.col("s"), F.col("q"), F.col("k"))) + (after - 1) * F.log(var(F.col("s_all") - F.col("s"), F.col("q_all") - F.col("q"), after))
    scored = summed.where((F.col("k") >= margin) & (after >= margin)).withColumn("aic", aic)
    best = F.min(F.struct(F.round("aic", 9).alias("a"), F.col("idx").alias("place"), "aic")).alias("b")
    return scored.groupBy(*by).agg(best).select(*by, "b.place", "b.aic")


def levinson(x: np.ndarray, order: int) -> np.ndarray:
    """Coefficients c of the predictor of x[t] by sum of c[j] x[t - 1 - j], from the biased autocovariances of x."""
    x = x - x.mean()
    r = np.array([x[: len(x) - k] @ x[k:] for k in range(order + 1)]) / max(1, len(x))
    c, error = np.zeros(order), r[0]
    for m in range(order):
        if error <= LEAST:
            break
        reflection = (r[m + 1] - c[:m] @ r[m:0:-1]) / error
        c[:m], c[m] = c[:m] - reflection * c[:m][::-1], reflection
        error *= 1 - reflection * reflection
    return c


def errors(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """What the predictor leaves of each sample; earlier samples than the first count as 0."""
    left = x.astype(float).copy()
    for j, v in enumerate(c, 1):
        left[j:] -= v * x[:-j]
    return left


def ar_place(x: np.ndarray, order: int, share: float) -> tuple[int, float] | None:
    """The place and its criterion: models from the first and the last `share` of the samples."""
    n, part = len(x), int(len(x) * share)
    if part <= 2 * order or n < 2 * order + 2:
        return None
    x = x - x[:part].mean()
    noise, signal = errors(x, levinson(x[:part], order)) ** 2, errors(x, levinson(x[n - part :], order)) ** 2
    k = np.arange(order + 1, n - order)
    before, after = np.cumsum(noise)[k - 1] / k, (signal.sum() - np.cumsum(signal)[k - 1]) / (n - k)
    aic = k * np.log(np.maximum(before, LEAST)) + (n - k) * np.log(np.maximum(after, LEAST))
    at = int(np.argmin(np.round(aic, 9)))
    return int(k[at]), float(aic[at])


def ar_places(inside: DataFrame, by: Sequence[str] = ("id", "on"), order: int = 3, share: float = 0.4) -> DataFrame:
    """by, place, aic for each span of samples long enough; masked samples are left out."""
    kinds = {f.name: f.dataType.simpleString() for f in inside.schema}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=["value"]).sort_values("idx")
        found = ar_place(rows["value"].to_numpy(float), order, share) if len(rows) else None
        if found is None:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in (*by, "place", "aic")})
        return pd.DataFrame({**{c: [rows[c].iloc[0]] for c in by}, "place": [int(rows["idx"].iloc[found[0]])], "aic": [found[1]]})

    return inside.groupBy(*by).applyInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", place long, aic double")
