"""Least squares of boxes and triangles in their corners, over each trigger.

A box or triangle is linear in its height but not smooth in its corners, so all corners on sample numbers are tried. With running sums of 1, x, x^2, y and x y
the height and the rest of any choice follow without another pass over the samples: least squares is greatest (sum y t)^2 / sum t^2, t the shape of
height one. A box tries all pairs, a triangle all triples of numbers of the span, a peak at a time; ties go to the smallest corners. Negative heights don't
count. The time of a span grows with the cube of its length, so triggers should come with a longest length.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: relative difference below which two fits are equal
TIE = 1e-12


def _best(gain: np.ndarray, held: float) -> tuple[int, ...] | None:
    """The first place of the greatest gain, if that is above what is held."""
    top = gain.max(initial=-np.inf)
    if not top > held * (1 + TIE):
        return None
    return tuple(int(k) for k in np.unravel_index(int(np.argmax(gain >= top * (1 - TIE))), gain.shape))


def box(x: np.ndarray, y: np.ndarray) -> tuple[float, int, int] | None:
    """height, first and last sample number of the box of least squares."""
    total, n = np.concatenate([[0.0], np.cumsum(y)]), len(x)
    found, held = None, 0.0
    for a in range(n):  # a row of pairs at a time
        inside = total[a + 1 :] - total[a]
        at = _best(np.where(inside > 0, inside * inside, 0.0) / np.arange(1, n - a + 1), held)
        if at is not None:
            b = a + at[0]
            held = float(inside[at[0]] ** 2 / (b - a + 1))
            found = (float(inside[at[0]] / (b - a + 1)), int(x[a]), int(x[b]))
    return found


def shape(x: np.ndarray, onset: int, peak: int, offset: int) -> np.ndarray:
    """The triangle of height one: 0 at onset and offset, 1 at the peak."""
    return np.where((x < onset) | (x > offset), 0.0, np.where(x <= peak, (x - onset) / (peak - onset), (offset - x) / (offset - peak)))


def triangle(x: np.ndarray, y: np.ndarray) -> tuple[float, int, int, int] | None:
    """height, onset, peak and offset of the triangle of least squares; corners are numbers from the first to the last sample, gaps included."""
    first, last = int(x[0]), int(x[-1])
    u = (x - first).astype(float)
    grid = np.arange(last - first + 1)
    upto = np.searchsorted(x, grid + first, side="right")  # samples up to each number
    sums = [np.concatenate([[0.0], np.cumsum(v)])[upto] for v in (np.ones(len(x)), u, u * u, y, u * y)]
    found, held = None, 0.0
    for p in range(1, len(grid) - 1):
        a, b = grid[:p].astype(float), grid[p + 1 :].astype(float)
        n, s, q, t, w = (v[p] - v[:p] for v in sums)  # samples of a + 1 to p
        rise, fall = p - a, b - p
        up, upper = (w - a * t) / rise, (q - 2 * a * s + a * a * n) / rise**2
        n, s, q, t, w = (v[p + 1 :] - v[p] for v in sums)  # samples of p + 1 to b
        down, lower = (b * t - w) / fall, (b * b * n - 2 * b * s + q) / fall**2
        inner, norm = up[:, None] + down[None, :], upper[:, None] + lower[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((inner > 0) & (norm > 1e-9), inner * inner / norm, 0.0)
        at = _best(gain, held)
        if at is not None:
            held = float(gain[at])
            found = (float(inner[at] / norm[at]), first + at[0], first + p, first + p + 1 + at[1])
    return found


def covariance(x: np.ndarray, y: np.ndarray, height: float, onset: int, peak: int, offset: int) -> np.ndarray:
    """Of height, onset, peak and offset, from the slopes of the triangle and the variance of the rest."""
    t = shape(x, onset, peak, offset)
    rises, falls = (x >= onset) & (x <= peak), (x > peak) & (x <= offset)
    rise, fall = peak - onset, offset - peak
    j = np.stack([t, np.where(rises, height * (x - peak) / rise**2, 0.0), np.where(rises, -height * (x - onset) / rise**2, np.where(falls, height * (offset - x) / fall**2, 0.0)), np.where(falls, height * (x - peak) / fall**2, 0.0)], 1)
    rest = y - height * t
    return np.linalg.pinv(j.T @ j) * (rest @ rest / max(1, len(x) - 4))


FIELDS = "box_height double, box_first long, box_last long, box_variance double, box_l2 double, triangle_height double, onset long, peak long, offset long, covariance array<array<double>>, triangle_l2 double"


def fits(inside: DataFrame, by: Sequence[str] = ("id", "on"), x: str = "idx", y: str = "value") -> DataFrame:
    """by and FIELDS for each group of samples (a trigger and what lies around it) with at least three; null where no positive height fits.

    box_variance is that of the height; the corners of a box lie anywhere within a sample.
    """
    kinds = {f.name: f.dataType.simpleString() for f in inside.schema}
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=[y]).sort_values(x)
        if len(rows) < 3:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in (*by, *names)})
        at, value = rows[x].to_numpy(np.int64), rows[y].to_numpy(float)
        made: dict[str, object] = dict.fromkeys(names)
        flat, peaked = box(at, value), triangle(at, value)
        if flat is not None:
            rest = value - np.where((at >= flat[1]) & (at <= flat[2]), flat[0], 0.0)
            n = int(((at >= flat[1]) & (at <= flat[2])).sum())
            made |= dict(zip(("box_height", "box_first", "box_last"), flat, strict=True)) | {"box_variance": float(rest @ rest / max(1, len(at) - 3) / n), "box_l2": float(np.sqrt(rest @ rest))}
        if peaked is not None:
            rest = value - peaked[0] * shape(at, *peaked[1:])
            made |= dict(zip(("triangle_height", "onset", "peak", "offset"), peaked, strict=True)) | {"covariance": covariance(at, value, *peaked).tolist(), "triangle_l2": float(np.sqrt(rest @ rest))}
        return pd.DataFrame({**{c: [rows[c].iloc[0]] for c in by}, **{c: [made[c]] for c in names}})

    return inside.groupBy(*by).applyInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in by) + f", {FIELDS}")
