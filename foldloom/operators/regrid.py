"""New grids for series: interpolation at any rate and offset, filtered decimation, and the preparation of window components.

Sample k of the new grid lies at (k * down + offset) / up old samples. These are whole numbers, so no rounding decides on
which side of a sample a place falls. Only contiguous unmasked samples are joined; nothing is made across a gap or beyond a piece's
ends. Local methods (slopes, linear, nearest, zero) need at most two neighbours and stay relational; splines and Lanczos
kernels work on bounded blocks with a margin in which their boundary dies away. Folds are always linear.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldloom.operators import collate, dsp, series, stack
from foldloom.operators.frames import LENGTH, framed

BY = ("id",)
LOCAL = ("slopes", "linear", "slinear", "nearest", "zero")
SMOOTH = ("quadratic", "cubic", "lanczos")
BLOCK, MARGIN, STRETCH = 65_536, 64, 256
LANCZOS = 20


def floor_div(a: Column, b: int) -> Column:
    return ((a - F.pmod(a, F.lit(b))) / b).cast("long")


def _slope(before: Column, after: Column) -> Column:
    """The slope at a sample between two differences, weighed by their inverse sizes: their harmonic mean, 0 where they turn."""
    return F.when(before * after > 0, 2 * before * after / (before + after)).otherwise(0.0)


def interpolated(samples: DataFrame, up: int, down: int = 1, method: str = "slopes", offset: int = 0, by: Sequence[str] = BY, length: int = LENGTH) -> DataFrame:
    """samples (by, idx, value, fold) on the grid (k * down + offset) / up, numbered by k.

    slopes: cubic pieces through the samples whose slopes are averages weighed by the inverse sizes of the neighbouring differences.
    linear (slinear), nearest (a half goes back), zero (the sample before); quadratic and cubic splines; lanczos.
    """
    if up < 1 or down < 1:
        raise ValueError("up and down must be at least 1")
    live = samples.where("value is not null").select(*by, "idx", "value", "fold")
    if method in SMOOTH:
        return _smooth(live, up, down, offset, method, by)
    if method not in LOCAL:
        raise ValueError(f"method must be one of {', '.join(LOCAL + SMOOTH)}")

    def make(w):
        near = lambda f, n, k, c="value": F.when(f("idx", n).over(w) == F.col("idx") + k, f(c, n).over(w))
        return {"back_": near(F.lag, 1, -1), "ahead_": near(F.lead, 1, 1), "then_": near(F.lead, 2, 2), "fold_": near(F.lead, 1, 1, "fold")}

    placed = framed(live, by, 1, 2, make, length)
    here = F.col("idx") * up - offset
    joined = F.col("ahead_").isNotNull()
    first = -floor_div(-here, down)
    last = F.when(joined, -floor_div(-(here + up), down) - 1).otherwise(floor_div(here, down))
    fine = placed.withColumns({"first_": first, "last_": last}).where("first_ <= last_").withColumn("k_", F.explode(F.sequence("first_", "last_")))
    at = (F.col("k_") * down + offset - F.col("idx") * up) / up
    value, ahead = F.col("value"), F.coalesce("ahead_", "value")
    step = ahead - value
    s0 = F.when(F.col("back_").isNull(), step).otherwise(_slope(value - F.col("back_"), step))
    s1 = F.when(F.col("then_").isNull(), step).otherwise(_slope(step, F.col("then_") - ahead))
    lerp = lambda a, b: a + (b - a) * at
    made = {
        "slopes": value + at * (s0 + at * (3 * step - 2 * s0 - s1 + at * (s0 + s1 - 2 * step))),
        "linear": lerp(value, ahead),
        "slinear": lerp(value, ahead),
        "nearest": F.when(at <= 0.5, value).otherwise(ahead),
        "zero": value,
    }[method]
    return fine.select(*by, F.col("k_").alias("idx"), made.alias("value"), lerp(F.col("fold"), F.coalesce("fold_", "fold")).alias("fold"))


def _basis(knots: np.ndarray, degree: int, at: np.ndarray) -> np.ndarray:
    """B-splines of a degree at places, by the recursion of Cox and de Boor."""
    inside = np.minimum(np.searchsorted(knots, at, side="right") - 1, len(knots) - degree - 2)
    out = (np.arange(len(knots) - 1) == inside[:, None]).astype(float)
    ratio = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b != 0)
    for d in range(1, degree + 1):
        rise = ratio(at[:, None] - knots[: -d - 1], np.broadcast_to(knots[d:-1] - knots[: -d - 1], (len(at), len(knots) - d - 1)))
        fall = ratio(knots[d + 1 :] - at[:, None], np.broadcast_to(knots[d + 1 :] - knots[1:-d], (len(at), len(knots) - d - 1)))
        out = rise * out[:, :-1] + fall * out[:, 1:]
    return out


def spline(y: np.ndarray, at: np.ndarray, degree: int) -> np.ndarray:
    """The interpolating spline through samples 0 to len(y) - 1; no knot next to an end (odd), knots half-way (even).

    Stretches are solved on their own with MARGIN samples around: a spline forgets a boundary by more than half each sample.
    """
    out = np.empty(len(at))
    for begin in range(0, max(1, len(y) - 1), STRETCH):
        mine = (at >= begin) & ((at < begin + STRETCH) | (begin + STRETCH >= len(y) - 1))
        if not mine.any():
            continue
        low, high = max(0, begin - MARGIN), min(len(y), begin + STRETCH + MARGIN + 1)
        x = np.arange(high - low, dtype=float)
        k = min(degree, len(x) - 1)
        if k < 1:
            out[mine] = y[0]
            continue
        middle = x[(k + 1) // 2 : -((k + 1) // 2)] if k % 2 else ((x[1:] + x[:-1]) / 2)[k // 2 : -(k // 2)]
        knots = np.concatenate((np.full(k + 1, x[0]), middle, np.full(k + 1, x[-1])))
        out[mine] = _basis(knots, k, at[mine] - low) @ np.linalg.solve(_basis(knots, k, x), y[low:high])
    return out


def lanczos(y: np.ndarray, at: np.ndarray, a: int = LANCZOS) -> np.ndarray:
    """Windowed sinc kernels of half-width a, their weights scaled to one where samples lack at the ends."""
    near = np.floor(at).astype(int)[:, None] + np.arange(1 - a, a + 1)
    d = at[:, None] - near
    weights = np.where((near >= 0) & (near < len(y)), np.sinc(d) * np.sinc(d / a), 0.0)
    return (weights * y[np.clip(near, 0, len(y) - 1)]).sum(axis=1) / weights.sum(axis=1)


WORK: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {"quadratic": lambda y, at: spline(y, at, 2), "cubic": lambda y, at: spline(y, at, 3), "lanczos": lanczos}


def _smooth(live: DataFrame, up: int, down: int, offset: int, method: str, by: Sequence[str]) -> DataFrame:
    low, high = F.floor((F.col("idx") - MARGIN) / BLOCK), F.floor((F.col("idx") + MARGIN) / BLOCK)
    placed = live.withColumn("block_", F.explode(F.sequence(low, high)))
    work = WORK[method]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, block = rows.sort_values("idx"), int(rows["block_"].iloc[0])
        idx, value, fold = (rows[c].to_numpy() for c in ("idx", "value", "fold"))
        out = []
        for part in np.split(np.arange(len(idx)), np.nonzero(np.diff(idx) != 1)[0] + 1):
            first, last = int(idx[part[0]]), int(idx[part[-1]])
            low, high = max(first, block * BLOCK), min(last, (block + 1) * BLOCK - 1)
            # places from `low` to before the next block; the last sample of a piece has a place of its own only
            k = np.arange(-(-(low * up - offset) // down), ((min(high + 1, last)) * up - offset) // down + 1)
            k = k[(k * down + offset) // up < (block + 1) * BLOCK]
            at = (k * down + offset - first * up) / up
            if len(k):
                out.append(pd.DataFrame({"idx": k, "value": work(value[part].astype(float), at), "fold": np.interp(at, np.arange(len(part)), fold[part])}))
        made = pd.concat(out) if out else pd.DataFrame({"idx": [], "value": [], "fold": []})
        return made.assign(**{c: rows[c].iloc[0] for c in by})[[*by, "idx", "value", "fold"]]

    kinds = ", ".join(f"`{c}` {live.schema[c].dataType.simpleString()}" for c in by)
    return placed.groupBy(*by, "block_").applyInPandas(run, f"{kinds}, idx long, value double, fold double")


def folds_on(samples: DataFrame, up: int, down: int, offset: int, first: int, last: int, by: Sequence[str] = BY, length: int = LENGTH) -> DataFrame:
    """by, idx, fold for samples first to last of the new grid: linear between neighbouring old samples, masked ones count as 0, and
    0 outside the series."""
    grid = samples.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))).alias("idx"))
    whole = stack.fill_gaps(samples.select(*by, "idx", "value", "fold"), by).withColumn("value", F.coalesce("fold", F.lit(0.0)))
    made = interpolated(whole, up, down, "linear", offset, by, length).select(*by, "idx", "fold")
    return grid.join(made, [*by, "idx"], "left").select(*by, "idx", F.coalesce("fold", F.lit(0.0)).alias("fold"))


def aligned(samples: DataFrame, shift: int, parts: int = 1_000_000, tolerance: float = 0.01, method: str = "slopes", by: Sequence[str] = BY, length: int = LENGTH) -> DataFrame:
    """samples of a series that lies shift / parts of a sample after the grid, on the grid.

    A shift within `tolerance` of a sample only renames them; otherwise values are interpolated at the grid's times, the first
    of them after the series' start.
    """
    whole = round(shift / parts)
    if abs(shift / parts - whole) <= tolerance:
        return samples.withColumn("idx", F.col("idx") + whole)
    # grid time k is sample k - shift / parts of the series
    return interpolated(samples, parts, parts, method, -shift, by, length)


def low_pass(factor: int, half: int = 10) -> np.ndarray:
    """Weights of a zero-phase low-pass below half the decimated rate: sinc times a Hamming window, half x factor samples a side."""
    k = np.arange(-half * factor, half * factor + 1)
    return np.sinc(k / factor) * (0.54 + 0.46 * np.cos(np.pi * k / (half * factor)))


def decimated(samples: DataFrame, factor: int, half: int = 10, by: Sequence[str] = BY) -> DataFrame:
    """Every factor-th sample of each contiguous piece after an anti-alias filter: by, piece (its first sample), idx as in series.decimate.

    The filter's weights are scaled to one where samples lack at the ends of a piece.
    """
    weights = low_pass(factor, half)

    def work(x: np.ndarray) -> np.ndarray:
        k = len(weights) // 2
        run = lambda v: np.convolve(np.pad(v, k), weights, "valid")
        return run(x) / run(np.ones(len(x)))

    filtered = dsp.by_segment(samples, work, by, margin=half * factor)
    pieces = series.split(filtered, by).withColumnRenamed("first", "piece").drop("last")
    return series.decimate(pieces, factor, [*by, "piece"])


def by_piece(samples: DataFrame, work: Callable[..., DataFrame], by: Sequence[str] = BY, **arguments: object) -> DataFrame:
    """Split at masks, apply an operator to each contiguous piece (it takes `by`), and put the pieces together again.

    A sample that several pieces give is masked.
    """
    pieces = series.split(samples.select(*by, "idx", "value", "fold"), by).withColumnRenamed("first", "piece_").drop("last")
    return stack.stack(work(pieces, by=[*by, "piece_"], **arguments).drop("piece_"), "drop", by)


def prepared(
    samples: DataFrame,
    up: int,
    down: int = 1,
    offset: int = 0,
    method: str = "slopes",
    band: tuple[float | None, float | None, float] | None = None,
    trend: str | None = "linear",
    taper: float | None = 0.05,
    taper_most: int | None = None,
    by: Sequence[str] = BY,
) -> DataFrame:
    """The preparation of a component, for each contiguous piece: detrend, filter (low, high, sampling rate), align and resample to the
    target grid, taper; then the pieces are merged."""

    def work(pieces: DataFrame, by: Sequence[str]) -> DataFrame:
        if trend is not None:
            pieces = series.detrend(pieces, trend, by)
        if band is not None:
            pieces = dsp.bandpass(pieces, *band, by=by)
        pieces = interpolated(pieces, up, down, method, offset, by)
        return pieces if taper is None else series.taper(pieces, taper, taper_most, by=by)

    return by_piece(samples, work, by)


def prepared_windows(
    samples: DataFrame, windows: DataFrame, components: Sequence[str], npts: int, up: int, down: int = 1, rule: str = "primary", thresholds: dict[str, float] | None = None, by: Sequence[str] = ("instrument", "k"), **steps: object
) -> DataFrame:
    """Windows ready for a model: every component prepared, trimmed or padded to the window's samples on the new grid (windows: by,
    first, last) with value 0 and fold 0, and missing or poor components repaired by the rule."""
    made = prepared(samples, up, down, by=[*by, "component"], **steps)
    inside = made.join(windows, list(by)).where(F.col("idx").between(F.col("first"), F.col("last"))).drop("first", "last")
    return collate.fill_components(collate.whole(inside, windows, by), npts, components, rule, by, **(thresholds or {}))
