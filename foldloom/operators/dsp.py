"""Signal processing that has no relational form: Fourier resampling, filters, recursive ratios, fits.

Work is dealt by (series, block): a series is cut into blocks of `block` samples, each with `margin` samples of its
neighbours on both sides, so that a task holds block + 2 x margin samples however long a series is. The margin follows the
operator: the samples it looks back, or the time in which it forgets its start (to 1e-12); the result of a block leaves
without it. Within a block, gaps split the samples (an operator sees
contiguous samples only) and results are put together again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.sources.scratch import stored

BLOCK = 65_536
FORGOTTEN = 1e-12
Segment = Callable[[np.ndarray], np.ndarray]


def by_segment(samples: DataFrame, work: Segment, by: Sequence[str] = ("id",), margin: int = 0, block: int = BLOCK) -> DataFrame:
    """samples with `work` applied to each contiguous unmasked stretch of each block; it must keep the number of samples, and
    each result must depend on at most `margin` samples on either side.
    """
    block = max(block, 2 * margin)
    low, high = F.floor((F.col("idx") - margin) / block), F.floor((F.col("idx") + margin) / block)
    placed = samples.select(*by, "idx", "value", "fold").withColumn("block_", F.explode(F.sequence(low, high)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx").reset_index(drop=True)
        live = rows["value"].notna().to_numpy()
        idx, value = rows["idx"].to_numpy(), rows["value"].to_numpy(dtype=float, copy=True)
        kept = np.nonzero(live)[0]
        if len(kept):
            cuts = np.nonzero(np.diff(idx[kept]) != 1)[0] + 1
            for part in np.split(kept, cuts):
                value[part] = work(value[part])
        rows["value"] = value
        own = rows["idx"] // block == rows["block_"]
        return rows[own].drop(columns="block_").replace({np.nan: None}) if not live.all() else rows[own].drop(columns="block_")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema if f.name != "block_")
    return placed.groupBy(*by, "block_").applyInPandas(run, fields)


def butterworth(order: int, low: float | None, high: float | None, sampling_rate: float, stop: bool = False) -> np.ndarray:
    """Second-order sections (b0 b1 b2 a1 a2) of a low-, high- or band-pass, or a band-stop, by the bilinear transform of the
    analogue prototype; both corners are transformed together.
    """
    cuts = [c for c in (low, high) if c is not None]
    if not cuts or not all(0 < c < sampling_rate / 2 for c in cuts) or (len(cuts) == 2 and low >= high) or (stop and len(cuts) < 2):
        raise ValueError("corners must lie between 0 and half the sampling rate, the low one below the high one")
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    edge = [2 * np.tan(np.pi * c / sampling_rate) for c in cuts]
    if len(cuts) == 2:
        width, centre = edge[1] - edge[0], edge[0] * edge[1]
        half = (width / poles if stop else width * poles) / 2
        poles = np.concatenate((half + np.sqrt(half**2 - centre + 0j), half - np.sqrt(half**2 - centre + 0j)))
        turn = 2 * np.arctan(np.sqrt(centre) / 2)
        zeros = np.array([1, -2 * np.cos(turn), 1]) if stop else np.array([1, 0, -1])
        still = 0.0 if stop else turn  # where the gain is one
    else:
        poles = edge[0] / poles if high is None else edge[0] * poles
        zeros, still = (np.array([1, -2, 1]), np.pi) if high is None else (np.array([1, 2, 1]), 0.0)
    z = (2 + poles) / (2 - poles)
    real = np.sort(z[np.abs(z.imag) < 1e-9].real)
    sections = [[1.0, -2 * p.real, abs(p) ** 2] for p in z[z.imag >= 1e-9]] + [[1.0, -(a + b), a * b] for a, b in zip(real[::2], real[1::2], strict=False)]
    out = []
    for a in sections:
        out.append([*zeros, *a[1:]])
    if len(real) % 2:
        out.append([1.0, zeros[1] / 2, 0.0, -real[-1], 0.0])
    at = np.exp(-1j * still * np.arange(3))
    return np.array([[*(np.array(s[:3]) * abs(at @ [1, *s[3:]]) / abs(at @ s[:3])), *s[3:]] for s in out])


def recurrence(x: np.ndarray, a1: float, a2: float = 0.0, stretch: int = 128) -> np.ndarray:
    """y[n] = x[n] - a1 y[n-1] - a2 y[n-2] from rest. Stretches are products with one triangular matrix; the two last values of each
    carry over to the next.
    """
    h = np.zeros(stretch + 1)  # the answer to one impulse
    h[0], h[1] = 1.0, -a1
    for k in range(2, stretch + 1):
        h[k] = -a1 * h[k - 1] - a2 * h[k - 2]
    n = -(-len(x) // stretch)
    parts = np.pad(np.asarray(x, float), (0, n * stretch - len(x))).reshape(n, stretch)
    at = np.arange(stretch)
    y = parts @ np.where(at[None, :] >= at[:, None], h[np.maximum(at[None, :] - at[:, None], 0)], 0.0)
    carry = np.stack([h[1:], -a2 * h[:-1]])  # what the last value and the one before it add
    for k in range(1, n):
        y[k] += y[k - 1, -1] * carry[0] + y[k - 1, -2] * carry[1]
    return y.ravel()[: len(x)]


def sos_filter(x: np.ndarray, sections: np.ndarray) -> np.ndarray:
    out = np.asarray(x, float)
    for b0, b1, b2, a1, a2 in sections.tolist():
        before = np.concatenate(([0.0, 0.0], out))
        out = recurrence(b0 * out + b1 * before[1:-1] + b2 * before[:-2], a1, a2)
    return out


def settling(sections: np.ndarray) -> int:
    """Samples after which the slowest pole has died away."""
    slowest = max(abs(r) for s in sections for r in np.roots([1.0, *s[3:]]))
    return int(np.ceil(np.log(FORGOTTEN) / np.log(min(slowest, 1 - 1e-9)))) if slowest > 0 else 2


def bandpass(samples: DataFrame, low: float | None, high: float | None, sampling_rate: float, order: int = 4, zero_phase: bool = False, stop: bool = False, by: Sequence[str] = ("id",), **blocks: int) -> DataFrame:
    """Butterworth filter (stop: the band goes); zero_phase runs it both ways."""
    sections = butterworth(order, low, high, sampling_rate, stop)

    def work(x: np.ndarray) -> np.ndarray:
        y = sos_filter(x, sections)
        return sos_filter(y[::-1], sections)[::-1] if zero_phase else y

    return by_segment(samples, work, by, settling(sections), **blocks)


def recursive_sta_lta(x: np.ndarray, nsta: int, nlta: int) -> np.ndarray:
    """The ratio of exponential means of squares; 0 for the first nlta samples."""
    short, long = (recurrence(x * x / n, -(1 - 1 / n)) for n in (nsta, nlta))
    out = np.divide(short, long, out=np.zeros(len(x)), where=long > 0)
    out[:nlta] = 0.0
    return out


def delayed_sta_lta(x: np.ndarray, nsta: int, nlta: int) -> np.ndarray:
    """The mean square of the last nsta samples over that of the nlta samples before them."""
    total = np.concatenate(([0.0], np.cumsum(x * x)))
    out, k = np.zeros(len(x)), np.arange(nsta + nlta - 1, len(x))
    short = (total[k + 1] - total[k + 1 - nsta]) / nsta
    long = (total[k + 1 - nsta] - total[k + 1 - nsta - nlta]) / nlta
    out[k] = np.divide(short, long, out=np.zeros(len(k)), where=long > 0)
    return out


def trailing_mean(x: np.ndarray, n: int) -> np.ndarray:
    """The mean of the last n samples, of fewer at the start."""
    total, k = np.concatenate(([0.0], np.cumsum(x))), np.arange(1, len(x) + 1)
    return (total[k] - total[np.maximum(k - n, 0)]) / np.minimum(k, n)


def carl_trigger(x: np.ndarray, nsta: int, nlta: int, ratio: float = 0.8, quiet: float = 0.8) -> np.ndarray:
    """star - ratio x ltar - |sta - lta| - quiet, over trailing means: sta and lta of values, star and ltar of their rectified rests."""
    sta = trailing_mean(x, nsta)
    lta = trailing_mean(sta, nlta)
    star = trailing_mean(np.abs(x - lta), nsta)
    return star - ratio * trailing_mean(star, nlta) - np.abs(sta - lta) - quiet


#: samples on which a result depends, for nsta and nlta
LOOKS_BACK: dict[str, Callable[[int, int], int]] = {
    "recstalta": lambda nsta, nlta: int(np.ceil(np.log(FORGOTTEN) / np.log1p(-1 / max(2, nsta, nlta)))),
    "delayedstalta": lambda nsta, nlta: nsta + nlta,
    "carlstatrig": lambda nsta, nlta: 2 * (nsta + nlta),
}
CHARACTERISTIC = {"recstalta": recursive_sta_lta, "delayedstalta": delayed_sta_lta, "carlstatrig": carl_trigger}


def characteristic(samples: DataFrame, name: str, nsta: int, nlta: int, **blocks: int) -> DataFrame:
    if name not in CHARACTERISTIC:
        raise ValueError(f"name must be one of {', '.join(CHARACTERISTIC)}")
    work = CHARACTERISTIC[name]
    return by_segment(samples, lambda x: work(x, nsta, nlta), margin=LOOKS_BACK[name](nsta, nlta), **blocks)


def fourier_resample(x: np.ndarray, n: int, window: str | None = None) -> np.ndarray:
    """n samples over the span of x, by cutting or padding its spectrum; window hann weighs the spectrum down to its highest frequency."""
    spectrum = np.fft.rfft(x)
    if window == "hann":
        spectrum = spectrum * (0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(len(spectrum)) + len(x) // 2) / len(x)))
    elif window is not None:
        raise ValueError("window must be hann or None")
    out = np.zeros(n // 2 + 1, complex)
    m = min(len(spectrum), len(out))
    out[:m] = spectrum[:m]
    if n > len(x) and len(x) % 2 == 0:
        out[m - 1] /= 2  # the highest frequency of an even number of samples stands for its negative too
    if n < len(x) and n % 2 == 0:
        out[-1] = 2 * out[-1].real if len(spectrum) > m else out[-1].real
    return np.fft.irfft(out, n) * n / len(x)


def resample(packets: DataFrame, factor: float, *keys: str, window: str | None = None) -> DataFrame:
    """Packets (keys, start, data, fold) at `factor` times their rate: Fourier for data, linear for folds.

    start counts samples of the new rate; samples past the span of a packet go. A packet is a bounded array; masked ones
    must be split first. At a factor above 1, one sample stays as it is, two or three are joined by the one wave through them.
    """

    def run(batches):
        for batch in batches:
            made: list[tuple[list[float], list[float]]] = []
            for data, fold in zip(batch["data"], batch["fold"], strict=True):
                x, f = np.asarray(data, float), np.asarray(fold, float)
                if np.isnan(x).any():
                    raise ValueError("masked packets must be split before they are resampled")
                n = max(1, int(round(len(x) * factor)))
                at = np.arange(n) / factor
                inside = at <= len(x) - 1
                made.append((fourier_resample(x, n, window)[inside].tolist(), np.interp(at, np.arange(len(f)), f)[inside].tolist()))
            batch["data"], batch["fold"] = [m[0] for m in made], [m[1] for m in made]
            batch["start"] = np.rint(batch["start"] * factor).astype(np.int64)
            yield batch

    rows = packets.select(*keys, "start", "data", "fold")
    return rows.mapInPandas(run, rows.schema)


def fit_gaussian(x: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares height, mean and deviation of a gaussian, by Levenberg-Marquardt, and their covariance."""
    p = np.array([y.max(), x[y.argmax()], max((x[-1] - x[0]) / 6, 1e-3)], float)
    shape = lambda q: q[0] * np.exp(-((x - q[1]) ** 2) / (2 * q[2] ** 2))

    def slopes(q):
        e = np.exp(-((x - q[1]) ** 2) / (2 * q[2] ** 2))
        return np.stack([e, q[0] * e * (x - q[1]) / q[2] ** 2, q[0] * e * (x - q[1]) ** 2 / q[2] ** 3], axis=1)

    damp, rest = 1e-3, y - shape(p)
    for _ in range(rounds):
        j = slopes(p)
        normal = j.T @ j
        step = np.linalg.lstsq(normal + damp * np.diag(np.maximum(np.diag(normal), 1e-12)), j.T @ rest, rcond=None)[0]
        new = p + step
        new[2] = abs(new[2]) + 1e-12
        after = y - shape(new)
        if after @ after < rest @ rest:
            small = np.abs(step).max() < 1e-10 * (1 + np.abs(p).max())
            p, rest, damp = new, after, damp / 5
            if small:
                break
        else:
            damp *= 5
    j = slopes(p)
    spread = rest @ rest / max(1, len(x) - 3)
    return p, np.linalg.pinv(j.T @ j) * spread


def gaussian_fits(inside: DataFrame, by: Sequence[str] = ("id", "on"), x: str = "idx", y: str = "value", most: int = 100_000) -> DataFrame:
    """height, mean, std, covariance (rows) and l2 of a gaussian fitted to the samples of each trigger with at least four.

    A trigger of at most `most` samples is fitted in one task; the sums of a longer one are grouped sums, round by round.
    """
    live = inside.where(F.col(y).isNotNull())
    sizes = live.groupBy(*by).agg(F.count("*").alias("n_"))
    long = sizes.where(F.col("n_") > most).select(*by)
    if long.isEmpty():
        return _fits_by_task(inside, by, x, y)
    return _fits_by_task(inside.join(long, list(by), "left_anti"), by, x, y).unionByName(_fits_by_sums(live.join(long, list(by), "left_semi"), by, x, y))


def _fits_by_sums(live: DataFrame, by: Sequence[str], x: str, y: str, rounds: int = 200) -> DataFrame:
    """The same fits with all sums over samples as grouped aggregates: each round sums up the slopes at the parameters on trial, and a step of
    Levenberg and Marquardt on one row a trigger keeps them or goes back. Each round's parameters are stored.
    """
    at = live.select(*by, F.col(x).cast("double").alias("x_"), F.col(y).cast("double").alias("y_"))
    first = at.groupBy(*by).agg(F.min("x_").alias("origin"), F.max("y_").alias("a_"), (F.max_by("x_", "y_") - F.min("x_")).alias("b_"), F.greatest((F.max("x_") - F.min("x_")) / 6, F.lit(1e-3)).alias("c_"))
    state = first.select(*by, "origin", F.array("a_", "b_", "c_").alias("trial"), F.lit(None).cast("array<double>").alias("best"), F.lit(None).cast("array<double>").alias("sums"), F.lit(1e-3).alias("damp"), F.lit(False).alias("done"))
    state = stored(state)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema)
    for _ in range(rounds):
        placed = at.join(state.select(*by, "origin", "trial"), list(by))
        u = F.col("x_") - F.col("origin") - F.col("trial")[1]
        c = F.col("trial")[2]
        e = F.exp(-u * u / (2 * c * c))
        j = (e, F.col("trial")[0] * e * u / (c * c), F.col("trial")[0] * e * u * u / (c * c * c))
        rest = F.col("y_") - F.col("trial")[0] * e
        pairs = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
        summed = placed.groupBy(*by).agg(F.array(*[F.sum(j[p] * j[q]) for p, q in pairs], *[F.sum(v * rest) for v in j], F.sum(rest * rest), F.count("*").cast("double")).alias("new_"))

        def step(batches):
            for rows in batches:
                out = rows.drop(columns="new_").copy()
                for k in range(len(rows)):
                    new, old = np.array(rows["new_"].iat[k]), rows["sums"].iat[k]
                    trial, damp = np.array(rows["trial"].iat[k]), rows["damp"].iat[k]
                    better = old is None or new[9] < old[9]
                    still = better and old is not None and np.abs(trial - np.array(rows["best"].iat[k])).max() < 1e-10 * (1 + np.abs(trial).max())
                    best, sums, damp = (trial, new, damp / 5) if better else (np.array(rows["best"].iat[k]), np.array(old), damp * 5)
                    normal = np.array([[sums[0], sums[1], sums[2]], [sums[1], sums[3], sums[4]], [sums[2], sums[4], sums[5]]])
                    moved = best + np.linalg.lstsq(normal + damp * np.diag(np.maximum(np.diag(normal), 1e-12)), sums[6:9], rcond=None)[0]
                    moved[2] = abs(moved[2]) + 1e-12
                    for name, value in (("trial", moved), ("best", best), ("sums", sums)):
                        out[name] = out[name].astype(object)
                        out[name].iat[k] = value.tolist()
                    out.iloc[k, out.columns.get_loc("damp")] = damp
                    out.iloc[k, out.columns.get_loc("done")] = bool(rows["done"].iat[k] or still or damp > 1e8)
                yield out

        state = stored(state.join(summed, list(by)).mapInPandas(step, kinds))
        if state.where("not done").isEmpty():
            break
    fields = ", ".join(f"`{c}` {live.schema[c].dataType.simpleString()}" for c in by) + ", height double, mean double, std double, covariance array<array<double>>, l2 double"

    def told(batches):
        for rows in batches:
            out = rows[list(by)].copy()
            best, sums = np.stack(rows["best"]), np.stack(rows["sums"])
            out["height"], out["mean"], out["std"] = best[:, 0], rows["origin"].to_numpy() + best[:, 1], best[:, 2]
            normal = sums[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
            out["covariance"] = [(np.linalg.pinv(m) * r / max(1, n - 3)).tolist() for m, r, n in zip(normal, sums[:, 9], sums[:, 10], strict=True)]
            out["l2"] = np.sqrt(sums[:, 9])
            yield out

    return state.mapInPandas(told, fields)


def _fits_by_task(inside: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in inside.schema}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=[y]).sort_values(x)
        head = {c: [rows[c].iloc[0]] for c in by} if len(rows) else {}
        if len(rows) < 4:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in (*by, "height", "mean", "std", "covariance", "l2")})
        at, values = rows[x].to_numpy(float), rows[y].to_numpy(float)
        origin = at[0]
        p, cov = fit_gaussian(at - origin, values)
        rest = values - p[0] * np.exp(-((at - origin - p[1]) ** 2) / (2 * p[2] ** 2))
        return pd.DataFrame({**head, "height": [p[0]], "mean": [origin + p[1]], "std": [p[2]], "covariance": [cov.tolist()], "l2": [float(np.sqrt(rest @ rest))]})

    fields = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", height double, mean double, std double, covariance array<array<double>>, l2 double"
    return inside.groupBy(*by).applyInPandas(run, fields)
