"""Live detection: windows of instruments and triggers of score series as keyed state with event-time timers.

Samples come in any order within `mute` samples of the newest one of their key; what lies further back is final and is consumed once, in order,
so results don't depend on how the stream is cut into batches. A timer goes off when the watermark has passed a key's newest sample by `timeout`
samples: the key is silent, what it holds becomes final at once, and its state goes. A longer gap within a key counts as such a silence, too. Rows
leave with `known`, the end of the newest sample they depend on (or the watermark that set off the timer), as event time for a next operator.

Later than `mute` samples behind, a sample is dropped. State a key: the samples of the newest `mute` (and of a window), and one open run.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

Cells = tuple[np.ndarray, np.ndarray, np.ndarray]  # idx, sum of value x fold, fold
EMPTY: Cells = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))


def merged(parts: Sequence[Cells]) -> Cells:
    """Cells in order of idx, each once."""
    idx, total, fold = (np.concatenate(x) for x in zip(*parts, strict=True))
    cells, inverse = np.unique(idx, return_inverse=True)
    return cells.astype(np.int64), np.bincount(inverse, total, len(cells)), np.bincount(inverse, fold, len(cells))


def cells(rows: pd.DataFrame) -> Cells:
    """Rows (idx, value, fold) that hold a value, as cells."""
    value, fold = rows["value"].to_numpy(np.float64), rows["fold"].to_numpy(np.float64)
    held = ~np.isnan(value) & (fold > 0)
    return merged([(rows["idx"].to_numpy()[held], value[held] * fold[held], fold[held])])


class Timed(StatefulProcessor):
    """Keeps one timer a key, at the end of its newest sample and `timeout` more."""

    def __init__(self, step_us: int, mute: int, timeout: int):
        if not 0 <= mute < timeout:
            raise ValueError("mute must be less than timeout, and neither negative")
        self.step_us, self.mute, self.timeout = step_us, mute, timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("series", self.STATE)

    def end_ms(self, idx: int) -> int:
        return -(-(idx + 1) * self.step_us // 1000)

    def renew(self, newest: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(self.end_ms(newest + self.timeout))

    def close(self) -> None:
        pass


def known(ms: int, n: int) -> pd.Series:
    return pd.Series(pd.to_datetime([ms] * n, unit="ms", utc=True))


class Runs:
    """Threshold excursions of final samples, fed in order: open is the run that may go on: last, on, npts, p_max, at_max, fold sum, lowest fold but that of
    the last sample, fold of the last sample; on is None before a sample above thr_on.
    """

    def __init__(self, thr_on: float, thr_off: float, open_: tuple | None = None):
        self.thr_on, self.thr_off, self.open, self.closed = thr_on, thr_off, open_, []

    def close(self) -> None:
        if self.open is not None and self.open[1] is not None:
            last, on, npts, p_max, at_max, total, low, _ = self.open
            self.closed.append((on, last, npts, p_max, at_max, total / npts, low))
        self.open = None

    def feed(self, idx: np.ndarray, value: np.ndarray, fold: np.ndarray, done: int) -> None:
        """Samples in order, all up to `done`; the run that reaches it stays open."""
        above = np.nonzero(value > self.thr_off)[0]
        for part in np.split(above, np.nonzero(np.diff(idx[above]) != 1)[0] + 1):
            if not len(part):
                continue
            if self.open is not None and idx[part[0]] != self.open[0] + 1:
                self.close()
            on = None if self.open is None else self.open[1]
            if on is None:
                over = np.nonzero(value[part] > self.thr_on)[0]
                if not len(over):
                    self.open = (int(idx[part[-1]]), None, 0, 0.0, 0, 0.0, float("inf"), float("inf"))
                    continue
                part = part[over[0] :]
                on, held = int(idx[part[0]]), (0, -float("inf"), 0, 0.0, float("inf"), float("inf"))
            else:
                held = self.open[2:]
            npts, p_max, at_max, total, low, before = held
            top = part[int(np.argmax(value[part]))]
            if value[top] > p_max:
                p_max, at_max = float(value[top]), int(idx[top])
            low = min(low, before, float(fold[part[:-1]].min(initial=float("inf"))))
            self.open = (int(idx[part[-1]]), on, npts + len(part), p_max, at_max, total + float(fold[part].sum()), low, float(fold[part[-1]]))
        if self.open is not None and self.open[0] < done:
            self.close()


class TriggerProcessor(Timed):
    """Triggers of a series of samples (idx, value, fold), each once its end is older than the newest `mute` samples."""

    STATE = "idx array<long>, total array<double>, fold array<double>, newest long, run struct<last:long,on:long,npts:long,p_max:double,at_max:long,total:double,low:double,before:double>"
    COLUMNS = ("on", "off", "npts", "p_max", "at_max", "fold_mean", "low")

    def __init__(self, thr_on: float, thr_off: float, step_us: int, mute: int, timeout: int):
        if thr_off > thr_on:
            raise ValueError("thr_off must not exceed thr_on")
        super().__init__(step_us, mute, timeout)
        self.thr_on, self.thr_off = thr_on, thr_off

    def load(self) -> tuple[Cells, int | None, Runs]:
        if not self.state.exists():
            return EMPTY, None, Runs(self.thr_on, self.thr_off)
        idx, total, fold, newest, run = self.state.get()
        return (np.array(idx, np.int64), np.array(total, float), np.array(fold, float)), newest, Runs(self.thr_on, self.thr_off, None if run is None else tuple(run))

    def told(self, key, runs: Runs, ms: int) -> Iterator[pd.DataFrame]:
        if runs.closed:
            yield pd.DataFrame(runs.closed, columns=list(self.COLUMNS)).assign(id=key[0], known=known(ms, len(runs.closed)))[["id", *self.COLUMNS, "known"]]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, newest, runs = self.load()
        done = -(1 << 62) if newest is None else newest - self.mute
        for frame in rows:  # a frame at a time: only cells are kept
            held = merged([held, cells(frame)])
        keep = held[0] > done
        idx, total, fold = (x[keep] for x in held)
        if not len(idx):
            return
        newest = int(idx[-1]) if newest is None else max(newest, int(idx[-1]))
        final = idx <= newest - self.mute
        runs.feed(idx[final], total[final] / fold[final], fold[final], newest - self.mute)
        self.state.update((idx[~final].tolist(), total[~final].tolist(), fold[~final].tolist(), newest, runs.open))
        self.renew(newest)
        yield from self.told(key, runs, self.end_ms(newest))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (idx, total, fold), newest, runs = self.load()
        if newest is None:
            return
        runs.feed(idx, total / fold, fold, newest)
        runs.close()
        self.state.clear()
        yield from self.told(key, runs, timerValues.getCurrentWatermarkInMs())


def triggers(samples: DataFrame, thr_on: float, thr_off: float, step_us: int, mute: int, timeout: int) -> DataFrame:
    """A stream of samples (id, idx, value, fold, and an event time with a watermark) as a stream of closed triggers."""
    made = TriggerProcessor(thr_on, thr_off, step_us, mute, timeout)
    schema = "id string, on long, off long, npts long, p_max double, at_max long, fold_mean double, low double, known timestamp"
    return samples.groupBy("id").transformWithStateInPandas(made, schema, "append", "EventTime", eventTimeColumnName="known")


class WindowProcessor(Timed):
    """Windows of an instrument's components: instrument, k, first, tensor, fold.

    Windows are anchored at the first sample of the primary (first) component and don't wait for each other. A window leaves once all its samples are
    final, if its primary has enough of them; a secondary that has not is replaced by the first one that has, or the primary, with fold 0. Gaps have value
    and fold 0; fold sums that of all components.
    """

    STATE = "component array<int>, idx array<long>, total array<double>, fold array<double>, newest long, last long, anchor long, k long"

    def __init__(self, components: str, length: int, step: int, primary_share: float, secondary_share: float, step_us: int, mute: int, timeout: int, tolerance: float = 1e-3):
        super().__init__(step_us, mute, timeout)
        self.components, self.length, self.step, self.shares, self.tolerance = components, length, step, (primary_share, secondary_share), tolerance

    def load(self) -> tuple[list[Cells], int | None, int | None, int | None, int]:
        if not self.state.exists():
            return [EMPTY] * len(self.components), None, None, None, 0
        component, idx, total, fold, newest, last, anchor, k = self.state.get()
        component, rest = np.array(component), [np.array(idx, np.int64), np.array(total, float), np.array(fold, float)]
        return [tuple(x[component == c] for x in rest) for c in range(len(self.components))], newest, last, anchor, k

    def window(self, held: list[Cells], first: int) -> tuple | None:
        values, folds, good = [], [], []
        for c, (idx, total, fold) in enumerate(held):
            a, b = np.searchsorted(idx, [first, first + self.length])
            value, weight = np.zeros(self.length), np.zeros(self.length)
            value[idx[a:b] - first], weight[idx[a:b] - first] = total[a:b] / fold[a:b], fold[a:b]
            values.append(value)
            folds.append(weight)
            good.append(b > a and (weight >= 1).sum() / self.length + self.tolerance >= self.shares[c > 0])
        if not good[0]:
            return None
        other = next((c for c in range(1, len(held)) if good[c]), 0)
        tensor = [(values[c] if good[c] else values[other]).astype(np.float32).tolist() for c in range(len(held))]
        return tensor, np.sum([folds[c] if good[c] else np.zeros(self.length) for c in range(len(held))], axis=0).tolist()

    def ready(self, held: list[Cells], anchor: int | None, k: int, done: int, silent: bool) -> tuple[list[tuple], int | None, int]:
        """Windows whose samples are all final (up to done), or, of a silent instrument, all that begin by done; and where to go on."""
        out = []
        if anchor is None:
            primary = held[0][0][held[0][0] <= done]
            if not len(primary):
                return out, None, 0
            anchor = int(primary[0])
        while (anchor + k * self.step if silent else anchor + k * self.step + self.length - 1) <= done:
            first = anchor + k * self.step
            made = self.window([tuple(x[c[0] <= done] for x in c) for c in held] if silent else held, first)
            if made is not None:
                out.append((k, first, *made))
            k += 1
        return out, anchor, k

    def cut(self, held: list[Cells], final: np.ndarray, last: int | None, anchor: int | None, k: int) -> tuple[list[tuple], list[Cells], int | None, int | None, int]:
        """The windows before each gap among final samples that is as long as a silence, and what goes on after the last one."""
        out = []
        before = np.concatenate([final[:1] if last is None else [last], final[:-1]])
        for gap in np.nonzero(final - before > self.timeout)[0].tolist():
            out += self.ready(held, anchor, k, int(before[gap]), True)[0]
            held, anchor, k = [tuple(x[c[0] >= final[gap]] for x in c) for c in held], None, 0
        return out, held, int(final[-1]) if len(final) else last, anchor, k

    def told(self, key, out: list[tuple], ms: int) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=["k", "first", "tensor", "fold"]).assign(instrument=key[0], known=known(ms, len(out)))[["instrument", "k", "first", "tensor", "fold", "known"]]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, newest, last, anchor, k = self.load()
        past = -(1 << 62) if newest is None else newest - self.mute
        for frame in rows:
            for c, letter in enumerate(self.components):
                fresh = cells(frame[frame["component"] == letter])
                late = fresh[0] <= past
                held[c] = merged([held[c], tuple(x[~late] for x in fresh)])
        idx = np.unique(np.concatenate([c[0] for c in held]))
        idx = idx[idx > past]
        if not len(idx):
            return
        newest = int(idx[-1]) if newest is None else max(newest, int(idx[-1]))
        done = newest - self.mute
        out, held, last, anchor, k = self.cut(held, idx[idx <= done], last, anchor, k)
        made, anchor, k = self.ready(held, anchor, k, done, False)
        out += made
        if anchor is not None:
            held = [tuple(x[c[0] >= anchor + k * self.step] for x in c) for c in held]
        else:  # nothing before a primary sample counts
            held = [tuple(x[c[0] > done] for x in c) for c in held]
        component = np.concatenate([np.full(len(c[0]), n) for n, c in enumerate(held)])
        idx, total, fold = (np.concatenate(x) for x in zip(*held, strict=True))
        self.state.update((component.astype(int).tolist(), idx.astype(int).tolist(), total.tolist(), fold.tolist(), newest, last, anchor, k))
        self.renew(newest)
        yield from self.told(key, out, self.end_ms(newest))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, newest, last, anchor, k = self.load()
        if newest is None:
            return
        idx = np.unique(np.concatenate([c[0] for c in held]))
        out, held, _, anchor, k = self.cut(held, idx if last is None else idx[idx > last], last, anchor, k)
        out += self.ready(held, anchor, k, newest, True)[0]
        self.state.clear()
        yield from self.told(key, out, timerValues.getCurrentWatermarkInMs())


def instrument_windows(
    samples: DataFrame, components: str, length: int, step: int, step_us: int, mute: int, timeout: int, primary_share: float = 0.95, secondary_share: float = 0.8
) -> DataFrame:
    """A stream of samples (instrument, component, idx, value, fold, and an event time with a watermark) as a stream of repaired windows."""
    made = WindowProcessor(components, length, step, primary_share, secondary_share, step_us, mute, timeout)
    times = [f.name for f in samples.schema if "spark.watermarkDelayMs" in f.metadata]
    counts = F.col("component").isin(*components) & F.col("value").isNotNull() & ~F.isnan("value") & (F.col("fold") > 0)
    for time in times:  # a condition on the event time stays above its watermark, which all rows move on
        counts |= F.col(time).isNull()
    samples = samples.where(counts).select("instrument", "component", "idx", "value", "fold", *times)
    schema = "instrument string, k long, first long, tensor array<array<float>>, fold array<double>, known timestamp"
    return samples.groupBy("instrument").transformWithStateInPandas(made, schema, "append", "EventTime", eventTimeColumnName="known")
