"""Keyed streaming operators: ring buffers, delayed windows and muted triggers, as stateful processors.

State is one row of arrays a key, bounded by the buffer's length. Lateness is judged against each key's own buffer, which
the query's one watermark can't do; the watermark, where set, only bounds what a source replays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foldloom.streaming.ring import Ring

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
PACKET = ("id", "start", "data", "fold")
#: samples that a task merges at once before it deals them out; they and their merged form are all it holds
GATHERED = 1 << 16
STATE = "start long, value array<double>, fold array<double>, late long, resets long, next long"


class _Buffered(StatefulProcessor):
    """Keeps a Ring in state and feeds it a batch's samples in order."""

    def __init__(self, length: int, method: str, past: str = "late", edge: str = "end"):
        self.length, self.method, self.past, self.edge = length, method, past, edge

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("ring", STATE)

    def load(self) -> tuple[Ring, int | None]:
        ring = Ring(self.length, self.method, self.past, self.edge)
        if not self.state.exists():
            return ring, None
        start, value, fold, late, resets, following = self.state.get()
        ring.start, ring.late, ring.resets = start, late, resets
        ring.value, ring.fold = np.array([np.nan if v is None else v for v in value], float), np.array(fold, float)
        return ring, following

    def save(self, ring: Ring, following: int | None) -> None:
        value = [None if np.isnan(v) else float(v) for v in ring.value]
        self.state.update((int(ring.start), value, [float(f) for f in ring.fold], int(ring.late), int(ring.resets), following))

    def packets(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """A batch's packets (start, data, fold) of a key, in order.

        Means and maxima don't depend on what is merged first, so each frame is merged by sample number as it comes and only samples are held, not
        packets; runs of them then leave in packets, their first sample by itself and the others in pieces shorter than the ring. Dropping is not of that
        kind, so its packets stay as they come.
        """
        if self.method == "drop":
            for r in pd.concat(list(rows), ignore_index=True).sort_values(["start"], kind="stable").itertuples():
                yield int(r.start), _floats(r.data), np.array(r.fold, float)
            return
        held: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        for frame in rows:
            sizes = frame["data"].map(len).to_numpy()
            first = np.repeat(np.cumsum(sizes) - sizes, sizes)
            idx = np.repeat(frame["start"].to_numpy(), sizes) + np.arange(len(first)) - first
            value, fold = _floats(np.concatenate(frame["data"].to_list())), np.concatenate(frame["fold"].to_list()).astype(float)
            held = self._merged(np.concatenate([held[0], idx]), np.concatenate([held[1], value]), np.concatenate([held[2], np.where(np.isnan(value), 0.0, fold)]))
        idx, value, fold = held
        step = max(1, self.length - 1)
        for part in np.split(np.arange(len(idx)), np.nonzero(np.diff(idx) != 1)[0] + 1):
            for at in (part[:1], *(part[k : k + step] for k in range(1, len(part), step))):
                if len(at):
                    yield int(idx[at[0]]), value[at], fold[at]

    def _merged(self, idx: np.ndarray, value: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(idx, kind="stable")
        idx, value, fold = idx[order], value[order], fold[order]
        starts = np.nonzero(np.diff(idx, prepend=idx[:1] - 1))[0]
        return idx[starts], *_cells(value, fold, starts, self.method)

    def close(self) -> None:
        pass


def _cells(value: np.ndarray, fold: np.ndarray, starts: np.ndarray, method: str) -> tuple[np.ndarray, np.ndarray]:
    """The value and fold of each cell of samples, of which each begins at one of `starts`; a sample by itself keeps its value."""
    alone = np.diff(starts, append=len(value)) == 1
    total, live = np.add.reduceat(fold, starts), ~np.isnan(value)
    with np.errstate(divide="ignore", invalid="ignore"):
        if method == "max":
            made = np.maximum.reduceat(np.where(live, value, -np.inf), starts)
            made[np.isinf(made)] = np.nan
        else:
            made = np.add.reduceat(np.where(live, value * fold, 0.0), starts) / total
            made = np.where(alone & (total > 0), value[starts], made)
    return made, np.where(np.isnan(made), 0.0, total)


def _floats(values: object) -> np.ndarray:
    return np.array([np.nan if v is None else v for v in values], float)


class BufferProcessor(_Buffered):
    """Emits the buffer of a key after each batch: id, start, value, fold, late, resets."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ring, _ = self.load()
        for start, data, fold in self.packets(rows):
            ring.append(start, data, fold)
        self.save(ring, None)
        value = [None if np.isnan(v) else float(v) for v in ring.value]
        yield pd.DataFrame({"id": [key[0]], "start": [ring.start], "value": [value], "fold": [ring.fold.tolist()], "late": [ring.late], "resets": [ring.resets]})


class WindowProcessor(_Buffered):
    """Emits ready windows of a key: id, first, value, fold.

    Windows are anchored at the key's first sample. A window that is not ready holds up those after it; once the buffer has
    moved past its start, the key is anchored anew at the buffer's first sample (catching up after an outage).

    consume: the folds of an emitted window go, so each sample counts in the first window that holds it only. timeout: a key without a new sample for
    so many is silent; every window that begins by its last sample and has enough valid samples leaves without delay, and the key's state goes. A gap as long
    within a batch ends a series likewise.
    """

    def __init__(self, length: int, method: str, window: int, step: int, min_valid: float, threshold: float, delay: int, consume: bool = False, timeout: int | None = None, step_us: int = 0):
        super().__init__(length, method)
        self.window, self.step, self.min_valid, self.threshold, self.delay = window, step, min_valid, threshold, delay
        self.consume, self.timeout, self.step_us = consume, timeout, step_us

    def end_ms(self, idx: int) -> int:
        return -(-(idx + 1) * self.step_us // 1000)

    def take(self, ring: Ring, first: int) -> tuple | None:
        """The window that begins at `first`, as far as the ring reaches, if enough of it is valid."""
        at = slice(first - ring.start, first - ring.start + self.window)
        fold = np.zeros(self.window)
        fold[: len(ring.fold[at])] = ring.fold[at]
        if (fold >= self.threshold).mean() < self.min_valid:
            return None
        value = np.full(self.window, np.nan)
        value[: len(ring.value[at])] = ring.value[at]
        if self.consume:
            ring.fold[at] = 0.0
        return first, [None if np.isnan(v) else float(v) for v in value], fold.tolist()

    def ready(self, ring: Ring, following: int) -> tuple[list[tuple], int]:
        """The windows that can leave now, and the start of the next one."""
        out = []
        while ring.end - self.delay > following + self.window - 1:
            if following < ring.start:
                live = np.nonzero(ring.fold > 0)[0]
                if not len(live):
                    break
                following = ring.start + int(live[0])
                continue
            made = self.take(ring, following)
            if made is None:
                break
            out.append(made)
            following += self.step
        return out, following

    def last(self, ring: Ring, following: int | None) -> list[tuple]:
        """The windows of a series that has ended."""
        live = np.nonzero(ring.fold > 0)[0]
        if following is None or not len(live):
            return []
        following = following if following >= ring.start else ring.start + int(live[0])
        return [made for first in range(following, ring.end + 1, self.step) if (made := self.take(ring, first)) is not None]

    def told(self, key, out: list[tuple], ms: int) -> Iterator[pd.DataFrame]:
        if out:
            found = pd.DataFrame(out, columns=["first", "value", "fold"])
            found.insert(0, "id", key[0])
            yield found if self.timeout is None else found.assign(known=pd.Series(pd.to_datetime([ms] * len(out), unit="ms", utc=True)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ring, following = self.load()
        out = []
        for start, data, fold in self.packets(rows):
            if self.timeout is not None and len(ring.value) and start - ring.end > self.timeout:
                out += self.last(ring, following)
                ring, following = Ring(self.length, self.method), None
            if following is None:
                following = start
            while len(data):
                # no window can leave before the sample that ends its delay, so what comes before is one packet
                n = max(1, min(len(data), following + self.window + self.delay - start))
                ring.append(start, data[:n], fold[:n])
                start, data, fold = start + n, data[n:], fold[n:]
                made, following = self.ready(ring, following)
                out += made
        self.save(ring, following)
        if self.timeout is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(self.end_ms(ring.end + self.timeout))
        yield from self.told(key, out, self.end_ms(ring.end))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            ring, following = self.load()
            self.state.clear()
            yield from self.told(key, self.last(ring, following), timerValues.getCurrentWatermarkInMs())


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, joined until they hold GATHERED samples."""
    held, samples = [], 0
    for batch in batches:
        held.append(batch)
        samples += len(batch.column("data").flatten())
        if samples >= GATHERED:
            yield pa.concat_batches(held)
            held, samples = [], 0
    if held:
        yield pa.concat_batches(held)


def _packed(batches: Iterator[pa.RecordBatch], method: str) -> Iterator[pa.RecordBatch]:
    """Batches of packets, the samples of each batch merged by id and number and put into one packet a run.

    A batch with a packet that is empty, null or of unequal lists, or with a value or fold that does not merge in any order, stays as it is.
    """
    for batch in _gathered(batches):
        ids, start, data, folds = (batch.column(c) for c in PACKET)
        size = pc.list_value_length(data)
        if not batch.num_rows or start.null_count or data.null_count or folds.null_count or pc.min(size).as_py() < 1 or not size.equals(pc.list_value_length(folds)):
            yield batch
            continue
        size, value, fold = size.to_numpy(), data.flatten().to_numpy(zero_copy_only=False), folds.flatten().to_numpy(zero_copy_only=False)
        live = ~np.isnan(value)
        if np.isinf(value).any() or not (np.isfinite(fold) & (fold > 0))[live].all():
            yield batch
            continue
        ids = pc.dictionary_encode(ids, null_encoding="encode")
        key, first = np.repeat(ids.indices.to_numpy(), size), np.repeat(np.cumsum(size) - size, size)
        idx = np.repeat(start.to_numpy(), size) + np.arange(len(first)) - first
        order = np.lexsort((idx, key))
        key, idx = key[order], idx[order]
        apart = lambda key, idx, by: np.nonzero(np.concatenate([[True], (np.diff(key) != 0) | by(np.diff(idx))]))[0]
        cells = apart(key, idx, lambda step: step != 0)
        key, idx = key[cells], idx[cells]
        value, fold = _cells(value[order], np.where(live, fold, 0.0)[order], cells, method)
        runs = apart(key, idx, lambda step: step != 1)
        ends = np.append(runs, len(idx)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(value, mask=np.isnan(value)), pa.array(fold))]
        yield pa.RecordBatch.from_arrays([ids.dictionary.take(pa.array(key[runs])), pa.array(idx[runs]), *lists], names=[*PACKET])


def packed(packets: DataFrame, method: str) -> DataFrame:
    """Packets (id, start, data, fold) merged before they are dealt out by id, as far as they come together in a task: an operator with state gets its rows one by one,
    so it should get few. Dropping depends on the number of packets, so there they stay as they are.
    """
    if method == "drop" or sorted(packets.columns) != sorted(PACKET):
        return packets
    kinds = {"start": "bigint", "data": "array<double>", "fold": "array<double>"}
    rows = packets.select("id", *[F.col(c).cast(t).alias(c) for c, t in kinds.items()])
    schema = f"id {packets.schema['id'].dataType.simpleString()}, {', '.join(f'{c} {t}' for c, t in kinds.items())}"
    return rows.mapInArrow(partial(_packed, method=method), schema)


def buffered(packets: DataFrame, length: int, method: str = "mean", mode: str = "update", past: str = "late", edge: str = "end") -> DataFrame:
    """A stream of packets (id, start, data, fold) as the state of each id's ring buffer after each batch. past, edge: see Ring."""
    made = BufferProcessor(length, method, past, edge)
    return packed(packets, method).groupBy("id").transformWithStateInPandas(made, "id string, start long, value array<double>, fold array<double>, late long, resets long", mode, "None")


def windowed(
    packets: DataFrame, length: int, window: int, step: int, min_valid: float = 0.9, threshold: float = 1.0, delay: int = 0, method: str = "mean", consume: bool = False, timeout: int | None = None, step_us: int = 0
) -> DataFrame:
    """A stream of packets as a stream of ready windows; length is that of the ring buffer behind them.

    timeout (samples of step_us each) needs an event time with a watermark; the rows then have `known`, the event time at which they left.
    """
    if length < window + delay:
        raise ValueError("the buffer must hold a window and its delay")
    made = WindowProcessor(length, method, window, step, min_valid, threshold, delay, consume, timeout, step_us)
    schema = "id string, first long, value array<double>, fold array<double>"
    if timeout is None:
        return packets.groupBy("id").transformWithStateInPandas(made, schema, "append", "None")
    return packets.groupBy("id").transformWithStateInPandas(made, f"{schema}, known timestamp", "append", "EventTime", eventTimeColumnName="known")


def gridded(rows: DataFrame, time: str, value: Column, keys: dict[str, Column], every: str, lateness: str) -> DataFrame:
    """A stream of raw rows as grid cells: window start, keys, mean and number of values. Needs a timestamp column."""
    marked = rows.withWatermark(time, lateness)
    return marked.groupBy(F.window(time, every).alias("cell"), *[c.alias(n) for n, c in keys.items()]).agg(F.avg(value).alias("value"), F.count(value).alias("fold"))


def unmuted(found: DataFrame, newest: Column, mute: int) -> DataFrame:
    """Triggers that end more than `mute` samples before the newest one; the rest wait for a later batch."""
    return found.where(F.col("off") < newest - mute)
