"""A ring buffer of one series: its newest samples over a fixed length, with folds. Pure state logic, used by the streaming
processors and by tests against the batch operators.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

METHODS = ("drop", "max", "mean")
PAST = ("late", "restricted", "unrestricted")


@dataclass
class Ring:
    """Samples start to start + len(value) - 1; masked ones are NaN with fold 0."""

    length: int
    method: str = "mean"
    past: str = "late"
    edge: str = "end"
    start: int = 0
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    fold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    late: int = 0
    resets: int = 0

    def __post_init__(self):
        if self.length < 1 or self.method not in METHODS:
            raise ValueError(f"length must be positive and method one of {', '.join(METHODS)}")
        if self.past not in PAST or self.edge not in ("start", "end"):
            raise ValueError(f"past must be one of {', '.join(PAST)}, and edge start or end")

    @property
    def end(self) -> int:
        return self.start + len(self.value) - 1

    def _set(self, start: int, value: np.ndarray, fold: np.ndarray) -> None:
        """The newest `length` samples up to the end of a packet, padded before its start."""
        end = start + len(value) - 1
        self.start = end - self.length + 1
        self.value, self.fold = np.full(self.length, np.nan), np.zeros(self.length)
        n = min(self.length, len(value))
        self.value[self.length - n :], self.fold[self.length - n :] = value[len(value) - n :], fold[len(fold) - n :]

    def _first(self, start: int, value: np.ndarray, fold: np.ndarray) -> None:
        """The first packet: its end (or start) is the buffer's, and what does not fit at the other edge goes."""
        if self.edge == "end":
            self._set(start, value, fold)
            return
        self.start, n = start, min(self.length, len(value))
        self.value, self.fold = np.full(self.length, np.nan), np.zeros(self.length)
        self.value[:n], self.fold[:n] = value[:n], fold[:n]

    def slide(self, to: int, edge: str = "end") -> None:
        """Move the buffer so that its end (or start) is sample `to`; what moves out goes, and what comes in is masked."""
        shift = to - (self.end if edge == "end" else self.start)
        value, fold = np.full(self.length, np.nan), np.zeros(self.length)
        low, high = max(0, shift), min(self.length, self.length + shift)
        if low < high:
            value[low - shift : high - shift], fold[low - shift : high - shift] = self.value[low:high], self.fold[low:high]
        self.value, self.fold, self.start = value, fold, self.start + shift

    def append(self, start: int, value: np.ndarray, fold: np.ndarray) -> str:
        """Take a packet: `first`, `joined`, `reset` (nothing of the buffer would remain), `late` (it ends before the buffer's start) or
        `empty`.

        The buffer's end is the latest end of all packets, so its scope never moves back, unless past is `unrestricted`: then a packet that
        begins no later than the buffer and ends before it moves the buffer back to the packet's end, or takes its place if nothing would remain.
        `restricted` takes the part of such a packet that lies within the buffer, as `late` does.
        """
        value, fold = np.asarray(value, float), np.where(np.isnan(np.asarray(value, float)), 0.0, np.asarray(fold, float))
        if not len(value):
            return "empty"
        if not len(self.value):
            self._first(start, value, fold)
            return "first"
        end = start + len(value) - 1
        if self.past == "unrestricted" and start <= self.start and end < self.end:
            if self.start - end >= self.length:
                self.resets += 1
                self._first(start, value, fold)
                return "reset"
            self.slide(end)
        if max(end, self.end) - self.length + 1 > self.end:
            self.resets += 1
            self._set(start, value, fold)
            return "reset"
        if end < self.start:
            self.late += 1
            return "late"
        shift = max(0, end - self.end)
        if shift:
            self.value = np.concatenate([self.value, np.full(shift, np.nan)])[-self.length :]
            self.fold = np.concatenate([self.fold, np.zeros(shift)])[-self.length :]
            self.start += shift
        low = max(start, self.start)
        here, there = slice(low - self.start, end - self.start + 1), slice(low - start, None)
        self.value[here], self.fold[here] = merge(self.value[here], self.fold[here], value[there], fold[there], self.method)
        return "joined"


def merge(a: np.ndarray, fa: np.ndarray, b: np.ndarray, fb: np.ndarray, method: str) -> tuple[np.ndarray, np.ndarray]:
    """Two aligned pieces become one, sample by sample."""
    only_a, only_b = np.isnan(b), np.isnan(a)
    both, total = ~only_a & ~only_b, fa + fb
    with np.errstate(divide="ignore", invalid="ignore"):
        met = {"drop": np.full(len(a), np.nan), "max": np.fmax(a, b), "mean": (a * fa + b * fb) / total}[method]
    value = np.where(both, met, np.where(only_a, a, b))
    value = np.where(np.isinf(value), np.nan, value)
    return value, np.where(np.isnan(value), 0.0, np.where(both, total, np.where(only_a, fa, fb)))
