"""Composition of operators: named transforms from a whitelist, checked between steps, and the picking sequence."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.functions import checks
from foldloom.operators import collate, dsp, measure, predict, select, series, stack, trigger, windows

Transform = Callable[..., DataFrame]
log = logging.getLogger("foldloom")

#: the operators that a declared pipeline may name; nothing else runs
OPERATORS: dict[str, Transform] = {
    "select": select.select,
    "lookup": select.lookup,
    "trim": series.trim,
    "normalize": series.normalize,
    "blind": series.blind,
    "taper": series.taper,
    "demean": series.demean,
    "detrend": series.detrend,
    "differentiate": series.differentiate,
    "integrate": series.integrate,
    "decimate": series.decimate,
    "interpolate": series.interpolate,
    "sta_lta": series.sta_lta,
    "z_detect": series.z_detect,
    "bandpass": dsp.bandpass,
    "characteristic": dsp.characteristic,
    "stack": stack.stack,
    "fill_gaps": stack.fill_gaps,
    "onsets": trigger.onsets,
    "triggers": trigger.triggers,
    "picks": trigger.picks,
    "summary": measure.summary,
}


@dataclass(frozen=True)
class Step:
    """A named transform with its arguments, and the columns it needs."""

    name: str
    work: Transform
    arguments: Mapping[str, object] = field(default_factory=dict)
    needs: tuple[str, ...] = ()

    def __call__(self, df: DataFrame) -> DataFrame:
        missing = [c for c in self.needs if c not in df.columns]
        if missing:
            raise ValueError(f"step {self.name} needs the columns {', '.join(missing)}; it is given {', '.join(df.columns)}")
        return self.work(df, **self.arguments)


class Pipeline:
    """An ordered set of steps; running it composes one lazy plan."""

    def __init__(self, *steps: Step):
        names = [s.name for s in steps]
        if len(set(names)) != len(names):
            raise ValueError("step names must differ")
        self.steps = tuple(steps)

    @property
    def names(self) -> list[str]:
        return [s.name for s in self.steps]

    def updated(self, step: Step) -> Pipeline:
        """The sequence with a step replaced by name, or added at its end."""
        if step.name not in self.names:
            return Pipeline(*self.steps, step)
        return Pipeline(*[step if s.name == step.name else s for s in self.steps])

    def run(self, df: DataFrame, observe: bool = False) -> DataFrame:
        """The result of all steps; observe: each step also reports its number of rows as an observed metric of its name."""
        for step in self.steps:
            log.debug("step %s", step.name)
            df = step(df)
            if observe:
                df = df.observe(step.name, F.count(F.lit(1)).alias("rows"))
        return df


def declared(config: Sequence[Mapping[str, object]]) -> Pipeline:
    """A sequence from plain data: [{"name": ..., "operator": ..., "arguments": {...}}]. Values are data and are never evaluated."""
    steps = []
    for k, entry in enumerate(config):
        unknown = set(entry) - {"name", "operator", "arguments", "needs"}
        if unknown or entry.get("operator") not in OPERATORS:
            raise ValueError(f"entry {k}: unknown {', '.join(unknown) or entry.get('operator')}")
        steps.append(Step(str(entry.get("name", f"{entry['operator']}_{k}")), OPERATORS[entry["operator"]], dict(entry.get("arguments", {})), tuple(entry.get("needs", ()))))
    return Pipeline(*steps)


def resolved(config: Mapping[str, Mapping[str, str]]) -> dict[str, dict[str, str]]:
    """Sections with ${Section:key} and ${key} references filled in; cycles are errors."""
    def value(section: str, key: str, seen: tuple[tuple[str, str], ...] = ()) -> str:
        if (section, key) in seen:
            raise ValueError(f"{section}:{key} refers to itself")
        if key not in config.get(section, {}):
            raise ValueError(f"no value {section}:{key}")
        return re.sub(r"\$\{(?:([^:}]+):)?([^}]+)\}", lambda m: value(m[1] or section, m[2], (*seen, (section, key))), config[section][key])

    return {s: {k: value(s, k) for k in keys} for s, keys in config.items()}


def section(config: Mapping[str, Mapping[str, str]], name: str, kind: str = "CLASS") -> tuple[str, dict[str, object]]:
    """The operator that a section names, and its other entries as arguments: references filled in, values read but never evaluated."""
    if name not in config:
        raise ValueError(f"no section {name}")
    entries = resolved(config)[name]
    if kind not in {k.upper() for k in entries}:
        raise ValueError(f"section {name} has no {kind}")
    chosen = next(v for k, v in entries.items() if k.upper() == kind)
    return chosen, {k: checks.coerced(v) for k, v in entries.items() if k.upper() != kind}


def preprocessing(sampling_rate: float, low: float, high: float, norm: str = "std") -> Pipeline:
    """The sequence before scoring: detrend, filter, taper, normalise, and the grid with gaps masked."""
    return Pipeline(
        Step("detrend", series.detrend, {"how": "linear"}, ("id", "idx", "value")),
        Step("filter", dsp.bandpass, {"low": low, "high": high, "sampling_rate": sampling_rate}),
        Step("taper", series.taper),
        Step("normalize", series.normalize, {"how": norm}),
        Step("grid", stack.fill_gaps),
    )


def postprocessing(thr_on: float, thr_off: float, blinding: int, step_us: int) -> Pipeline:
    """The sequence after scoring: blind, stack, trigger, pick."""
    return Pipeline(
        Step("blind", series.blind, {"left": blinding}, ("id", "idx", "value", "fold")),
        Step("stack", stack.stack, {"method": "mean"}),
        Step("trigger", trigger.triggers, {"thr_on": thr_on, "thr_off": thr_off}),
        Step("pick", trigger.picks, {"thr_on": thr_on, "step_us": step_us}),
    )


def picking(rows: DataFrame, components: str, length: int, step: int, blinding: int, thr_on: float, thr_off: float, step_us: int = 3_600_000_000) -> DataFrame:
    """Samples (instrument, component, idx, value, fold) to picks: windows with repaired components, scores, blinded
    edges, a fold-weighed stack of the labels P and S, triggers, one pick each.
    """
    primary = F.col("component") == components[0]
    placed = windows.placed(rows, ["instrument"], primary, length, step)
    predict.check_blinding(length - step, blinding)
    filled = collate.fill_components(placed, length, components, "secondary", primary_share=0.9, secondary_share=0.8)
    filled = collate.whole(filled, windows.spans(placed, ["instrument"], length, step))
    tensors = collate.tensor(filled, components, length)
    scored = predict.predict(tensors, {"fast": predict.energy_ratio(max(1, length // 12), max(2, length // 3))}, ("Detection", "P", "S"), "ER").where("label in ('P', 'S')")
    per = measure.collapse_fold(filled, ["instrument", "k"])
    folds = per.groupBy("instrument", "k").agg(F.min("idx").alias("first"), F.transform(F.sort_array(F.collect_list(F.struct("idx", "fold"))), lambda x: x["fold"]).alias("fold"))
    series_ = predict.to_series(scored, folds, length, blinding)
    stacked = stack.stack(series_.where("fold > 0"), "mean")
    return trigger.picks(trigger.triggers(stacked, thr_on, thr_off), thr_on, step_us)
