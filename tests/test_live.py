"""Live operators against the batch ones, for any cut into batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldloom.operators import trigger
from foldloom.plans import live_queries
from foldloom.streaming import live
from foldloom.streaming.processors import WindowProcessor
from foldloom.streaming.ring import Ring

STEP = 1_000_000  # a sample a second
SAMPLES = "id string, idx long, value double, fold double, ts timestamp"


def random_samples(seed, n=300, keys=("a", "b")):
    rng = np.random.default_rng(seed)
    rows = []
    for key in keys:
        level = 0.5
        for idx in range(1000, 1000 + n):
            level = float(np.clip(level + rng.normal(0, 0.25), 0, 1))
            for _ in range(rng.integers(0, 3)):
                rows.append((key, idx, round(level + float(rng.normal(0, 0.02)), 4), float(rng.integers(1, 3))))
    return rows


def streamed(spark, rows, made, cut, beats=(10_000, 20_000)):
    """rows through a streaming operator, in batches by `cut` (row to number), with heartbeats behind; and the number of batches."""
    beat = [("", t, None, 0.0) for t in beats]
    df = spark.createDataFrame([(*r, cut(r)) for r in rows] + [(*r, 1000 + k) for k, r in enumerate(beat)], "id string, idx long, value double, fold double, part int")
    path = live_queries.in_parts(df.withColumn("ts", F.timestamp_seconds(F.col("idx") + 0.5)), F.col("part"))
    stream = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("ts", "30 seconds")
    return live_queries.collected(made(stream))


@pytest.mark.parametrize("seed, size", [(0, 300), (1, 40), (2, 7)])
def test_live_triggers_for_any_cut(spark, seed, size):
    rows = random_samples(seed, 120 if size < 10 else 300)
    rng = np.random.default_rng(seed)
    order = {id(r): (r[1] - 1000 + int(rng.integers(0, 5))) // size for r in rows}  # up to four samples late
    found = streamed(spark, rows, lambda s: live.triggers(s, 0.7, 0.4, STEP, 5, 100), lambda r: order[id(r)])
    cells = spark.createDataFrame(rows, "id string, idx long, value double, fold double").groupBy("id", "idx").agg((F.sum(F.col("value") * F.col("fold")) / F.sum("fold")).alias("value"), F.sum("fold").alias("fold"))
    wanted = trigger.triggers(cells, 0.7, 0.4).collect()
    got = {(r["id"], r["on"], r["off"]): r for r in found.collect()}
    assert len(got) == found.count() and len(wanted) > 5  # each once
    assert got.keys() == {(r["id"], r["on"], r["off"]) for r in wanted}
    for r in wanted:
        g = got[r["id"], r["on"], r["off"]]
        assert (g["npts"], g["at_max"]) == (r["npts"], r["at_max"]) and np.allclose([g["p_max"], g["fold_mean"]], [r["p_max"], r["fold_mean"]])


def test_runs_across_any_feeding():
    rng = np.random.default_rng(3)
    idx = np.sort(rng.choice(400, 300, replace=False))
    value, fold = np.round(rng.random(300), 2), rng.integers(1, 4, 300).astype(float)
    whole = live.Runs(0.8, 0.3)
    whole.feed(idx, value, fold, 1000)
    for cuts in ([], [1], [150], list(range(0, 300, 7)), list(range(300))):
        runs, at = live.Runs(0.8, 0.3), 0
        for end in [*cuts, 300]:
            done = int(idx[end - 1]) if 0 < end < 300 else -1 if end == 0 else 1000
            again = live.Runs(0.8, 0.3, runs.open)  # as from state
            again.closed = runs.closed
            again.feed(idx[at:end], value[at:end], fold[at:end], done)
            runs, at = again, end
        assert len(whole.closed) > 20 and np.allclose(runs.closed, whole.closed) and runs.open is None


def test_late_samples_and_wrong_parameters(spark):
    rows = [("a", 1000 + k, 0.9, 1.0) for k in range(3)] + [("a", 1040 + k, 0.9, 1.0) for k in range(20)] + [("a", 1003, 0.9, 1.0)]
    found = streamed(spark, rows, lambda s: live.triggers(s, 0.7, 0.4, STEP, 5, 100), lambda r: 5 if r[1] == 1003 else r[1] // 1040).collect()
    assert sorted((r["on"], r["off"]) for r in found) == [(1000, 1002), (1040, 1059)]  # sample 1003 came too late
    for wrong in (lambda: live.TriggerProcessor(0.3, 0.7, STEP, 1, 5), lambda: live.TriggerProcessor(0.7, 0.3, STEP, 5, 5)):
        with pytest.raises(ValueError):
            wrong()


def test_windows_are_cut_at_a_silence():
    """A gap as long as the timeout within a batch ends a series as a timer does."""
    made = live.WindowProcessor("PS", 4, 2, 0.5, 0.5, STEP, 0, 10)
    cell = lambda *idx: (np.array(idx), np.ones(len(idx)), np.ones(len(idx)))
    held = [cell(0, 1, 2, 3, 20, 21, 22, 23), cell(0, 1)]
    out, held, last, anchor, k = made.cut(held, np.array([0, 1, 2, 3, 20, 21, 22, 23]), None, None, 0)
    assert [w[:2] for w in out] == [(0, 0), (1, 2)] and (last, anchor, k) == (23, None, 0)
    out, anchor, k = made.ready(held, anchor, k, 23, False)
    assert [w[:2] for w in out] == [(0, 20)] and anchor == 20 and k == 1
    tensor, fold = out[0][2:]
    assert tensor == [[1.0] * 4, [1.0] * 4] and fold == [1.0] * 4  # the secondary is missing: the primary takes its place, with fold 0


def test_windows_of_a_series_that_falls_silent():
    ring = Ring(40)
    ring.append(0, np.ones(25), np.ones(25))
    made = WindowProcessor(40, "mean", 10, 5, 0.5, 1.0, 2, timeout=20, step_us=STEP)
    sent, following = made.ready(ring, 0)
    assert [w[0] for w in sent] == [0, 5, 10] and following == 15
    rest = made.last(ring, following)
    assert [w[0] for w in rest] == [15, 20] and rest[1][2] == [1.0] * 5 + [0.0] * 5 and rest[1][1][5:] == [None] * 5


def test_consumed_samples_count_once():
    ring = Ring(40)
    ring.append(0, np.ones(40), np.ones(40))
    made = WindowProcessor(40, "mean", 10, 5, 0.5, 1.0, 0, consume=True)
    sent, _ = made.ready(ring, 0)
    total = np.zeros(60)
    for first, _, fold in sent:
        total[first : first + 10] += fold
    assert total.max() == 1.0 and [w[0] for w in sent] == [0, 5, 10, 15, 20, 25]


def test_merging_before_the_ring_changes_nothing():
    rng = np.random.default_rng(5)
    import pandas as pd

    rows = []
    for _ in range(60):
        n = int(rng.integers(1, 9))
        data = [None if rng.random() < 0.1 else float(np.round(rng.normal(), 3)) for _ in range(n)]
        rows.append((int(rng.integers(0, 200)), data, [0.0 if v is None else float(rng.integers(1, 3)) for v in data]))
    frame = pd.DataFrame(rows, columns=["start", "data", "fold"])
    for method in ("mean", "max"):
        from foldloom.streaming.processors import BufferProcessor

        made, merged, plain = BufferProcessor(64, method), Ring(64, method), Ring(1000, method)
        for start, data, fold in made.packets(iter([frame[:20], frame[20:45], frame[45:]])):
            merged.append(start, data, fold)
        for start, data, fold in rows:
            plain.append(start, [np.nan if v is None else v for v in data], fold)
        a, b = merged.start - plain.start, merged.start - plain.start + 64
        assert np.allclose(merged.value, plain.value[a:b], equal_nan=True) and np.allclose(merged.fold, plain.fold[a:b])


def test_state_partitions_grow_with_the_table(spark, tmp_path, monkeypatch):
    spark.range(20_000).selectExpr("id", "rand(1) as value").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    size = sum(f.stat().st_size for f in (tmp_path / "events.parquet").glob("part*"))
    advised = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    usual = spark.conf.get(advised)
    try:
        found = {}
        for at_once in (2 * size, size // 2, size // 1000):
            spark.conf.set(advised, f"{at_once}b")
            found[at_once] = live_queries.state_partitions(spark, str(tmp_path))
    finally:
        spark.conf.set(advised, usual)
    assert [*found.values()][0] == 1 and [*found.values()][1] in (2, 3) and [*found.values()][2] == 4  # at most the session's shuffle partitions


def stores(spark, folder, before):
    """Numbers of state partitions of the operators of the one streaming query run since."""
    (run,) = set(folder.glob("stream-*")) - before
    return [len([p for p in op.iterdir() if p.name.isdigit()]) for op in sorted((run / "progress" / "state").iterdir())]


@pytest.mark.parametrize("name, operators", [("stream_picking", 2), ("stream_buffer_edge", 1), ("stream_buffer_backwards", 1)])
def test_small_streams_have_few_state_partitions(spark, name, operators):
    from pathlib import Path

    from foldloom.plans import catalog
    from foldloom.sources import scratch

    folder, usual = Path(scratch.shared_folder(spark).removeprefix("file:")), spark.conf.get("spark.sql.shuffle.partitions")
    before = set(folder.glob("stream-*"))
    catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert stores(spark, folder, before) == [1] * operators and spark.conf.get("spark.sql.shuffle.partitions") == usual == "4"


def test_windows_take_only_rows_that_count(spark):
    """Rows of other components, null or not a number, or without fold change nothing but the event time: the windows leave when heartbeats of none of them come."""
    good = [(c, 1000 + k, float(k), 1.0) for c in "PS" for k in range(8)] * 2  # repeated rows count twice
    odd = [("X", 1003, 9.0, 1.0), (None, 1003, 9.0, 1.0), ("", 1003, 9.0, 1.0), ("P", 1003, None, 1.0), ("S", 1004, float("nan"), 1.0), ("P", 1005, 9.0, 0.0), ("P", 1006, 9.0, None), ("P", 1007, 9.0, -1.0)]
    beats = [("", 10_000, None, 0.0), ("", 20_000, None, 0.0)]

    def made(rows):
        parts = [("i", *r, 0) for r in rows] + [(None, "P", 1001, 5.0, 1.0, 0)] + [("", *r, 1 + k) for k, r in enumerate(beats)]
        df = spark.createDataFrame(parts, "instrument string, component string, idx long, value double, fold double, part int").withColumn("more", F.lit("x"))
        path = live_queries.in_parts(df.withColumn("ts", F.timestamp_seconds(F.col("idx") + 0.5)), F.col("part"))
        schema = "instrument string, component string, idx long, value double, fold double, more string, ts timestamp"
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("ts", "30 seconds")
        found = live_queries.collected(live.instrument_windows(stream, "PS", 4, 2, STEP, 1, 10, 0.5, 0.5), partitions=2)
        return sorted((str(r["instrument"]), r["k"], r["first"], r["tensor"], r["fold"]) for r in found.drop("known").collect())

    got = made(good + odd)
    assert got == made(good) and [r[2] for r in got if r[0] == "i"] == [1000, 1002, 1004, 1006]
    assert [r[3][0] for r in got if r[0] == "i"][-1] == [6.0, 7.0, 0.0, 0.0]
    plan = live.instrument_windows(spark.readStream.schema("instrument string, component string, idx long, value double, fold double, more string, ts timestamp").parquet("/root/testdata/sf0.001/events.parquet").withWatermark("ts", "1 hour"), "PS", 4, 2, STEP, 1, 10)
    above, _, below = plan._jdf.queryExecution().analyzed().toString().partition("Filter")
    assert "more#" not in above and "component#" in above and "more#" in below and "EventTimeWatermark" in below  # only what is needed is dealt out, and all rows move the time


def test_live_queries_run_in_several_batches(spark):
    stream = live_queries.events_live(spark, "/root/testdata/sf0.001")
    batches = set()

    def count(batch, number):
        if not batch.isEmpty():
            batches.add(number)

    from foldloom.sources import scratch

    stream.writeStream.foreachBatch(count).option("checkpointLocation", scratch.new_folder(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    assert len(batches) >= 8  # parts and heartbeats
