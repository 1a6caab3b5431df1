import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldloom.operators import stack
from foldloom.plans.stream_queries import finished
from foldloom.sources import store
from foldloom.streaming import metrics, processors
from foldloom.streaming.ring import Ring

PACKETS = "id string, start long, data array<double>, fold array<double>"


def packets(rng, n, keys=("a", "b")):
    rows = []
    for k in range(n):
        size = int(rng.integers(1, 6))
        data = [None if rng.random() < 0.1 else float(np.round(rng.normal(), 3)) for _ in range(size)]
        rows.append((keys[k % len(keys)], int(rng.integers(0, 60)), data, [0.0 if v is None else 1.0 for v in data]))
    return rows


def test_streamed_buffer_equals_batch_stack(spark, tmp_path):
    rows = packets(np.random.default_rng(0), 40)
    for k in range(0, 40, 10):
        spark.createDataFrame(rows[k : k + 10], PACKETS).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = store.replay(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], PACKETS).schema, files_per_batch=1)
    found = finished(processors.buffered(stream, 200), "update").collect()
    from foldloom.sources.packets import to_samples

    whole = stack.stack(to_samples(spark.createDataFrame(rows, PACKETS), "id"), "mean").collect()
    wanted = {(r["id"], r["idx"]): (r["value"], r["fold"]) for r in whole if r["value"] is not None}
    latest = {}
    for r in found:  # one row a key and batch; the fullest is the last
        if r["id"] not in latest or sum(r["fold"]) > sum(latest[r["id"]]["fold"]):
            latest[r["id"]] = r
    got = {(r["id"], r["start"] + k): (v, f) for r in latest.values() for k, (v, f) in enumerate(zip(r["value"], r["fold"], strict=True)) if v is not None}
    assert got.keys() == wanted.keys()
    assert all(np.allclose(got[k], wanted[k]) for k in got)


def test_streamed_windows_stall_and_catch_up(spark, tmp_path):
    rows = [("a", s, [1.0] * 10, [1.0] * 10) for s in (0, 10, 20)] + [("a", 500, [1.0] * 10, [1.0] * 10), ("a", 510, [1.0] * 20, [1.0] * 20)]
    spark.createDataFrame(rows, PACKETS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.createDataFrame([], PACKETS).schema).parquet(str(tmp_path / "in"))
    found = finished(processors.windowed(stream, 40, 10, 5, delay=2), "append").collect()
    assert sorted(r["first"] for r in found) == [0, 5, 10, 15, 500, 505, 510, 515]
    assert all(r["fold"] == [1.0] * 10 for r in found)


def test_late_packets_are_counted_by_key():
    ring = Ring(10)
    ring.append(100, np.ones(10), np.ones(10))
    for start in (0, 50, 89):
        assert ring.append(start, np.ones(2), np.ones(2)) == ("late" if start < 89 else "late")
    assert ring.late == 3 and ring.append(90, np.ones(11), np.ones(11)) == "joined"


def test_store_prunes_folders(spark, tmp_path):
    rows = spark.range(2000).select(F.lit("N").alias("network"), (F.col("id") % 3).cast("string").alias("station"), (F.col("id") * 3_600_000_000).alias("us"), F.col("id").alias("idx"), F.rand(1).alias("value"))
    store.write(store.with_day(rows, F.col("us")), str(tmp_path / "s"))
    chosen = store.read(spark, str(tmp_path / "s"), F.col("station") == "1")
    assert chosen.count() == len([k for k in range(2000) if k % 3 == 1])
    assert "PartitionFilters: [isnotnull(station" in chosen._jdf.queryExecution().toString()
    assert store.by_arrival(rows, F.col("us"), 7_200_000_000).agg(F.max("batch")).first()[0] == 999


def test_metrics_rows(spark):
    recorder = metrics.Recorder()
    recorder._add(("q", 1, 10**18, 1, 5, 5, "max"))
    assert recorder.table(spark).collect()[0][:2] == ("q", 1)


def merged_once(rows, method, size=7):
    """rows through the step that merges packets before they are dealt out, in Arrow batches of `size`."""
    schema = pa.schema([("id", pa.string()), ("start", pa.int64()), ("data", pa.list_(pa.float64())), ("fold", pa.list_(pa.float64()))])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[k : k + size]], schema) for k in range(0, len(rows), size)]
    return [tuple(r.values()) for b in processors._packed(iter(batches), method) for r in b.to_pylist()]


def states(rows, method, **how):
    """The ring of each id after rows."""
    out = {}
    for key in {r[0] for r in rows}:
        made, ring = processors.BufferProcessor(80, method, **how), Ring(80, method, **how)
        frame = pd.DataFrame([r[1:] for r in rows if r[0] == key], columns=["start", "data", "fold"])
        for packet in made.packets(iter([frame])):
            ring.append(*packet)
        out[key] = (ring.start, np.round(ring.value, 9).tolist(), ring.fold.tolist(), ring.resets)
    return {k: str(v) for k, v in out.items()}


@pytest.mark.parametrize("method", ["mean", "max"])
def test_packets_merged_before_they_are_dealt_out_give_the_same_rings(method):
    rows = packets(np.random.default_rng(1), 300, ("a", "b", None))
    rows += rows[:50] + [("c", 5, [2.0], [3.0]), ("a", 500, [None, 1.0, float("nan")], [0.0, 2.0, 0.0])]  # repeated, alone, far and masked ones
    for how in ({}, {"edge": "start"}, {"past": "unrestricted"}):
        assert states(merged_once(rows, method), method, **how) == states(rows, method, **how)
    assert len(merged_once(rows, method)) < 10  # a packet a run, however many batches
    assert ("c", 5, [2.0], [3.0]) in merged_once(rows, method)


def test_odd_packets_stay_as_they_are():
    plain = [("a", 1, [1.0], [1.0]), ("a", 1, [2.0], [1.0])]
    assert merged_once(plain, "mean") == [("a", 1, [1.5], [2.0])] and merged_once([], "mean") == []
    for odd in (("a", 1, [], []), ("b", None, [1.0], [1.0]), ("b", 1, None, [1.0]), ("b", 1, [1.0], None), ("b", 1, [1.0, 2.0], [1.0]), ("b", 1, [float("inf")], [1.0]), ("b", 1, [1.0], [0.0]), ("b", 1, [1.0], [None])):
        assert merged_once([*plain, odd], "mean") == [*plain, odd]


def test_buffers_deal_out_few_rows(spark, tmp_path):
    rows = [(f"k{n % 3}", n // 30, [float(n % 7)], [1.0]) for n in range(6000)] + [(None, 0, [1.0], [1.0]), ("empty", 4, [], [])]
    spark.createDataFrame(rows, PACKETS).coalesce(1).write.parquet(str(tmp_path / "in"))
    plain = spark.read.schema(PACKETS).parquet(str(tmp_path / "in"))
    assert processors.packed(plain.where("size(data) > 0"), "mean").count() == 4  # three runs of 200 samples, and one packet
    assert processors.packed(plain, "drop") is plain and processors.packed(plain.withColumn("ts", F.lit(1)), "mean").count() == 6002
    stream = spark.readStream.schema(plain.schema).parquet(str(tmp_path / "in"))
    found = {r["id"]: r for r in finished(processors.buffered(stream, 200), "update").collect()}
    assert set(found) == {"k0", "k1", "k2", None, "empty"} and found["empty"]["value"] == [] and found["k1"]["fold"] == [10.0] * 200
    dealt = finished(processors.buffered(stream.where("size(data) > 0"), 200), "update").collect()
    assert sorted((str(r["id"]), r["start"], r["value"], r["fold"]) for r in dealt) == sorted((str(r["id"]), r["start"], r["value"], r["fold"]) for r in found.values() if r["id"] != "empty")
