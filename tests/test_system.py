import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from foldloom.functions import checks
from foldloom.operators import predict
from foldloom.plans import pipeline
from foldloom.sources import packets
from foldloom.streaming.ring import Ring


def ring(*appended, **options):
    r = Ring(5, **options)
    said = [r.append(start, np.array(v, float), np.ones(len(v))) for start, v in appended]
    return r, said


def held(r):
    return {r.start + k: v for k, v in enumerate(r.value) if not np.isnan(v)}


def test_past_packets_by_rule():
    first, near, far = (10, [1, 2, 3, 4, 5]), (7, [9, 9, 9, 9, 9]), (0, [8, 8])
    r, said = ring(first, near, far, past="restricted")
    assert said == ["first", "joined", "late"] and r.start == 10 and held(r) == {10: 5, 11: 5.5, 12: 3, 13: 4, 14: 5}
    r, said = ring(first, near, past="unrestricted")
    assert said == ["first", "joined"] and r.start == 7 and held(r) == {7: 9, 8: 9, 9: 9, 10: 5, 11: 5.5}
    r, said = ring(first, far, past="unrestricted")
    assert said == ["first", "reset"] and r.end == 1 and held(r) == {0: 8, 1: 8}
    with pytest.raises(ValueError):
        Ring(5, past="never")


def test_first_packet_by_edge():
    short, long = (10, [1, 2]), (10, [1, 2, 3, 4, 5, 6, 7])
    assert ring(short)[0].start == 7 and ring(short, edge="start")[0].start == 10
    assert held(ring(long)[0]) == {12: 3, 13: 4, 14: 5, 15: 6, 16: 7} and held(ring(long, edge="start")[0]) == {10: 1, 11: 2, 12: 3, 13: 4, 14: 5}


@pytest.mark.parametrize(("to", "edge", "expected"), [(16, "end", {12: 3, 13: 4, 14: 5}), (8, "start", {10: 1, 11: 2, 12: 3}), (14, "end", {10: 1, 11: 2, 12: 3, 13: 4, 14: 5}), (40, "start", {})])
def test_sliding(to, edge, expected):
    r, _ = ring((10, [1, 2, 3, 4, 5]))
    r.slide(to, edge)
    assert held(r) == expected and (r.end if edge == "end" else r.start) == to and (r.fold[np.isnan(r.value)] == 0).all()


def test_written_values():
    made = {t: checks.coerced(t) for t in ("12", "-3", "1e3", "0.5", "True", "none", "{'a': '7', 'b': 'x'}", "[1, 2]", "__import__('os')", "a b")}
    assert made == {"12": 12, "-3": -3, "1e3": 1000.0, "0.5": 0.5, "True": True, "none": None, "{'a': '7', 'b': 'x'}": {"a": 7, "b": "x"}, "[1, 2]": [1, 2], "__import__('os')": "__import__('os')", "a b": "a b"}
    with pytest.raises(ValueError):
        pipeline.section({"A": {"x": "1"}}, "A")
    with pytest.raises(ValueError):
        pipeline.section({}, "A")


def test_window_parameters():
    assert predict.window_parameters(6000, 500, 3000) == {"in_samples": 6000, "blinding": 500, "overlap": 3000, "step": 3000}
    assert predict.window_parameters(100, defaults=(10, 50))["blinding"] == 10
    with pytest.warns(UserWarning, match="gaps"):
        predict.window_parameters(6000, 500, 600)
    for wrong in ((6000, 3001, 0), (6000, 0, 6000), (6000, 1.5, 0)):
        with pytest.raises(ValueError):
            predict.window_parameters(*wrong)


def test_rejected_packets_are_counted(spark):
    rows = spark.sql("select 'N' network, 'S' station, '' location, 'C' channel, 1.0D sampling_rate, timestamp'2024-01-01' starttime, array(1.0D) data, array(1.0D) fold")
    broken = rows.withColumn("network", F.lit(None).cast("string")).unionByName(rows.withColumn("data", F.array().cast("array<double>"))).unionByName(rows.withColumn("fold", F.array(F.lit(1.0), F.lit(1.0))))
    seen = Observation("rejected")
    told = rows.unionByName(broken).withColumn("reason_", packets.rejection()).observe(seen, F.count(F.when(F.col("reason_") == "data", 1)).alias("data"))
    assert told.where("reason_ is null").count() == 1 and seen.get["data"] == 1
    assert packets.accepted(rows.unionByName(broken), "rejected").count() == 1
