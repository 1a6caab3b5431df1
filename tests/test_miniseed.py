"""miniSEED records: round trips, splits at record boundaries, and a record worked out by hand."""

import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foldloom.sources import miniseed


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(-9, 9), st.integers(-600, 600), st.integers(-(2**28), 2**28)), min_size=1, max_size=400))
def test_steim_round_trip(values):
    x = np.array(values)
    done = 0
    while done < len(x):
        body, n = miniseed.packed(x[done:], int(x[done]), 7)
        assert n and len(body) % 64 == 0 and len(body) <= 7 * 64
        assert miniseed.unpacked(body, n, 11).tolist() == x[done : done + n].tolist()
        done += n


def test_a_steim_1_frame_by_hand():
    # 100, 101, 99, 99, 104 | 1104, 104 | 2_000_104: four bytes, two halves, one word; the first difference is of the record before
    control = 1 << (30 - 2 * 3) | 2 << (30 - 2 * 4) | 3 << (30 - 2 * 5)
    words = [control, 100, 2_000_104, struct.unpack(">I", struct.pack(">bbbb", 7, 1, -2, 0))[0], struct.unpack(">I", struct.pack(">hh", 5, 1000))[0], 1_999_000, *[0] * 10]
    frame = struct.pack(">16I", *words)
    assert miniseed.unpacked(frame, 7, 10).tolist() == [100, 101, 99, 99, 104, 1104, 2_000_104]
    with pytest.raises(ValueError, match="fewer"):
        miniseed.unpacked(frame, 8, 10)
    with pytest.raises(ValueError, match="last value"):
        miniseed.unpacked(frame, 6, 10)


def test_rates():
    for rate in (100.0, 1.0, 40.0, 1 / 3600, 0.5, 12.5, 200 / 3):
        assert miniseed.rate_of(*miniseed.rate_fields(rate)) == pytest.approx(rate, rel=1e-12)


def test_files_are_read_by_splits(spark, tmp_path):
    rng = np.random.default_rng(0)
    whole = np.cumsum(rng.integers(-50, 50, 5000)).astype(float)
    broken = np.round(rng.normal(size=700), 3)
    rows = [("XX", "AAA", "", "EHZ", 1_693_678_190.05, 100.0, 5000, whole.tolist()), ("XX", "BBB", "01", "ENN", 0.0, 12.5, 700, broken.tolist()), ("XX", "EMPTY", "", "EHZ", 0.0, 1.0, 0, [])]
    miniseed.register(spark)
    path = str(tmp_path / "seed")
    spark.createDataFrame(rows, miniseed.SCHEMA).coalesce(1).write.format("miniseed").mode("append").option("recordLength", 512).save(path)
    back = spark.read.format("miniseed").option("splitBytes", 2048).load(path)
    assert back.rdd.getNumPartitions() > 5
    found = {}
    for r in sorted(back.collect(), key=lambda r: (r["station"], r["startt"])):
        held = found.setdefault((r["network"], r["station"], r["location"], r["channel"], r["samprate"]), [r["startt"], []])
        assert r["startt"] == pytest.approx(held[0] + len(held[1]) / r["samprate"], abs=1e-4) and r["nsamp"] == len(r["data"])
        held[1] += r["data"]
    assert found == {("XX", "AAA", "", "EHZ", 100.0): [1_693_678_190.05, whole.tolist()], ("XX", "BBB", "01", "ENN", 12.5): [0.0, broken.tolist()]}
    spark.createDataFrame(rows[1:2], miniseed.SCHEMA).write.format("miniseed").mode("overwrite").save(path)
    assert {r["station"] for r in spark.read.format("miniseed").load(path).collect()} == {"BBB"}


def test_what_can_not_be_written(tmp_path):
    row = ["XX", "AAA", "", "EHZ", 0.0, 1.0, 2, [1.0, None]]
    with pytest.raises(ValueError, match="gaps"):
        list(miniseed.records(row, 512, 1))
    with pytest.raises(ValueError, match="longer"):
        list(miniseed.records(["XX", "TOOLONG", "", "EHZ", 0.0, 1.0, 1, [1.0]], 512, 1))
    with pytest.raises(ValueError, match="power of two"):
        miniseed.Writer({"path": str(tmp_path), "recordLength": "500"}, False)
