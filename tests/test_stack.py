import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foldloom.operators import measure, select, series, stack
from foldloom.sources.packets import invalid, to_packets, to_samples, with_fold
from foldloom.streaming.ring import Ring, merge


def packet(spark, *packets):
    rows = [(i, s, [float(x) if x is not None else None for x in d], [float(x) for x in (f or [0 if v is None else 1 for v in d])]) for i, s, d, f in packets]
    return to_samples(spark.createDataFrame(rows, "id string, start long, data array<double>, fold array<double>"), "id")


def table(df):
    return {r["idx"]: (r["value"], r["fold"]) for r in df.collect()}


UP = list(range(1000))
DOWN = UP[::-1]


def test_gap_between_packets(spark):
    both = packet(spark, ("a", 0, UP, None), ("a", 2000, DOWN, None))
    for method in stack.METHODS:
        found = table(stack.fill_gaps(stack.stack(both, method)))
        assert len(found) == 3000
        assert [found[i][0] for i in (0, 999, 2000, 2999)] == [0, 999, 999, 0]
        assert found[999][1] == 1 and found[1000] == (None, 0) and found[1999] == (None, 0)


def test_overlap(spark):
    both = packet(spark, ("a", 0, UP, None), ("a", 800, DOWN, None))
    drop, top, mean = (table(stack.stack(both, m)) for m in stack.METHODS)
    assert len(drop) == 1800 and all(drop[i] == (None, 0) for i in range(800, 1000)) and drop[799] == (799, 1)
    assert all(top[i] == (max(i, 999 - (i - 800)), 2) for i in range(800, 1000))
    assert all(mean[i] == ((i + 999 - (i - 800)) / 2, 2) for i in range(800, 1000))


def test_overlap_and_gap(spark):
    three = packet(spark, ("a", 0, UP, None), ("a", 800, DOWN, None), ("a", 2400, UP, None))
    found = table(stack.fill_gaps(stack.stack(three, "drop")))
    assert len(found) == 3400
    assert {i for i, (v, f) in found.items() if v is None and f == 0} == set(range(800, 1000)) | set(range(1800, 2400))


def test_equal_packets_add_folds(spark):
    rows = [("a", 5, [1.0, 2.0, None], [1.0, 1.0, 0.0])] * 3 + [("a", 5, [1.0, 2.0, 3.0], [1.0, 1.0, 1.0]), ("b", 5, [1.0], [2.0])]
    packets = spark.createDataFrame(rows, "id string, start long, data array<double>, fold array<double>")
    found = {(r["id"], tuple(r["data"])): r["fold"] for r in stack.collapse_identical(packets).collect()}
    assert found == {("a", (1.0, 2.0, None)): [3, 3, 0], ("a", (1.0, 2.0, 3.0)): [1, 1, 1], ("b", (1.0,)): [2]}


def test_insert_into_gap_in_any_order(spark):
    parts = [("a", 0, [0, 1], None), ("a", 2, [2, 3], None), ("a", 4, [4, 5], None)]
    for order in (parts, parts[::-1], [parts[1], parts[2], parts[0]]):
        assert table(stack.fill_gaps(stack.stack(packet(spark, *order), "mean"))) == {i: (i, 1) for i in range(6)}


def test_fold_weighs_the_mean_and_masks(spark):
    rows = packet(spark, ("a", 0, [1, None, 5, 7], [1, 0, 0, 0]), ("a", 0, [4, 3, 6, None], [2, 1, 0, 0]))
    assert table(stack.stack(rows, "mean")) == {0: (3, 3), 1: (3, 1), 2: (None, 0), 3: (7, 0)}
    assert table(stack.stack(rows, "max"))[2] == (6, 0)
    with pytest.raises(NotImplementedError):
        stack.stack(rows, "interpolate")


def test_packets_round_trip(spark):
    rows = packet(spark, ("a", 3, [1, None, 3, 4, 5], None), ("a", 12, [9], None))
    packets = to_packets(rows, 4, "id")
    assert invalid(packets).count() == 0 and {r["npts"] for r in packets.collect()} == {1, 4}
    assert {k: v for k, v in table(to_samples(packets, "id")).items() if v[0] is not None} == {3: (1, 1), 5: (3, 1), 6: (4, 1), 7: (5, 1), 12: (9, 1)}
    made = with_fold(spark.createDataFrame([([1.0, float("nan"), None],)], "data array<double>")).first()
    assert made["fold"] == [1, 0, 0] and made["data"] == [1, None, None]


def test_segments_of_masked_series(spark):
    rows = packet(spark, ("a", 0, [None, 1, 2, None, 3], None), ("b", 7, [1, 1, 1], None))
    for length in (2, 65_536):
        assert {tuple(r) for r in series.segments(rows, length=length).collect()} == {("a", 1, 2), ("a", 4, 4), ("b", 7, 9)}
    assert {r["id"]: (r["segments"], r["gaps"], r["longest"]) for r in measure.gap_counts(rows).collect()} == {"a": (2, 1, 2), "b": (1, 0, 3)}


def test_blinding_one_edge_only(spark):
    rows = packet(spark, ("a", 0, list(range(10)), None))
    assert [f for _, (_, f) in sorted(table(series.blind(rows, 3, 0)).items())] == [0] * 3 + [1] * 7
    assert [f for _, (_, f) in sorted(table(series.blind(rows, 99)).items())] == [0] * 10


@pytest.mark.parametrize(("start", "aligned", "moved"), [(1_000_000, 1_000_000, False), (1_009_000, 1_000_000, False), (995_000, 1_000_000, False), (1_300_000, 2_000_000, True), (600_000, 1_000_000, True)])
def test_align(spark, start, aligned, moved):
    row = series.align_start(spark.createDataFrame([(start,)], "start_us long"), 1.0).first()
    assert (row["aligned_us"], row["resampled"]) == (aligned, moved)


def test_view_clamps_and_refuses_backward_intervals(spark):
    rows = packet(spark, ("a", 0, list(range(10)), None))
    assert select.view(rows, -5_000_000, -1_000_000, 0, 1.0).count() == 0
    assert sorted(table(select.view(rows, 2_500_000, None, 0, 1.0))) == list(range(2, 10))
    with pytest.raises(ValueError):
        select.view(rows, 2, 1, 0, 1.0)
    with pytest.raises(ValueError):
        series.trim(rows, 5, 4)


# ring buffers


def test_ring_overlaps():
    rng = np.random.default_rng(0)
    parts = [rng.normal(size=121) for _ in range(3)]
    ring = Ring(61)
    assert ring.append(0, parts[0], np.ones(121)) == "first" and len(ring.value) == 61 and ring.end == 120
    assert ring.append(30, parts[1], np.ones(121)) == "joined" and ring.end == 150
    assert ring.fold.tolist() == [2.0] * 31 + [1.0] * 30
    assert np.allclose(ring.value[:31], (parts[0][90:] + parts[1][60:91]) / 2)
    assert ring.append(0, np.ones(90), np.ones(90)) == "late" and ring.late == 1
    assert ring.append(29, np.ones(62), np.ones(62)) == "joined" and ring.end == 150
    assert ring.append(1000, np.ones(5), np.ones(5)) == "reset" and ring.fold.sum() == 5


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.lists(st.one_of(st.none(), st.integers(-9, 9)), min_size=1, max_size=12)), min_size=1, max_size=8), st.sampled_from(["max", "mean"]))
def test_ring_equals_stack_of_all(packets, method):
    """Where nothing is lost to the buffer's length, any order gives the stack."""
    ring, contributions = Ring(60, method), {}
    ring.append(41, np.array([1.0]), np.array([1.0]))
    contributions[41] = [1.0]
    for start, data in packets:
        ring.append(start, np.array([np.nan if v is None else v for v in data], float), np.ones(len(data)))
        for k, v in enumerate(data):
            if v is not None:
                contributions.setdefault(start + k, []).append(float(v))
    for idx in range(ring.start, ring.end + 1):
        value, fold, c = ring.value[idx - ring.start], ring.fold[idx - ring.start], contributions.get(idx, [])
        assert fold == len(c)
        assert np.isnan(value) if not c else np.isclose(value, max(c) if method == "max" else np.mean(c))


def test_merge_drop():
    value, fold = merge(np.array([1.0, np.nan, 3.0]), np.array([1.0, 0, 1]), np.array([2.0, 2.0, np.nan]), np.array([1.0, 1, 0]), "drop")
    assert np.isnan(value[0]) and value[1:].tolist() == [2, 3] and fold.tolist() == [0, 1, 1]
