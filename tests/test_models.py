"""Fitted corners, places of change, bridged series, convolutional scorers and the repeatable sink against plain versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldloom.operators import convnet, corners, onset, stack, trigger
from foldloom.sources import store

SAMPLES = "id string, idx long, value double, fold double"


# corners


def brute_box(x, y):
    best = None
    for a, b in itertools.combinations_with_replacement(range(len(x)), 2):
        h = y[a : b + 1].mean()
        rest = float(((y - np.where((np.arange(len(x)) >= a) & (np.arange(len(x)) <= b), h, 0)) ** 2).sum())
        if h > 0 and (best is None or rest < best[0] - 1e-9):
            best = (rest, h, x[a], x[b])
    return best


def brute_triangle(x, y):
    best = None
    for p in range(x[0] + 1, x[-1]):
        for a in range(x[0], p):
            for b in range(p + 1, x[-1] + 1):
                t = corners.shape(x, a, p, b)
                if t @ t > 1e-9 and t @ y > 0:
                    h = t @ y / (t @ t)
                    rest = float(((y - h * t) ** 2).sum())
                    if best is None or rest < best[0] - 1e-9:
                        best = (rest, h, a, p, b)
    return best


def test_corners_against_all_choices():
    rng = np.random.default_rng(0)
    for n in (3, 4, 7, 15):
        for _ in range(6):
            x = np.sort(rng.choice(n + 5, n, replace=False)) + 100
            y = np.round(rng.normal(0.3, 1, n), 2)
            flat, peaked = corners.box(x, y), corners.triangle(x, y)
            wanted = brute_box(x, y)
            assert (flat is None) == (wanted is None) and (flat is None or np.allclose(flat, wanted[1:]))
            wanted = brute_triangle(x, y)
            assert (peaked is None) == (wanted is None)
            if peaked is not None:
                rest = ((y - peaked[0] * corners.shape(x, *peaked[1:])) ** 2).sum()
                assert rest == pytest.approx(wanted[0], abs=1e-8)


def test_true_corners_come_back():
    x = np.arange(500, 560)
    y = 3.0 * corners.shape(x, 510, 522, 551)
    height, *found = corners.triangle(x, y)
    assert found == [510, 522, 551] and height == pytest.approx(3)
    assert corners.box(x, np.where((x >= 520) & (x <= 533), 2.0, 0.0)) == (2.0, 520, 533)
    assert corners.box(x, -np.ones(60)) is None and corners.triangle(x, -np.ones(60)) is None


def test_covariance_is_that_of_small_changes():
    x = np.arange(0, 40)
    y = 2.0 * corners.shape(x, 5, 14, 33) + np.random.default_rng(1).normal(0, 0.05, 40)
    # between sample numbers, where the triangle is smooth in its corners
    p = np.array([2.0, 5.3, 14.4, 33.6])
    slopes = np.stack([(p[0] * 0 + (p + e)[0] * corners.shape(x, *(p + e)[1:]) - (p - e)[0] * corners.shape(x, *(p - e)[1:])) / 2e-6 for e in np.eye(4) * 1e-6], 1)
    rest = y - p[0] * corners.shape(x, *p[1:])
    wanted = np.linalg.pinv(slopes.T @ slopes) * (rest @ rest / 36)
    assert np.allclose(corners.covariance(x, y, *p), wanted, rtol=1e-4)


def test_fits_of_few_and_masked_samples(spark):
    rows = [("a", 1, k, None if k == 2 else float(k), 1.0) for k in range(6)] + [("b", 1, 0, 1.0, 1.0), ("b", 1, 1, 2.0, 1.0)] + [("c", 2, k, -1.0, 1.0) for k in range(5)]
    found = {r["id"]: r for r in corners.fits(spark.createDataFrame(rows, "id string, on long, idx long, value double, fold double")).collect()}
    assert set(found) == {"a", "c"} and found["c"]["box_height"] is None and found["c"]["onset"] is None and found["a"]["box_last"] == 5


# places of change


def test_places_where_series_change(spark):
    rng = np.random.default_rng(2)
    rows = []
    for name, at in (("a", 60), ("b", 35)):
        quiet, loud = rng.normal(0, 0.1, at), rng.normal(0, 2, 100 - at)
        rows += [(name, 7, k, float(v), 1.0) for k, v in enumerate(np.concatenate([quiet, loud]))]
    df = spark.createDataFrame(rows, "id string, on long, idx long, value double, fold double")
    assert {r["id"]: abs(r["place"] - {"a": 60, "b": 35}[r["id"]]) <= 2 for r in onset.variance_places(df).collect()} == {"a": True, "b": True}
    assert all(abs(r["place"] - {"a": 60, "b": 35}[r["id"]]) <= 3 for r in onset.ar_places(df, share=0.3).collect())
    for r in onset.ar_places(df, order=2, share=0.3).collect():  # against the plain criterion
        x = np.array([v[3] for v in rows if v[0] == r["id"]])
        x = x - x[:30].mean()
        one, two = onset.errors(x, onset.levinson(x[:30], 2)) ** 2, onset.errors(x, onset.levinson(x[70:], 2)) ** 2
        aic = {k: k * np.log(one[:k].mean()) + (100 - k) * np.log(two[k:].mean()) for k in range(3, 98)}
        assert r["aic"] == pytest.approx(min(aic.values())) and aic[r["place"]] == pytest.approx(r["aic"])


def test_levinson_solves_the_normal_equations():
    x = np.cumsum(np.random.default_rng(3).normal(size=200))
    x = x - x.mean()
    r = np.array([x[: 200 - k] @ x[k:] for k in range(6)]) / 200
    matrix = np.array([[r[abs(i - j)] for j in range(5)] for i in range(5)])
    assert np.allclose(onset.levinson(x, 5), np.linalg.solve(matrix, r[1:]))
    assert not onset.levinson(np.zeros(10), 3).any()


def test_spans_too_short_have_no_place(spark):
    df = spark.createDataFrame([("a", 1, k, float(k), 1.0) for k in range(4)] + [("b", 1, 0, None, 0.0)], "id string, on long, idx long, value double, fold double")
    assert onset.ar_places(df).collect() == [] and [r["id"] for r in onset.variance_places(df).collect()] == ["a"]


# bridged series


def series(name, first, values, fold=1.0):
    return [(name, first + k, v, fold) for k, v in enumerate(values)]


def test_bridges(spark):
    left = series("over", 0, [0.0] * 10) + series("gap", 0, [1.0] * 4) + series("in", 0, [5.0] * 10) + series("around", 3, [5.0] * 2) + series("alone", 0, [1.0]) + series("turned", 6, [8.0] * 10) + series("next", 0, [1.0, 1.0])
    right = series("over", 6, [8.0] * 10, 2.0) + series("gap", 7, [9.0] * 3) + series("in", 2, [7.0] * 3) + series("around", 0, [7.0] * 9) + series("other", 5, [2.0]) + series("turned", 0, [0.0] * 10) + series("next", 2, [3.0])
    made = stack.bridged(*(spark.createDataFrame(rows, SAMPLES) for rows in (left, right)), gaps=True).collect()
    got = {}
    for r in sorted(made, key=lambda r: r["idx"]):
        got.setdefault(r["id"], []).append((r["idx"], r["value"], r["fold"]))
    line = [0.0, 8 / 3, 16 / 3, 8.0]  # samples 6 to 9
    assert [v for _, v, _ in got["over"]] == pytest.approx([0.0] * 6 + line + [8.0] * 6)
    assert [f for *_, f in got["over"]] == [1.0] * 6 + [3.0] * 4 + [2.0] * 6
    assert [v for _, v, _ in got["turned"]] == pytest.approx([0.0] * 6 + line + [8.0] * 6)
    assert [tuple(map(float, x)) for x in got["gap"]] == [(float(k), 1.0, 1.0) for k in range(4)] + [(4.0, 3.0, 0.0), (5.0, 5.0, 0.0), (6.0, 7.0, 0.0)] + [(float(k), 9.0, 1.0) for k in (7, 8, 9)]
    assert {v for _, v, _ in got["in"]} == {5.0} and len(got["in"]) == 10
    assert {v for _, v, _ in got["around"]} == {7.0} and len(got["around"]) == 9
    assert got["alone"] == [(0, 1.0, 1.0)] and got["other"] == [(5, 2.0, 1.0)] and len(got["next"]) == 3
    without = stack.bridged(*(spark.createDataFrame(rows, SAMPLES) for rows in (left, right))).where("id = 'gap'")
    assert without.count() == 7


# triggers


def test_long_triggers_are_cut(spark):
    df = spark.createDataFrame(series("a", 0, [0.0, 0.9, 0.9, 0.9, 0.9, 0.5, 0.0, 0.9]), SAMPLES)
    assert sorted((r["on"], r["off"]) for r in trigger.onsets(df, 0.8, 0.4, max_len=2, cut=True).collect()) == [(1, 3), (7, 7)]
    found = {r["on"]: r["npts"] for r in trigger.triggers(df, 0.8, 0.4, max_len=2, cut=True).collect()}
    assert found == {1: 3, 7: 1}


# scorers with weights


def test_hand_worked_net(spark):
    # one channel: the difference of neighbours, halved, then the positive part; then twice that minus one, through a sigmoid
    layers = [("N", "w", 0, [[[-0.5, 0.0, 0.5]]], [0.0], "relu"), ("N", "w", 1, [[[2.0]]], [-1.0], "sigmoid"), ("N", "v", 0, [[[0.0, 1.0, 0.0]]], [0.25], "none")]
    catalogue = spark.createDataFrame(layers, convnet.SCHEMA)
    df = spark.createDataFrame([(1, [[0.0, 1.0, 4.0, 2.0]])], "k int, tensor array<array<double>>")
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    got = df.select(convnet.scores(catalogue, "N", "w", normalize=False)("tensor").alias("y")).first()["y"]
    assert got[0] == pytest.approx([sigmoid(0.0), sigmoid(3.0), sigmoid(0.0), sigmoid(-1.0)])  # halves 0.5, 2, 0.5 and -2, cut at 0
    other = df.select(convnet.scores(catalogue, "N", "v", normalize=False)("tensor").alias("y")).first()["y"]
    assert other == [[0.25, 1.25, 4.25, 2.25]]
    with pytest.raises(ValueError, match="no weights"):
        convnet.scores(catalogue, "N", "x")
    broken = spark.createDataFrame([("N", "w", 0, [[[1.0]]], [0.0], "relu"), ("N", "w", 1, [[[1.0], [1.0]]], [0.0], "none")], convnet.SCHEMA)
    with pytest.raises(ValueError, match="fit each other"):
        convnet.scores(broken, "N", "w")


def test_convolution_against_loops():
    rng = np.random.default_rng(4)
    for size in (1, 2, 3, 4, 7):
        x, kernel, bias = rng.normal(size=(2, 3, 9)), rng.normal(size=(4, 3, size)), rng.normal(size=4)
        want = np.zeros((2, 4, 9))
        for b, o, t in itertools.product(range(2), range(4), range(9)):
            want[b, o, t] = bias[o] + sum(kernel[o, i, j] * x[b, i, t + j - (size - 1) // 2] for i in range(3) for j in range(size) if 0 <= t + j - (size - 1) // 2 < 9)
        assert np.allclose(convnet.convolved(x, kernel, bias), want)


# the repeatable sink


def test_sink_takes_a_batch_once(spark, tmp_path):
    sink = store.BatchSink(str(tmp_path / "sink"))
    rows = [spark.createDataFrame([("s", k, float(k), 1.0, n) for k in range(5)], "station string, idx long, value double, fold double, n int") for n in (0, 1)]
    with pytest.raises(ValueError, match="nothing is stored"):
        sink.read(spark)
    for batch, number in ((rows[0], 0), (rows[0], 0), (rows[1], 1)):
        sink(batch, number)
    store.write(rows[0].withColumn("kind", F.lit("value")), str(tmp_path / "sink" / "batch=2"), ("kind", "station"), "overwrite")  # broken down before its mark
    assert sink.committed(spark) == [0, 1]
    back = sink.read(spark, ("station", "idx", "n")).collect()
    assert sorted((r["n"], r["idx"], r["value"], r["fold"]) for r in back) == [(n, k, float(k), 1.0) for n in (0, 1) for k in range(5)]


@pytest.mark.parametrize("length", [3, 7, 65_536])
def test_summaries_across_chunks(spark, length):
    """Triggers of any length over chunks of any length, against one pass over each series."""
    rng = np.random.default_rng(0)
    rows = []
    for name in "ab":
        idx = np.sort(rng.choice(600, 480, replace=False))
        value = np.abs(np.sin(np.arange(480) / rng.integers(5, 30))) * rng.random(480) ** 0.3
        rows += [(name, int(i), float(round(v, 2)), float(rng.integers(1, 5))) for i, v in zip(idx, value, strict=True)]
    wanted = []

    def closed(run):
        first = next((k for k, r in enumerate(run) if r[2] > 0.6), None)
        if first is not None:
            part = run[first:]
            top = max(r[2] for r in part)
            low = min((r[3] for r in part[:-1]), default=float("inf"))
            wanted.append((part[0][0], part[0][1], part[-1][1], len(part), top, next(r[1] for r in part if r[2] == top), np.mean([r[3] for r in part]), low))

    for name in "ab":
        run = []
        for r in (r for r in rows if r[0] == name):
            if not (r[2] > 0.25 and run and run[-1][1] == r[1] - 1):
                closed(run)
                run = []
            if r[2] > 0.25:
                run.append(r)
        closed(run)
    df = spark.createDataFrame(rows, SAMPLES)
    for least in (None, 2.0):
        found = sorted((r["id"], r["on"], r["off"], r["npts"], r["p_max"], r["at_max"]) for r in trigger.triggers(df, 0.6, 0.25, min_fold=least, length=length).collect())
        assert found == sorted(w[:6] for w in wanted if least is None or w[7] >= least) and len(found) > 50
    means = {(r["id"], r["on"]): r["fold_mean"] for r in trigger.triggers(df, 0.6, 0.25, length=length).collect()}
    assert means == pytest.approx({w[:2]: w[6] for w in wanted})
