import numpy as np
import pytest
from pyspark.sql import functions as F

from foldloom.operators import dsp, frames, regrid, select, series, windows

from .test_stack import packet, table


def plain(x, up, down, offset, first, make):
    """Values by number of the new grid, for one contiguous piece from sample `first`."""
    out = {}
    for k in range(-(-(first * up - offset) // down), ((first + len(x) - 1) * up - offset) // down + 1):
        out[k] = make(x, (k * down + offset) / up - first)
    return out


def slopes(x, at):
    i = min(int(at), len(x) - 2)
    d = np.diff(x)
    mean = lambda a, b: 2 / (1 / a + 1 / b) if a * b > 0 else 0.0
    s = [d[0], *[mean(a, b) for a, b in zip(d[:-1], d[1:], strict=True)], d[-1]]
    u = at - i
    return x[i] * (2 * u**3 - 3 * u**2 + 1) + s[i] * (u**3 - 2 * u**2 + u) + x[i + 1] * (3 * u**2 - 2 * u**3) + s[i + 1] * (u**3 - u**2)


@pytest.mark.parametrize(("up", "down", "offset"), [(3, 2, 0), (1, 4, 2), (7, 5, -3), (4, 4, 1)])
def test_new_grids(spark, up, down, offset):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=30), rng.normal(size=9)
    rows = packet(spark, ("a", 5, x.tolist(), None), ("a", 60, y.tolist(), None), ("b", 7, [1.5], None))
    for method, make in (("slopes", slopes), ("linear", lambda x, at: np.interp(at, np.arange(len(x)), x)), ("zero", lambda x, at: x[int(at)])):
        expected = plain(x, up, down, offset, 5, make) | plain(y, up, down, offset, 60, make)
        for length in (7, 65_536):
            got = regrid.interpolated(rows, up, down, method, offset, length=length)
            found = {k: v[0] for k, v in table(got.where("id = 'a'")).items()}
            assert found.keys() == expected.keys() and all(found[k] == pytest.approx(expected[k]) for k in found)
    alone = table(regrid.interpolated(rows.where("id = 'b'"), up, down, "slopes", offset))
    assert [v[0] for v in alone.values()] == ([1.5] if (7 * up - offset) % down == 0 else [])


def test_splines_reproduce_their_polynomials():
    at = np.linspace(0, 999, 3001)
    for degree in (2, 3):
        poly = np.polynomial.Polynomial(np.random.default_rng(degree).normal(size=degree + 1) / 1000.0 ** np.arange(degree + 1))
        assert np.allclose(regrid.spline(poly(np.arange(1000.0)), at, degree), poly(at), atol=1e-9)
    assert regrid.spline(np.array([2.0]), np.array([0.0]), 3).tolist() == [2.0]
    assert np.allclose(regrid.spline(np.array([2.0, 4.0]), np.array([0.5]), 3), 3.0)


def test_stretches_of_a_spline_join(monkeypatch):
    y, at = np.random.default_rng(1).normal(size=900), np.sort(np.random.default_rng(2).uniform(0, 899, 500))
    for degree in (2, 3):
        parts = regrid.spline(y, at, degree)
        monkeypatch.setattr(regrid, "STRETCH", 10_000)
        assert np.allclose(parts, regrid.spline(y, at, degree), atol=1e-10)
        assert np.allclose(regrid.spline(y, np.arange(900.0), degree), y)
        monkeypatch.undo()


@pytest.mark.parametrize("method", ["quadratic", "cubic", "lanczos"])
def test_smooth_methods_by_block(spark, monkeypatch, method):
    monkeypatch.setattr(regrid, "BLOCK", 100)
    x = np.sin(np.arange(330) / 9.0)
    rows = packet(spark, ("a", 40, x.tolist(), None), ("a", 500, x[:50].tolist(), None))
    found = {k: v[0] for k, v in table(regrid.interpolated(rows, 3, 2, method, 1)).items()}
    expected = plain(x, 3, 2, 1, 40, lambda x, at: np.sin(at / 9.0)) | plain(x[:50], 3, 2, 1, 500, lambda x, at: np.sin(at / 9.0))
    assert found.keys() == expected.keys() and all(found[k] == pytest.approx(expected[k], abs=0.03 if method == "lanczos" else 2e-4) for k in found)


def test_folds_on_a_new_grid(spark):
    rows = packet(spark, ("a", 0, [0.0, 1, 2, 3, 4, 5], [1, 1, 1, 2, 2, 2]))
    found = [r["fold"] for r in regrid.folds_on(rows, 2, 1, 0, -2, 12).orderBy("idx").collect()]
    assert found == [0, 0, 1, 1, 1, 1, 1, 1.5, 2, 2, 2, 2, 2, 0, 0]


def test_alignment(spark):
    rows = packet(spark, ("a", 0, [1.0] * 10, None))
    assert sorted(table(regrid.aligned(rows, 5, 1000))) == list(range(10))
    found = table(regrid.aligned(rows, 300, 1000))
    assert sorted(found) == list(range(1, 10)) and all(v == (1.0, 1.0) for v in found.values())
    ramp = table(regrid.aligned(packet(spark, ("a", 0, [float(k) for k in range(10)], None)), 300, 1000))
    assert all(ramp[k][0] == pytest.approx(k - 0.3) for k in range(1, 10))


def test_decimation_removes_what_would_alias(spark):
    n = np.arange(2000)
    slow, fast = np.sin(2 * np.pi * n / 100), np.sin(2 * np.pi * n * 0.4)
    found = {r["idx"]: r["value"] for r in regrid.decimated(packet(spark, ("a", 0, (slow + fast).tolist(), None)), 5).collect()}
    assert len(found) == 400 and all(abs(found[k] - slow[5 * k]) < 0.01 for k in range(20, 380))


def test_pieces_are_worked_on_alone(spark):
    rows = packet(spark, ("a", 0, [0.0, 1, 2, None, 9, 9, 9], None))
    found = table(regrid.by_piece(rows, series.detrend))
    assert sorted(found) == [0, 1, 2, 4, 5, 6] and all(abs(v[0]) < 1e-9 for v in found.values())


def test_bands_are_transformed_whole():
    for order in (1, 2, 3, 4, 5):
        for stop in (False, True):
            sections = dsp.butterworth(order, 5.0, 20.0, 100.0, stop)
            impulse = np.zeros(8192)
            impulse[0] = 1
            gain = np.abs(np.fft.rfft(dsp.sos_filter(impulse, sections)))
            f = np.fft.rfftfreq(8192, 0.01)
            warped = np.tan(np.pi * f[1:-1] / 100)
            low, high = np.tan(np.pi * 5 / 100), np.tan(np.pi * 20 / 100)
            with np.errstate(divide="ignore"):
                ratio = (warped**2 - low * high) / (warped * (high - low))
                expected = 1 / np.sqrt(1 + (1 / ratio if stop else ratio) ** (2 * order))
            assert np.allclose(gain[1:-1], expected, atol=1e-3), (order, stop)
    with pytest.raises(ValueError):
        dsp.butterworth(4, 20.0, 5.0, 100.0)


def test_recurrence_against_a_loop():
    x = np.random.default_rng(3).normal(size=777)
    for a1, a2 in ((-0.9, 0.0), (-1.6, 0.8), (0.3, 0.1)):
        y, p, q = [], 0.0, 0.0
        for v in x:
            p, q = v - a1 * p - a2 * q, p
            y.append(p)
        assert np.allclose(dsp.recurrence(x, a1, a2), y)


@pytest.mark.parametrize("name", ["recstalta", "delayedstalta", "carlstatrig"])
def test_margins_follow_the_operator(spark, name):
    """Blocks give what the whole series gives, also where an operator looks back over several blocks of the default size."""
    x = np.random.default_rng(4).normal(size=40_000)
    rows = spark.createDataFrame([("a", k, float(v), 1.0) for k, v in enumerate(x)], "id string, idx long, value double, fold double")
    for nlta, block in ((6000, 9000), (50, 1000)):
        got = {r["idx"]: r["value"] for r in dsp.characteristic(rows, name, 20, nlta, block=block).collect()}
        assert np.allclose([got[k] for k in range(len(x))], dsp.CHARACTERISTIC[name](x, 20, nlta), atol=1e-6)


def test_carl_against_plain_means():
    x = np.random.default_rng(5).normal(size=60)
    mean = lambda v, n: np.array([np.mean(v[max(0, k - n + 1) : k + 1]) for k in range(len(v))])
    sta = mean(x, 3)
    lta = mean(sta, 9)
    star = mean(np.abs(x - lta), 3)
    assert np.allclose(dsp.carl_trigger(x, 3, 9), star - 0.8 * mean(star, 9) - np.abs(sta - lta) - 0.8)


def test_spectral_window_keeps_a_slow_wave():
    x = np.sin(2 * np.pi * 2 * np.arange(400) / 400)
    found = dsp.fourier_resample(x, 200, "hann")
    assert np.allclose(found, x[::2], atol=1e-3) and dsp.fourier_resample(np.cos(np.pi * np.arange(400)), 800, "hann").max() < 0.01


def test_many_runs_in_a_long_series(spark):
    """10^6 samples with 10^5 runs: linear in both."""
    rows = spark.range(1_000_000).selectExpr("'a' as id", "id as idx", "case when id % 10 < 7 then 1.0D end as value", "1.0D as fold")
    found = series.split(rows)
    told = found.agg(F.count("*").alias("n"), F.count_distinct("first").alias("runs"), F.sum((F.col("idx").between(F.col("first"), F.col("last"))).cast("int")).alias("inside"), F.min(F.col("last") - F.col("first")).alias("least")).first()
    assert (told["n"], told["runs"], told["inside"], told["least"]) == (700_000, 100_000, 700_000, 6)


def test_spans_may_overlap(spark):
    rows = packet(spark, ("a", 0, [float(k) for k in range(10)], None))
    spans = spark.createDataFrame([("a", 1, 4, "x"), ("a", 3, 6, "y")], "id string, first long, last long, name string")
    found = sorted((r["name"], r["idx"]) for r in frames.in_spans(rows, spans, ["id"]).collect())
    assert found == [("x", 1), ("x", 2), ("x", 3), ("x", 4), ("y", 3), ("y", 4), ("y", 5), ("y", 6)]


def test_positions_to_the_end(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as v").repartition(5)
    assert [r["v"] for r in select.positions(df, ["v"], 3, None, 100).orderBy("v").collect()] == list(range(3, 1000, 100))
    assert sorted(r["v"] for r in select.positions(df, ["v"], 5, 9).collect()) == [5, 6, 7, 8]


def test_repeated_rows_stay_owned(spark):
    rows = spark.createDataFrame([("a", k) for k in (0, 5, 5, 30)], "id string, idx long")
    found = sorted((r["idx"], r["k"]) for r in windows.owned(rows, ["id"], F.lit(True), 24, 12).collect())
    assert found == [(0, 0), (5, 0), (5, 0), (30, 1)]


def test_long_triggers_are_fitted_by_sums(spark):
    rng = np.random.default_rng(6)
    shape = lambda k, h, m, d: h * np.exp(-((k - m) ** 2) / (2 * d**2))
    k = np.arange(400)
    rows = [("a", 0, int(i) + 1000, float(v)) for i, v in zip(k, shape(k, 3.0, 180.0, 40.0) + rng.normal(size=400) * 0.05, strict=True)]
    rows += [("b", 7, int(i), float(v)) for i, v in zip(k[:30], shape(k[:30], 2.0, 14.0, 4.0), strict=True)]
    inside = spark.createDataFrame(rows, 'id string, `on` long, idx long, value double')
    one, two = ({r["id"]: r for r in dsp.gaussian_fits(inside, most=n).collect()} for n in (10_000, 50))
    assert one.keys() == two.keys() == {"a", "b"}
    for name in one:
        for c in ("height", "mean", "std", "l2"):
            assert two[name][c] == pytest.approx(one[name][c], rel=1e-5, abs=1e-6)
        assert np.allclose(np.array(one[name]["covariance"]), np.array(two[name]["covariance"]), rtol=1e-3, atol=1e-8)
