import fnmatch

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldloom.functions import ids, shapes
from foldloom.operators import collate, dsp, frames, pairs, predict, series, trigger, windows
from foldloom.plans import pipeline
from foldloom.sources import messages, packets

from .test_stack import packet, table


@given(st.text(alphabet="ab.[]!*?-^\\", max_size=8), st.text(alphabet="ab.-^", max_size=6))
def test_globs_are_those_of_the_shell(pattern, text):
    import re

    try:
        expected = fnmatch.fnmatchcase(text, pattern)
    except re.error:
        return
    assert bool(re.match(ids.glob_to_regex(pattern), text)) == expected


def test_id_keys(spark):
    row = [("UW", "MCW", "", "ENZ", "", ""), ("UW", "MCW", None, "ENZ", "EQT", "stead"), ("UW", "MCW", "01", "ENZ", "", "w")]
    df = spark.createDataFrame(row, "network string, station string, location string, channel string, model string, weight string")
    assert [r[0] for r in df.select(ids.id_key("id")).collect()] == ["UW.MCW..ENZ", "UW.MCW..ENZ.EQT.stead", "UW.MCW.01.ENZ..w"]
    assert df.select(ids.id_key("inst"), ids.id_key("component"), ids.id_key("sncl"), ids.id_key("site")).first()[:] == ("UW.MCW..EN", "Z", "MCW.UW.ENZ.", "UW.MCW.")
    with pytest.raises(ValueError):
        ids.id_key("nope")


def test_chunks_do_not_matter(spark):
    rng = np.random.default_rng(0)
    rows = packet(spark, ("a", 5, rng.normal(size=100).tolist(), None), ("a", 140, rng.normal(size=30).tolist(), None))
    for work in (
        lambda n: series.differentiate(rows, 2.0, length=n),
        lambda n: series.integrate(rows, 2.0, length=n),
        lambda n: series.sta_lta(rows, 3, 9, length=n),
        lambda n: series.z_detect(rows, 4, length=n),
        lambda n: series.interpolate(rows, 3, length=n),
    ):
        small, large = table(work(7)), table(work(65_536))
        assert small.keys() == large.keys()
        assert all(small[k] == pytest.approx(large[k]) for k in small)


@given(st.lists(st.booleans(), min_size=1, max_size=60), st.sampled_from([1, 2, 7]))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_runs_across_chunks(spark, marks, length):
    rows = spark.createDataFrame([("a", k, bool(m)) for k, m in enumerate(marks)], "id string, idx long, m boolean")
    expected, first = [], None
    for k, m in enumerate([*marks, False]):
        if m and first is None:
            first = k
        if not m and first is not None:
            expected.append((first, k - 1))
            first = None
    assert sorted((r["first"], r["last"]) for r in frames.run_bounds(rows, ["id"], F.col("m"), length).collect()) == expected


@pytest.mark.parametrize("length", [3, 65_536])
def test_triggers(spark, length):
    data = [0, 0.4, 0.6, 0.9, 0.9, 0.4, 0.2, 0.6, 0.1, 0.4, 0.4, 0.8]
    rows = packet(spark, ("a", 100, data, None))
    assert {(r["on"], r["off"]) for r in trigger.onsets(rows, 0.5, 0.3, length=length).collect()} == {(102, 105), (107, 107), (111, 111)}
    assert {(r["on"], r["off"]) for r in trigger.onsets(rows, 0.5, 0.3, max_len=2, length=length).collect()} == {(107, 107), (111, 111)}
    found = {r["on"]: r for r in trigger.triggers(rows, 0.5, 0.3, length=length).collect()}
    assert (found[102]["p_max"], found[102]["at_max"], found[102]["npts"], found[102]["fold_mean"]) == (0.9, 103, 4, 1.0)


def test_fold_gate_spares_the_last_sample(spark):
    rows = packet(spark, ("a", 0, [0, 1, 1, 1, 0, 1, 1, 0], [1, 1, 1, 0, 1, 0, 1, 1]))
    assert {r["on"] for r in trigger.triggers(rows, 0.5, 0.5, min_fold=1.0).collect()} == {1}


def test_butterworth_gain():
    sections = dsp.butterworth(4, 2.0, 20.0, 100.0)
    impulse = np.zeros(4096)
    impulse[0] = 1
    gain = np.abs(np.fft.rfft(dsp.sos_filter(impulse, sections)))
    at = lambda f: gain[int(round(f * 4096 / 100))]
    assert at(7) == pytest.approx(1, abs=0.02) and at(2) == pytest.approx(2**-0.5, abs=0.01) and at(20) == pytest.approx(2**-0.5, abs=0.01)
    assert at(0) < 1e-6 and at(0.5) < 0.01 and at(45) < 0.01


def test_filter_blocks_settle_in_their_margin(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=3000)
    rows = packet(spark, ("a", 0, data.tolist(), None))
    whole = dsp.sos_filter(data, dsp.butterworth(4, 5.0, 20.0, 100.0))
    found = table(dsp.bandpass(rows, 5.0, 20.0, 100.0, block=500))
    assert np.allclose([found[k][0] for k in range(3000)], whole, atol=1e-6)


def test_resample_of_a_sine():
    x = np.sin(2 * np.pi * 3 * np.arange(100) / 100)
    assert np.allclose(dsp.fourier_resample(x, 200), np.sin(2 * np.pi * 3 * np.arange(200) / 200))
    assert np.allclose(dsp.fourier_resample(x, 50), x[::2])


def test_packets_with_gaps_are_resampled_in_pieces(spark):
    x = np.sin(np.arange(20))
    data = [float(v) for v in x]
    data[4] = data[11] = data[13] = None
    rows = packet(spark, ("a", 100, data, None))
    pieces = {r["start"]: r["data"] for r in packets.unmasked(packets.to_packets(rows, 48, "id"), "id").collect()}
    assert pieces == {100: data[:4], 105: data[5:11], 112: data[12:13], 114: data[14:]}
    found = table(packets.to_samples(dsp.resample(packets.unmasked(packets.to_packets(rows, 48, "id"), "id"), 2.0, "id"), "id"))
    assert {k // 2 - 100 for k in found if k % 2 == 0} == {k for k, v in enumerate(data) if v is not None} and len(found) == 7 + 11 + 1 + 11
    assert all(found[2 * (100 + k)][0] == pytest.approx(v) for k, v in enumerate(data) if v is not None)


def test_windows_with_gaps_reach_the_scorer(spark):
    rows = [("i", c, k, float(k), 1.0) for c in "PCS" for k in range(48) if (c, k) not in (("P", 5), ("C", 6), ("S", 23), ("S", 24), ("P", 40))]
    df = spark.createDataFrame(rows, "instrument string, component string, idx long, value double, fold double")
    placed = windows.placed(df, ["instrument"], F.col("component") == "P", 24, 12)
    filled = collate.fill_components(placed, 24, "PCS", "secondary", primary_share=0.9, secondary_share=0.8)
    given = collate.whole(filled, windows.spans(placed, ["instrument"], 24, 12))
    found = {r["k"]: r["tensor"] for r in collate.tensor(given, "PCS", 24).collect()}
    assert set(found) == {0, 1, 2} and found[0][0] == [0.0 if k == 5 else float(k) for k in range(24)] and found[1][2][11:14] == [0.0, 0.0, 25.0]
    assert {(r["component"], r["idx"]) for r in given.where("k = 0 and fold = 0").collect()} == {("P", 5), ("C", 6), ("S", 23)}


def test_picks_in_spite_of_gaps(spark):
    rows = [("i", c, k, 50.0 if 60 <= k < 66 else 1.0, 1.0) for c in "PCS" for k in range(120) if k % 24 != 1]
    df = spark.createDataFrame(rows, "instrument string, component string, idx long, value double, fold double")
    found = pipeline.picking(df, "PCS", length=24, step=12, blinding=2, thr_on=0.6, thr_off=0.3).collect()
    assert found


def test_characteristic_functions():
    x = np.r_[np.ones(50), 5 * np.ones(10)]
    assert dsp.recursive_sta_lta(x, 3, 20)[:20].tolist() == [0] * 20 and dsp.recursive_sta_lta(x, 3, 20)[52] > 2
    assert dsp.delayed_sta_lta(x, 3, 20)[49] == pytest.approx(1) and dsp.delayed_sta_lta(x, 3, 20)[52] == pytest.approx(25)
    swinging = dsp.carl_trigger(x * (-1.0) ** np.arange(60), 4, 20)
    assert swinging[55] > 1 > swinging[40]


def test_gaussian_fit(spark):
    x = np.arange(60, dtype=float)
    y = 0.9 * np.exp(-((x - 31.3) ** 2) / (2 * 5.0**2))
    p, cov = dsp.fit_gaussian(x, y)
    assert p == pytest.approx([0.9, 31.3, 5.0], abs=1e-6) and cov.shape == (3, 3)
    rows = spark.createDataFrame([("a", 7, int(i), float(v)) for i, v in zip(x, y, strict=True)] + [("b", 1, 1, 1.0)], "id string, on long, idx long, value double")
    (row,) = dsp.gaussian_fits(rows).collect()
    assert (row["id"], row["on"]) == ("a", 7) and row["mean"] == pytest.approx(31.3, abs=1e-5)


def test_shapes_and_distances(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    assert [r[0] for r in df.select(shapes.uniform(F.col("x"), 2, 1, 3)).collect()] == [0, 2, 2, 0, 0]
    assert [r[0] for r in df.select(shapes.isosceles(F.col("x"), 2, 2, 2)).collect()] == [0, 1, 2, 1, 0]
    one = lambda v: F.lit(float(v))
    row = df.select(shapes.kl_gaussian(one(0), one(1), one(0), one(1)), shapes.kl_gaussian(one(0), one(1), one(2), one(4)), shapes.kl_uniform(one(2), one(4)), shapes.ssmd(one(0), one(9), one(5), one(16))).first()
    assert row[0] == 0 and row[1] == pytest.approx(0.5 * (np.log(4) + 5 / 4 - 1)) and row[2] == pytest.approx(np.log(2)) and row[3] == 1


def test_band_join_equals_filtered_pairs(spark):
    rng = np.random.default_rng(3)
    stats = spark.createDataFrame([(k, float(m), float(v)) for k, (m, v) in enumerate(zip(rng.normal(0, 6, 80), rng.uniform(1, 2, 80), strict=True))], "key int, mean double, var double")
    near = {(r["key_1"], r["key_2"]) for r in pairs.band_pairs(stats, 1.5).collect()}
    every = {(r["key_1"], r["key_2"]) for r in pairs.all_pairs(stats).where("abs(mean_1 - mean_2) <= 1.5").collect()}
    assert near == every and near


def test_dense_bands_are_dealt_to_tasks(spark, monkeypatch):
    """Many rows of one mean make more tasks, none of which has a large share of the pairs; and none is lost or found twice."""
    for name, value in (("BLOCK_ROWS", 16), ("TASK_PAIRS", 1 << 12)):
        monkeypatch.setattr(pairs, name, value, raising=False)
    rng = np.random.default_rng(4)
    means = [1.0] * 250 + [float(m) for m in rng.uniform(-20, 20, 50)]
    stats = spark.createDataFrame([(k, m, 1.0 + k % 3) for k, m in enumerate(means)] + [(300, None, 1.0)], "key int, mean double, var double")
    wanted = sorted((a, b) for a, m in enumerate(means) for b, n in enumerate(means) if a != b and abs(m - n) <= 1.5)
    found = pairs.band_pairs(stats, 1.5).select("key_1", "key_2", F.spark_partition_id().alias("part")).collect()
    assert sorted((r["key_1"], r["key_2"]) for r in found) == wanted
    picks = stats.select(F.lit("x").alias("id"), F.col("key").alias("pick_id"), "mean", "var")
    half = trigger.similar(picks, 1.5, ["id"]).select("pick_id_1", "pick_id_2", F.spark_partition_id().alias("part")).collect()
    assert sorted((r["pick_id_1"], r["pick_id_2"]) for r in half) == [(a, b) for a, b in wanted if a < b]
    for rows in (found, half):
        assert max(sum(r["part"] == p for r in rows) for p in {r["part"] for r in rows}) < len(rows) / 4


def test_window_counts(spark):
    rows = packet(spark, ("a", 10, list(range(100)), None)).withColumn("series", F.lit("a"))
    found = windows.ready(rows, ["id"], "series", F.lit(True), 20, 15, min_valid=1.0, delay=5).collect()
    assert sorted(r["first"] for r in found) == [10, 25, 40, 55, 70]
    assert len(windows.ready(rows, ["id"], "series", F.lit(True), 20, 15, min_valid=1.0, eager=True).collect()) == 6
    with pytest.raises(ValueError):
        windows.ready(rows, ["id"], "series", F.lit(True), 20, 15, delay=1, eager=True)
    assert windows.model_windows(6000, 100.0, 1800, 2) == {"length": 60.0, "step": 42.0, "delay": 78.0}


def test_components_are_repaired(spark):
    rows = [("i", 0, c, k, float(k + 10 * n), 1.0) for n, c in enumerate("ZN") for k in range(4)] + [("i", 0, "E", 0, 5.0, 1.0)] + [("i", 1, "N", k, 1.0, 1.0) for k in range(4, 8)]
    df = spark.createDataFrame(rows, "instrument string, k long, component string, idx long, value double, fold double")
    for rule, values in (("zeros", [0.0] * 4), ("primary", [0.0, 1, 2, 3]), ("secondary", [10.0, 11, 12, 13])):
        filled = collate.fill_components(df, 4, "ZNE", rule)
        got = {(r["component"], r["idx"]): (r["value"], r["fold"]) for r in filled.collect()}
        assert len(got) == 12 and [got["E", k] for k in range(4)] == [(v, 0.0) for v in values] and got["N", 3] == (13, 1)
        (t,) = collate.tensor(filled, "ZNE", 4).collect()
        assert t["tensor"][2] == values
    assert [r["primary"] for r in collate.header(df, ["Z"]).collect()] == ["Z"]


def test_scorer_shapes(spark):
    scorer = predict.energy_ratio(2, 8)
    out = scorer(np.random.default_rng(0).normal(size=(29, 3, 60)).astype(np.float32))
    assert out.shape == (29, 3, 60) and out.min() >= 0 and out.max() <= 1
    rows = spark.createDataFrame([("i", k, [[float(x) for x in range(12)]] * 3) for k in range(5)], "instrument string, k long, tensor array<array<float>>")
    assert predict.predict(rows, {"a": scorer, "b": scorer}, ("D", "P", "S"), "M", batch_size=2).count() == 5 * 2 * 3


def test_declared_pipeline(spark):
    rows = packet(spark, ("a", 0, [1.0, 2, 3, 4], None))
    made = pipeline.declared([{"operator": "demean", "needs": ["value"]}, {"name": "scale", "operator": "normalize", "arguments": {"how": "max"}}])
    assert [v for _, (v, _) in sorted(table(made.run(rows)).items())] == pytest.approx([-1, -1 / 3, 1 / 3, 1])
    assert made.names == ["demean_0", "scale"] and made.updated(pipeline.Step("more", series.demean)).names[-1] == "more"
    with pytest.raises(ValueError):
        pipeline.declared([{"operator": "os.system"}])
    with pytest.raises(ValueError):
        made.run(rows.drop("value"))
    assert pipeline.resolved({"a": {"x": "1", "y": "${x}2"}, "b": {"z": "<${a:y}>"}}) == {"a": {"x": "1", "y": "12"}, "b": {"z": "<12>"}}
    with pytest.raises(ValueError):
        pipeline.resolved({"a": {"x": "${y}", "y": "${x}"}})


def test_waves_round_trip(spark):
    rows = [("S", "N", "BHZ", "", 3, 2.0, 10.0, 11.0, "i4", [1.0, 2.0, 3.0]), ("S", "N", "BHZ", "", 4, 2.0, 10.0, 11.0, "i4", [1.0, 2.0, 3.0]), ("", None, None, None, None, None, None, None, None, None)]
    waves = spark.createDataFrame(rows, messages.WAVE)
    assert [r[0] for r in waves.select(messages.is_wave()).collect()] == [True, False, False]
    assert [r[0] for r in waves.select(messages.is_empty()).collect()] == [False, False, True]
    packets = messages.wave_to_packet(waves)
    assert messages.packet_to_wave(packets, "i4").collect() == waves.limit(1).select("station", "network", "channel", "location", "nsamp", "samprate", "startt", "endt", "datatype", "data").collect()
    gappy = packets.withColumn("data", F.expr("array(1D, null, 1e12)")).withColumn("fold", F.expr("array(1D, 0D, 1D)"))
    assert [(r["nsamp"], r["startt"], r["data"]) for r in messages.packet_to_wave(gappy, "i2").orderBy("startt").collect()] == [(1, 10.0, [1.0]), (1, 11.0, [32767.0])]


def test_message_codes(spark):
    codes = {r["name"]: r["code"] for r in messages.message_codes(spark).collect()}
    assert codes["TYPE_HEARTBEAT"] == 3 and codes["TYPE_PICK2K"] == 10 and codes["TYPE_TRACEBUF2"] == 19 and len(codes) == 40
