"""Restartable sweeps and scored submissions on small waveforms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

K = ["pair_id", "component"]


@pytest.fixture(scope="module")
def waves(spark):
    rng = np.random.default_rng(0)
    t = np.arange(64) - 32.0
    rows = []
    for p in range(3):
        base = np.interp(np.arange(64), np.arange(0, 64, 2), rng.normal(size=32))
        for d in range(40):
            eps = 0.02 * np.sin(d / 9)
            rows.append((f"pair{p}", "ZZ", d, [float(x) for x in np.interp(t / (1 + eps), t, base) + 0.05 * rng.normal(size=64)]))
    return spark.createDataFrame(rows, "pair_id string, component string, day long, ccf array<double>").cache()


def truth(waves):
    return waves.select("pair_id", "day").distinct().withColumn("truth", -0.02 * F.sin(F.col("day") / 9.0))


PAIR = "struct<lo:double,hi:double>"
GRID = f"pair_id string, config_index int, estimator string, band {PAIR}, window {PAIR}, stack int, reference string, gate boolean, eps_max double"


def grid(spark):
    rows = [
        (f"pair{p}", i, e, (0.05, 0.4), (4.0, hi), k, "fixed", False, 0.06)
        for p in range(3) for i, (e, hi, k) in enumerate([("stretching (TS)", 28.0, 1), ("MWCS", 28.0, 3), ("nonsense", 28.0, 1), ("stretching (TS)", 20.0, 3), ("MWCS", 20.0, 5)])
    ]
    return spark.createDataFrame(rows, GRID)


def table(df):
    return sorted((r["pair_id"], r["config_index"], None if r["rms"] is None else round(r["rms"], 9), r["ok"]) for r in df.collect())


def test_a_resumed_sweep_equals_an_uninterrupted_one(spark, waves, tmp_path):
    from tremorlake.operators.campaign import run_sweep

    go = lambda path, **kw: run_sweep(waves, grid(spark), truth(waves), str(path), K, fs=1.0, t0=-32.0, max_stack=5, waves=3, **kw)
    whole = table(go(tmp_path / "a"))
    assert len(whole) == 15 and sum(ok for *_, ok in whole) == 12
    first = table(go(tmp_path / "b", most_waves=1))
    assert 0 < len(first) < 15
    # a run that wrote its results and died before the manifest does not count
    lost = spark.createDataFrame([("dead", "pair0", 0, 9.9, 1, True, None)], "run string, pair_id string, config_index long, rms double, n_valid long, ok boolean, error string")
    lost.write.mode("append").parquet(str(tmp_path / "b" / "cells"))
    assert table(go(tmp_path / "b")) == whole
    before = spark.read.parquet(str(tmp_path / "b" / "cells")).count()
    assert table(go(tmp_path / "b")) == whole and spark.read.parquet(str(tmp_path / "b" / "cells")).count() == before


def test_submissions_are_checked_run_and_scored(spark, waves):
    from tremorlake.operators.campaign import score_config_submissions

    ok, band, window = "stretching (TS)", (0.05, 0.4), (4.0, 28.0)
    rows = [
        ("good", "pair0", "volcano", ok, band, window), ("no band", "pair0", "volcano", ok, None, window), ("magic", "pair0", "volcano", "magic", band, window),
        ("turned", "pair1", "volcano", ok, (0.4, 0.1), window), ("good", "pair1", "an aquifer", ok, band, window), ("unknown", "pair1", "moon base", ok, band, window),
        ("poor", "pair2", "volcano", "MWCS", (0.3, 0.31), (20.0, 29.0)), ("good", "pair9", "volcano", ok, band, window), ("good", "pair2", "volcano", ok, band, window),
    ]
    sub = spark.createDataFrame([(*r, 1, "fixed", False) for r in rows], f"submission_id string, pair_id string, use_case string, estimator string, band {PAIR}, window {PAIR}, stack int, reference string, gate boolean")
    cases = spark.createDataFrame([("pair0", 0.005, 0.3, None), ("pair1", 1e-6, 0.3, 1e-4), ("pair2", 0.005, 0.3, None)], "pair_id string, rms_target double, rel_tol double, rms_wrong_layer double")
    got = {(r["submission_id"], r["pair_id"]): r for r in score_config_submissions(sub, waves, truth(waves), cases, K, fs=1.0, t0=-32.0, max_stack=3).collect()}
    assert len(got) == len(rows)
    assert got["good", "pair0"]["score"] == 1.0 and got["good", "pair0"]["rms"] < 0.0065
    assert {k for k, r in got.items() if not r["valid"]} == {("no band", "pair0"), ("magic", "pair0"), ("turned", "pair1"), ("unknown", "pair1")}
    assert all(got[k]["score"] == 0.0 and got[k]["rms"] is None for k in got if not got[k]["valid"])
    assert got["good", "pair1"]["score"] == 0.0 and got["good", "pair1"]["rms"] > 0  # its case asks for more
    assert got["good", "pair9"]["score"] is None and got["poor", "pair2"]["score"] < got["good", "pair2"]["score"]
