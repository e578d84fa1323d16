import pandas as pd
import pytest
from pyspark.sql import Observation, functions as F

from tremorlake.operators import sites as site_ops, sweep
from tremorlake.sources import io
from tremorlake.streaming.align import stream_bins


@pytest.fixture()
def frame():
    return pd.DataFrame({"Date": ["2001-01-02", "2001-01-01", "bad"], "dvv": [0.2, 0.1, 0.3], "site_id": "a"})


def test_formats_agree(spark, frame, tmp_path):
    import pyarrow as pa
    import pyarrow.feather as feather

    frame.to_csv(tmp_path / "x.csv", index=False)
    frame.to_csv(tmp_path / "x.tsv", index=False, sep="\t")
    frame.to_parquet(tmp_path / "x.parquet")
    feather.write_feather(pa.Table.from_pandas(frame, preserve_index=False), str(tmp_path / "x.feather"))
    for name in ("x.csv", "x.tsv", "x.parquet", "x.feather"):
        obs = Observation()
        out = io.load_dvv(io.read_table(spark, str(tmp_path / name)), units="percent", observation=obs).toPandas()
        assert sorted(out["dvv"]) == pytest.approx([0.001, 0.002])
        assert out["dvv_err"].tolist() == pytest.approx([1e-5, 1e-5]) and out["err_defaulted"].all()
        assert obs.get["n_dropped"] == 1 and obs.get["n_rows"] == 3
    with pytest.raises(ValueError):
        io.read_table(spark, "x.xlsx")


def test_station_folder(spark, tmp_path):
    for st in ("CI.AAA", "CI.BBB"):
        pd.DataFrame({"DATE": pd.to_datetime(["2001-01-01", "2001-01-01", "2001-01-02"]), "DVV": [1.0, 9.0, 2.0], "CC": 0.9}).to_parquet(tmp_path / f"{st}.parquet", coerce_timestamps="us")
    out = io.load_station_archive(spark, str(tmp_path)).toPandas()
    assert sorted(out["site_id"].unique()) == ["CI.AAA", "CI.BBB"] and len(out) == 4
    assert out.groupby("ts")["dvv"].max().tolist() == pytest.approx([0.01, 0.02])


def test_ambiguous_forcing(spark):
    df = spark.createDataFrame([("s", "2001-01-01", 1.0, 2.0)], "site_id string, time string, a double, b double")
    with pytest.raises(ValueError):
        io.load_forcing(df, "rain")
    assert io.load_forcing(df, "rain", value_column="b").first()["value"] == 2.0


def test_sites_json(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"site_id": "a", "latitude": 1.0,\n "layers": [{"thickness_km": 1.0, "vp": 2.0, "vs": 1.0, "rho": 2.0}, {"thickness_km": 9.0, "vp": 3.0, "vs": 1.5, "rho": 2.2}]}')
    out = io.read_layers(io.read_sites(spark, str(tmp_path / "s.json"))).toPandas()
    assert out["layer_idx"].tolist() == [0, 1] and out["vs"].tolist() == [1.0, 1.5]


def test_sweep_write_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "sweep")
    rows = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 2.0)], "case_id string, config_index long, rms double")
    io.write_sweep(rows, path)
    io.write_sweep(rows.where("case_id = 'a'").withColumn("rms", F.lit(5.0)), path)
    got = {r["case_id"]: r["rms"] for r in io.read_sweep(spark, path).collect()}
    assert got == {"a": 5.0, "b": 2.0}


def test_export_run_and_benchmark(spark, tmp_path):
    coef = spark.createDataFrame([("s1", "a0", 1.0), ("s2", "a0", 2.0)], "site_id string, param string, mean double")
    io.export_run({"parameters": coef, "results": coef, "residuals": coef, "summary": coef}, str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run/residuals")).count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "run/parameters")).count() == 2
    rows = spark.range(100).select("id", (F.col("id") % 2).alias("task"), F.lit(None).cast("string").alias("split"), F.lit(None).cast("string").alias("visibility"))
    kept = io.benchmark_rows(rows, splits=["validation"])
    a = io.benchmark_manifest(kept, by="task", payload=["id", "split"]).orderBy("task").collect()
    b = io.benchmark_manifest(kept.repartition(7), by="task", payload=["id", "split"]).orderBy("task").collect()
    assert a == b and [r["n_rows"] for r in a] == [50, 50]
    io.export_benchmark_rows(kept, str(tmp_path / "bench"), by="task", payload=["id"])
    assert spark.read.json(str(tmp_path / "bench/rows")).count() == 100


def test_grid_sizes(spark):
    cases = spark.createDataFrame([("c1", "volcano", False), ("c2", "groundwater", True)], "case_id string, use_case string, two_layer boolean")
    n = {(g, r["case_id"]): r["count"] for g in ("compact", "multiverse") for r in sweep.build_grid(cases, g).groupBy("case_id").count().collect()}
    assert n[("compact", "c1")] == 4 and n[("multiverse", "c1")] == 648 and n[("multiverse", "c2")] == 432
    idx = sorted(r[0] for r in sweep.build_grid(cases, "multiverse").where("case_id = 'c1'").select("config_index").collect())
    assert idx == list(range(648))
    with pytest.raises(ValueError):
        sweep.build_grid(cases, "huge")
    with pytest.raises(KeyError):
        sweep.recommend_config(cases, overrides=["bandd"])


def test_oat_menu(spark):
    base = spark.createDataFrame([("c", "TS", 10)], "case_id string, estimator string, stack int")
    out = sweep.oat_menu(base, {"estimator": ["MWCS", "DTW"], "stack": [1]}).orderBy("config_index").collect()
    assert [(r["axis"], r["estimator"], r["stack"]) for r in out] == [("baseline", "TS", 10), ("estimator", "MWCS", 10), ("estimator", "DTW", 10), ("stack", "TS", 1)]


def test_default_priors(spark):
    assert site_ops.default_priors(spark).count() == 18


def test_stream_bins(spark, tmp_path):
    src = spark.createDataFrame(pd.DataFrame({"site_id": "s", "channel": "rain", "ts": pd.date_range("2001-01-01", periods=240, freq="h"), "value": 1.0}))
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = stream_bins(stream).writeStream.format("memory").queryName("bins").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    out = spark.table("bins").toPandas()
    assert len(out) >= 7 and (out["total"] == 24).all()
