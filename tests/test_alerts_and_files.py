"""Streaming alerts, station folders and bootstrap draws."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F


def series(seed, n=120):
    rng = np.random.default_rng(seed)
    day = np.sort(rng.choice(np.arange(2 * n), n, replace=False))
    z = rng.normal(0, 1, n)
    for at, m in ((10, 9), (40, 4), (70, 12)):
        z[at : at + m] = 5 * rng.choice([-1, 1]) + rng.random(m)
    return pd.DataFrame({"site_id": f"s{seed}", "ts": pd.Timestamp("2001-01-01") + pd.to_timedelta(day, unit="D"), "z": z})


def runs_of(pdf, threshold=3.0, least=7):
    out, run = [], []
    for r in [*pdf.sort_values("ts").itertuples(), None]:
        if r is not None and abs(r.z) >= threshold:
            run.append(r)
        else:
            if len(run) >= least and r is not None:
                out.append((run[0].ts, run[-1].ts, len(run)))
            run = []
    return out


def test_stream_alerts_equal_the_batch_operators(spark, tmp_path):
    from tremorlake.operators.quality import gap_detect
    from tremorlake.streaming.alerts import stream_alerts

    frames = [series(s) for s in (1, 2)]
    quiet = series(3).iloc[:20]  # ends early
    far = pd.DataFrame({"site_id": ["end"], "ts": [pd.Timestamp("2003-01-01")], "z": [0.0]})
    rows = pd.concat([*frames, quiet]).sort_values("ts")
    schema = "site_id string, ts timestamp, z double"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    alerts = stream_alerts(stream, lateness="20 days")
    for k, part in enumerate([*[rows.iloc[i] for i in np.array_split(np.arange(len(rows)), 6)], far, far.assign(ts=pd.Timestamp("2003-06-01"))]):
        part = part.sample(frac=1.0, random_state=k)  # inside a file in any order
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = alerts.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
    got = spark.read.parquet(str(tmp_path / "out")).toPandas()
    gaps = gap_detect(spark.createDataFrame(rows, schema), ["site_id"]).toPandas()
    mine = got[got.kind == "gap"]
    assert sorted(zip(mine.site_id, mine.start_ts, mine.end_ts)) == sorted(zip(gaps.site_id, gaps.gap_start, gaps.gap_end)) and len(gaps) > 5
    mine = got[got.kind == "run"]
    want = [(f.site_id.iloc[0], *r) for f in [*frames, quiet] for r in runs_of(f)]
    assert sorted(zip(mine.site_id, mine.start_ts, mine.end_ts, mine.n_samples)) == sorted(want) and len(want) >= 4
    assert mine.peak.abs().min() >= 4
    silent = got[got.kind == "silent"]
    assert ("s3", quiet.ts.max()) in set(zip(silent.site_id, silent.start_ts)) and silent.end_ts.isna().all()


def test_station_folder_with_corrupt_files(spark, tmp_path):
    from tremorlake.sources.io import load_station_archive, station_files

    for name in ("AB.X", "C D"):
        pd.DataFrame({"DATE": pd.date_range("2001-01-01", periods=5), "DVV": np.arange(5.0), "CC": 0.9}).to_parquet(tmp_path / f"{name}.parquet")
    (tmp_path / "bad.parquet").write_bytes(b"not a parquet file")
    (tmp_path / "none.parquet").write_bytes(b"")
    schema = "DATE timestamp, DVV double, CC double"
    got = load_station_archive(spark, str(tmp_path), schema=schema).toPandas()
    assert sorted(got.site_id.unique()) == ["AB.X", "C D"] and len(got) == 10
    files = {r["file_path"].rsplit("/", 1)[1]: (r["n_rows"], r["status"]) for r in station_files(spark, str(tmp_path), schema=schema).collect()}
    assert files["AB.X.parquet"] == (5, "ok") and files["bad.parquet"] == (0, "corrupt") and files["none.parquet"] == (0, "empty") and len(files) == 4


def test_bootstrap_draws_are_rows_with_replacement(spark):
    from tremorlake.operators.regress import bootstrap_draws, propagate

    rows = [("a", i, float(i), -float(i)) for i in range(50)] + [("b", 7, 3.0, -3.0)]
    df = spark.createDataFrame(rows, "site_id string, sample long, x double, y double")
    got = bootstrap_draws(df, ["site_id"], n_draws=5000).toPandas()
    assert (got.x == -got.y).all() and got.groupby("site_id").size().to_dict() == {"a": 5000, "b": 5000}
    share = got[got.site_id == "a"].x.value_counts()
    assert len(share) == 50 and share.min() > 60 and share.max() < 145
    again = bootstrap_draws(df.repartition(7), ["site_id"], n_draws=5000).toPandas()
    assert sorted(map(tuple, got.values)) == sorted(map(tuple, again.values))
    r = {x["site_id"]: x for x in propagate(bootstrap_draws(df, ["site_id"], n_draws=5000), ["site_id"], s=F.col("x") ** 2).collect()}
    assert r["b"]["s_mean"] == 9.0 and r["b"]["s_std"] == 0.0 and r["a"]["s_mean"] == pytest.approx(np.mean(np.arange(50.0) ** 2), rel=0.1)
