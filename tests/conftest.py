import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture()
def both_forms(spark):
    """Run a function in the bounded and in the hot form and return both results."""
    from tremorlake.operators.scan import HOT_CONF

    def run(fn):
        out = []
        for mode in ("false", "true"):
            spark.conf.set(HOT_CONF, mode)
            try:
                out.append(fn().toPandas())
            finally:
                spark.conf.unset(HOT_CONF)
        return out

    return run


@pytest.fixture(scope="session")
def series(spark):
    """One site holds most rows; irregular times, gaps and ties."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    parts = []
    for site, n in (("hot", 3000), ("b", 150), ("c", 60)):
        day = np.sort(rng.choice(np.arange(n * 2), n, replace=False))
        parts.append(pd.DataFrame({
            "site_id": site, "ts": pd.Timestamp("2001-01-01") + pd.to_timedelta(day, unit="D"),
            "dvv": np.round(rng.normal(0, 1, n), 2), "dvv_err": rng.uniform(0.5, 2, n),
            "precipitation": np.where(rng.random(n) < 0.7, 0.0, rng.exponential(1.0, n)), "temperature": rng.normal(10, 3, n),
        }))
    return spark.createDataFrame(pd.concat(parts))
