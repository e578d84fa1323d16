"""Queries against their SQL twins on larger tables than the smallest, and what made them differ."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

TABLES = "/root/testdata"


@pytest.mark.skipif(not Path(TABLES).exists(), reason="test tables not present")
@pytest.mark.parametrize("name, sf", [("network_dvv", "sf0.01"), ("disambiguate_keys", "sf0.1")])
def test_twin(spark, name, sf):
    ok, message, rows, _ = compare(spark, duck(f"{TABLES}/{sf}"), entry.queries()[name], entry.oracle_sql()[name], f"{TABLES}/{sf}")
    assert ok and rows > 0, message


def test_one_character_suffixes_pass_z(spark):
    from tremorlake.operators import literature

    rows = [("k", f"d{i:03d}", i) for i in range(300)] + [(None, "x", 999)]
    df = spark.createDataFrame(rows, "base string, doi string, n int")
    got = {r["doi"]: r["cite_key"] for r in literature.disambiguate_keys(df, base="base", doi="doi", order="n", letters=False).collect()}
    assert got == {"d000": "k", "x": None} | {f"d{i:03d}": "k" + chr(97 + i) for i in range(1, 300)}


def test_copies_of_sites_stay_off_the_driver(spark):
    import numpy as np
    import pandas as pd

    from tremorlake.operators.align import events_near_sites

    rng = np.random.default_rng(2)
    place = lambda n: {"latitude": np.round(rng.uniform(30, 31, n), 1), "longitude": np.round(rng.uniform(-120, -119, n), 1)}
    events = pd.DataFrame({"event_id": range(80), "magnitude": 5.0, **place(80)})
    sites = pd.DataFrame({"site_id": range(40), **place(40)})
    df = events_near_sites(spark.createDataFrame(events), spark.createDataFrame(sites), radius_km=40.0)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    both = events.merge(sites, how="cross")
    p, q = np.radians(both.latitude_x), np.radians(both.latitude_y)
    h = np.sin((p - q) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(both.longitude_x - both.longitude_y) / 2) ** 2
    want = both[2 * 6371.0 * np.arcsin(np.sqrt(h)) <= 40.0]
    got = df.toPandas()
    assert len(got) > 80 and sorted(zip(got.event_id, got.site_id)) == sorted(zip(want.event_id, want.site_id))
