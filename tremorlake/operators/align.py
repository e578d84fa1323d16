"""Joins in time and space: as-of, interpolation, bins, ranges, nearest."""

from __future__ import annotations

from collections.abc import Sequence
import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from tremorlake.functions.exprs import EARTH_RADIUS_KM, haversine_km
from tremorlake.operators.scan import (
    DAY_US,
    attach,
    chunk_of,
    is_hot,
    exact_quantiles,
    key_stats,
    micros,
    running,
    with_row_index,
)

# Channels that are summed over a bin; every other channel is interpolated.
SUM_CHANNELS = ("precipitation", "precip", "rain", "snowmelt")
KM_PER_DEGREE = math.pi * EARTH_RADIUS_KM / 180.0


def neighbours(
    targets: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    *,
    x: str = "ts",
    value: str = "value",
    chunk: Column | None = None,
    hot: bool | None = None,
) -> DataFrame:
    """Adds prev / next ``struct(x, v)``: the source samples around each target.

    One ordered scan over targets and source together; nothing is replicated per
    target.  ``prev`` includes a sample exactly at the target.
    """
    extra = [c for c in targets.columns if c not in (*keys, x)]
    t = targets.select(*keys, x, F.lit(1).alias("_is_t"), F.struct(F.lit(1).alias("_"), *extra).alias("_row"))
    s = source.where(F.col(value).isNotNull()).select(
        *keys, x, F.lit(0).alias("_is_t"), F.col(value).alias("_val")
    )
    both = t.unionByName(s, allowMissingColumns=True)
    sample = F.when(F.col("_is_t") == 0, F.struct(F.col(x).alias("x"), F.col("_val").alias("v")))
    chunk = chunk_of(x) if chunk is None else chunk
    order = [x, "_is_t"]
    scan = running(both, keys, order, {"prev": ("last", sample)}, chunk=chunk, hot=hot)
    scan = running(scan, keys, order, {"next": ("last", sample)}, chunk=chunk, reverse=True, hot=hot)
    return scan.where(F.col("_is_t") == 1).select(
        *keys, x, *[F.col(f"_row.{c}").alias(c) for c in extra], "prev", "next"
    )


def _num(c: Column, is_time: bool) -> Column:
    return F.unix_micros(c).cast("double") if is_time else c.cast("double")


def _blend(x: Column, is_time: bool = True) -> Column:
    return _blend_pair(F.col("prev"), F.col("next"), x, is_time)


def _blend_pair(p: Column, n: Column, x: Column, is_time: bool) -> Column:
    x0, x1, xt = _num(p["x"], is_time), _num(n["x"], is_time), _num(x, is_time)
    inside = p["v"] + (n["v"] - p["v"]) * (xt - x0) / (x1 - x0)
    return F.when(x0 == xt, p["v"]).when(n.isNotNull(), inside)


def interp_linear(
    targets: DataFrame, source: DataFrame, keys: Sequence[str], *, x: str = "ts", out: str = "value"
) -> DataFrame:
    """Time-weighted interpolation: leading gap NULL, trailing gap forward-filled."""
    nb = neighbours(targets, source, keys, x=x)
    value = F.when(
        F.col("prev").isNotNull(), F.coalesce(_blend(F.col(x)), F.col("prev.v"))
    )
    return nb.withColumn(out, value).drop("prev", "next")


def interp_nearest(
    targets: DataFrame, source: DataFrame, keys: Sequence[str], *, out: str = "value"
) -> DataFrame:
    """Nearest sample inside the source span; a tie takes the earlier sample."""
    nb = neighbours(targets, source, keys)
    back = micros("ts") - F.unix_micros("prev.x")
    ahead = F.unix_micros("next.x") - micros("ts")
    value = F.when(back == 0, F.col("prev.v")).when(
        F.col("prev").isNotNull() & F.col("next").isNotNull(),
        F.when(back <= ahead, F.col("prev.v")).otherwise(F.col("next.v")),
    )
    return nb.withColumn(out, value).drop("prev", "next")


def asof_ffill(
    targets: DataFrame, source: DataFrame, keys: Sequence[str], *, out: str = "value"
) -> DataFrame:
    """Latest source value at or before each target."""
    rows = targets.select("*", F.lit(1).alias("_is_t")).unionByName(
        source.where(F.col("value").isNotNull()).select(
            *keys, "ts", F.col("value").alias("_val"), F.lit(0).alias("_is_t")
        ),
        allowMissingColumns=True,
    )
    scan = running(rows, keys, ["ts", "_is_t"], {out: ("last", F.col("_val"))})
    return scan.where(F.col("_is_t") == 1).select(*targets.columns, out)


def asof_nearest_tolerance(
    targets: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    *,
    tolerance_s: float = 3600.0,
    out: str = "value",
) -> DataFrame:
    """Nearest sample within the tolerance, on either side; a tie takes the later one."""
    nb = neighbours(targets, source, keys)
    back = (micros("ts") - F.unix_micros("prev.x")) / 1e6
    ahead = (F.unix_micros("next.x") - micros("ts")) / 1e6
    use_back = F.col("next").isNull() | (back < ahead) | (back == 0)
    gap = F.when(use_back, back).otherwise(ahead)
    value = F.when(use_back, F.col("prev.v")).otherwise(F.col("next.v"))
    return nb.withColumn(out, F.when(gap <= tolerance_s, value)).drop("prev", "next")


def target_grid(targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: first target (t0_us) and the median target spacing in whole seconds."""
    gaps = running(
        targets.select(*keys, "ts"), keys, ["ts"], {"_prev": ("lag", F.col("ts"))}
    ).withColumn("_gap", (micros("ts") - micros("_prev")) / 1e6)
    step = exact_quantiles(gaps, keys, F.col("_gap"), {"_step": 0.5})
    start = targets.groupBy(*keys).agg(F.min(micros("ts")).alias("t0_us"))
    return start.join(step, list(keys)).select(
        *keys, "t0_us", (F.floor("_step") * 1_000_000).cast("long").alias("step_us")
    )


def bin_aggregate(
    targets: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    *,
    aggregation: str = "sum",
    out: str = "value",
) -> DataFrame:
    """Aggregate the source into bins [t, t + step) anchored at the first target.

    Targets off the bin edges and outside the source's bins get NULL; an empty
    bin inside is 0 for a sum, NULL otherwise.
    """
    agg = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}[aggregation]
    grid = target_grid(targets, keys)
    offset = micros("ts") - F.col("t0_us")
    k = F.floor(offset / F.col("step_us")).cast("long")
    binned = (
        attach(source, grid, keys, ["ts"])
        .groupBy(*keys, k.alias("_bin"))
        .agg(agg("value").alias(out))
    )
    extent = binned.groupBy(*keys).agg(
        F.min("_bin").alias("_first"), F.max("_bin").alias("_last")
    )
    grid = grid.join(extent, list(keys))
    edges = attach(targets, grid, keys, ["ts"], how="left").withColumn(
        "_bin", F.when(F.pmod(offset, F.col("step_us")) == 0, k)
    )
    joined = edges.join(binned, [*keys, "_bin"], "left")
    if aggregation == "sum":
        inside = F.col("_bin").between(F.col("_first"), F.col("_last"))
        joined = joined.withColumn(
            out, F.coalesce(F.col(out), F.when(inside, F.lit(0.0)))
        )
    return joined.select(*targets.columns, out)


def align_forcings(
    dvv: DataFrame, forcing: DataFrame, channels: Sequence[str], *, key: str = "site_id"
) -> DataFrame:
    """One row per dv/v epoch with one column per channel.

    Sum-type channels are binned, all others are interpolated in time.
    """
    if not is_hot(dvv, None):
        return _align_in_one_scan(dvv, forcing, channels, key)
    out = dvv
    epochs = dvv.select(key, "ts")
    for channel in channels:
        src = forcing.where(F.col("channel") == channel).select(key, "ts", "value")
        fn = bin_aggregate if channel.lower() in SUM_CHANNELS else interp_linear
        out = out.join(fn(epochs, src, [key], out=channel), [key, "ts"], "left")
    return out


def _align_in_one_scan(dvv: DataFrame, forcing: DataFrame, channels: Sequence[str], key: str) -> DataFrame:
    """Bounded form of ``align_forcings``: one shuffle by key for everything.

    Epochs and forcing samples are united once; grid, bins and neighbours are
    window functions over the same partitioning, so each input is read once.
    """
    extra = [c for c in dvv.columns if c not in (key, "ts")]
    epochs = dvv.select(key, "ts", F.lit(1).alias("_is_t"), F.struct(F.lit(1).alias("_"), *extra).alias("_row"))
    samples = forcing.where(F.col("channel").isin(list(channels)) & F.col("value").isNotNull()).select(
        key, "ts", F.lit(0).alias("_is_t"), "channel", "value"
    )
    rows = epochs.unionByName(samples, allowMissingColumns=True)
    is_t, us = F.col("_is_t") == 1, micros("ts")
    whole = W.partitionBy(key)
    earlier = W.partitionBy(key).orderBy("ts", "_is_t").rowsBetween(W.unboundedPreceding, -1)
    gap = F.when(is_t, us - F.max(F.when(is_t, us)).over(earlier)) / 1e6
    rows = rows.withColumn("_gap", gap).select(
        "*",
        F.min(F.when(is_t, us)).over(whole).alias("_t0"),
        (F.floor(F.percentile("_gap", F.lit(0.5)).over(whole)) * 1_000_000).cast("long").alias("_step"),
    )
    offset = us - F.col("_t0")
    rows = rows.withColumn("_bin", F.floor(offset / F.col("_step")).cast("long"))
    specs = {"prev": {}, "next": {}}
    bins, out = [], {}
    in_bin = W.partitionBy(key, "_bin")
    for i, channel in enumerate(channels):
        mine = F.col("channel") == channel
        if channel.lower() in SUM_CHANNELS:
            bins += [
                F.sum(F.when(mine, F.col("value"))).over(in_bin).alias(f"_sum{i}"),
                F.min(F.when(mine, F.col("_bin"))).over(whole).alias(f"_lo{i}"),
                F.max(F.when(mine, F.col("_bin"))).over(whole).alias(f"_hi{i}"),
            ]
            inside = F.col("_bin").between(F.col(f"_lo{i}"), F.col(f"_hi{i}"))
            total = F.coalesce(F.col(f"_sum{i}"), F.when(inside, F.lit(0.0)))
            out[channel] = F.when(F.pmod(offset, F.col("_step")) == 0, total)
            continue
        sample = F.when(mine, F.struct(F.col("ts").alias("x"), F.col("value").alias("v")))
        specs["prev"][f"_p{i}"] = specs["next"][f"_n{i}"] = ("last", sample)
        p, n = F.col(f"_p{i}"), F.col(f"_n{i}")
        out[channel] = F.when(p.isNotNull(), F.coalesce(_blend_pair(p, n, F.col("ts"), True), p["v"]))
    rows = rows.select("*", *bins) if bins else rows
    if specs["prev"]:
        rows = running(rows, [key], ["ts", "_is_t"], specs["prev"], hot=False)
        rows = running(rows, [key], ["ts", "_is_t"], specs["next"], hot=False, reverse=True)
    return rows.where(is_t).select(
        key, "ts", *[F.col(f"_row.{c}").alias(c) for c in extra], *[e.alias(c) for c, e in out.items()]
    )


def self_lag(
    df: DataFrame, keys: Sequence[str], *, value: str, shifts_days: Sequence[float], out: str, shift: str | None = None
) -> DataFrame:
    """A series' own value (mean removed) ``shift`` days earlier, 0 outside the record.

    Every row is expanded in place into its sample and one shifted reading point
    per lag, so the input is read once whatever the number of lags.  ``shift``
    names the lag column of the result; it is left out for a single lag.
    """
    centred = key_stats(df, keys, {"_mu": F.avg(value)}).withColumn("_v", F.col(value) - F.col("_mu"))
    # each sample carries its successor, so one forward scan finds both neighbours
    own = F.struct(F.col("ts").alias("x"), F.col("_v").alias("v"))
    centred = running(centred, keys, ["ts"], {"_after": ("lag", own)}, reverse=True)
    points = F.array(F.lit(None).cast("double"), *[F.lit(float(s)) for s in shifts_days])
    rows = centred.withColumn("_s", F.explode(points)).withColumn("_is_t", F.col("_s").isNotNull().cast("int"))
    rows = rows.withColumn(
        "_x", F.timestamp_micros((micros("ts") - F.coalesce("_s", F.lit(0.0)) * DAY_US).cast("long"))
    )
    sample = F.when(F.col("_is_t") == 0, F.struct(F.col("ts").alias("x"), F.col("_v").alias("v"), F.col("_after").alias("n")))
    rows = running(rows, keys, ["_x", "_is_t"], {"prev": ("last", sample)})
    lagged = F.coalesce(_blend_pair(F.col("prev"), F.col("prev.n"), F.col("_x"), True), F.lit(0.0))
    keep = [c for c in df.columns if c != out]
    return rows.where(F.col("_is_t") == 1).select(
        *keep, *([F.col("_s").alias(shift)] if shift else []), lagged.alias(out)
    )


def lag_join(
    targets: DataFrame,
    series: DataFrame,
    keys: Sequence[str],
    *,
    shift_days: Column,
    value: str,
    out: str,
) -> DataFrame:
    """``value`` (mean removed) at ``ts - shift``, linear, 0 outside the record.

    ``targets`` may carry one row per (epoch, shift): the series itself is never
    replicated over the shifts.
    """
    centred = key_stats(series, keys, {"_mu": F.avg(value)}).select(
        *keys, F.col("ts").alias("_x"), (F.col(value) - F.col("_mu")).alias("value")
    )
    shifted = targets.withColumn(
        "_x", F.timestamp_micros((micros("ts") - shift_days * DAY_US).cast("long"))
    )
    nb = neighbours(shifted, centred, keys, x="_x")
    return nb.withColumn(out, F.coalesce(_blend(F.col("_x")), F.lit(0.0))).drop(
        "_x", "prev", "next"
    )


def events_near_sites(
    events: DataFrame,
    sites: DataFrame,
    *,
    radius_km: float,
    min_magnitude: float | None = None,
    digits: int | None = None,
    salts: int = 16,
) -> DataFrame:
    """Events within a radius of each site: grid-cell equi-join, exact filter.

    Distances, rounded to ``digits`` before the filter if given, are worked out once for each
    pair of different places; events and sites then join their places.

    Cells are about one radius wide.  Sites are copied to every cell their
    circle touches (all longitudes when it holds a pole); event places keep one cell
    and a salt, so a swarm in one cell spreads over tasks.  Both sides of each join are
    shuffled: the copies look as small as the site table to the planner, which
    would send all of them through the driver.
    """
    span = radius_km / KM_PER_DEGREE
    n_lon = max(1, int(360.0 / max(span, 1e-6)))
    width = 360.0 / n_lon
    lat, lon = F.col("latitude"), F.col("longitude")
    reach = F.sin(F.lit(min(radius_km / EARTH_RADIUS_KM, math.pi / 2))) / F.cos(F.radians(lat))
    polar = (F.abs(lat) + span >= 90.0) | (reach >= 1.0)
    dlon = F.when(polar, 180.0).otherwise(F.degrees(F.asin(F.least(reach, F.lit(1.0)))))
    lon_cells = F.array_distinct(
        F.transform(
            F.sequence(
                F.floor((lon - dlon + 180.0) / width).cast("long"),
                F.floor((lon + dlon + 180.0) / width).cast("long"),
            ),
            lambda c: F.pmod(c, F.lit(n_lon)),
        )
    )
    copies = (
        sites.select("latitude", "longitude").distinct()
        .withColumns({"site_lat": lat, "site_lon": lon})
        .withColumn(
            "_clat",
            F.explode(
                F.sequence(
                    F.floor((lat - span) / span).cast("long"),
                    F.floor((lat + span) / span).cast("long"),
                )
            ),
        )
        .withColumn("_clon", F.explode(lon_cells))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        .drop("latitude", "longitude")
    )
    ev = events if min_magnitude is None else events.where(F.col("magnitude") >= min_magnitude)
    cells = ev.select("latitude", "longitude").distinct().select(
        "*",
        F.floor(lat / span).cast("long").alias("_clat"),
        F.pmod(F.floor((lon + 180.0) / width), F.lit(n_lon)).cast("long").alias("_clon"),
        F.pmod(F.xxhash64("latitude", "longitude"), F.lit(salts)).cast("int").alias("_salt"),
    )
    distance = haversine_km(F.col("site_lat"), F.col("site_lon"), lat, lon)
    places = (
        cells.join(copies.hint("merge"), ["_clat", "_clon", "_salt"])
        .withColumn("distance_km", distance if digits is None else F.round(distance, digits))
        .where(F.col("distance_km") <= radius_km)
        .drop("_clat", "_clon", "_salt")
    )
    at = sites.select("site_id", lat.alias("site_lat"), lon.alias("site_lon"))
    near = places.join(at.hint("merge"), ["site_lat", "site_lon"]).drop("site_lat", "site_lon")
    if "site_id" in ev.columns:
        ev = ev.drop("site_id")
    return ev.join(near.hint("merge"), ["latitude", "longitude"]).select(*ev.columns, "site_id", "distance_km")


def nearest_layer(points: DataFrame, layers: DataFrame, *, depth: str) -> DataFrame:
    """Layer whose midpoint is nearest to a depth; ties take the shallower layer.

    A profile has a handful of layers, so they travel as one array per site and
    the points are never grouped.
    """
    deep = running(layers, ["site_id"], ["layer_idx"], {"_deep": ("sum", F.col("thickness_km"))}, hot=False)
    profile = (
        deep.withColumn("mid_km", F.col("_deep") - F.col("thickness_km") / 2)
        .groupBy("site_id")
        .agg(F.sort_array(F.collect_list(F.struct("layer_idx", "mid_km", "vp", "vs", "rho"))).alias("_l"))
    )
    best = F.array_min(
        F.transform(
            "_l",
            lambda e: F.struct(
                F.abs(e["mid_km"] - F.col(depth)).alias("gap"), e["layer_idx"].alias("layer_idx"),
                e["mid_km"].alias("mid_km"), e["vp"].alias("vp"), e["vs"].alias("vs"),
                e["rho"].alias("rho"),
            ),
        )
    )
    return points.join(profile, "site_id").withColumn("_best", best).select(
        *points.columns, "_best.layer_idx", "_best.mid_km", "_best.vp", "_best.vs", "_best.rho"
    )


def _nearest_axis(stations: DataFrame, axis: DataFrame, name: str) -> DataFrame:
    one = F.lit(0).alias("_k")
    t = stations.select("site_id", one, F.col(name).cast("double").alias("_x"))
    s = axis.select(one, F.col(name).cast("double").alias("_x")).distinct().withColumn("value", F.col("_x"))
    nb = neighbours(t, s, ["_k"], x="_x", chunk=F.floor("_x").cast("long"), hot=True)
    back, ahead = F.col("_x") - F.col("prev.x"), F.col("next.x") - F.col("_x")
    pick = F.when(F.col("next").isNull() | (back <= ahead), F.col("prev.v")).otherwise(F.col("next.v"))
    return nb.select("site_id", pick.alias(f"cell_{name}"))


def nearest_grid_cell(stations: DataFrame, cells: DataFrame) -> DataFrame:
    """Nearest node of a rectangular grid, axis by axis, via one sorted scan each."""
    lat = _nearest_axis(stations, cells, "latitude")
    lon = _nearest_axis(stations, cells, "longitude")
    return lat.join(lon, "site_id")


def case_config_cross(cases: DataFrame, configs: DataFrame, *, on: str = "use_case") -> DataFrame:
    """Every (case, config) cell of a case's own grid, in stable order."""
    return cases.join(configs, on)


def event_onset_match(
    segments: DataFrame, events: DataFrame, keys: Sequence[str], *, window: int = 5
) -> DataFrame:
    """Adds n_near_events: events within +-window samples of a segment onset.

    Events are first merged per sample, then copied to the two or three buckets
    their reach touches, which turns the range join into an equi-join.
    """
    width = 2 * window + 1
    merged = events.groupBy(*keys, F.col("idx").alias("_ev")).agg(F.count("*").alias("_n"))
    near = merged.withColumn(
        "_bucket",
        F.explode(
            F.sequence(
                F.floor((F.col("_ev") - window) / width).cast("long"),
                F.floor((F.col("_ev") + window) / width).cast("long"),
            )
        ),
    )
    seg = segments.withColumn("_bucket", F.floor(F.col("onset_idx") / width).cast("long"))
    hits = seg.select(*keys, "onset_idx", "_bucket").distinct().join(near, [*keys, "_bucket"])
    counts = (
        hits.where(F.abs(F.col("_ev") - F.col("onset_idx")) <= window)
        .groupBy(*keys, "onset_idx")
        .agg(F.sum("_n").alias("n_near_events"))
    )
    return segments.join(counts, [*keys, "onset_idx"], "left").withColumn(
        "n_near_events", F.coalesce("n_near_events", F.lit(0))
    )


def provider_fallback(
    candidates: DataFrame, order: Sequence[str], *, key: str = "site_id"
) -> DataFrame:
    """First provider in ``order`` that resolves; earlier misses become warnings.

    ``candidates``: key, provider, resolved, reason.  There are at most
    ``len(order)`` rows per key, so the list of misses is bounded.
    """
    ranks = F.create_map(*[F.lit(v) for pair in ((p, i) for i, p in enumerate(order)) for v in pair])
    c = candidates.withColumn("_rank", F.element_at(ranks, F.col("provider"))).where(
        F.col("_rank").isNotNull()
    )
    miss = F.struct("_rank", F.concat_ws(": ", "provider", "reason").alias("text"))
    per = c.groupBy(key).agg(
        F.min(F.when(F.col("resolved"), F.col("_rank"))).alias("_win"),
        F.sort_array(F.collect_set(F.when(~F.col("resolved"), miss))).alias("_miss"),
    )
    winner = F.element_at(F.array(*[F.lit(p) for p in order]), (F.col("_win") + 1).cast("int"))
    before = F.filter("_miss", lambda m: F.col("_win").isNull() | (m["_rank"] < F.col("_win")))
    return per.select(
        key,
        F.when(F.col("_win").isNotNull(), winner).otherwise("unresolved").alias("source"),
        F.transform(before, lambda m: m["text"]).alias("warnings"),
    )


def epoch_pair_join(
    df: DataFrame, keys: Sequence[str], *, max_lag: int, value: str = "dvv", sigma: str = "dvv_err"
) -> DataFrame:
    """Edges (i, j) with i < j <= i + max_lag as an equi-join on the epoch number."""
    idx = with_row_index(df.select(*keys, "ts", value, sigma), keys, ["ts"], "i")
    left = idx.select(
        *keys, "i", F.col(value).alias("_vi"), F.col(sigma).alias("_si"),
        F.explode(F.sequence(F.col("i") + 1, F.col("i") + max_lag)).alias("j"),
    )
    right = idx.select(*keys, F.col("i").alias("j"), F.col(value).alias("_vj"), F.col(sigma).alias("_sj"))
    return left.join(right, [*keys, "j"]).select(
        *keys, "i", "j", (F.col("_vi") - F.col("_vj")).alias("rel"),
        F.sqrt(F.col("_si") ** 2 + F.col("_sj") ** 2).alias("sigma"),
    )
