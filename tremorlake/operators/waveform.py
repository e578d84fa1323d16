"""Measure dv/v from correlation waveforms: one distributed job for all pairs.

Input ``ccf``: key columns, ``day`` (0-based epoch number) and ``ccf`` (array).
Epochs are cut into chunks with a halo of earlier epochs, so stacks and moving
references are exact and no task ever holds a whole pair.
"""

from __future__ import annotations

from collections.abc import Sequence
import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tremorlake.functions import kernels
from tremorlake.functions.exprs import eps_to_dvv, weaver_error
from tremorlake.operators.chain import chain_nodes
from tremorlake.operators.scan import attach, running

CHUNK = 64
REF_DAYS = 45
BLOCK_DAYS = 7
MAX_BLOCK_LAG = 10
SUM_VALUES = 4_000_000  # samples of vector sums that a task holds before it passes them on
KEYS = ("pair_id", "component")


def _axis(n: int, fs: float, t0: float) -> np.ndarray:
    return t0 + np.arange(n) / fs


def _key_schema(df: DataFrame, keys: Sequence[str], rest: str) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in keys) + ", " + rest


def _partial_sums(batch: pa.RecordBatch, keys: Sequence[str], held: dict) -> None:
    """Add a batch's waveforms to the sums per key; waveforms of different lengths are kept apart."""
    waves = batch.column("ccf")
    length = pc.fill_null(pc.list_value_length(waves), 0).to_numpy(zero_copy_only=False)
    ids = {f"k{i}": batch.column(k).to_pandas() for i, k in enumerate(keys)}
    for at in pd.DataFrame({**ids, "n": length}).groupby([*ids, "n"], dropna=False, sort=False).indices.values():
        n = int(length[at[0]])
        if n == 0:
            continue
        rows = pa.array(at)
        flat = waves.take(rows).flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)
        seen = np.full(n, len(at), np.int64)
        if flat.null_count:
            absent = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, n)
            x, seen = np.where(absent, 0.0, x), seen - absent.sum(0)
        first = batch.select(list(keys)).take(pa.array([at[0]]))
        name = (*(repr(v) for v in first.to_pylist()[0].values()), n)
        if name in held:
            held[name][1] += x.sum(0)
            held[name][2] += seen
            held[name][3] += len(at)
        else:
            held[name] = [first, x.sum(0), seen, len(at)]


def _sum_batch(held: dict, keys: Sequence[str]) -> pa.RecordBatch:
    cols = {k: pa.concat_arrays([h[0].column(k) for h in held.values()]) for k in keys}
    cols["s"] = pa.array([h[1] for h in held.values()], pa.list_(pa.float64()))
    cols["c"] = pa.array([h[2] for h in held.values()], pa.list_(pa.int64()))
    cols["n"] = pa.array([h[3] for h in held.values()], pa.int64())
    held.clear()
    return pa.RecordBatch.from_pydict(cols)


def elementwise_mean(df: DataFrame, keys: Sequence[str], *, ccf: str = "ccf") -> DataFrame:
    """Mean waveform per key (keys, ccf, n_epochs).

    Every task adds up the waveforms of each key as vectors, and only those sums are shuffled and merged. Null
    samples are left out of the mean; a null or empty waveform does not count.
    """
    keys = list(keys)
    head = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.schema if f.name in keys)

    def add(batches):
        held: dict = {}
        for batch in batches:
            _partial_sums(batch, keys, held)
            if sum(len(h[1]) for h in held.values()) > SUM_VALUES:
                yield _sum_batch(held, keys)
        if held:
            yield _sum_batch(held, keys)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        size = max(map(len, pdf["s"]))
        total, seen, epochs = np.zeros(size), np.zeros(size, np.int64), np.zeros(size, np.int64)
        for s, c, n in zip(pdf["s"], pdf["c"], pdf["n"]):
            total[: len(s)] += s
            seen[: len(s)] += c
            epochs[: len(s)] += n
        mean = [float(t) / int(c) if c else None for t, c in zip(total, seen)]
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "ccf": mean, "n_epochs": int(epochs.max())}])

    order = [f.name for f in df.schema if f.name in keys]
    sums = df.select(*order, F.col(ccf).alias("ccf")).mapInArrow(add, f"{head}s array<double>, c array<long>, n long")
    return sums.groupBy(*keys).applyInPandas(merge, f"{head}ccf array<double>, n_epochs long").select(*keys, "ccf", "n_epochs")


def fixed_reference(ccf: DataFrame, keys: Sequence[str] = KEYS, *, fraction: float = 0.6) -> DataFrame:
    """Mean of the first 60 % of the epochs of each key."""
    n = ccf.groupBy(*keys).agg(F.count("*").alias("_n"))
    early = attach(ccf, n, keys, ["day"], hot=True).where(F.col("day") < F.floor(fraction * F.col("_n")))
    return elementwise_mean(early, keys)


def block_stack(ccf: DataFrame, keys: Sequence[str] = KEYS, *, block: int = BLOCK_DAYS) -> DataFrame:
    """Non-overlapping means of ``block`` epochs; an incomplete tail is dropped."""
    out = elementwise_mean(ccf.withColumn("block", F.floor(F.col("day") / block).cast("long")), [*keys, "block"])
    return out.where(F.col("n_epochs") == block).drop("n_epochs")


def _chunked(ccf: DataFrame, halo: int, size: int = CHUNK, day: str = "day") -> DataFrame:
    """Copy every epoch to its chunk and to the next chunks it is history for."""
    d = F.col(day)
    return ccf.withColumn(
        "_chunk",
        F.explode(F.sequence(F.floor(d / size).cast("long"), F.floor((d + halo) / size).cast("long"))),
    )


def _stack(x: np.ndarray, day: np.ndarray, k: int) -> np.ndarray:
    """Trailing mean of k rows (fewer at the start of the record) by cumulative sums."""
    if k <= 1:
        return x
    c = np.vstack([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)])
    hi = np.arange(1, len(x) + 1)
    lo = np.maximum(hi - k, 0)
    return (c[hi] - c[lo]) / (hi - lo)[:, None]


def _previous(x: np.ndarray, ref_days: int):
    """Mean of the ref_days rows before each row, and which rows have them."""
    c = np.vstack([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)])
    i = np.arange(len(x))
    lo = np.maximum(i - ref_days, 0)
    return (c[i] - c[lo]) / ref_days, i >= ref_days


def _per_chunk(ccf: DataFrame, keys: Sequence[str], halo: int, fn) -> DataFrame:
    keys = list(keys)
    schema = _key_schema(ccf, keys, "day bigint, ccf array<double>")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        chunk, day = int(pdf["_chunk"].iloc[0]), pdf["day"].to_numpy()
        out, ok = fn(np.stack(pdf["ccf"].to_numpy()).astype(float), day)
        keep = (day // CHUNK == chunk) & ok
        return pd.DataFrame({**{k: pdf[k].to_numpy()[keep] for k in keys}, "day": day[keep],
                             "ccf": pd.Series(list(out[keep]), dtype=object)})

    return _chunked(ccf.select(*keys, "day", "ccf"), halo).groupBy(*keys, "_chunk").applyInPandas(run, schema)


def trailing_stack(ccf: DataFrame, keys: Sequence[str] = KEYS, *, k: int) -> DataFrame:
    """Mean of the last k waveforms, shorter at the start."""
    return _per_chunk(ccf, keys, k - 1, lambda x, d: (_stack(x, d, k), np.ones(len(x), bool)))


def moving_reference(ccf: DataFrame, keys: Sequence[str] = KEYS, *, ref_days: int = REF_DAYS) -> DataFrame:
    """Mean of the ``ref_days`` epochs before each epoch; no row during warm-up."""
    return _per_chunk(ccf, keys, ref_days, lambda x, d: _previous(x, ref_days))


def bandpass_ccf(ccf: DataFrame, keys: Sequence[str] = KEYS, *, band: tuple[float, float], fs: float) -> DataFrame:
    """Zero-phase band-pass of every waveform, batch by batch."""
    keys = list(keys)
    schema = _key_schema(ccf, keys, "day bigint, ccf array<double>")

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = kernels.bandpass(np.stack(pdf["ccf"].to_numpy()).astype(float), fs, band)
                yield pdf.assign(ccf=list(x))

    return ccf.select(*keys, "day", "ccf").mapInPandas(run, schema)


def cc_image(
    ccf: DataFrame, reference: DataFrame, keys: Sequence[str] = KEYS, *, fs: float, t0: float,
    window: tuple[float, float], eps_max: float = 0.06, n_eps: int = 161, branch: str = "both",
) -> DataFrame:
    """Coherence image per epoch as an array over the stretch grid.

    Epochs come in chunks with their reference as one extra row; the bank of stretched, normalised references is made
    once a chunk and one matrix product gives the chunk's image. Waveforms are taken as already band-passed; an epoch without
    waveform has a null image, a key without reference no rows.
    """
    keys = list(keys)
    chunk = F.floor(F.col("day") / CHUNK).cast("long").alias("_chunk")
    rows = ccf.select(*keys, "day", F.col("ccf").cast("array<double>"), chunk)
    refs = rows.select(*keys, "_chunk").distinct().join(reference.select(*keys, F.col("ccf").cast("array<double>")), keys)
    both = rows.withColumn("_ref", F.lit(False)).unionByName(refs.select(*keys, F.lit(None).cast("long").alias("day"), "ccf", "_chunk", F.lit(True).alias("_ref")))
    eps = np.linspace(-eps_max, eps_max, n_eps)

    def image(pdf: pd.DataFrame) -> pd.DataFrame:
        is_ref = pdf["_ref"].to_numpy(bool)
        ref, waves = pdf.loc[is_ref, "ccf"], pdf[~is_ref]
        out = waves[[*keys, "day"]].assign(cc=pd.Series([None] * len(waves), waves.index, dtype=object))
        if not len(ref) or ref.iloc[0] is None:
            return out.iloc[:0]
        have = waves["ccf"].notna()
        if have.any():
            r = np.asarray(ref.iloc[0], float)
            cc = kernels.cc_image(np.stack(waves.loc[have, "ccf"].to_numpy()), r, _axis(len(r), fs, t0), window, eps, branch)
            out.loc[have, "cc"] = pd.Series(list(cc), out.index[have], dtype=object)
        return out

    return both.groupBy(*keys, "_chunk").applyInPandas(image, _key_schema(ccf, keys, "day bigint, cc array<double>"))


def peak_eps(image: DataFrame, keys: Sequence[str] = KEYS, *, eps_max: float = 0.06, n_eps: int = 161) -> DataFrame:
    """First maximum over the stretch grid with parabolic refinement, mapped to dv/v."""
    step = 2 * eps_max / (n_eps - 1)
    best = F.array_max("cc")
    rows = image.withColumn("_cc", best).withColumn("_i", (F.array_position("cc", best) - 1).cast("int"))
    a, b, c = F.get("cc", F.col("_i") - 1), F.col("_cc"), F.get("cc", F.col("_i") + 1)
    curve = a - 2 * b + c
    inner = (F.col("_i") > 0) & (F.col("_i") < n_eps - 1) & (curve != 0)
    off = F.when(inner, 0.5 * (a - c) / curve).otherwise(0.0)
    eps = -eps_max + step * (F.col("_i") + off)
    return rows.select(*keys, "day", eps.alias("eps"), eps_to_dvv(eps).alias("dvv"), F.col("_cc").alias("cc"))


def _measure_chunk(pdf: pd.DataFrame, keys: list[str], fs: float, t0: float, ref_days: int, configs: list[dict], size: int = CHUNK) -> pd.DataFrame:
    """All configs of one chunk: stacks, references and the band-pass are shared between configs.

    The band-pass is linear, so a moving reference of filtered stacks is the filtered reference.
    """
    chunk = int(pdf["_chunk"].iloc[0])
    fixed = pdf.loc[pdf["day"] == -1, "ccf"]
    ref = None if fixed.empty else np.asarray(fixed.iloc[0], float)
    rows = pdf[pdf["day"] >= 0].sort_values("day")
    day = rows["day"].to_numpy()
    x = np.stack(rows["ccf"].to_numpy()).astype(float)
    t, mine = _axis(x.shape[1], fs, t0), day // size == chunk
    stacks: dict = {}

    def stack(k: int, band: tuple | None) -> np.ndarray:
        if (k, band) not in stacks:
            stacks[k, band] = _stack(x, day, k) if band is None else kernels.bandpass(stack(k, None), fs, band)
        return stacks[k, band]

    references: dict = {}

    def reference(band: tuple | None):
        if band not in references:
            references[band] = ref if ref is None or band is None else kernels.bandpass(ref, fs, band)
        return references[band]

    previous: dict = {}
    parts = []
    for cfg in configs:
        n = int(mine.sum())
        dvv, cc, error = np.full(n, np.nan), np.full(n, np.nan), None
        try:
            k = int(cfg["stack"])
            band = tuple(map(float, cfg["band"])) if cfg["estimator"] in kernels.BAND_LIMITED else None
            cur = stack(k, band)
            if cfg["reference"] == "fixed":
                use, refs = np.ones(n, bool), reference(band)
            elif cfg["reference"] == "moving":
                if (k, band) not in previous:
                    previous[k, band] = _previous(cur, ref_days)
                before, enough = previous[k, band]
                use = (enough & (day >= ref_days))[mine]
                refs = before[mine][use]
            else:
                raise ValueError(f"unknown reference {cfg['reference']!r}")
            if use.any():
                d, c = kernels.ESTIMATORS[cfg["estimator"]](cur[mine][use], refs, t, fs, {**cfg, "filtered": band is not None})
                dvv[use] = d
                if c is not None:
                    cc[use] = c
        except Exception as exc:  # a bad cell is a row, not a failed job
            error = f"{type(exc).__name__}: {exc}"
        valid = np.isfinite(dvv)
        if cfg.get("gate") and cfg["reference"] == "fixed" and np.isfinite(cc).any():
            valid &= cc > 0.6
        parts.append(pd.DataFrame({
            **{key: rows[key].iloc[0] for key in keys}, "config_index": int(cfg["config_index"]), "day": day[mine],
            "dvv": dvv, "cc": cc, "valid": valid, "error": error,
        }))
    return pd.concat(parts, ignore_index=True)


RESULT = "config_index bigint, day bigint, dvv double, cc double, valid boolean, error string"


def _null_nan(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("dvv", "cc")})


def measure_dvv(
    ccf: DataFrame,
    configs: Sequence[dict] | DataFrame,
    keys: Sequence[str] = KEYS,
    *,
    fs: float,
    t0: float,
    ref_days: int = REF_DAYS,
    max_stack: int | None = None,
) -> DataFrame:
    """dv/v of every key, config and epoch: keys, config_index, day, dvv, cc, valid, error.

    ``configs`` is a list of dicts (config_index, estimator, band, window, stack,
    reference, gate, eps_max) used for every key, or a DataFrame keyed by the
    first key column with the grid of each case (then pass ``max_stack``).
    """
    keys = list(keys)
    base = ccf.select(*keys, "day", "ccf")
    if isinstance(configs, DataFrame):
        if max_stack is None:
            raise ValueError("a config table needs max_stack, which sizes the halo")
        pair = lambda c: F.array(f"{c}.lo", f"{c}.hi").alias(c)
        grids = configs.groupBy(keys[0]).agg(
            F.to_json(F.collect_list(F.struct(
                "config_index", "estimator", pair("band"), pair("window"), "stack", "reference", "gate", "eps_max"
            ))).alias("_cfg")
        )
        shared = None
    else:
        shared = list(configs)
        max_stack = max(int(c["stack"]) for c in shared)
        grids = None
    halo = max_stack - 1 + ref_days
    size = max(CHUNK, 4 * halo)  # a waveform is then copied to one and a quarter chunks
    rows = _chunked(base, halo, size)
    fixed = fixed_reference(base, keys).select(*keys, F.col("ccf"))
    # the reference reaches every chunk as one extra row
    chunks = base.select(*keys, F.floor(F.col("day") / size).cast("long").alias("_chunk")).distinct()
    ref_rows = fixed.join(chunks, keys).select(*keys, F.lit(-1).cast("long").alias("day"), "ccf", "_chunk")
    both = rows.withColumn("ccf", F.col("ccf").cast("array<double>")).unionByName(ref_rows)

    if grids is not None:  # the grid too is one row a chunk
        cfg_rows = chunks.join(grids, keys[0]).select(*keys, F.lit(-2).cast("long").alias("day"), "_chunk", "_cfg")
        both = both.unionByName(cfg_rows, allowMissingColumns=True)
    schema = _key_schema(ccf, keys, RESULT)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cfgs = shared
        if cfgs is None:
            cfgs = [c for text in pdf.loc[pdf["day"] == -2, "_cfg"] for c in json.loads(text)]
        chunk = int(pdf["_chunk"].iloc[0])
        cfgs = [c for c in cfgs if c["reference"] != "inversion"]
        if not cfgs or not ((pdf["day"] >= 0) & (pdf["day"] // size == chunk)).any():
            return pd.DataFrame(columns=[*keys, "config_index", "day", "dvv", "cc", "valid", "error"])
        return _measure_chunk(pdf, keys, fs, t0, ref_days, cfgs, size)

    out = _null_nan(both.groupBy(*keys, "_chunk").applyInPandas(run, schema))
    if shared is None:
        # cells that differ in stack or gate only share one inversion
        cells = (
            configs.where(F.col("reference") == "inversion")
            .groupBy(keys[0], F.col("band.lo").alias("blo"), F.col("band.hi").alias("bhi"), F.col("window.lo").alias("t1"), F.col("window.hi").alias("t2"))
            .agg(F.collect_list(F.col("config_index").cast("long")).alias("cells"))
            .groupBy(keys[0]).agg(F.collect_list(F.struct("blo", "bhi", "t1", "t2", "cells")).alias("_inv"))
        )
        asked = base.join(cells.select(keys[0]), keys[0], "left_semi")
        joint = _inversions(asked, asked.select(*keys).distinct().join(cells, keys[0]), keys, fs, t0)
    else:
        spots: dict = {}
        for c in shared:
            if c["reference"] == "inversion":
                spots.setdefault((*map(float, c["band"]), *map(float, c["window"])), []).append(int(c["config_index"]))
        if not spots:
            return out
        joint = _inversions(base, base.select(*keys).distinct().withColumn("_inv", _inversion_list(spots)), keys, fs, t0)
    return out.unionByName(joint.select(
        *keys, "config_index", "day", "dvv", F.lit(None).cast("double").alias("cc"),
        F.col("dvv").isNotNull().alias("valid"), F.lit(None).cast("string").alias("error"),
    ))


def _inversion_list(spots: dict) -> Column:
    return F.array(*[
        F.struct(
            *[F.lit(v).alias(n) for n, v in zip(("blo", "bhi", "t1", "t2"), spot)],
            F.array(*[F.lit(c).cast("long") for c in cells]).alias("cells"),
        )
        for spot, cells in spots.items()
    ])


def joint_inversion(
    ccf: DataFrame, keys: Sequence[str] = KEYS, *, fs: float, t0: float, band, window, smooth: float = 5.0
) -> DataFrame:
    """Continuous series (keys, day, dvv) from weekly stacks measured against each other."""
    spots = {(*map(float, band), *map(float, window)): [0]}
    specs = ccf.select(*keys).distinct().withColumn("_inv", _inversion_list(spots))
    return _inversions(ccf.select(*keys, "day", "ccf"), specs, list(keys), fs, t0, smooth).drop("config_index")


def _inversions(ccf: DataFrame, specs: DataFrame, keys: list[str], fs: float, t0: float, smooth: float = 5.0) -> DataFrame:
    """All (band, window) inversions of every key; ``specs`` (keys, _inv) lists them with their cells.

    Edges (block i against block j, up to ten blocks apart) are measured in
    chunks of blocks; the banded system is solved block by block (``chain``); the search
    half-width is fixed at 3 %.
    """
    plain = keys
    days = ccf.groupBy(*plain).agg(F.count("*").alias("_n"))
    blocks = block_stack(ccf, plain).join(specs, plain).select(
        *plain, "block", "ccf", F.posexplode("_inv").alias("spot", "_s")
    ).select(*plain, "spot", "block", "ccf", "_s.blo", "_s.bhi", "_s.t1", "_s.t2")
    keys = [*plain, "spot"]
    edge_schema = _key_schema(ccf, plain, "spot int, i bigint, j bigint, m double, w double")
    eps = np.linspace(-0.03, 0.03, 81)

    def edges(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        chunk, b = int(pdf["_chunk"].iloc[0]), pdf["block"].to_numpy()
        band, window = pdf[["blo", "bhi"]].iloc[0].tolist(), pdf[["t1", "t2"]].iloc[0].tolist()
        x = kernels.bandpass(np.stack(pdf["ccf"].to_numpy()).astype(float), fs, band)
        t, out = _axis(x.shape[1], fs, t0), []
        for r in range(len(b)):  # reference block r, later blocks owned by this chunk
            later = (b > b[r]) & (b <= b[r] + MAX_BLOCK_LAG) & (b // CHUNK == chunk)
            if later.any():
                e, c = kernels.peak(eps, kernels.cc_image(x[later], x[r], t, window, eps))
                out.append(pd.DataFrame({"i": b[later], "j": b[r], "m": kernels.to_dvv(e), "w": np.maximum(c, 0.0)}))
        res = pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["i", "j", "m", "w"])
        for k in keys:
            res[k] = pdf[k].iloc[0]
        return res[[*keys, "i", "j", "m", "w"]]

    e = _chunked(blocks, MAX_BLOCK_LAG, day="block").groupBy(*keys, "_chunk").applyInPandas(edges, edge_schema)
    wd = F.col("w") * F.col("m")
    e = e.select(*keys, "i", "j", "w", wd.alias("wd"), (wd * F.col("m")).alias("wdd"), F.lit(1).cast("long").alias("m"))
    x = chain_nodes(e, keys, reach=MAX_BLOCK_LAG, smooth=smooth).select(*keys, "i", "x")
    size = x.groupBy(*keys).agg((F.max("i") + 1).alias("_m"))
    base = x.join(size, keys).where(F.col("i") < F.greatest(F.lit(1), F.floor(F.col("_m") / 20))).groupBy(*keys, "_m").agg(F.avg("x").alias("_base"))
    x = running(x, keys, ["i"], {"_next": ("lag", F.col("x"))}, chunk=F.floor(F.col("i") / 1000), reverse=True)
    x = x.join(base, keys).join(days, plain)
    at = F.col("i") * BLOCK_DAYS + BLOCK_DAYS // 2  # day of a block's value; both ends are held
    start = F.when(F.col("i") == 0, F.lit(0)).otherwise(at)
    stop = F.when(F.col("i") == F.col("_m") - 1, F.col("_n") - 1).otherwise(at + BLOCK_DAYS - 1)
    daily = x.withColumn("day", F.explode(F.sequence(start, stop)))
    slope = F.coalesce(F.col("_next") - F.col("x"), F.lit(0.0)) / BLOCK_DAYS
    dvv = F.col("x") + slope * F.greatest(F.col("day") - at, F.lit(0)) - F.col("_base")
    solved = daily.select(*keys, "day", dvv.alias("dvv"))
    cells = specs.select(*plain, F.posexplode("_inv").alias("spot", "_s")).select(
        *plain, "spot", F.explode("_s.cells").alias("config_index")
    )
    return solved.join(cells, keys).select(*plain, "config_index", "day", "dvv")


def coda_window(
    reference: DataFrame, keys: Sequence[str] = KEYS, *, fs: float, t0: float, bands: Sequence[tuple[float, float]],
    t_start: float = 3.0, floor_factor: float = 1.8, floor_window: tuple[float, float] = (40.0, 50.0),
    persist_s: float = 3.0, smooth_s: float = 1.5,
) -> DataFrame:
    """Coda window per key and band: ends where the envelope stays at its late floor."""
    keys = list(keys)
    schema = _key_schema(reference, keys, "fmin double, fmax double, t_start double, t_end double")

    def run(batches):
        for pdf in batches:
            rows = []
            for _, r in pdf.iterrows():
                x = np.asarray(r["ccf"], float)
                t = _axis(len(x), fs, t0)
                for lo, hi in bands:
                    n = max(1, int(smooth_s * fs))
                    env = np.convolve(np.abs(kernels.bandpass(x, fs, (lo, hi))), np.ones(n) / n, mode="same")[t >= 0]
                    tp = t[t >= 0]
                    late = (tp >= floor_window[0]) & (tp <= floor_window[1])
                    flat = env <= floor_factor * (np.median(env[late]) if late.any() else env[-1])
                    run_n = max(1, int(persist_s * fs))
                    csum = np.concatenate([[0], np.cumsum(flat)])
                    held = csum[run_n:] - csum[:-run_n] == run_n
                    hit = np.flatnonzero(held & (tp[: len(held)] >= t_start))
                    rows.append({**{k: r[k] for k in keys}, "fmin": lo, "fmax": hi, "t_start": t_start,
                                 "t_end": float(tp[hit[0]] if len(hit) else tp[-1])})
            yield pd.DataFrame(rows, columns=[*keys, "fmin", "fmax", "t_start", "t_end"])

    return reference.select(*keys, "ccf").mapInPandas(run, schema)


def processing_ensemble(
    ccf: DataFrame, configs: Sequence[dict], keys: Sequence[str] = KEYS, *, fs: float, t0: float, cadence: int = 1
) -> DataFrame:
    """Every config on shared waveforms with its own noise floor.

    With a ``cadence`` only every so many days are measured, as a series of their own.  The floor comes from the stretching coherence of the same band, window and
    stack, whatever the estimator.
    """
    keys = list(keys)
    extra, twin = [], {}
    offset = 1 + max(int(c["config_index"]) for c in configs)
    for c in configs:
        spot = (tuple(c["band"]), tuple(c["window"]), c["stack"])
        if spot not in twin:
            twin[spot] = offset + len(twin)
            extra.append({**c, "estimator": "stretching (TS)", "reference": "fixed", "gate": False, "eps_max": 0.06, "config_index": twin[spot]})
    if cadence > 1:
        ccf = ccf.where(F.col("day") % cadence == 0).withColumn("day", F.expr(f"day div {int(cadence)}").cast(ccf.schema["day"].dataType))
    out = measure_dvv(ccf, [*configs, *extra], keys, fs=fs, t0=t0)
    if cadence > 1:
        out = out.withColumn("day", F.col("day") * cadence)
    info = ccf.sparkSession.createDataFrame(
        [(int(c["config_index"]), twin[(tuple(c["band"]), tuple(c["window"]), c["stack"])], float(sum(c["band"]) / 2), float(c["window"][0]), float(c["window"][1])) for c in configs],
        "config_index long, twin long, fc double, t1 double, t2 double",
    )
    members = out.join(F.broadcast(info), "config_index")
    floor = out.select(*keys, "day", F.col("config_index").alias("twin"), F.col("cc").alias("coherence"))
    joined = members.join(floor, [*keys, "day", "twin"])
    cc = F.greatest(F.least(F.col("coherence"), F.lit(0.999)), F.lit(0.5))
    return joined.select(*keys, "config_index", "day", "dvv", weaver_error(cc, F.col("fc"), F.col("t1"), F.col("t2")).alias("sigma"))


def ensemble_configs() -> list[dict]:
    """Defensible pipelines: three estimators, two bands, two windows."""
    cells = [(e, b, w) for e in ("stretching (TS)", "MWCS", "DTW") for b in ((0.4, 1.0), (0.6, 1.4)) for w in ((8, 28), (12, 34))]
    return [
        {"config_index": i, "estimator": e, "band": b, "window": w, "stack": 10, "reference": "fixed", "gate": False, "eps_max": 0.06}
        for i, (e, b, w) in enumerate(cells)
    ]


def multiverse_configs() -> list[dict]:
    """The 108-cell factorial over estimator, band, window, stack and reference."""
    cells = [
        (e, b, w, k, r)
        for e in ("stretching (TS)", "MWCS", "DTW") for b in ((0.4, 1.0), (0.8, 2.0))
        for w in ((10, 30), (4, 14), (25, 45)) for k in (1, 10, 45) for r in ("fixed", "moving")
    ]
    return [
        {"config_index": i, "estimator": e, "band": b, "window": w, "stack": k, "reference": r, "gate": False, "eps_max": 0.06}
        for i, (e, b, w, k, r) in enumerate(cells)
    ]


def score_cells(
    measured: DataFrame, truth: DataFrame, keys: Sequence[str] = ("pair_id",), *, aligned: bool = True, event_day: Column | None = None
) -> DataFrame:
    """One row per case and config: channels averaged, RMS, ok flag and error text.

    ``aligned`` takes the baselines off first; the plain RMS needs more than ten epochs.  With an
    ``event_day`` the recovered drop is added.
    """
    from tremorlake.operators.combine import nanmean_channels
    from tremorlake.operators.sweep import drop_amplitude, rms_baseline_aligned, rms_error

    keys = list(keys)
    cell = [*keys, "config_index"]
    combined = nanmean_channels(measured, [*cell, "day"], F.col("valid"))
    paired = combined.join(truth, [*keys, "day"])
    if aligned:
        rms = rms_baseline_aligned(paired, cell, valid=F.col("valid"))
    else:
        rms = rms_error(paired, cell, valid=F.col("valid")).withColumn("rms", F.when(F.col("n_valid") > 10, F.col("rms")))
    more = []
    if event_day is not None:
        drop = drop_amplitude(paired.withColumn("dvv", F.when(F.col("valid"), F.col("dvv"))), cell, value="dvv", event_day=event_day)
        rms, more = rms.join(drop, cell, "left"), ["drop"]
    errors = measured.groupBy(*cell).agg(F.min("error").alias("error"))
    return errors.join(rms, cell, "left").select(
        *cell, "rms", *more, F.coalesce("n_valid", F.lit(0)).alias("n_valid"), F.col("error").isNull().alias("ok"), "error"
    )


def pending_cells(grid: DataFrame, done: DataFrame, cell: Sequence[str] = ("case_id", "config_index")) -> DataFrame:
    """Cells of a restarted sweep that are not written yet."""
    return grid.join(done.select(*cell), list(cell), "left_anti")
