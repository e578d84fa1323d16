"""Site configuration, layered models and physical interpretation."""

from __future__ import annotations

from collections.abc import Sequence
import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tremorlake.functions.exprs import GRAVITY, WATER_RHO, clip, col, normal_key
from tremorlake.operators.scan import attach, key_stats, running, with_row_index

# Forcing channel -> model -> accepted aliases.
FORCING_MODELS = {
    "thermoelastic": {"berger": ["phase_shift", "berger1975"]},
    "hydrological": {
        "baseflow": ["okubo_gwl", "okubo2024"],
        "talwani": [],
        "drained": ["roeloffs1988"],
        "cdm": [],
        "precomputed": [],
    },
    "capillary": {"vahedifard": ["shi2026"]},
    "loading": {"instantaneous": [], "snowpack": []},
    "damage": {
        "snieder_healing": ["snieder2017"],
        "logarithmic_healing": ["logarithmic"],
    },
}

# Default layer profiles (thickness km, vp km/s, vs km/s, rho g/cm3).
DEFAULT_LAYERS = {
    "california_rock": [
        (0.20, 3.0, 1.5, 2.3), (1.00, 4.5, 2.5, 2.5), (5.00, 5.8, 3.3, 2.7), (50.0, 6.2, 3.6, 2.8),
    ],
    "volcanic": [
        (0.05, 1.1, 0.4, 1.8), (0.45, 2.5, 1.2, 2.2), (3.00, 4.8, 2.7, 2.6), (50.0, 6.2, 3.6, 2.8),
    ],
    "california_alluvium": [
        (0.03, 1.2, 0.45, 1.9), (0.17, 2.0, 0.8, 2.1), (1.50, 4.0, 2.2, 2.4),
        (5.00, 5.5, 3.1, 2.6), (50.0, 6.2, 3.6, 2.8),
    ],
}
# Default priors per profile (mean, std).
DEFAULT_PRIORS = {
    "california_rock": {
        "beta": (240.0, 100.0), "mu_prime": (250.0, 110.0), "porosity": (0.03, 0.02),
        "skempton": (0.45, 0.20), "biot": (0.65, 0.15), "log10_diffusivity": (0.0, 1.0),
    },
    "volcanic": {
        "beta": (300.0, 120.0), "mu_prime": (280.0, 120.0), "porosity": (0.10, 0.05),
        "skempton": (0.55, 0.20), "biot": (0.75, 0.15), "log10_diffusivity": (-0.5, 1.2),
    },
    "california_alluvium": {
        "beta": (300.0, 120.0), "mu_prime": (280.0, 120.0), "porosity": (0.10, 0.05),
        "skempton": (0.60, 0.20), "biot": (0.80, 0.15), "log10_diffusivity": (0.0, 1.2),
    },
}


def model_aliases(spark: SparkSession) -> DataFrame:
    """channel, alias, canonical: one small dimension table."""
    rows = [
        (channel, alias, canonical)
        for channel, models in FORCING_MODELS.items()
        for canonical, aliases in models.items()
        for alias in (canonical, *aliases)
    ]
    return spark.createDataFrame(rows, "channel string, alias string, canonical string")


def select_models(requests: DataFrame, *, channel: str = "channel", model: str = "model") -> DataFrame:
    """Adds canonical (NULL for an unknown model) through the fixed alias table."""
    aliases = model_aliases(requests.sparkSession).withColumnsRenamed(
        {"channel": channel, "alias": model}
    )
    return requests.join(F.broadcast(aliases), [channel, model], "left")


def rejected_models(requests: DataFrame, *, channel: str = "channel", model: str = "model") -> DataFrame:
    """Requests whose model is unknown, with the valid choices."""
    bad = select_models(requests, channel=channel, model=model).where(F.col("canonical").isNull())
    choices = F.create_map(
        *[x for c, m in FORCING_MODELS.items() for x in (F.lit(c), F.lit(", ".join(sorted(m))))]
    )
    return bad.drop("canonical").withColumn("choices", F.try_element_at(choices, F.col(channel)))


def validate_sites(sites: DataFrame, layers: DataFrame) -> DataFrame:
    """site_id, severity, message: structural errors and advisory warnings."""
    def tight(name: str, lo: float, hi: float) -> Column:
        m, s = F.col(f"{name}_mean"), F.col(f"{name}_std")
        return (m - 3 * s < lo) | (m + 3 * s > hi)

    def issue(bad: Column, severity: str, message: str) -> Column:
        return F.when(bad, F.struct(F.lit(severity).alias("severity"), F.lit(message).alias("message")))

    aliases = F.array(*[F.lit(a) for m, al in FORCING_MODELS["hydrological"].items() for a in (m, *al)])
    checks = F.array_compact(
        F.array(
            issue(F.col("fmin") >= F.col("fmax"), "error", "frequency band not ordered"),
            issue(F.col("fmin") <= 0, "error", "frequency band not positive"),
            issue(~(F.col("hydro_enabled") | F.col("thermo_enabled")), "error", "no forcing channel enabled"),
            issue(~F.array_contains(aliases, F.col("hydro_model")), "error", "unknown hydrological model"),
            issue(F.col("start_date") >= F.col("end_date"), "warning", "start date not before end date"),
            issue(F.col("uncertainty_method") == "mcmc", "warning", "mcmc not available, wls is used"),
            issue(~F.col("uncertainty_method").isin("wls", "mcmc"), "warning", "unknown uncertainty method"),
            issue(F.least(*[F.col(f"{p}_std") for p in ("porosity", "skempton", "biot")]) <= 0, "error", "prior std not positive"),
            issue(tight("porosity", 0.0, 0.6), "error", "porosity prior outside (0, 0.6]"),
            issue(tight("skempton", 0.0, 1.05), "error", "skempton prior outside [0, 1.05]"),
            issue(tight("biot", 0.0, 1.05), "error", "biot prior outside [0, 1.05]"),
        )
    )
    site_issues = sites.select("site_id", F.explode(checks).alias("i")).select("site_id", "i.*")
    positive = (F.col("thickness_km") > 0) & (F.col("vp") > 0) & (F.col("vs") > 0) & (F.col("rho") > 0)
    layer_checks = F.array_compact(
        F.array(
            issue(~positive, "error", "layer values not positive"),
            issue(F.col("vp") <= F.col("vs") * math.sqrt(2), "error", "vp/vs below sqrt(2)"),
        )
    )
    layer_issues = layers.select("site_id", F.explode(layer_checks).alias("i")).select("site_id", "i.*")
    return site_issues.unionByName(layer_issues.distinct())


def prior_log_density(value: Column, mean: Column, std: Column) -> Column:
    return -0.5 * F.pow((value - mean) / std, 2)


def shear_modulus(rho: Column, vs: Column) -> Column:
    """GPa from g/cm3 and km/s."""
    return rho * vs * vs


def bulk_modulus(rho: Column, vp: Column, vs: Column) -> Column:
    return rho * (vp * vp - 4.0 * vs * vs / 3.0)


def moduli(layers: DataFrame) -> DataFrame:
    """Adds top_km, mid_km, mu_gpa, kappa_gpa."""
    stacked = running(
        layers, ["site_id"], ["layer_idx"], {"_bottom": ("sum", F.col("thickness_km"))},
        chunk=F.floor(F.col("layer_idx") / 4096).cast("long"),
    )
    return stacked.select(
        *layers.columns,
        (F.col("_bottom") - F.col("thickness_km")).alias("top_km"),
        (F.col("_bottom") - F.col("thickness_km") / 2).alias("mid_km"),
        shear_modulus(F.col("rho"), F.col("vs")).alias("mu_gpa"),
        bulk_modulus(F.col("rho"), F.col("vp"), F.col("vs")).alias("kappa_gpa"),
    )


def refine_layers(layers: DataFrame, *, dz_km: float = 0.01, max_depth_km: float | None = None) -> DataFrame:
    """Split finite layers into equal sublayers of at most dz; the half-space stays whole."""
    m = moduli(layers)
    bottom = F.col("top_km") + F.col("thickness_km")
    if max_depth_km is not None:
        bottom = F.least(bottom, F.lit(max_depth_km))
    m = key_stats(m, ["site_id"], {"_last": F.max("layer_idx")}, salt_on=["layer_idx"]).withColumn(
        "_half", F.col("layer_idx") == F.col("_last")
    ).withColumn("_bottom", bottom)
    if max_depth_km is not None:
        m = m.where(F.col("_half") | (F.col("top_km") < max_depth_km))
    height = F.col("_bottom") - F.col("top_km")
    n_sub = F.when(F.col("_half"), 1).otherwise(F.greatest(F.ceil(height / dz_km), F.lit(1))).cast("long")
    return m.withColumn("_n", n_sub).select(
        "site_id", "layer_idx",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("sub_idx"),
        F.when(F.col("_half"), F.col("thickness_km")).otherwise(height / F.col("_n")).alias("thickness_km"),
        "vp", "vs", "rho",
    )


def _profiles(layers: DataFrame) -> DataFrame:
    return moduli(layers).groupBy("site_id").agg(
        F.sort_array(
            F.collect_list(F.struct("layer_idx", "mid_km", "vs", "rho", "mu_gpa", "kappa_gpa"))
        ).alias("_layers")
    )


def _nearest(z: Column) -> Column:
    ranked = F.transform(
        "_layers",
        lambda e: F.struct(F.abs(e["mid_km"] - z).alias("gap"), e["layer_idx"].alias("i"), e.alias("layer")),
    )
    return F.array_min(ranked)["layer"]


def depth_rule_of_thumb(bands: DataFrame, layers: DataFrame, *, frequency: str = "frequency_hz") -> DataFrame:
    """Peak depth per site and frequency: z = vs / (3 f), iterated from 0.5 km."""
    out = bands.join(_profiles(layers), "site_id").withColumn("_z", F.lit(0.5))
    for _ in range(3):
        out = out.withColumn("_z", _nearest(F.col("_z"))["vs"] / (3.0 * F.col(frequency)))
    peak = out.withColumn("_l", _nearest(F.col("_z")))
    return peak.select(
        *bands.columns,
        F.col("_z").alias("peak_depth_km"),
        (F.col("_z") / 2).alias("half_max_top_km"),
        (1.5 * F.col("_z")).alias("half_max_bottom_km"),
        F.col("_l.vs").alias("vs_at_peak"),
        F.col("_l.rho").alias("rho_at_peak"),
        F.col("_l.mu_gpa").alias("mu_gpa"),
        F.col("_l.kappa_gpa").alias("kappa_gpa"),
    )


def depth_from_kernel(kernel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Peak depth and half-maximum bounds of supplied kernels (keys, depth_km, g)."""
    keys = list(keys)
    a = F.abs("g")
    peak = kernel.groupBy(*keys).agg(
        F.max_by("depth_km", F.struct(a, -F.col("depth_km"))).alias("peak_depth_km"),
        F.max(a).alias("_k"),
        F.max("depth_km").alias("_deep"),
    )
    low = a < F.col("_k") / 2
    z, zp = F.col("depth_km"), F.col("peak_depth_km")
    return kernel.join(peak, keys).groupBy(*keys, "peak_depth_km").agg(
        F.coalesce(F.max(F.when(low & (z < zp), z)), F.lit(0.0)).alias("half_max_top_km"),
        F.coalesce(F.min(F.when(low & (z > zp), z)), F.max("_deep")).alias("half_max_bottom_km"),
    )


def site_characterise(sites: DataFrame, layers: DataFrame) -> DataFrame:
    """Central frequency, depth table and moduli at the peak layer."""
    f = sites.select("site_id", F.sqrt(F.col("fmin") * F.col("fmax")).alias("frequency_hz"))
    return depth_rule_of_thumb(f, layers).withColumns(
        {"mu_pa": F.col("mu_gpa") * 1e9, "kappa_pa": F.col("kappa_gpa") * 1e9}
    )


# --- interpretation ---------------------------------------------------------------


def bridge_beta(mu_prime: Column, kappa: Column, mu: Column) -> Column:
    return F.when(mu > 0, -mu_prime * kappa / (2.0 * mu))


def mu_prime_from_beta(beta: Column, kappa: Column, mu: Column) -> Column:
    return -2.0 * mu * beta / kappa


def bridge(df: DataFrame, *, mu_prime: str, kappa: str, mu: str, pressure: str, pressure_std: str) -> DataFrame:
    """beta, pressure sensitivity, mu' round trip and mean stress with its std."""
    b = bridge_beta(F.col(mu_prime), F.col(kappa), F.col(mu))
    return df.withColumns(
        {
            "beta": b,
            "d_dvv_dp": b / F.col(kappa),
            "mu_prime_back": mu_prime_from_beta(b, F.col(kappa), F.col(mu)),
            "stress_mean_pa": F.col(pressure),
            "stress_std_pa": F.col(pressure_std),
        }
    )


def fold_priors(df: DataFrame) -> DataFrame:
    """Linear propagation of fit and beta prior: beta_eff, mu', d(dvv)/dp.

    Needs mean, std (fit), beta_mean, beta_std, kappa_pa, mu_pa.  The maps are
    linear, so mean and std are exact and no sampling is needed.
    """
    k = 2.0 * F.col("mu_pa") / F.col("kappa_pa")
    return df.withColumns(
        {
            "beta_eff": F.col("beta_mean"),
            "beta_eff_std": F.col("beta_std"),
            "mu_prime": -k * F.col("beta_mean"),
            "mu_prime_std": k * F.col("beta_std"),
            "d_dvv_dp": F.col("mean") / F.col("kappa_pa"),
            "d_dvv_dp_std": F.col("std") / F.col("kappa_pa"),
        }
    )


def bridge_closure(coef: DataFrame, moduli_at_peak: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Strain-convention beta from the fit against the prior, with z score.

    ``moduli_at_peak``: keys, kappa_pa, mu_pa, mu_prime_mean, mu_prime_std.
    """
    kappa, mu = F.col("kappa_pa"), F.col("mu_pa")
    per_unit = F.when(F.col("units") == "fraction / Pa", 1.0 / (3.0 * kappa)).when(
        F.col("units").isin("fraction / m water head", "fraction / m cumulative departure"),
        WATER_RHO * GRAVITY / (3.0 * kappa),
    )
    rows = coef.where(F.col("param") == "p1_dGWL").join(moduli_at_peak, list(keys))
    rows = rows.withColumns(
        {
            "beta_data": F.col("mean") / per_unit,
            "beta_data_std": F.abs(F.col("std") / per_unit),
            "beta_prior": -3.0 * F.col("mu_prime_mean") * kappa / (2.0 * mu),
            "beta_prior_std": F.abs(3.0 * F.col("mu_prime_std") * kappa / (2.0 * mu)),
        }
    )
    var = F.pow("beta_data_std", F.lit(2.0)) + F.pow("beta_prior_std", F.lit(2.0))
    return rows.select(
        *keys, "beta_data", "beta_data_std", "beta_prior", "beta_prior_std",
        mu_prime_from_beta(F.col("beta_data") / 3.0, kappa, mu).alias("mu_prime_data"),
        (2.0 * mu / kappa * F.col("beta_data_std") / 3.0).alias("mu_prime_data_std"),
        F.when(var > 0, (F.col("beta_data") - F.col("beta_prior")) / F.sqrt(var)).alias("z_score"),
    )


def head_from_pressure(pressure_pa: Column) -> Column:
    return pressure_pa / (WATER_RHO * GRAVITY)


def head_change(resid: DataFrame, coef: DataFrame, keys: Sequence[str], *, value: str = "residual") -> DataFrame:
    """Water-level change from the residual and p1; NULL where p1 is 0."""
    p1 = coef.where(F.col("param") == "p1_dGWL").select(
        *keys, F.nullif("mean", F.lit(0.0)).alias("_p1"), F.col("std").alias("_s1")
    )
    head = F.col(value) / F.col("_p1")
    return attach(resid, p1, keys, ["ts"]).select(
        *resid.columns, head.alias("head_change_m"),
        (F.abs(head) * F.col("_s1") / F.abs("_p1")).alias("head_change_std_m"),
    )


# --- property providers --------------------------------------------------------------


def vp_from_vs(vs: Column, ratio: float = 1.85) -> Column:
    return F.greatest(ratio * vs, 1.05 * math.sqrt(2.0) * vs)


def density_from_vp(vp: Column) -> Column:
    """Gardner-style density, clipped to a rock range."""
    return clip(1.74 * F.pow(vp, 0.25), 1.6, 3.1)


def default_layers(spark: SparkSession) -> DataFrame:
    rows = [
        (name, i, *layer) for name, layers in DEFAULT_LAYERS.items() for i, layer in enumerate(layers)
    ]
    return spark.createDataFrame(
        rows, "profile string, layer_idx long, thickness_km double, vp double, vs double, rho double"
    )


def default_priors(spark: SparkSession) -> DataFrame:
    rows = [(p, n, *v) for p, priors in DEFAULT_PRIORS.items() for n, v in priors.items()]
    return spark.createDataFrame(rows, "profile string, param string, mean double, std double")


def default_properties(sites: DataFrame) -> DataFrame:
    """Layers per site from its profile; a positive vs30_m_s replaces the top layer.

    ``sites``: site_id, profile, vs30_m_s (nullable).  Unknown profiles use alluvium.
    """
    known = F.col("profile").isin(*DEFAULT_LAYERS)
    has_vs30 = F.coalesce(F.col("vs30_m_s") > 0, F.lit(False))
    s = sites.withColumn("_vs30", has_vs30).withColumn(
        "profile",
        F.when(F.col("_vs30") | ~known | F.col("profile").isNull(), "california_alluvium").otherwise(F.col("profile")),
    )
    top = F.col("_vs30") & (F.col("layer_idx") == 0)
    vs = F.when(top, F.col("vs30_m_s") / 1000.0).otherwise(F.col("vs"))
    vp = F.when(top, vp_from_vs(F.col("vs30_m_s") / 1000.0)).otherwise(F.col("vp"))
    rho = F.when(top, density_from_vp(vp_from_vs(F.col("vs30_m_s") / 1000.0))).otherwise(F.col("rho"))
    return s.join(F.broadcast(default_layers(sites.sparkSession)), "profile").select(
        "site_id", "layer_idx", "thickness_km", vp.alias("vp"), vs.alias("vs"), rho.alias("rho"),
        F.when(F.col("_vs30"), "medium").otherwise("low").alias("confidence"),
    )


def layers_from_depth_samples(samples: DataFrame, *, half_space_km: float = 50.0) -> DataFrame:
    """Consecutive depth samples (site_id, depth_m, vp, vs, rho) become layers.

    Values above 20 are SI and scaled; the last sample becomes the half-space.
    """
    scaled = {c: F.when(F.col(c) > 20, F.col(c) / 1000.0).otherwise(F.col(c)) for c in ("vp", "vs", "rho")}
    rows = samples.withColumns(scaled)
    chunk = F.floor(F.col("depth_m") / 10_000).cast("long")
    rows = with_row_index(rows, ["site_id"], ["depth_m"], "layer_idx", chunk=chunk)
    rows = running(
        rows, ["site_id"], ["depth_m"], {"_next": ("lag", F.col("depth_m"))}, chunk=chunk, reverse=True
    )
    return rows.select(
        "site_id", "layer_idx",
        F.coalesce((F.col("_next") - F.col("depth_m")) / 1000.0, F.lit(half_space_km)).alias("thickness_km"),
        "vp", "vs", "rho",
    )


def normalise_text_keys(df: DataFrame, column: str, out: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """Normalised key, then an optional alias table (kept as is when unknown)."""
    df = df.withColumn(out, normal_key(col(column)))
    if aliases:
        table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
        df = df.withColumn(out, F.coalesce(F.try_element_at(table, F.col(out)), F.col(out)))
    return df
