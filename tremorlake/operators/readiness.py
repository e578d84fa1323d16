"""Which science goals a site's inputs support, and what is missing.

Rules are data: a goal needs one member of each requirement group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tremorlake.functions.exprs import normal_key

# Goal names and their aliases.
GOALS = ("groundwater", "stress", "coupling")
GOAL_ALIASES = {
    "groundwater_monitoring": "groundwater", "soil_moisture": "groundwater", "hydrology": "groundwater",
    "stress_inversion": "stress", "stress_at_depth": "stress",
    "coupling_mechanisms": "coupling", "mechanisms": "coupling",
}
# Input families.
HYDROLOGIC = (
    "precipitation", "precip", "rain", "snowmelt", "snowpack", "swe", "groundwater_level", "gwl",
    "well_level", "soil_moisture", "streamflow", "grace", "hydrologic_proxy",
)
HYDROLOGIC_CALIBRATION = (
    "groundwater_level", "gwl", "well_level", "pore_pressure", "soil_moisture", "streamflow", "grace",
)
THERMAL = ("temperature", "temp", "air_temperature", "surface_temperature", "ground_temperature")
LOADING = (
    "loading", "surface_load", "snowpack", "swe", "barometric_pressure", "barometer", "tide_strain", "earth_tide",
)
STRESS_CALIBRATION = (
    "groundwater_level", "gwl", "well_level", "pore_pressure", "barometric_pressure", "tide_strain",
    "earth_tide", "gnss", "strainmeter", "surface_load", "loading",
)
DAMAGE = ("earthquake_catalog", "earthquake_times")
SNOW = ("snowpack", "swe")

COMMON = [
    ("dvv column", ("dvv",)),
    ("time axis", ("datetime_index",)),
    ("measurement uncertainty", ("dvv_err",)),
    ("site configuration", ("site_config",)),
    ("measurement frequency band", ("measurement_frequency_band",)),
    ("velocity model", ("velocity_model",)),
]
REQUIRED = {
    "groundwater": [*COMMON, ("hydrologic driver or proxy", HYDROLOGIC)],
    "stress": [
        *COMMON,
        ("material-property priors", ("material_property_priors",)),
        ("calibrated pressure, loading or strain constraint", STRESS_CALIBRATION),
    ],
    "coupling": COMMON,
}
FAMILIES = (HYDROLOGIC, THERMAL, LOADING, DAMAGE)
TWO_FAMILIES = "two independent forcing families"
# next data: (message, inputs that satisfy it; empty = always suggested)
NEXT = {
    "groundwater": [
        ("hydrologic calibration data", HYDROLOGIC_CALIBRATION),
        ("temperature", THERMAL),
        ("snow data", SNOW),
    ],
    "stress": [
        ("hydrologic forcing", HYDROLOGIC),
        ("temperature", THERMAL),
        ("several bands or station pairs", ()),
        ("independent elastic properties", ()),
    ],
    "coupling": [
        ("earthquake catalog", ("earthquake_catalog",)),
        ("surface-load data", LOADING),
        ("independent validation data", ()),
        ("several pairs, components or bands", ()),
    ],
}
WARNINGS = [
    ("no dvv column", ("dvv",)),
    ("no time index", ("datetime_index",)),
    ("no measurement uncertainty", ("dvv_err",)),
    ("no correlation quality", ("cc", "correlation_coefficient", "corrcoef")),
]


def _known_inputs() -> list[str]:
    groups = [g for rules in REQUIRED.values() for _, g in rules] + [g for rules in NEXT.values() for _, g in rules]
    groups += [*FAMILIES, *[g for _, g in WARNINGS]]
    return sorted({name for g in groups for name in g})


def _available(inventory: DataFrame) -> DataFrame:
    """Per site the set of known inputs: at most as many as the rules name."""
    named = inventory.select("site_id", normal_key("input_name").alias("name"))
    flag = F.collect_set(F.when(F.col("name").isin(*_known_inputs()), F.col("name")))
    return named.groupBy("site_id").agg(flag.alias("_have"))


def _lacks(group) -> Column:
    if not group:
        return F.lit(True)
    return ~F.arrays_overlap("_have", F.array(*[F.lit(g) for g in group]))


def _messages(rules) -> list[Column]:
    return [F.when(_lacks(group), F.lit(text)) for text, group in rules]


def readiness_report(inventory: DataFrame) -> DataFrame:
    """site_id, goal, status, missing_required, next_data, warnings."""
    have = _available(inventory)
    families = sum((F.when(~_lacks(g), 1).otherwise(0) for g in FAMILIES), start=F.lit(0))
    rows = []
    for goal in GOALS:
        missing = _messages(REQUIRED[goal])
        if goal == "coupling":
            missing.append(F.when(families < 2, F.lit(TWO_FAMILIES)))
        rows.append(
            F.struct(
                F.lit(goal).alias("goal"),
                F.array_compact(F.array(*missing)).alias("missing_required"),
                F.array_compact(F.array(*_messages(NEXT[goal]))).alias("next_data"),
            )
        )
    out = have.withColumn("warnings", F.array_compact(F.array(*_messages(WARNINGS)))).select(
        "site_id", "warnings", F.explode(F.array(*rows)).alias("g")
    )
    status = F.when(F.size("g.missing_required") == 0, "ready").otherwise("missing data")
    return out.select(
        "site_id", "g.goal", status.alias("status"), "g.missing_required", "g.next_data", "warnings"
    )


def missing_requirements(inventory: DataFrame) -> DataFrame:
    """One row per site, goal and unmet requirement: an anti-join against the rules."""
    spark = inventory.sparkSession
    members = spark.createDataFrame(
        [(g, text, name) for g in GOALS for text, group in REQUIRED[g] for name in group],
        "goal string, requirement string, name string",
    )
    rules = F.array(
        *[F.struct(F.lit(g).alias("goal"), F.lit(text).alias("requirement")) for g in GOALS for text, _ in REQUIRED[g]]
    )
    wanted = inventory.select("site_id").distinct().select("site_id", F.explode(rules).alias("r")).select("site_id", "r.*")
    named = inventory.select("site_id", normal_key("input_name").alias("name"))
    met = named.join(F.broadcast(members), "name").select("site_id", "goal", "requirement").distinct()
    return wanted.join(met, ["site_id", "goal", "requirement"], "left_anti")
