"""Clean-up of the study table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Markers of a missing field, DOI pattern.
MISSING = ("n/r", "n/a", "")
DOI_PATTERN = r"10\.\d{4,9}/[^\s\"<>]+"


def norm_doi(url: Column) -> Column:
    """DOI inside the text without trailing dots, else the lower-cased text."""
    u = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    doi = F.regexp_replace(F.regexp_extract(u, f"({DOI_PATTERN})", 1), r"\.+$", "")
    return F.when(doi != "", doi).otherwise(u)


def missing_count(columns: Sequence[str]) -> Column:
    """How many fields carry a missing marker."""
    return sum(
        (
            F.when(F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))).isin(*MISSING), 1).otherwise(0)
            for c in columns
        ),
        start=F.lit(0),
    )


def dedupe_study(df: DataFrame, *, url: str, application: str, fields: Sequence[str], order: str) -> DataFrame:
    """One row per DOI: fewest missing fields, then first loaded.

    The other applications of the same DOI are gathered; a study table has a
    handful of distinct applications, so that list is bounded.  All aggregates
    combine map-side, so a heavily repeated DOI does not reach one task raw.
    """
    cols = [c for c in df.columns if c != "study_key"]
    keyed = df.withColumn("study_key", norm_doi(F.col(url)))
    best = keyed.groupBy("study_key").agg(
        F.min_by(F.struct(*cols), F.struct(missing_count(fields), F.col(order))).alias("_b"),
        F.count("*").alias("n_copies"),
        F.array_sort(F.collect_set(application)).alias("_apps"),
    )
    return best.select(
        "study_key", "_b.*", "n_copies",
        F.filter("_apps", lambda a: a != F.col(f"_b.{application}")).alias("also_applications"),
    )


def overlay_verified(base: DataFrame, verified: DataFrame, fields: Sequence[str], *, key: str = "study_key") -> DataFrame:
    """Verified non-empty fields win for full-text and partial records; provenance stamp.

    ``verified``: key, status and the fields.
    """
    v = verified.select(key, F.col("status").alias("_status"), *[F.col(f).alias(f"_v_{f}") for f in fields])
    joined = base.join(v, key, "left")
    good = F.coalesce(F.col("_status").isin("full-text", "partial"), F.lit(False))
    cols = {
        f: F.when(good, F.coalesce(F.when(F.trim(f"_v_{f}") != "", F.col(f"_v_{f}")), F.col(f))).otherwise(F.col(f))
        for f in fields
    }
    source = (
        F.when(good, "full text").when(F.col("_status") == "inaccessible", "abstract only").otherwise("abstract scan")
    )
    return joined.withColumns(cols).withColumn("measurement_source", source).select(*base.columns, "measurement_source")


def disambiguate_keys(df: DataFrame, *, base: str, doi: str, order: str, letters: bool = True) -> DataFrame:
    """Citation keys: the second different DOI of a key gets suffix b, the third c ... z, then aa, ab ...

    Without ``letters`` every suffix is one character, the code point after the last one's (after z: {, |, ...).
    Ranks are computed among distinct (key, DOI) pairs only.  A row without a base key keeps a NULL key.
    """
    from pyspark.sql import Window as W

    first = df.groupBy(base, doi).agg(F.min(order).alias("_first"))
    rank = F.row_number().over(W.partitionBy(base).orderBy("_first", doi))
    if letters:
        # letters of the rank, counted like spreadsheet columns (up to four letters)
        name, left = F.lit(""), F.col("_r")
        for _ in range(4):
            letter = F.chr(F.lit(ord("a")) + F.pmod(left - 1, F.lit(26)))
            name = F.when(left > 0, F.concat(letter, name)).otherwise(name)
            left = F.when(left > 0, F.floor((left - 1) / 26)).otherwise(F.lit(0))
    else:
        name = F.decode(F.unhex(F.lpad(F.hex(F.col("_r") + (ord("a") - 1)), 8, "0")), "UTF-32")
    suffix = F.when(F.col("_r") > 1, name).otherwise("")
    keys = first.withColumn("_r", rank).select(F.col(base).alias("_b"), F.col(doi).alias("_d"), F.concat(F.col(base), suffix).alias("cite_key"))
    same = F.col(base).eqNullSafe(F.col("_b")) & F.col(doi).eqNullSafe(F.col("_d"))
    return df.join(keys, same).select(*df.columns, "cite_key")


def study_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts per level with totals."""
    return df.rollup(*by).agg(F.count("*").alias("n_studies"))


def coverage_rate(df: DataFrame, by: Sequence[str], field: str) -> DataFrame:
    """Share of studies that report the field."""
    known = ~F.lower(F.trim(F.coalesce(F.col(field), F.lit("")))).isin(*MISSING)
    return df.groupBy(*by).agg(F.count("*").alias("n_studies"), F.avg(known.cast("double")).alias("rate"))


def exclude_public(full: DataFrame, public: DataFrame, key: str = "case_id") -> DataFrame:
    """Cases that are not public."""
    return full.join(public.select(key), key, "left_anti")


def strip_truth(df: DataFrame, hidden: Sequence[str] = ("truth", "truth_other")) -> DataFrame:
    """Observables only."""
    return df.drop(*hidden)
