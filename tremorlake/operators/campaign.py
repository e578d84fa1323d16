"""Sweeps and submissions run on waveforms: restartable, scored case by case."""

from __future__ import annotations

from collections.abc import Sequence
import uuid

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tremorlake.functions import kernels
from tremorlake.operators.sweep import config_submissions, score_from_rms, score_thresholds
from tremorlake.operators.waveform import REF_DAYS, measure_dvv, pending_cells, score_cells


def _folder(df: DataFrame, path: str, name: str, schema) -> DataFrame:
    """The table at ``path/name``, started empty where there is none."""
    spark = df.sparkSession
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/{name}")
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def run_sweep(
    ccf: DataFrame, grid: DataFrame, truth: DataFrame, path: str, keys: Sequence[str], *, fs: float, t0: float, max_stack: int,
    ref_days: int = REF_DAYS, waves: int = 4, most_waves: int | None = None,
) -> DataFrame:
    """Run the cells of ``grid`` (first key, config_index, config) that ``path`` does not hold yet; all results so far.

    Cells go in ``waves``, dealt by a hash of case, band, window and stack, so that a case's costly grid is spread over all waves and
    cells that share a stack or band-pass stay together. Each wave writes its results under a run id and then that id with
    the wave's cells to the manifest. Only runs in the manifest count: a job that dies in between is as if the
    wave had not been run, and its cells run again at the next call. A cell without any result is in the manifest too.
    ``most_waves`` stops early. Rows: case, config_index, rms, n_valid, ok, error.
    """
    case = keys[0]
    kind = {f.name: f.dataType.simpleString() for f in grid.schema}
    cell = f"{case} {kind[case]}, config_index long"
    manifest_schema, result_schema = f"run string, {cell}", f"run string, {cell}, rms double, n_valid long, ok boolean, error string"
    wave = F.pmod(F.xxhash64(case, F.col("band.lo"), F.col("window.lo"), F.col("window.hi"), "stack"), F.lit(waves))
    todo = pending_cells(grid, _folder(grid, path, "manifest", manifest_schema), (case, "config_index"))
    left = sorted(r[0] for r in todo.select(wave.alias("wave")).distinct().collect())
    for n in left[:most_waves]:
        run = uuid.uuid4().hex
        # asked again for each wave: what is written meanwhile counts
        cells = pending_cells(grid, _folder(grid, path, "manifest", manifest_schema), (case, "config_index")).where(wave == n)
        measured = measure_dvv(ccf, cells, keys, fs=fs, t0=t0, ref_days=ref_days, max_stack=max_stack)
        scored = score_cells(measured, truth, [case])
        rows = scored.select(F.lit(run).alias("run"), case, F.col("config_index").cast("long").alias("config_index"), "rms", F.col("n_valid").cast("long").alias("n_valid"), "ok", "error")
        rows.write.mode("append").parquet(f"{path}/cells")
        cells.select(F.lit(run).alias("run"), case, F.col("config_index").cast("long").alias("config_index")).write.mode("append").parquet(f"{path}/manifest")
    runs = _folder(grid, path, "manifest", manifest_schema).select("run").distinct()
    return _folder(grid, path, "cells", result_schema).join(runs, "run", "left_semi").drop("run")


def score_config_submissions(
    submitted: DataFrame, ccf: DataFrame, truth: DataFrame, cases: DataFrame, keys: Sequence[str], *, fs: float, t0: float, max_stack: int,
    estimators: Sequence[str] = tuple(kernels.ESTIMATORS), ref_days: int = REF_DAYS,
) -> DataFrame:
    """Score submitted processing choices by running them on their case's waveforms.

    ``submitted``: submission_id, first key, use_case and the config axes; ``cases``: first key, rms_target, rel_tol, rms_wrong_layer. A
    submission without estimator, band or window, or with invalid ones, is not run and scores 0; the other axes fall back to the
    application's recommendation. A run that fails or recovers nothing scores 0. Thresholds are each case's own. Rows:
    submission_id, first key, valid, rms, score; a submission for a case without thresholds has score NULL.
    """
    case = keys[0]
    checked = config_submissions(submitted, estimators=estimators)
    number = F.row_number().over(W.partitionBy(case).orderBy("submission_id"))
    checked = checked.withColumn("config_index", number)
    grid = checked.where("valid").withColumn("stack", F.least(F.greatest("stack", F.lit(1)), F.lit(max_stack)))
    scored = score_cells(measure_dvv(ccf, grid, keys, fs=fs, t0=t0, ref_days=ref_days, max_stack=max_stack), truth, [case])
    scored = scored.select(case, F.col("config_index").cast("int").alias("config_index"), F.when(F.col("ok"), F.col("rms")).alias("rms"))
    good, bad = score_thresholds(F.col("rms_target"), F.col("rel_tol"), F.col("rms_wrong_layer"))
    rows = checked.join(scored, [case, "config_index"], "left").join(cases, case, "left")
    score: Column = F.when(F.col("rms_target").isNotNull(), F.when(F.col("valid"), score_from_rms(F.col("rms"), good, bad)).otherwise(0.0))
    return rows.select("submission_id", case, "valid", "rms", score.alias("score"))
