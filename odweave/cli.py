"""Command line: ``python -m odweave.cli ols|spatial|indicators ...`` (or as the application of spark-submit)."""

from __future__ import annotations

import argparse
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odweave.operators import regression as R
from odweave.operators import spatial, stats
from odweave.plans import stages
from odweave.sources import files, sinks


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="odweave", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    ols = sub.add_parser("ols", help="baseline and enhanced least squares from a CSV")
    ols.add_argument("--input-csv", required=True)
    ols.add_argument("--response", required=True)
    ols.add_argument("--baseline-predictors", nargs="+", required=True)
    ols.add_argument("--enhanced-predictors", nargs="+", required=True)
    ols.add_argument("--output-dir", required=True)
    sp = sub.add_parser("spatial", help="least squares, spatial lag and spatial error models from a CSV and an edge table (i, j)")
    sp.add_argument("--input-csv", required=True)
    sp.add_argument("--edges-csv", required=True)
    sp.add_argument("--key", required=True)
    sp.add_argument("--response", required=True)
    sp.add_argument("--predictors", nargs="+", required=True)
    sp.add_argument("--output-dir", required=True)
    ind = sub.add_parser("indicators", help="monthly indicators from flow records and areas in Parquet")
    ind.add_argument("--mode", choices=stages.MODES, required=True)
    ind.add_argument("--records", required=True)
    ind.add_argument("--areas", required=True)
    ind.add_argument("--first", type=date.fromisoformat, required=True)
    ind.add_argument("--last", type=date.fromisoformat, required=True)
    ind.add_argument("--date", type=date.fromisoformat, help="the day of the mode validation")
    ind.add_argument("--output-dir", required=True)
    return p


def _save(df: DataFrame, folder: str, name: str) -> None:
    sinks.write_csv(df, f"{folder}/{name}", one_file=True)


# Names of the output files of ``ols`` and keys of its JSON.
OLS_FILES = {"comparison": "ols_model_comparison", "coefficients": "enhanced_ols_coefficients", "correlations": "predictor_correlation_matrix", "inflation": "variance_inflation_factors", "diagnostics": "ols_diagnostics"}
OLS_KEYS = ("baseline_metrics", "enhanced_metrics", "diagnostics", "maximum_vif", "mean_vif", "condition_number")


def run_ols(spark: SparkSession, a: argparse.Namespace) -> None:
    df = files.read_csv(spark, a.input_csv)
    fits = {"baseline": R.fit_ols(df, a.response, a.baseline_predictors), "enhanced": R.fit_ols(df, a.response, a.enhanced_predictors)}
    best, v = fits["enhanced"], stats.vif(df, a.enhanced_predictors)
    tables = {"inflation": v, "coefficients": best.coefficients(spark), "comparison": R.compare(fits, spark), "correlations": stats.correlation_matrix(df, a.enhanced_predictors)}
    for kind, table in tables.items():
        _save(table, a.output_dir, OLS_FILES[kind])
    m = v.agg(F.max("vif").alias("a"), F.avg("vif").alias("b")).first()
    values = (fits["baseline"].metrics(), best.metrics(), R.diagnostics(best), m["a"], m["b"], stats.condition_number(df, a.enhanced_predictors))
    sinks.write_json(dict(zip(OLS_KEYS, values, strict=True)), f"{a.output_dir}/{OLS_FILES['diagnostics']}.json")


def run_spatial(spark: SparkSession, a: argparse.Namespace) -> None:
    df = files.read_csv(spark, a.input_csv, a.key)
    w = spatial.row_standardised(files.read_csv(spark, a.edges_csv).select(*(F.trim(F.col(c).cast("string")).alias(c) for c in "ij")))
    ols = R.fit_ols(df.select(a.key, a.response, *a.predictors), a.response, a.predictors)
    fits = [f(df.select(a.key, a.response, *a.predictors), w, a.key, a.response, a.predictors) for f in (R.fit_sar, R.fit_sem)]
    _save(R.spatial_comparison(ols, fits, spark), a.output_dir, "spatial_model_comparison")
    for f in fits:
        _save(f.inference(spark), a.output_dir, f"{f.kind.lower()}_coefficients")
    sinks.write_json({k: list(v) for k, v in R.lm_tests(ols, w, a.key).items()}, f"{a.output_dir}/lm_tests.json")


def run_indicators(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.mode == "validation" and not a.date:
        raise SystemExit("--date is required for validation mode")
    records = spark.read.parquet(a.records)
    if a.mode == "validation":
        records = records.where(F.col("day") == F.lit(a.date))
    t = stages.run_monthly(spark, a.mode, spark.read.parquet(a.areas), records, a.first, a.last)
    t.write.mode("overwrite").parquet(f"{a.output_dir}/indicators")


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if "://" not in a.output_dir:
        Path(a.output_dir).mkdir(parents=True, exist_ok=True)
    spark = SparkSession.builder.appName(f"odweave {a.command}").getOrCreate()
    {"ols": run_ols, "spatial": run_spatial, "indicators": run_indicators}[a.command](spark, a)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
