"""Writers of stage results and reports."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import stars


def write_stage(df: DataFrame, path: str, keys: list[str], overwrite: bool = False) -> None:
    """A stage's table, partitioned by its keys. Existing results stay unless told otherwise; then only partitions at hand are replaced."""
    writer = df.write.partitionBy(*keys).option("partitionOverwriteMode", "dynamic")
    writer.mode("overwrite" if overwrite else "ignore").parquet(path)


def stage(spark: SparkSession, path: str, keys: list[str], make: Callable[[], DataFrame], overwrite: bool = False) -> DataFrame:
    """The stage's table: read if it is there (a run goes on where the last one ended), else made, written and read."""
    if not overwrite:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    write_stage(make(), path, keys, overwrite)
    return spark.read.parquet(path)


def export_sorted(df: DataFrame, path: str, keys: list[str]) -> None:
    """One CSV in the order of its keys, for tables of windows or smaller."""
    df.orderBy(*keys).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_documents(df: DataFrame, path: str) -> None:
    """Rows, nested as they are, as JSON lines."""
    df.write.mode("overwrite").json(path)


def learning_curve_rows(documents: DataFrame, curve: str = "learning_curve.aggregated", keys: tuple[str, ...] = ("experiment_name",)) -> DataFrame:
    """The points of each result's learning curve, a row each, beside its keys."""
    return documents.select(*keys, F.inline(curve))


def record_run(spark: SparkSession, log: str, settings: dict) -> None:
    """Append a run's settings, as one JSON line, to the log of runs."""
    spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").write.mode("append").text(log)


def matching_runs(spark: SparkSession, log: str, wanted: dict) -> DataFrame:
    """Settings (JSON) of recorded runs that have all the wanted values; a wanted None also fits where the setting is absent."""
    rows = spark.read.text(log)
    for key, value in wanted.items():
        own = F.get_json_object("value", f"$.{key}")
        rows = rows.where(own.isNull() if value is None else own == (value if isinstance(value, str) else json.dumps(value)))
    return rows


def append_widening(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append rows that may have new columns; read with ``mergeSchema``."""
    df.write.partitionBy(*keys).mode("append").parquet(path)


def p_text(p: Column) -> Column:
    """A p value with three places, or the mark of a very small one, and its stars."""
    return F.concat(F.when(p < 0.001, F.lit("<.001")).otherwise(F.format_number(p, 3)), stars(p))


def latex_table(df: DataFrame, columns: list[str], caption: str, label: str) -> list[str]:
    """The lines of a long table around the ``line`` column of a report; a row for each feature."""
    head = " & ".join(columns) + r" \\"
    start = [r"\begin{longtable}{l" + "c" * (len(columns) - 1) + "}", rf"\caption{{{caption}}} \label{{{label}}} \\", r"\toprule", head, r"\midrule", r"\endfirsthead", r"\toprule", head, r"\midrule", r"\endhead"]
    return [*start, *[r["line"] for r in df.orderBy("line").collect()], r"\bottomrule", r"\end{longtable}"]


def latex_rows(df: DataFrame, label: str, pairs: list[tuple[str, str]], ps: list[str]) -> DataFrame:
    """``line``: a row of a LaTeX table, mean and sd of each condition with two places, then p values."""
    cells = [F.format_string("%.2f $\\pm$ %.2f", F.col(m), F.col(s)) for m, s in pairs] + [p_text(F.col(p)) for p in ps]
    return df.select(F.concat(F.concat_ws(" & ", F.replace(F.col(label), F.lit("_"), F.lit("\\_")), *cells), F.lit(" \\\\")).alias("line"))
