"""Report series (P1-P4): the data behind the comparison charts.

Input is a table of reports (one row per run, the four metric maps). A run is
told by its id (``run_col``; the report's path, say), never by its label: two runs
may well have the same label, which is carried along as ``label``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsearch_spark.functions.text import file_stem

MAP_PREFIXES = {"recall_at_k": "Recall@", "ndcg_at_k": "NDCG@", "map_at_k": "MAP@",
                "precision_at_k": "P@"}


def explode_metrics(reports: DataFrame, run_col: str = "run", label_col: str | None = None) -> DataFrame:
    """(run, [label,] metric_map, k, value) for entries whose key is the map's
    prefix followed by an integer; other keys are skipped."""
    keep = [run_col] + ([F.col(label_col).alias("label")] if label_col else [])
    names = [run_col] + (["label"] if label_col else [])
    out = None
    for col, prefix in MAP_PREFIXES.items():
        e = reports.select(*keep, F.lit(col).alias("metric_map"), F.explode(F.col(col)).alias("key", "value"))
        rest = F.substr(F.col("key"), F.lit(len(prefix) + 1))
        p = (e.filter(F.col("key").startswith(prefix))
             .withColumn("k", rest.try_cast("int"))
             .filter(F.col("k").isNotNull())
             .select(*names, "metric_map", "k", F.col("value").cast("double").alias("value")))
        out = p if out is None else out.unionByName(p)
    return out


def _axes(series: DataFrame, run_col: str) -> DataFrame:
    return series.groupBy(run_col, "metric_map").agg(F.array_sort(F.collect_list("k")).alias("axis"))


def _label(series: DataFrame) -> list[str]:
    return ["label"] if "label" in series.columns else []


def paired_series(series: DataFrame, left: str, right: str, run_col: str = "run") -> DataFrame:
    """``left`` and ``right`` side by side per k, only for runs whose two k
    lists are identical. (run, [label,] k, left_value, right_value)."""
    ax = _axes(series.filter(F.col("metric_map").isin(left, right)), run_col)
    la = ax.filter(F.col("metric_map") == left).select(run_col, F.col("axis").alias("la"))
    ra = ax.filter(F.col("metric_map") == right).select(run_col, F.col("axis").alias("ra"))
    ok = la.join(ra, run_col).filter(F.col("la") == F.col("ra")).select(run_col)
    lv = series.filter(F.col("metric_map") == left).select(run_col, *_label(series), "k",
                                                           F.col("value").alias("left_value"))
    rv = series.filter(F.col("metric_map") == right).select(run_col, "k", F.col("value").alias("right_value"))
    return lv.join(ok, run_col, "left_semi").join(rv, [run_col, "k"])


def compare_runs(series: DataFrame, run_order: DataFrame, run_col: str = "run") -> DataFrame:
    """Recall and NDCG per k across runs. The k axis is the first run's
    recall axis; a run whose axis for a metric differs is left out of that
    metric; fewer than two runs or an empty axis gives nothing.

    ``run_order``: (run, ord), one row per run. Returns (metric_map, k, run, [label,] value).
    """
    ax = _axes(series, run_col)
    runs = run_order.agg(F.min_by(run_col, "ord").alias("first"), F.count_distinct(run_col).alias("n_runs"))
    axis0 = (ax.filter("metric_map = 'recall_at_k'").join(runs.filter("n_runs >= 2"), F.col(run_col) == F.col("first"))
             .select(F.col("axis").alias("axis0")))
    # one axis of a few numbers
    sel = (ax.filter(F.col("metric_map").isin("recall_at_k", "ndcg_at_k"))
           .join(axis0, F.col("axis") == F.col("axis0")).filter(F.size("axis0") > 0)
           .join(run_order.select(run_col), run_col, "left_semi").select(run_col, "metric_map"))
    return series.join(sel, [run_col, "metric_map"]).select("metric_map", "k", run_col, *_label(series), "value")


def compare_runs_wide(series: DataFrame, run_order: DataFrame, runs: list[str], run_col: str = "run") -> DataFrame:
    """P3 as a table: one row per metric and k, one column per run of ``runs``
    (NULL where the run is left out of the metric)."""
    return (compare_runs(series, run_order, run_col).groupBy("metric_map", "k")
            .pivot(run_col, runs).agg(F.first("value")))


def run_label(label: Column, dataset: Column, path: Column) -> Column:
    """Given label, else a non-empty dataset field, else the file stem."""
    return F.coalesce(label, F.when(F.length(dataset) > 0, dataset), file_stem(path))
