"""Panel analysis: correlation screening, top-N, heatmap, trend, rankings.

The reference loops over up to 8k wide columns and scans the panel once per
column.  Here the season table is long, so every statistic over every
feature is **one** grouped aggregate on (param, rel_year, dekad36) after a
join on (site_id, year).  The production side of that join is one row per
site-year (municipalities × years); AQE broadcasts it when the measured
stage is small; the covariance/variance aggregates are algebraic, so partial
aggregation runs map-side and a hot site never reaches a single reducer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (base_code, corr_direction, corr_sentence, corr_strength,
                                 pair_count, pearson, safe_div)
from .broadcast import bounded
from .climate import WINDOW_Y1, window_exact

FEATURE_KEY = ["param", "rel_year", "dekad36"]
MIN_PAIRS = 5  # strictly more pairs than this are needed for a coefficient


def _pairs(season: DataFrame, panel: DataFrame, metric: str, extra=()) -> DataFrame:
    y = panel.select("site_id", "year", F.col(metric).alias("y"), *extra)
    x = season.selectExpr("site_id", "season_year AS year", *FEATURE_KEY, "value AS x")
    # y is one row per site-year; AQE broadcasts it when measured small
    return x.join(y, ["site_id", "year"])


def climate_correlations(season: DataFrame, panel: DataFrame, metric: str,
                         min_pairs: int = MIN_PAIRS) -> DataFrame:
    """M1: Pearson r of every climate feature against ``metric``.

    Pairwise-complete (F5), more than ``min_pairs`` pairs, undefined r
    (constant side) dropped.  Returns param, rel_year, dekad36, feature,
    n_pairs, r, abs_r.
    """
    p = _pairs(season, panel, metric)
    g = p.groupBy(*FEATURE_KEY).agg(pair_count("x", "y").alias("n_pairs"),
                                    pearson("x", "y").alias("r"))
    return (g.filter(f"n_pairs > {int(min_pairs)} AND r IS NOT NULL")
             .selectExpr(*FEATURE_KEY,
                         "concat(param, '_dec', CAST(dekad36 AS STRING), '_ano', CAST(rel_year AS STRING)) AS feature",
                         "n_pairs", "r", "abs(r) AS abs_r"))


def _tie_break():
    return [F.col("param").asc(), F.col("rel_year").asc(), F.col("dekad36").asc()]


def top_correlations(corr: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest |r| (a total order breaks ties, T15).

    A top-k: Spark plans ``TakeOrderedAndProject`` (per-partition top-n, then
    a single merge of n rows per partition).
    """
    return corr.orderBy(F.col("abs_r").desc(), *_tie_break()).limit(n)


def top_detail(top: DataFrame, k: int = 3, attrs: DataFrame | None = None,
               metric: str = "yield_kg_ha") -> DataFrame:
    """W2 + X9: rank 1..k of the top list with label, strength, direction, sentence."""
    w = Window.orderBy(F.col("abs_r").desc(), *_tie_break())
    ranked = top.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    if attrs is not None:
        ranked = with_labels(ranked, attrs, "param")
    else:
        ranked = ranked.withColumn("label", F.col("param"))
    return ranked.select(
        "rank", *FEATURE_KEY, "feature", "r", "abs_r", "label",
        corr_strength("r").alias("strength"), corr_direction("r").alias("direction"),
        corr_sentence("r", "label", F.lit(metric)).alias("sentence"))


def corr_matrix(df: DataFrame, cols) -> DataFrame:
    """M2: pairwise-complete Pearson matrix (long: row, col, r) in one aggregate."""
    cols = [c for c in cols if c in df.columns]
    exprs, pairs = [], []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j < i:
                continue
            exprs.append(pearson(a, b).alias(f"r_{i}_{j}"))
            pairs.append((i, j))
    one = df.agg(*exprs)
    cells = []
    for i, j in pairs:
        cells.append(f"'{cols[i]}', '{cols[j]}', r_{i}_{j}")
        if i != j:
            cells.append(f"'{cols[j]}', '{cols[i]}', r_{i}_{j}")
    # one SQL ``stack`` unpivots the single aggregate row into (row, col, r)
    return one.selectExpr(f"stack({len(cells)}, {', '.join(cells)}) AS (row, col, r)")


def period_label(rel="rel_year", dek="dekad36"):
    """R6 column label ``Ano1_Dec26`` … ``Ano2_Dec15``."""
    return F.concat(F.lit("Ano"), F.col(rel).cast("string"), F.lit("_Dec"), F.col(dek).cast("string"))


def period_order(rel="rel_year", dek="dekad36"):
    """R6 order: year-1 dekads 26..36 → 0..10, year-2 dekads 1..15 → 11..25."""
    return F.when(F.col(rel) == 1, F.col(dek) - WINDOW_Y1[0]).otherwise(F.lit(11) + F.col(dek) - 1)


def heatmap_from_corr(corr: DataFrame, params=None) -> DataFrame:
    """M3 from already computed M1 rows: each feature's r depends on its own
    pairs only, so the heatmap is the exact-window rows of the chosen
    parameters (no second pass over the season table)."""
    c = corr.filter(window_exact())
    if params is not None:
        if isinstance(params, DataFrame):
            c = c.join(params.select("param").distinct(), "param", "left_semi")
        else:
            c = c.filter(F.col("param").isin(list(params)))
    return c.select("param", "rel_year", "dekad36", period_label().alias("period"),
                    period_order().alias("period_order"), "r")


def heatmap_params(top: DataFrame, k: int = 5) -> DataFrame:
    """Default heatmap variables: the first ``k`` sorted distinct params of a top list."""
    return top.select("param").distinct().orderBy("param").limit(k)


def heatmap_matrix(heat: DataFrame) -> DataFrame:
    """R6 export: parameter × ordered period (explicit column list)."""
    cols = [f"Ano1_Dec{d}" for d in range(26, 37)] + [f"Ano2_Dec{d}" for d in range(1, 16)]
    return heat.groupBy("param").pivot("period", cols).agg(F.first("r"))


def phase_mean(heat: DataFrame) -> DataFrame:
    """Per phase, the mean of per-period means (not a flat mean)."""
    per_period = heat.groupBy("rel_year", "period").agg(F.avg("r").alias("period_mean"))
    return (per_period.groupBy("rel_year")
                      .agg(F.avg("period_mean").alias("phase_mean"),
                           F.count(F.lit(1)).alias("n_periods")))


def trend(pairs: DataFrame, x: str = "x", y: str = "y", by=FEATURE_KEY) -> DataFrame:
    """M4: OLS slope/intercept and the fitted line at min/max x, per group.

    Needs more than one point; a constant x gives no slope (NULL).
    """
    g = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        safe_div(F.covar_pop(y, x), F.var_pop(x)).alias("slope"),
        F.avg(x).alias("_mx"), F.avg(y).alias("_my"),
        F.min(x).alias("x_min"), F.max(x).alias("x_max"))
    g = g.filter(F.col("n") > 1).withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mx"))
    return g.select(*by, "n", "slope", "intercept", "x_min", "x_max",
                    (F.col("slope") * F.col("x_min") + F.col("intercept")).alias("y_at_min"),
                    (F.col("slope") * F.col("x_max") + F.col("intercept")).alias("y_at_max"))


def scatter_points(season: DataFrame, panel: DataFrame, metric: str,
                   size: str = "produced_kg") -> DataFrame:
    """M5: (feature, x, y, year, site, size) with every field present."""
    p = _pairs(season, panel, metric, extra=("name", F.col(size).alias("size")))
    return (p.dropna(subset=["x", "y", "year", "name", "size"])
             .select(*FEATURE_KEY, "site_id", "name", "year", "x", "y", "size"))


def site_means(panel: DataFrame, cols, by=("site_id", "name")) -> DataFrame:
    """Per-site means over years."""
    return panel.groupBy(*by).agg(*[F.avg(c).alias(c) for c in cols])


RANK_METRICS = ["produced_kg", "yield_kg_ha", "planted_ha", "value_brl"]


def rank_sites(panel: DataFrame, n: int = 5, metrics=RANK_METRICS) -> DataFrame:
    """Top-``n`` sites by mean of each metric, all metrics in one pass.

    Sites are grouped by name (as the reference does); ties keep the
    alphabetically first name.  The window is partitioned by metric over the
    per-site means, i.e. over sites × metrics rows.
    """
    means = site_means(panel, metrics, by=("name",))
    long = means.unpivot(["name"], list(metrics), "metric", "mean_value").filter(F.col("mean_value").isNotNull())
    w = Window.partitionBy("metric").orderBy(F.col("mean_value").desc(), F.col("name").asc())
    return long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def site_trajectories(panel: DataFrame, ranked: DataFrame) -> DataFrame:
    """Yearly value of each ranked site for its metric, ordered."""
    metrics = [r for r in RANK_METRICS if r in panel.columns]
    long = panel.select("name", "year", *metrics).unpivot(["name", "year"], metrics, "metric", "value")
    return (long.join(ranked.select("metric", "name", "rank"), ["metric", "name"], "left_semi")
                .orderBy("metric", "name", "year"))


def with_labels(df: DataFrame, attrs: DataFrame, code_col: str = "param") -> DataFrame:
    """Description lookup by base code; label ``CODE = description`` or the code."""
    a = attrs.select(F.trim("code").alias("_code"), F.trim("description").alias("_desc"))
    # the dictionary has one row per parameter code (bounded by the attribute list)
    out = df.withColumn("_code", base_code(code_col)).join(bounded(a), "_code", "left")
    label = F.when(F.col("_desc").isNotNull() & (F.col("_desc") != ""),
                   F.concat(F.col("_code"), F.lit(" = "), F.col("_desc"))).otherwise(F.col("_code"))
    return out.withColumn("label", label).withColumn("description", F.coalesce("_desc", "_code")).drop("_code", "_desc")


def legend(df: DataFrame, attrs: DataFrame, code_col: str = "param") -> DataFrame:
    """J8 legend: distinct sorted ``CODE = description`` entries joined by ``; ``.

    The entries are distinct parameter codes, bounded by the attribute list.
    """
    codes = df.select(base_code(code_col).alias("code")).distinct()
    a = attrs.select(F.trim("code").alias("code"), F.trim("description").alias("description"))
    lab = codes.join(bounded(a), "code", "left").select(
        F.concat(F.col("code"), F.lit(" = "), F.coalesce("description", "code")).alias("entry"))
    return lab.agg(F.array_join(F.array_sort(F.collect_set("entry")), "; ").alias("legend"),
                   F.count(F.lit(1)).alias("n_entries"))
