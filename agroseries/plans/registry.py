"""Registered queries: ``name → (spark, sf_dir) → DataFrame``.

Every query reads the driver tables of ``sf_dir`` through ``bindings`` and
runs over whole tables.  ``finalize`` rounds doubles to 6 decimals so that
results compare by value hash with the DuckDB oracle (``oracle.py``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import bindings as B
from ..functions import columns as C
from ..operators import climate, rules as RU

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def finalize(df: DataFrame, digits: int = 6) -> DataFrame:
    out = []
    for f in df.schema.fields:
        n = "`" + f.name.replace("`", "``") + "`"
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(f"round({n}, {int(digits)}) AS {n}")
        else:
            out.append(n)
    return df.selectExpr(*out)


# ---------------------------------------------------------------- climate
@register("daily_clean")
def q_daily_clean(spark, sf):
    """Typed daily rows, −999 → NULL."""
    return finalize(B.daily(spark, sf))


@register("dekad_keys")
def q_dekad_keys(spark, sf):
    """Year, month, dekad, dekad36 of every daily row, counted."""
    d = C.with_dekad(B.daily(spark, sf), "date")
    return (d.groupBy("year", "month", "dekad")
             .agg(F.count(F.lit(1)).alias("n_rows"))
             .withColumn("dekad36", C.dekad36("month", "dekad")))


@register("dekad_aggregate")
def q_dekad_aggregate(spark, sf):
    """A1."""
    return finalize(dekads(spark, sf))


@register("dekad_aggregate_long")
def q_dekad_aggregate_long(spark, sf):
    """A1 on melted rows, the default rules given as a table."""
    return finalize(climate.dekad_aggregate(B.daily(spark, sf), RU.default_rules(spark)))


# fixed values: another rule set; two rules fit PRICE_MAX and agree, two fit
# PRICE_MIN and are told apart by precedence in ``rule_conflicts``
OTHER_RULES = [("^price", "range", 1), ("max$", "range", 2), ("^(tax|disc)", "max", 3), ("count$|qty$", "mean", 4)]
CLASHING_RULES = [*OTHER_RULES, ("min$", "min", 0), ("prob", "min", 5)]


@register("dekad_rules")
def q_dekad_rules(spark, sf):
    """A1 with a rule table of its own."""
    return finalize(climate.dekad_aggregate(B.daily(spark, sf), spark.createDataFrame(OTHER_RULES, RU.RULE_SCHEMA)))


@register("rule_conflicts")
def q_rule_conflicts(spark, sf):
    """Rules resolved per parameter that occurs, with the conflicts they have."""
    found = RU.resolve(B.daily_raw(spark, sf), spark.createDataFrame(CLASHING_RULES, RU.RULE_SCHEMA))
    return found.select("param", "rule", "n_rules", F.array_join("candidates", "/").alias("candidates"))


@register("dekad36_mean")
def q_dekad36_mean(spark, sf):
    """A2."""
    return finalize(climate.collapse_dekads(dekads(spark, sf)))


def dekads(spark, sf) -> DataFrame:
    """A1 on the wide daily rows: aggregated before they are melted."""
    return climate.dekad_aggregate_wide(B.daily_wide(spark, sf), [p for p, _ in B.DAILY_PARAMS])


def season(spark, sf) -> DataFrame:
    return climate.seasons_of(dekads(spark, sf))


@register("season_pairs")
def q_season_pairs(spark, sf):
    """Rows per (season, rel_year) after pairing."""
    return finalize(season(spark, sf))


@register("season_window_exact")
def q_season_window_exact(spark, sf):
    """F4 exact."""
    return finalize(climate.season_window(season(spark, sf), exact=True))


@register("season_window_substring")
def q_season_window_substring(spark, sf):
    """F4 substring mode (D1): counts per (rel_year, dekad36) kept."""
    s = climate.season_window(season(spark, sf), exact=False)
    return finalize(s.groupBy("rel_year", "dekad36")
                     .agg(F.count(F.lit(1)).alias("n_rows"),
                          F.max("value").alias("max_value"), F.min("value").alias("min_value")))


@register("season_wide")
def q_season_wide(spark, sf):
    """Wide season export within the exact window."""
    params = [p for p, _ in B.DAILY_PARAMS]
    s = climate.season_window(season(spark, sf), exact=True)
    return finalize(climate.season_wide(s, params, exact=True))


# ---------------------------------------------------------------- production / panel
from ..session import scratch_path  # noqa: E402
from ..operators import analysis, panel as P, production as PR, quality as Q  # noqa: E402
from ..functions.formatting import format_br, format_scaled  # noqa: E402

YEARS = list(range(1995, 2002))
REGIONS_PICK = ["AMERICA", "EUROPE"]
YEARS_PICK = [1997, 1998, 1999]


def crosstab_long(spark, sf, variable: int) -> DataFrame:
    return PR.unpivot_years(B.crosstab(spark, sf, variable, YEARS), YEARS)


def dpanel(spark, sf) -> DataFrame:
    """Dashboard panel: production + P5 + P6."""
    return PR.dashboard_panel(B.production(spark, sf))


@register("unpivot_years")
def q_unpivot_years(spark, sf):
    """R1."""
    return crosstab_long(spark, sf, 0)


@register("clean_dash")
def q_clean_dash(spark, sf):
    """Dash → 0, '..'/blank → NULL → 0."""
    d = crosstab_long(spark, sf, 0)
    return finalize(d.withColumn("value", C.clean_number("raw")))


@register("combine_variables")
def q_combine_variables(spark, sf):
    """J3 over crosstab sheets: one union, one conditional aggregate, then the melt.

    Unsorted: row order of a DataFrame is not kept downstream; the sorted
    form (W6) is for file export (``sort=True``).
    """
    wides = [(B.CROSSTAB_VARIABLES[i][0], B.crosstab(spark, sf, i, YEARS)) for i in range(len(B.CROSSTAB_VARIABLES))]
    return finalize(PR.combine_crosstabs(wides, YEARS, sort=False))


@register("combine_variables_long")
def q_combine_variables_long(spark, sf):
    """J3 on already-melted inputs: union long + one conditional aggregate."""
    longs = [(B.CROSSTAB_VARIABLES[i][0], crosstab_long(spark, sf, i)) for i in range(len(B.CROSSTAB_VARIABLES))]
    return finalize(PR.combine_variables(longs, sort=False))


@register("production")
def q_production(spark, sf):
    """PRODUCTION binding (sums per site-year)."""
    return finalize(B.production(spark, sf), 8)


@register("loss_pct")
def q_loss_pct(spark, sf):
    """P5 + P6."""
    return finalize(dpanel(spark, sf))


@register("join_geo")
def q_join_geo(spark, sf):
    """J1 (+ Q2 m:1)."""
    return finalize(P.order_columns(P.join_geo(dpanel(spark, sf), B.sites(spark, sf))))


@register("join_climate")
def q_join_climate(spark, sf):
    """J2 long: production+geo ⟕ exact-window season cells."""
    pg = P.join_geo(dpanel(spark, sf), B.sites(spark, sf))
    s = climate.season_window(season(spark, sf), exact=True)
    # season_table output is grouped on its key: unique by construction
    return finalize(P.order_columns(P.join_climate(pg, s, validate_season=False)))


@register("unmatched")
def q_unmatched(spark, sf):
    """Q3: production rows with no geography / no climate; sites with no coordinates."""
    prod = dpanel(spark, sf)
    # one nation is left out of the site table, so that something is unmatched
    sites = B.sites(spark, sf).where(F.col("site_id") != C.norm_code(F.lit(B.DROPPED_NATION)))
    s = climate.season_window(season(spark, sf), exact=True).withColumnRenamed("season_year", "year")
    def n(df, check):
        return df.agg(F.lit(check).alias("check"), F.count(F.lit(1)).alias("n"))
    return (n(Q.unmatched(prod, sites, ["site_id"]), "no_geography")
            .unionByName(n(Q.unmatched(prod, s, ["site_id", "year"]), "no_climate"))
            .unionByName(n(sites.filter(F.col("lat").isNull() | F.col("lon").isNull()), "no_coordinates")))


@register("expect_unique")
def q_expect_unique(spark, sf):
    """Q2: duplicated (site, date, param) keys of the daily table with multiplicity."""
    return Q.duplicate_keys(B.daily(spark, sf), ["site_id", "date", "param"])


@register("completeness")
def q_completeness(spark, sf):
    """Q1 counts over the joined geography panel."""
    return Q.completeness(P.join_geo(dpanel(spark, sf), B.sites(spark, sf)))


@register("yearly_totals")
def q_yearly_totals(spark, sf):
    """A3."""
    return finalize(PR.yearly_totals(dpanel(spark, sf)), 4)


@register("weighted_yield")
def q_weighted_yield(spark, sf):
    """A4."""
    return finalize(PR.weighted_metrics(PR.yearly_totals(dpanel(spark, sf))), 4)


@register("kpi_summary")
def q_kpi_summary(spark, sf):
    """A5 (rollup: one row per year + the consolidated row)."""
    return finalize(PR.kpi_summary(dpanel(spark, sf)), 4)


@register("kpi_delta")
def q_kpi_delta(spark, sf):
    """A6 over the filtered years (first vs last)."""
    return finalize(PR.kpi_delta(PR.yearly_totals(dpanel(spark, sf))), 4)


@register("period_label")
def q_period_label(spark, sf):
    """W8 for the full panel and for a non-contiguous pick."""
    d = dpanel(spark, sf)
    full = PR.period_label(d).withColumn("selection", F.lit("all"))
    pick = PR.period_label(P.filter_panel(d, years=[1996, 1998, 1999])).withColumn("selection", F.lit("pick"))
    return full.unionByName(pick)


@register("panel_profile")
def q_panel_profile(spark, sf):
    """A7 over the long joined panel."""
    pg = P.join_geo(dpanel(spark, sf), B.sites(spark, sf))
    s = climate.season_window(season(spark, sf), exact=True)
    return P.panel_profile(P.join_climate(pg, s, validate=False))


@register("filter_panel")
def q_filter_panel(spark, sf):
    """F1 + F2: years and the sites of chosen regions (semi-join)."""
    sites = B.sites(spark, sf)
    chosen = P.sites_in_regions(sites, REGIONS_PICK)
    return finalize(P.filter_panel(dpanel(spark, sf), years=YEARS_PICK, sites=chosen))


@register("sites_in_regions")
def q_sites_in_regions(spark, sf):
    """F2."""
    return P.sites_in_regions(B.sites(spark, sf), REGIONS_PICK)


@register("slice_year")
def q_slice_year(spark, sf):
    """F3 + A5 on one year."""
    return finalize(PR.kpi_summary(P.slice_year(dpanel(spark, sf), 1998)).filter(F.col("year").isNotNull()), 4)


@register("format_br")
def q_format_br(spark, sf):
    """X7/X8 on yearly totals."""
    t = PR.weighted_metrics(PR.yearly_totals(dpanel(spark, sf)))
    return t.select("year",
                    format_br("planted_ha", 0, "", " ha").alias("planted_text"),
                    format_br("yield_kg_ha", 2).alias("yield_text"),
                    format_scaled("produced_kg", "", " kg").alias("produced_text"),
                    format_scaled(-F.col("value_brl"), "R$ ").alias("value_text"),
                    format_scaled(F.col("lost_ha") / 1000, "", " ha").alias("lost_text"))


# ---------------------------------------------------------------- analysis
METRIC = "yield_kg_ha"
PROD_CORR_COLS = ["planted_ha", "harvested_ha", "lost_ha", "produced_kg", "yield_kg_ha",
                  "value_brl", "value_share", "loss_pct"]


def corr(spark, sf, metric=METRIC) -> DataFrame:
    s = climate.season_window(season(spark, sf), exact=True)
    return analysis.climate_correlations(s, dpanel(spark, sf), metric)


@register("climate_corr")
def q_climate_corr(spark, sf):
    """M1 over the exact window, metric = yield."""
    return finalize(corr(spark, sf))


@register("climate_corr_production")
def q_climate_corr_production(spark, sf):
    """M1 against production over all 72 dekads (no window)."""
    return finalize(analysis.climate_correlations(season(spark, sf), dpanel(spark, sf), "produced_kg"))


@register("top_corr")
def q_top_corr(spark, sf):
    """Top-10 |r| (flagship)."""
    return finalize(analysis.top_correlations(corr(spark, sf), 10))


@register("corr_strength")
def q_corr_strength(spark, sf):
    """W2 + X9 + J8: top-3 detail with labels and interpretation."""
    top = analysis.top_correlations(corr(spark, sf), 10)
    return finalize(analysis.top_detail(top, 3, attrs=attributes(spark), metric="Yield (kg per ha)"))


@register("corr_matrix")
def q_corr_matrix(spark, sf):
    """M2 over the production measures."""
    return finalize(analysis.corr_matrix(dpanel(spark, sf), PROD_CORR_COLS))


@register("trend")
def q_trend(spark, sf):
    """M4: OLS trend per feature over the scatter points."""
    s = climate.season_window(season(spark, sf), exact=True)
    pts = analysis.scatter_points(s, dpanel(spark, sf), METRIC)
    return finalize(analysis.trend(pts))


@register("scatter")
def q_scatter(spark, sf):
    """M5."""
    s = climate.season_window(season(spark, sf), exact=True)
    return finalize(analysis.scatter_points(s, dpanel(spark, sf), METRIC))


def heat(spark, sf) -> DataFrame:
    # the correlation table (one row per feature, bounded) feeds the top list,
    # the parameter choice and the heat rows: materialise it once
    from ..session import cut_lineage
    c = cut_lineage(corr(spark, sf))
    params = analysis.heatmap_params(analysis.top_correlations(c, 10), 5)
    return analysis.heatmap_from_corr(c, params)


@register("heatmap")
def q_heatmap(spark, sf):
    """M3 + R6 order."""
    return finalize(heat(spark, sf))


@register("heatmap_wide")
def q_heatmap_wide(spark, sf):
    """R6 export."""
    return finalize(analysis.heatmap_matrix(heat(spark, sf)))


@register("phase_mean")
def q_phase_mean(spark, sf):
    """A9."""
    return finalize(analysis.phase_mean(heat(spark, sf)))


@register("site_means")
def q_site_means(spark, sf):
    """A8."""
    return finalize(analysis.site_means(dpanel(spark, sf), analysis.RANK_METRICS), 4)


@register("rank_sites")
def q_rank_sites(spark, sf):
    """Top-5 per metric."""
    return finalize(analysis.rank_sites(dpanel(spark, sf), 5), 4)


@register("trajectories")
def q_trajectories(spark, sf):
    """W4 + J9."""
    d = dpanel(spark, sf)
    return finalize(analysis.site_trajectories(d, analysis.rank_sites(d, 5)), 4)


# fixed values: attribute dictionary for the bound parameter names (one left
# without a description to exercise the fallback to the code)
ATTRIBUTES = [
    ("PREC_QTY", "Shipped quantity, summed per dekad"),
    ("PRICE_MAX", "Highest extended price"),
    ("PRICE_MIN", "Lowest extended price"),
    ("DISC_RANGE", "Range of discounts"),
    ("TAX", "Mean tax rate"),
    ("PREC_PROB", "Mean discount"),
]


def attributes(spark) -> DataFrame:
    """The dictionary as a file (BOM, quoted commas), read back."""
    from ..sources import readers, sinks
    path = scratch_path(spark, "attributes")
    rows = spark.createDataFrame([(0, "\ufeffAtributo", "Descrição"), *((i + 1, *x) for i, x in enumerate(ATTRIBUTES))], "ord int, code string, description string")
    quoted = F.when(F.col("description").contains(","), F.concat(F.lit('"'), "description", F.lit('"'))).otherwise(F.col("description"))
    sinks.write_text_files(rows.select(F.lit("0").alias("file"), "ord", F.concat_ws(",", "code", quoted).alias("text")), path, "file", "ord")
    return readers.read_attributes(spark, f"{path}/file=0")


@register("io_attributes")
def q_io_attributes(spark, sf):
    """S10 → J8: the attribute dictionary of the parameters that occur."""
    used = B.daily_raw(spark, sf).groupBy(F.col("param").alias("code")).agg(F.count(F.lit(1)).alias("n_rows"))
    return used.join(attributes(spark), "code", "left")


@register("labels_lookup")
def q_labels_lookup(spark, sf):
    """Labels of every correlated feature + legend."""
    c = corr(spark, sf)
    return finalize(analysis.with_labels(c, attributes(spark), "feature")
                    .select("feature", "param", "rel_year", "dekad36", "label", "description"))


@register("legend")
def q_legend(spark, sf):
    """J8 legend over the heatmap parameters."""
    return analysis.legend(heat(spark, sf), attributes(spark), "param")


# ---------------------------------------------------------------- mining
from ..operators import clustering as CL, evaluation as EV, features as FE  # noqa: E402
from ..session import cut_lineage  # noqa: E402


def mining_inputs(spark, sf):
    s = climate.season_window(season(spark, sf), exact=True)
    pg = P.join_geo(dpanel(spark, sf), B.sites(spark, sf))
    return s, pg


def mining_table(spark, sf):
    s, pg = mining_inputs(spark, sf)
    return FE.site_feature_table(s, pg, METRIC)


@register("coverage")
def q_coverage(spark, sf):
    """per-site feature coverage of kept sites."""
    s, pg = mining_inputs(spark, sf)
    feats = FE.feature_index(s)
    kept = FE.filter_coverage(FE.site_feature_means(s, pg), FE.site_targets(pg, METRIC), feats.count())
    return finalize(kept.select("site_id", "coverage"))


@register("impute_median")
def q_impute_median(spark, sf):
    """M6 (long grid of site × feature)."""
    s, pg = mining_inputs(spark, sf)
    feats = FE.feature_index(s)
    means = FE.site_feature_means(s, pg)
    kept = FE.filter_coverage(means, FE.site_targets(pg, METRIC), feats.count())
    return finalize(FE.impute_median(means, kept, feats))


@register("standardise")
def q_standardise(spark, sf):
    """M8."""
    long, _ = mining_table(spark, sf)
    return finalize(long.select("site_id", "idx", "param", "rel_year", "dekad36", "z"))


def site_classes(spark, sf) -> DataFrame:
    """y_true = quartile of mean yield; y_pred = quartile of mean loss % (to be aligned)."""
    _, sites = mining_table(spark, sf)
    d = dpanel(spark, sf).groupBy("site_id").agg(F.avg("loss_pct").alias("loss"))
    j = sites.join(d, "site_id")
    return FE.quantile_classes(j, "loss", out="y_pred")


@register("quantile_classes")
def q_quantile_classes(spark, sf):
    """M7."""
    _, sites = mining_table(spark, sf)
    return finalize(sites.select("site_id", "target", "y_true"))


@register("class_distribution")
def q_class_distribution(spark, sf):
    """A10."""
    _, sites = mining_table(spark, sf)
    return finalize(EV.class_distribution(sites, "y_true"))


@register("box_stats")
def q_box_stats(spark, sf):
    """Target by class."""
    _, sites = mining_table(spark, sf)
    return finalize(EV.box_stats(sites, "y_true", "target"))


def aligned(spark, sf) -> DataFrame:
    return EV.align_labels(site_classes(spark, sf), "y_true", "y_pred", "y_aligned")


@register("align_labels")
def q_align_labels(spark, sf):
    """M11."""
    return aligned(spark, sf).select("site_id", "y_true", "y_pred", "y_aligned")


@register("confusion")
def q_confusion(spark, sf):
    """M12 on aligned site classes."""
    return finalize(EV.confusion(aligned(spark, sf), "y_true", "y_aligned"))


@register("class_metrics")
def q_class_metrics(spark, sf):
    """M13 + M14 per class."""
    return finalize(EV.class_metrics(aligned(spark, sf), "y_true", "y_aligned"))


@register("metric_summary")
def q_metric_summary(spark, sf):
    """M13 global."""
    return finalize(EV.summary_metrics(EV.class_metrics(aligned(spark, sf), "y_true", "y_aligned")))


def doc_labels(spark, sf) -> DataFrame:
    return B.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y_true"),
                                              F.col("toxic").alias("y_pred"))


@register("confusion_labels")
def q_confusion_labels(spark, sf):
    """M12 over the labels table (k = 2)."""
    return finalize(EV.confusion(doc_labels(spark, sf)))


@register("class_metrics_labels")
def q_class_metrics_labels(spark, sf):
    """M13/M14 over the labels table."""
    return finalize(EV.class_metrics(doc_labels(spark, sf)))


@register("metric_report")
def q_metric_report(spark, sf):
    """M18 over the labels table."""
    pc = EV.class_metrics(doc_labels(spark, sf))
    return finalize(EV.metric_report(pc, EV.summary_metrics(pc)))


def embedding_scores(spark, sf) -> DataFrame:
    """M15 on embeddings: inverse-distance scores to the per-label mean vectors."""
    e = B.table(spark, sf, "embeddings")
    pts = e.select("vec_id", F.col("label").alias("y_true"), F.col("embedding").cast("array<double>").alias("embedding"))
    return CL.inverse_distance_rows(pts, "embedding", CL.label_centroids(pts, "embedding", "y_true"), ["vec_id", "y_true"])


@register("inverse_distance_scores")
def q_inverse_distance_scores(spark, sf):
    """M15."""
    return finalize(embedding_scores(spark, sf).select("vec_id", "y_true", "cls", "dist", "score"))


@register("auc_ovr")
def q_auc_ovr(spark, sf):
    """M16 per class + macro (cls NULL)."""
    a = EV.auc_ovr(embedding_scores(spark, sf), "y_true", "cls", "score")
    macro = a.agg(F.lit(None).cast("int").alias("cls"), F.avg("auc").alias("auc"),
                  F.sum("P").alias("P"), F.sum("N").alias("N"))
    return finalize(a.unionByName(macro))


@register("roc_points")
def q_roc_points(spark, sf):
    """M17 ROC points."""
    return finalize(EV.roc_points(embedding_scores(spark, sf), "y_true", "cls", "score"))


@register("roc_points_thin")
def q_roc_points_thin(spark, sf):
    """M17 ROC points without collinear ones."""
    return finalize(EV.roc_points_thin(embedding_scores(spark, sf), "y_true", "cls", "score"))


@register("youden")
def q_youden(spark, sf):
    """M17 Youden optimum."""
    return finalize(EV.youden(EV.roc_points(embedding_scores(spark, sf), "y_true", "cls", "score")))


@register("pca_variance")
def q_pca_variance(spark, sf):
    """M9 + W7 (rows check: signs and solver are the library's)."""
    long, _ = mining_table(spark, sf)
    proj, explained, k = CL.pca_reduce(FE.site_vectors(long))
    return CL.variance_table(spark, explained).withColumn("kept", F.col("component") <= k)


@register("pca_kmeans_invariants")
def q_pca_kmeans_invariants(spark, sf):
    """What does not depend on signs, on the solver or on where K-Means
    starts, as (check, value)."""
    long, sites = mining_table(spark, sf)
    proj, explained, k = CL.pca_reduce(FE.site_vectors(long))
    proj = cut_lineage(proj)
    shares = CL.variance_table(spark, explained)
    model, cost = CL.kmeans_best(proj, restarts=CL.KMEANS_RESTARTS)
    _, once = CL.kmeans_best(proj, restarts=1)
    pred = model.transform(proj)
    one = lambda df, check, value: df.agg(F.lit(check).alias("check"), value.cast("double").alias("value"))
    flag = lambda c: F.coalesce(F.bool_and(c), F.lit(False)).cast("int")
    from pyspark.sql import Window
    fall = shares.withColumn("before", F.lag("explained").over(Window.orderBy("component")))  # a row per component
    kept, target = F.col("component") == k, CL.VARIANCE_TARGET
    parts = [
        one(shares, "components", F.count("*")), one(fall, "shares fall", flag(F.col("before").isNull() | (F.col("before") >= F.col("explained") - 1e-12))),
        one(shares, "shares sum to one", flag(F.lit(True)) * (F.abs(F.sum("explained") - 1) < 1e-9).cast("int")),
        one(shares, "cumulative ends at one", (F.abs(F.max("cumulative") - 1) < 1e-9).cast("int")),
        one(shares, "kept reach the target", F.max(F.when(kept, (F.col("cumulative") >= target - 1e-12).cast("int")))),
        one(shares, "one fewer would not", F.coalesce(F.max(F.when((F.col("component") == k - 1) & (F.col("component") >= CL.MIN_COMPONENTS), (F.col("cumulative") < target).cast("int"))), F.lit(1))),
        one(proj, "sites projected", F.count("*")), one(pred, "sites in clusters", F.count("raw")),
        one(pred, "clusters within k", flag(F.col("raw").between(0, CL.KMEANS_K - 1))),
        one(shares.limit(1), "cost not above one restart", F.max(F.lit(int(cost <= once * (1 + 1e-9))))),
    ]
    from functools import reduce
    return reduce(DataFrame.unionByName, parts)


@register("kmeans")
def q_kmeans(spark, sf):
    """M9 → M10 → M11 → M15 on site features (rows check)."""
    long, sites = mining_table(spark, sf)
    proj, _, _ = CL.pca_reduce(FE.site_vectors(long))
    model, cost = CL.kmeans_best(proj, restarts=CL.KMEANS_RESTARTS)
    pred = model.transform(proj).join(sites.select("site_id", "y_true"), "site_id")
    al = EV.align_labels(pred, "y_true", "raw", "y_pred")
    rows = al.select("raw", "y_pred").distinct().collect()
    mapping = {r["raw"]: r["y_pred"] for r in rows}
    d = CL.centroid_distances(al, model.clusterCenters())
    sc = CL.inverse_distance_scores(d, mapping, CL.KMEANS_K)
    return sc.select("site_id", "y_true", "raw", "y_pred", F.lit(cost).alias("cost"),
                     F.transform("scores", lambda v: F.round(v, 6)).alias("scores"))


# ---------------------------------------------------------------- geo
from ..operators import boundary as BO, geo as G  # noqa: E402

BOUNDARY_REGIONS = ["AMERICA", "ASIA"]


@register("centroid")
def q_centroid(spark, sf):
    """G1 on GeoJSON built from the site table: a Point and a square Polygon per
    site, and per region a MultiPolygon of its sites' squares."""
    s = B.sites(spark, sf)
    sq = F.format_string("[[[%s,%s],[%s,%s],[%s,%s],[%s,%s],[%s,%s]]]",
                         F.col("lon") - 0.1, F.col("lat") - 0.1, F.col("lon") + 0.1, F.col("lat") - 0.1,
                         F.col("lon") + 0.1, F.col("lat") + 0.1, F.col("lon") - 0.1, F.col("lat") + 0.1,
                         F.col("lon") - 0.1, F.col("lat") - 0.1)
    pts = s.select(F.concat(F.lit("P"), "site_id").alias("code"), F.lit("Point").alias("type"),
                   F.format_string("[%s,%s]", "lon", "lat").alias("coords"))
    polys = s.select(F.concat(F.lit("S"), "site_id").alias("code"), F.lit("Polygon").alias("type"), sq.alias("coords"))
    multi = (s.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("site_id", sq.alias("r")))).alias("rs"))
              .select(F.concat(F.lit("R"), "region").alias("code"), F.lit("MultiPolygon").alias("type"),
                      F.concat(F.lit("["), F.array_join(F.transform("rs", lambda e: e["r"]), ","), F.lit("]")).alias("coords")))
    geoms = pts.unionByName(polys).unionByName(multi)
    return finalize(geoms.select("code", "type", G.centroid("type", "coords").alias("c"))
                    .select("code", "type", "c.lat", "c.lon"))


def boundary_edges(spark, sf) -> DataFrame:
    s = B.sites(spark, sf).filter(F.col("region").isin(BOUNDARY_REGIONS))
    return G.ring_edges(G.star_polygon(s))


@register("clip_points")
def q_clip_points(spark, sf):
    """G2 + F7: sites inside (or on) a boundary built from two regions' sites."""
    s = G.valid_coords(B.sites(spark, sf))
    return finalize(G.clip_points(s, boundary_edges(spark, sf)).select("site_id", "name", "lat", "lon"))


def region_boundaries(spark, sf) -> DataFrame:
    """(code, geometry) of each region: a box around its sites with a diamond cut out
    of its middle, and a triangle beside it."""
    s = B.sites(spark, sf).where("lon IS NOT NULL AND lat IS NOT NULL")
    ext = s.groupBy("region_id").agg(F.min("lon").alias("a"), F.max("lon").alias("b"), F.min("lat").alias("c"), F.max("lat").alias("d"))
    ring = lambda *p: F.array(*(F.array(F.expr(x), F.expr(y)) for x, y in (*p, p[0])))
    box = ring(("a - 0.1", "c - 0.1"), ("b + 0.1", "c - 0.1"), ("b + 0.1", "d + 0.1"), ("a - 0.1", "d + 0.1"))
    hole = ring(("(a + b) / 2 - 0.5", "(c + d) / 2"), ("(a + b) / 2", "(c + d) / 2 + 0.5"), ("(a + b) / 2 + 0.5", "(c + d) / 2"), ("(a + b) / 2", "(c + d) / 2 - 0.5"))
    beside = ring(("b + 0.2", "c"), ("b + 1.2", "c + 0.3"), ("b + 0.4", "d"))
    return ext.select("region_id", F.array(F.array(box, hole), F.array(beside)).alias("coordinates"))


@register("clip_geojson")
def q_clip_geojson(spark, sf):
    """S2 → G2: regions written as GeoJSON (two parts, one with a hole), read back and
    turned into edges; which customers' points each region holds."""
    path = scratch_path(spark, "regions")
    feats = region_boundaries(spark, sf).select(
        F.lit("Feature").alias("type"), F.struct(F.col("region_id").cast("string").alias("codarea")).alias("properties"),
        F.struct(F.lit("MultiPolygon").alias("type"), "coordinates").alias("geometry"))
    feats.write.mode("overwrite").json(path)
    edges = BO.geometry_edges(R.read_boundaries(spark, path, collection=False))
    pts = B.table(spark, sf, "customer").selectExpr("c_custkey", "-47.9D - CAST(c_custkey * 31 % 997 AS DOUBLE) * 0.0083D AS x", "-22.3D - CAST(c_custkey * 17 % 613 AS DOUBLE) * 0.0079D AS y")
    return finalize(BO.locate(pts, edges).select("c_custkey", "boundary"))


def boundary_grid(spark, sf):
    e = boundary_edges(spark, sf)
    b = e.agg(F.min(F.least("x1", "x2")), F.min(F.least("y1", "y2")),
              F.max(F.greatest("x1", "x2")), F.max(F.greatest("y1", "y2"))).first()
    return G.mask_grid(G.make_grid(spark, tuple(float(v) for v in b)), e)


@register("grid")
def q_grid(spark, sf):
    """G3 + G4: 0.02° grid over the boundary's bbox with the strict-inside mask."""
    return finalize(boundary_grid(spark, sf))


def stations(spark, sf):
    """Clipped sites with class 1..4 of mean yield (quartiles over the clipped sites)."""
    e = boundary_edges(spark, sf)
    s = G.clip_points(G.valid_coords(B.sites(spark, sf)), e)
    y = dpanel(spark, sf).groupBy("site_id").agg(F.avg(METRIC).alias("target"))
    c = FE.quantile_classes(s.join(y, "site_id"), "target")
    return c.select("lon", "lat", (F.col("y_true") + 1).cast("double").alias("z"))


@register("idw_surface")
def q_idw_surface(spark, sf):
    """G5 (IDW kernel) over inside cells."""
    g = boundary_grid(spark, sf).filter("inside")
    return finalize(G.idw_surface(g, stations(spark, sf)).select("i", "j", "z"))


# ---------------------------------------------------------------- sources / sinks / streaming
from ..sources import readers as R, sinks as K  # noqa: E402
from ..streaming import ingest as ST  # noqa: E402


@register("io_daily_csv")
def q_io_daily_csv(spark, sf):
    """K2 → S5: daily rows written per parameter folder as CSV and read back typed."""
    path = scratch_path(spark, "daily")
    K.write_daily(B.daily_raw(spark, sf), path)
    return finalize(R.read_daily(spark, path))


@register("io_dekads_parquet")
def q_io_dekads_parquet(spark, sf):
    """K3 → S6: dekads written by year, read back (all years)."""
    path = scratch_path(spark, "dekads")
    K.write_by_year(dekads(spark, sf), path)
    return finalize(R.read_dekads(spark, path).select("site_id", "name", "lat", "lon", "year", "month",
                                                       "dekad", "param", "value"))


@register("io_panel_parquet")
def q_io_panel_parquet(spark, sf):
    """K6 → S9: joined panel as snappy Parquet."""
    path = scratch_path(spark, "panel")
    K.write_panel(P.order_columns(P.join_geo(dpanel(spark, sf), B.sites(spark, sf))), path)
    return finalize(R.read_panel(spark, path))


@register("mining_report")
def q_mining_report(spark, sf):
    """M10 → M11 → M12/M13 → M15 → M16 → M18 and A11 of the predicted classes: what
    does not depend on where K-Means starts."""
    long, sites = mining_table(spark, sf)
    proj, _, _ = CL.pca_reduce(FE.site_vectors(long))
    model, _ = CL.kmeans_best(proj, restarts=CL.KMEANS_RESTARTS)
    pred = model.transform(proj).join(sites.select("site_id", "y_true", "target"), "site_id")
    al = cut_lineage(EV.align_labels(pred, "y_true", "raw", "y_pred"))
    mapping = {r["raw"]: r["y_pred"] for r in al.select("raw", "y_pred").distinct().collect()}
    scored = CL.inverse_distance_scores(CL.centroid_distances(al, model.clusterCenters()), mapping, CL.KMEANS_K)
    rows = scored.select("site_id", "y_true", F.posexplode("scores").alias("cls", "score"))
    auc = EV.auc_ovr(rows)
    per_class = EV.class_metrics(al, "y_true", "y_pred")
    report = EV.metric_report(per_class, EV.summary_metrics(per_class), auc)
    full = EV.confusion(al, "y_true", "y_pred")
    boxes = EV.box_stats(al, "y_pred", "target")
    one = lambda df, check, value: df.agg(F.lit(check).alias("check"), value.cast("double").alias("value"))
    in_unit = lambda c: F.coalesce(F.bool_and(F.col(c).between(0, 1) | F.col(c).isNull()), F.lit(True)).cast("int")
    parts = [
        one(al, "sites", F.count("*")), one(full, "confusion cells sum to sites", F.sum("n")),
        one(boxes, "sites in boxes", F.sum("n")), one(rows.groupBy("site_id").agg(F.round(F.sum("score"), 9).alias("s")), "sites whose scores sum to one", F.count(F.when(F.col("s") == 1, 1))),
        one(auc, "aucs within 0 and 1", in_unit("auc")), one(report.where("metric <> 'auc'"), "metrics within 0 and 1", in_unit("value")),
        one(al, "aligned not below unaligned", (F.sum((F.col("y_true") == F.col("y_pred")).cast("int")) >= F.sum((F.col("y_true") == F.col("raw")).cast("int"))).cast("int")),
        *[one(per_class.where(F.col("cls") == i), f"true sites of class {i}", F.coalesce(F.sum("support"), F.lit(0))) for i in range(CL.KMEANS_K)]]
    from functools import reduce
    return reduce(DataFrame.unionByName, parts)


def registry_json(spark, sf) -> DataFrame:
    n = B.table(spark, sf, "nation")
    r = B.table(spark, sf, "region")
    j = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "left")  # 25 × 5 rows by spec
    meso = F.struct(F.col("n_regionkey").cast("long").alias("id"), F.col("r_name").alias("nome"))
    return j.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("nome"),
                    F.struct(meso.alias("mesorregiao")).alias("microrregiao"))


@register("io_sites_json")
def q_io_sites_json(spark, sf):
    """Nested registry JSON."""
    path = scratch_path(spark, "sites-json")
    registry_json(spark, sf).write.mode("overwrite").json(path)
    return R.read_sites(spark, path, multiline=False)


@register("io_sites_csv")
def q_io_sites_csv(spark, sf):
    """K1 → S8: site CSV with BOM and fixed field order, read with an explicit schema."""
    from ..schemas import SITE
    path = scratch_path(spark, "sites-csv")
    K.write_sites(B.sites(spark, sf), path)
    return finalize(R.read_csv(spark, path, SITE))


def square_json(lon="lon", lat="lat"):
    return F.format_string("[[[%s,%s],[%s,%s],[%s,%s],[%s,%s],[%s,%s]]]",
                           F.col(lon) - 0.1, F.col(lat) - 0.1, F.col(lon) + 0.1, F.col(lat) - 0.1,
                           F.col(lon) + 0.1, F.col(lat) + 0.1, F.col(lon) - 0.1, F.col(lat) + 0.1,
                           F.col(lon) - 0.1, F.col(lat) - 0.1)


@register("io_boundaries")
def q_io_boundaries(spark, sf):
    """S2 → G1 → J5: GeoJSON features per site, centroids attached to the registry."""
    path = scratch_path(spark, "geojson")
    s = B.sites(spark, sf)
    feats = s.select(F.lit("Feature").alias("type"),
                     F.struct(F.col("site_id").alias("codarea")).alias("properties"),
                     F.struct(F.lit("Polygon").alias("type"),
                              F.from_json(square_json(), G.POLYGON_T).alias("coordinates")).alias("geometry"))
    feats.write.mode("overwrite").json(path)
    b = R.read_boundaries(spark, path, collection=False)
    cents = b.select("code", G.centroid("geom_type", "coords").alias("c")).select("code", "c.lat", "c.lon")
    reg_path = scratch_path(spark, "sites-json")
    registry_json(spark, sf).write.mode("overwrite").json(reg_path)
    reg = R.read_sites(spark, reg_path, multiline=False).withColumn("code", C.code_int("site_id"))
    return finalize(reg.join(cents, "code", "left").select("site_id", "name", "lat", "lon"))


@register("io_payloads")
def q_io_payloads(spark, sf):
    """S3: one payload file per site (prose, marker, YEAR/DOY CSV).  Values are the
    daily maxima."""
    params = [p for p, _ in B.DAILY_PARAMS]
    d = (B.daily_raw(spark, sf).groupBy("site_id", "date").pivot("param", params).agg(F.max("value")))
    line = F.concat_ws(",", F.year("date").cast("string"), F.dayofyear("date").cast("string"),
                       *[F.col(p).cast("string") for p in params])
    body = d.select("site_id", F.concat(F.lit("3|"), F.col("date").cast("string")).alias("ord"), line.alias("text"))
    sites = d.select("site_id").distinct()
    head = sites.select("site_id", F.explode(F.array(
        F.struct(F.lit("0").alias("ord"), F.lit("Daily point series, derived for testing").alias("text")),
        F.struct(F.lit("1").alias("ord"), F.lit(R.END_HEADER).alias("text")),
        F.struct(F.lit("2").alias("ord"), F.lit(",".join(["YEAR", "DOY"] + params)).alias("text")))).alias("h")
    ).select("site_id", "h.ord", "h.text")
    path = scratch_path(spark, "payloads")
    K.write_text_files(head.unionByName(body), path, "site_id", "ord")
    rows, _ = R.read_point_payloads(spark, path, site_pattern=r"site_id=([^/]+)")
    return finalize(rows.withColumn("value", C.sentinel_null("value")))


@register("io_payload_quarantine")
def q_io_payload_quarantine(spark, sf):
    """S3 quarantine: files rejected with a reason (rows check)."""
    params = [p for p, _ in B.DAILY_PARAMS]
    d = B.daily_raw(spark, sf).select("site_id").distinct()
    dropped = C.norm_code(F.lit(B.DROPPED_NATION))
    txt = d.select("site_id", F.lit("0").alias("ord"),
                   F.when(F.col("site_id") == dropped, F.lit("no marker here"))
                    .otherwise(F.concat_ws("\n", F.lit(R.END_HEADER), F.lit(",".join(["YEAR", "DOY"] + params))))
                    .alias("text"))
    path = scratch_path(spark, "payloads-q")
    K.write_text_files(txt, path, "site_id", "ord")
    _, q = R.read_point_payloads(spark, path, site_pattern=r"site_id=([^/]+)")
    return q.select(F.regexp_extract("file", r"site_id=([^/]+)", 1).alias("site_id"), "reason")


PRODUCTION_SHEETS = [("planted_ha", "Área plantada (Hectares)"), ("produced_t", "Quantidade produzida (Toneladas)")]


@register("io_production")
def q_io_production(spark, sf):
    """One sheet export per variable (padded title rows, "Variável - …", two
    header rows over 51 years, quoted names, rows per site, a nameless footer) and a
    sheet of notes, which is skipped."""
    prod = B.production(spark, sf)
    every = list(range(1960, 2011))
    lines = []
    pad = "," * len(every)
    for i, (col, title) in enumerate(PRODUCTION_SHEETS):
        w = prod.groupBy("site_id", "name").pivot("year", YEARS).agg(F.first(col))
        cells = [F.coalesce(F.col(str(y)).cast("string"), F.lit("-")) if y in YEARS else F.lit("..") for y in every]
        data = w.select(F.lit(f"Tabela {i}").alias("sheet"), F.concat(F.lit("3|"), F.col("site_id")).alias("ord"),
                        F.concat_ws(",", "site_id", F.concat(F.lit('"'), "name", F.lit('"')), *cells).alias("text"))
        hdr = w.agg(F.count(F.lit(1)).alias("_n")).select(F.lit(f"Tabela {i}").alias("sheet"), F.explode(F.array(
            F.struct(F.lit("0").alias("ord"), F.lit(f'"Tabela {i}, derived production"{pad},').alias("text")),
            F.struct(F.lit("1").alias("ord"), F.lit(f"Variável - {title}{pad},").alias("text")),
            F.struct(F.lit("2a").alias("ord"), F.lit("Cód.,Município,Ano" + "," * (len(every) - 1)).alias("text")),
            F.struct(F.lit("2b").alias("ord"), F.lit(",," + ",".join(str(y) for y in every)).alias("text")),
            F.struct(F.lit("9").alias("ord"), F.lit("Fonte: derived from the line table" + pad + ",").alias("text")))).alias("h")
        ).select("sheet", "h.ord", "h.text")
        lines += [hdr, data]
    notes = lines[0].where("ord < '3'").withColumn("sheet", F.lit("Notas"))
    from functools import reduce
    allv = reduce(DataFrame.unionByName, [*lines, notes])
    path = scratch_path(spark, "production")
    K.write_text_files(allv, path, "sheet", "ord")
    return finalize(R.read_production(spark, path, every).where(F.col("year").isin(YEARS)).drop("raw"))


@register("io_params")
def q_io_params(spark, sf):
    """Parameter list written as CSV (header ``Atributo``) and read back distinct."""
    path = scratch_path(spark, "params")
    B.daily_raw(spark, sf).select(F.col("param").alias("Atributo")).distinct() \
        .write.mode("overwrite").option("header", True).csv(path)
    return R.read_params(spark, path)


@register("io_wide_csv")
def q_io_wide_csv(spark, sf):
    """K4: season export with fixed decimals, read back as strings.

    Means are rounded to 8 digits first: their last bits depend on the order of
    summation, and would decide the text on a tie.
    """
    params = [p for p, _ in B.DAILY_PARAMS]
    path = scratch_path(spark, "wide")
    wide = climate.season_wide(climate.season_window(season(spark, sf), exact=True), params, exact=True)
    K.write_wide_csv(finalize(wide, 8), path, 4)
    return spark.read.option("header", True).csv(path)


@register("incremental_ingest")
def q_incremental_ingest(spark, sf):
    """Events split into one file per day, ingested with an availableNow
    stream and a checkpoint, then counted per (year, month, dekad, type)."""
    src = scratch_path(spark, "events-src")
    ev = B.table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    ev.repartition("day").write.mode("overwrite").partitionBy("day").parquet(src)
    out, ck = scratch_path(spark, "events-out"), scratch_path(spark, "events-ckpt")
    schema = T.StructType([f for f in ev.schema.fields if f.name != "day"] + [T.StructField("day", T.DateType())])
    ST.ingest_incremental(spark, src, out, ck, schema, ts_col="ts", value_col="value")
    got = ST.read_ingested(spark, out)
    return finalize(got.groupBy("year", "month", "dekad", "event_type")
                       .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("sum_value")), 4)


def messy_lines(spark, sf) -> DataFrame:
    """Daily rows of one parameter as CSV lines; some have a field too few or too many,
    a value, a date or a key that does not fit."""
    q = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    li = B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.to_date("l_shipdate").cast("string").alias("day"))
    kind = F.col("l_orderkey") % 40
    site = F.when(kind == 5, F.lit("")).otherwise(F.lpad(F.col("l_linenumber").cast("string"), 7, "0"))
    name = F.concat(F.lit('"Site, '), q("l_linenumber"), F.lit('"'))
    day = F.when(kind == 7, F.lit("1995-13-41")).otherwise(F.col("day"))
    value = F.when(kind == 9, F.lit("n/a")).when(kind == 11, F.lit("")).otherwise(q("l_quantity"))
    line = F.concat_ws(",", site, name, F.lit("-22.5"), F.lit("-48.25"), day, value, F.lit("PREC_QTY"))
    return li.select(F.when(kind == 1, F.substring_index(line, ",", 5)).when(kind == 3, F.concat(line, F.lit(",extra"))).otherwise(line).alias("value"))


@register("io_bad_rows")
def q_io_bad_rows(spark, sf):
    """Q1 + S5 row by row: good rows by site, malformed ones by reason."""
    path = scratch_path(spark, "messy")
    messy_lines(spark, sf).write.text(path)
    good, bad = R.read_daily_checked(spark, path)
    return (good.groupBy("site_id", "name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.sum(F.col("value").isNull().cast("int")).alias("n_null"))
                .select("site_id", "name", F.lit(None).cast("string").alias("reason"), "n", "total", "n_null")
                .unionByName(bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n")), allowMissingColumns=True))


@register("io_rewrite_year")
def q_io_rewrite_year(spark, sf):
    """K3: all years written, then one year again with other values; all read back."""
    path = scratch_path(spark, "years")
    d = cut_lineage(dekads(spark, sf))
    K.rewrite_years(d, path)
    K.rewrite_years(d.where("year = 1998").withColumn("value", F.col("value") * 2 + 1), path)
    return finalize(R.read_dekads(spark, path).select(d.columns))


@register("io_ordered_csv")
def q_io_ordered_csv(spark, sf):
    """K5: the production panel as one ordered CSV in parts; each line with its number
    in the whole file, found from the parts' names and the manifest."""
    path = scratch_path(spark, "ordered")
    p = B.production(spark, sf).select("site_id", "name", "year", "planted_ha", "harvested_ha")
    manifest = K.write_ordered_csv(p, path, ["site_id", "year"])
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("part"), F.monotonically_increasing_id().alias("id"), "value")
    from pyspark.sql import Window
    # a part's lines by their place; the manifest (a row per part) says how many come before
    at = F.row_number().over(Window.partitionBy("part").orderBy("id"))
    before = F.coalesce(F.sum("n_rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = F.when(F.row_number().over(Window.orderBy("part")) == 1, F.lit(0)).otherwise(F.lit(1))
    parts = manifest.select("part", before.alias("before"), head.alias("head"))
    return lines.withColumn("at", at).join(parts, "part").select((F.col("before") + F.col("at") + F.col("head") - 1).alias("line_no"), F.col("value").alias("line"))


@register("incremental_dekads")
def q_incremental_dekads(spark, sf):
    """S11 + A1: days arrive in three streams (odd years; even years; late days of
    all), the second is written twice, two years are folded; then the dekads."""
    from ..streaming import dekads as SD
    src, out, ck = (scratch_path(spark, f"dekads-{x}") for x in ("in", "parts", "checkpoint"))
    raw = B.daily_raw(spark, sf)
    late = F.dayofmonth("date").isin(9, 19, 29)
    odd = F.year("date") % 2 == 1
    for part in (raw.where(odd & ~late), raw.where(~odd & ~late), raw.where(late)):
        part.write.mode("append").parquet(src)
        SD.ingest_dekads(spark, src, out, ck, raw.schema, max_files_per_trigger=1_000)
    SD.apply_batch(raw.where(~odd & ~late).withColumn("value", C.sentinel_null("value")), 1, out)  # as after a crash
    SD.compact(spark, out, [1996, 1997])
    return finalize(SD.read_dekads(spark, out))


# ---------------------------------------------------------------- SQL text only
from .. import sql as SQL  # noqa: E402

SQL_DEKADS = """
WITH keyed AS (SELECT *, agro_observed(value) AS v, year(date) AS year, month(date) AS month, agro_dekad(date) AS dekad, agro_dekad_rule(param) AS rule FROM agro_daily),
parts AS (SELECT site_id, name, lat, lon, year, month, dekad, param, rule, sum(v) AS total, avg(v) AS mean, max(v) AS high, min(v) AS low FROM keyed
  WHERE site_id IS NOT NULL AND name IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND date IS NOT NULL AND param IS NOT NULL GROUP BY ALL),
chosen AS (SELECT *, CASE rule WHEN 'sum' THEN coalesce(total, 0.0D) WHEN 'max' THEN high WHEN 'min' THEN low WHEN 'range' THEN high - low ELSE mean END AS value FROM parts)
SELECT site_id, name, round(lat, 6) AS lat, round(lon, 6) AS lon, year, month, dekad, param, round(value, 6) AS value FROM chosen WHERE value IS NOT NULL"""

SQL_REPORT = """
WITH named AS (SELECT p.*, coalesce(s.region, '?') AS region FROM agro_production p LEFT JOIN agro_site s ON agro_site_code(p.site_id) = s.site_id),
totals AS (SELECT region, year, sum(planted_ha) AS planted, sum(harvested_ha) AS harvested, sum(produced_t) * 1000 AS produced FROM named GROUP BY ALL)
SELECT region, year, round(planted, 4) AS planted_ha, round(agro_loss_pct(planted, harvested), 4) AS loss_pct,
  agro_br_number(round(planted, 4), 1) AS planted_text, agro_br_number(try_divide(produced, harvested), 2) AS yield_text
FROM totals"""

SQL_SCREEN = """
WITH yearly AS (SELECT site_id, param, year(date) AS year, avg(v) AS x FROM (SELECT *, agro_observed(value) AS v FROM agro_daily) GROUP BY ALL),
m AS (SELECT y.param, count(*) AS n, sum(x) AS sx, sum(yield_kg_ha) AS sy, sum(x * x) AS sxx, sum(yield_kg_ha * yield_kg_ha) AS syy, sum(x * yield_kg_ha) AS sxy
  FROM yearly y JOIN agro_production p ON p.site_id = y.site_id AND p.year = y.year WHERE x IS NOT NULL AND yield_kg_ha IS NOT NULL GROUP BY y.param HAVING count(*) > 5),
c AS (SELECT param, n, agro_pearson(n, sx, sy, sxx, syy, sxy) AS r FROM m)
SELECT param, n, round(r, 5) AS r, agro_strength(r) AS strength FROM c"""


def in_sql(text: str):
    def run(spark, sf):
        SQL.install(spark, sf)
        return spark.sql(text)
    return run


for _name, _text in (("sql_dekads", SQL_DEKADS), ("sql_report", SQL_REPORT), ("sql_screen", SQL_SCREEN)):
    register(_name)(in_sql(_text))


# ---------------------------------------------------------------- remaining scalar / reshape operators
@register("parse_feature_name")
def q_parse_feature_name(spark, sf):
    """P10: wide names of every season cell parsed back to (param, dekad, rel_year) and base code."""
    names = season(spark, sf).select(C.feature_name("param", "dekad36", "rel_year").alias("feature")).distinct()
    p = C.parse_feature_name("feature")
    return names.select("feature", p["param"].alias("param"), p["dekad"].alias("dekad"),
                        p["rel_year"].alias("rel_year"), C.base_code("feature").alias("base"))


@register("ascii_names")
def q_ascii_names(spark, sf):
    """X3 over whole document texts."""
    d = B.table(spark, sf, "documents")
    return d.select("doc_id", C.ascii_safe("text").alias("safe"))


def daily_wide(spark, sf) -> DataFrame:
    params = [p for p, _ in B.DAILY_PARAMS]
    return B.daily_raw(spark, sf).groupBy("site_id", "date").pivot("param", params).agg(F.max("value"))


@register("melt_params")
def q_melt_params(spark, sf):
    """R2: wide daily maxima melted back to long, only present parameters."""
    params = [p for p, _ in B.DAILY_PARAMS] + ["NOT_A_PARAM"]
    return finalize(climate.melt_params(daily_wide(spark, sf), ["site_id", "date"], params))


@register("pivot_params")
def q_pivot_params(spark, sf):
    """Dekad values with one column per parameter."""
    params = [p for p, _ in B.DAILY_PARAMS]
    return finalize(climate.pivot_params(dekads(spark, sf), params))


@register("pivot_dekads")
def q_pivot_dekads(spark, sf):
    """``<P>_dec<N>`` columns per (site, name, year)."""
    params = [p for p, _ in B.DAILY_PARAMS]
    return finalize(climate.pivot_dekads(climate.collapse_dekads(dekads(spark, sf)), params))


@register("param_rules")
def q_param_rules(spark, sf):
    """The rule chosen per parameter and how many rule families match."""
    p = B.daily_raw(spark, sf).select("param").distinct()
    return p.select("param", climate.rule_of("param").alias("rule"), climate.rule_matches("param").alias("n_rules"))


@register("canonical_panel")
def q_canonical_panel(spark, sf):
    """P7 + P8: renamed production panel with the default region label."""
    d = dpanel(spark, sf).withColumnsRenamed({"planted_ha": "area_planted_ha", "value_brl": "production_value"})
    return finalize(P.order_columns(P.canonicalise(d)))


@register("union_batches")
def q_union_batches(spark, sf):
    """Dekad rows and season rows in one table, columns matched by name."""
    dek = dekads(spark, sf)
    return finalize(climate.union_all([dek, climate.seasons_of(dek)]))


@register("io_panel_csv")
def q_io_panel_csv(spark, sf):
    """K5 → S8: the joined panel as CSV, read back with an explicit schema."""
    path = scratch_path(spark, "panel-csv")
    pg = P.order_columns(P.join_geo(dpanel(spark, sf), B.sites(spark, sf)))
    K.write_panel_csv(pg, path)
    return finalize(R.read_csv(spark, path, pg.schema))
