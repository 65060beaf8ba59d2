"""Site-level feature table for mining.

Long form throughout: (site_id, feature index, value).  The site × feature
grid needed for imputation is generated per site with ``explode(sequence)``
(no cross join); its size is sites × features, both bounded (municipalities,
parameters × dekads).  Only per-feature statistics (bounded by the schema) and
the four quartile edges are brought to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import feature_name
from ..session import cut_lineage
from .ranges import quantiles
from .broadcast import bounded

FEATURE_KEY = ["param", "rel_year", "dekad36"]
COVERAGE = 0.70


class DuplicateEdgesError(ValueError):
    pass


def feature_index(season: DataFrame) -> DataFrame:
    """The feature list (param, rel_year, dekad36) with a dense 0-based index.

    Bounded by parameters × 72; the ordering window runs over that list only.
    Coordinates are never features (the long table has no lat/lon rows).
    """
    feats = season.select(*FEATURE_KEY).distinct()
    w = Window.orderBy(*FEATURE_KEY)
    return (feats.withColumn("idx", (F.row_number().over(w) - 1).cast("int"))
                 .withColumn("feature", feature_name("param", "dekad36", "rel_year")))


def site_feature_means(season: DataFrame, panel: DataFrame) -> DataFrame:
    """A8 for climate: mean of each feature per site over the panel's site-years."""
    sy = panel.select("site_id", F.col("year").alias("season_year")).distinct()
    s = season.join(sy, ["site_id", "season_year"], "left_semi")
    return (s.groupBy("site_id", *FEATURE_KEY).agg(F.avg("value").alias("value"))
             .filter(F.col("value").isNotNull()))


def site_targets(panel: DataFrame, metric: str) -> DataFrame:
    """Per-site mean target and coordinates (the reference keeps the first; sites have one)."""
    cols = [F.avg(metric).alias("target")]
    for c in ("lat", "lon"):
        if c in panel.columns:
            cols.append(F.max(c).alias(c))
    return panel.groupBy("site_id").agg(*cols)


def filter_coverage(means: DataFrame, sites: DataFrame, n_features: int,
                    threshold: float = COVERAGE) -> DataFrame:
    """keep sites whose share of present features is ≥ ``threshold``."""
    cov = means.groupBy("site_id").agg(F.count(F.lit(1)).alias("_n"))
    out = sites.join(cov, "site_id", "left").withColumn(
        "coverage", F.coalesce(F.col("_n"), F.lit(0)) / F.lit(float(n_features)))
    return out.filter(F.col("coverage") >= threshold).drop("_n")


def impute_median(means: DataFrame, kept: DataFrame, feats: DataFrame) -> DataFrame:
    """M6: exact per-feature median over kept sites fills missing site-features.

    Returns (site_id, idx, param, rel_year, dekad36, value, imputed).
    """
    n = feats.count()
    m = means.join(kept.select("site_id"), "site_id", "left_semi")
    # counted values in ranges: no task buffers a feature's values, whatever their number
    med = quantiles(m, FEATURE_KEY, "value", [0.5]).select(*FEATURE_KEY, F.col("q")[0].alias("_median"))
    fb = bounded(feats.join(med, FEATURE_KEY, "left"))  # one row per feature
    spine = kept.select("site_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("idx"))
    grid = spine.join(fb, "idx").join(m, ["site_id", *FEATURE_KEY], "left")
    return grid.select("site_id", "idx", *FEATURE_KEY,
                       F.coalesce("value", "_median").alias("value"),
                       F.col("value").isNull().alias("imputed"))


def standardise(long: DataFrame, col: str = "value") -> DataFrame:
    """M8: z = (x − mean) / population std per feature; constant feature → 0."""
    st = long.groupBy("idx").agg(F.avg(col).alias("_mu"), F.stddev_pop(col).alias("_sd"))
    out = long.join(bounded(st), "idx")  # one row per feature
    z = F.when(F.col("_sd") == 0, F.lit(0.0)).otherwise((F.col(col) - F.col("_mu")) / F.col("_sd"))
    return out.withColumn("z", z).drop("_mu", "_sd")


def quartile_edges(df: DataFrame, col: str, q: int = 4) -> list[float]:
    """Exact, linearly interpolated quantile edges (0, 1/q, …, 1); duplicates raise."""
    probs = [i / q for i in range(q + 1)]
    row = quantiles(df.withColumn("_one", F.lit(1)), ["_one"], col, probs).first()
    edges = list(row["q"]) if row else []
    if len(set(edges)) < len(edges):
        raise DuplicateEdgesError(f"quantile edges are not unique: {edges}")
    return edges


def class_of(col: str, edges: list[float]):
    """Right-closed bins, lowest edge included: (e0,e1] → 0 … (e3,e4] → 3."""
    c = F.col(col)
    expr = None
    for i in range(1, len(edges)):
        cond = c <= F.lit(edges[i])
        expr = F.when(cond, F.lit(i - 1)) if expr is None else expr.when(cond, F.lit(i - 1))
    # values above the top edge cannot occur (it is the maximum)
    return F.when(c.isNull(), F.lit(None)).otherwise(expr.otherwise(F.lit(len(edges) - 2)))


def quantile_classes(df: DataFrame, col: str, out: str = "y_true", q: int = 4) -> DataFrame:
    """M7: quartile class 0..q−1 of ``col`` (pandas ``qcut`` semantics)."""
    edges = quartile_edges(df, col, q)
    return df.withColumn(out, class_of(col, edges).cast("int"))


def site_feature_table(season: DataFrame, panel: DataFrame, metric: str,
                       threshold: float = COVERAGE):
    """Full chain: means → coverage → median imputation → standardisation → classes.

    Returns (long, sites): long = (site_id, idx, param, rel_year, dekad36,
    value, imputed, z); sites = (site_id, target, lat, lon, coverage, y_true).
    """
    # site × feature means are bounded (sites × features) and feed several
    # aggregates: cut the lineage once into the shared checkpoint folder
    means = cut_lineage(site_feature_means(season, panel))
    feats = feature_index(means)
    n = feats.count()
    kept = cut_lineage(filter_coverage(means, site_targets(panel, metric), n, threshold))
    long = standardise(impute_median(means, kept, feats))
    sites = quantile_classes(kept, "target")
    return long, sites


def site_vectors(long: DataFrame, col: str = "z") -> DataFrame:
    """(site_id, features VECTOR) ordered by feature index.

    Each site's group holds exactly one value per feature: the group size is
    the (schema-bounded) feature count, never the data size.
    """
    from pyspark.ml.functions import array_to_vector
    arr = F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col(col).alias("v")))), lambda s: s["v"])
    return long.groupBy("site_id").agg(array_to_vector(arr).alias("features"))
