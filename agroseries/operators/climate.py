"""Climate core: daily → dekad → season, all on long-form DataFrames.

Plan shape (``daily → with_dekad → dekad_aggregate → collapse → pair_seasons``):
one partial+final hash aggregate on the dekad key (map-side combine keeps a
hot site from flooding a reducer), a second small aggregate on the
(site, year, dekad36) key, and a semi-join against the set of valid seasons,
which is bounded by sites × years and broadcast by AQE when it measures small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dekad36, feature_name
from ..schemas import DEKAD_KEY
from ..session import cut_lineage

# --------------------------------------------------------------------------
# fixed values: aggregation rule by parameter name (lower-case substrings),
# in precedence order; anything unmatched is averaged
# --------------------------------------------------------------------------
RULE_SUM, RULE_MEAN, RULE_MAX, RULE_MIN, RULE_RANGE = "sum", "mean", "max", "min", "range"
# season window: year-1 dekads 26..36, year-2 dekads 1..15
WINDOW_Y1 = (26, 36)
WINDOW_Y2 = (1, 15)


RULE_SQL = ("CASE WHEN (lower({p}) LIKE '%prec%' AND lower({p}) NOT LIKE '%prob%') OR lower({p}) LIKE '%count%' "
            "THEN 'sum' WHEN lower({p}) LIKE '%prec%' AND lower({p}) LIKE '%prob%' THEN 'mean' "
            "WHEN lower({p}) LIKE '%max%' THEN 'max' WHEN lower({p}) LIKE '%min%' THEN 'min' "
            "WHEN lower({p}) LIKE '%range%' THEN 'range' ELSE 'mean' END")


def rule_of(param) -> Column:
    """A1 rule for a parameter name.

    precipitation without "prob" → sum; "count" → sum; precipitation with
    "prob" → mean; "max" → max; "min" → min; "range" → max − min; else mean.
    A name matching several rules takes the first (D6).
    """
    if isinstance(param, str):
        return F.expr(RULE_SQL.format(p=f"`{param}`"))
    p = F.lower(param if isinstance(param, Column) else F.col(param))
    has = p.contains
    return (F.when((has("prec") & ~has("prob")) | has("count"), F.lit(RULE_SUM))
             .when(has("prec") & has("prob"), F.lit(RULE_MEAN))
             .when(has("max"), F.lit(RULE_MAX))
             .when(has("min"), F.lit(RULE_MIN))
             .when(has("range"), F.lit(RULE_RANGE))
             .otherwise(F.lit(RULE_MEAN)))


def rule_matches(param) -> Column:
    """Number of rule families a name falls into (D6 check: must be ≤ 1)."""
    p = F.lower(param if isinstance(param, Column) else F.col(param))
    has = p.contains
    fams = [(has("prec") & ~has("prob")) | has("count"), has("prec") & has("prob"),
            has("max"), has("min"), has("range")]
    return sum(f.cast("int") for f in fams)


PARTIAL = ["n", "total", "high", "low"]
DEKAD_COLUMNS = ["site_id", "name", "lat", "lon", "CAST(year AS INT) AS year", "CAST(month AS INT) AS month",
                 "CAST(dekad AS INT) AS dekad", "param", "value"]


def _keyed(daily: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    d = "`date`"
    return (daily.selectExpr("site_id", "name", "lat", "lon", *columns, f"year({d}) AS year", f"month({d}) AS month",
                             f"CASE WHEN dayofmonth({d}) <= 10 THEN 1 WHEN dayofmonth({d}) <= 20 THEN 2 ELSE 3 END AS dekad")
                 .filter(" AND ".join(f"{k} IS NOT NULL" for k in keys)))


def dekad_partials(daily: DataFrame) -> DataFrame:
    """Mergeable parts of A1: per dekad key and parameter the number of values, their
    sum, maximum and minimum (null where there is none).

    Null keys are dropped (T14); NaN is missing (T2).
    """
    keys = DEKAD_KEY + ["param"]
    keyed = _keyed(daily, ["param", "CASE WHEN NOT isnan(value) THEN value END AS value"], keys)
    return keyed.groupBy(*keys).agg(F.expr("count(value) AS n"), F.expr("sum(value) AS total"),
                                    F.expr("max(value) AS high"), F.expr("min(value) AS low"))


def merge_partials(partials: DataFrame) -> DataFrame:
    """Parts of the same key added up; any split of the days gives the same parts."""
    return partials.groupBy(*DEKAD_KEY, "param").agg(F.expr("sum(n) AS n"), F.expr("sum(total) AS total"),
                                                     F.expr("max(high) AS high"), F.expr("min(low) AS low"))


def finish_partials(partials: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """One value per key from its parts, by ``rules`` (default: the fixed ones).

    All-missing groups: the sum rule gives 0, the others give no row (T1).
    """
    if rules is None:
        ruled = partials.withColumn("rule", rule_of("param"))
    else:
        from . import rules as R
        # read for the check, for the rules and for the values: the days are aggregated once
        partials = cut_lineage(partials)
        R.expect_unambiguous(partials, rules)
        ruled = partials.join(R.resolve(partials, rules).select("param", "rule"), "param")
    from .rules import value_of
    value = value_of(F.col("rule"), F.col("n"), F.col("total"), F.col("high"), F.col("low"))
    return ruled.withColumn("value", value).filter("value IS NOT NULL").selectExpr(*DEKAD_COLUMNS)


def dekad_aggregate(daily: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """A1: daily long rows → one value per (site, name, lat, lon, year, month, dekad, param).

    One ``groupBy`` computes count/sum/max/min together; the rule picks one.
    All-missing groups: the sum rule gives 0, the others give no row (T1).
    Null grouping keys are dropped as pandas does (T14).
    """
    return finish_partials(dekad_partials(daily), rules)


def dekad_aggregate_wide(daily: DataFrame, params: list[str], rules: dict[str, str] | None = None) -> DataFrame:
    """A1 for daily rows with one column per parameter, as payloads deliver them.

    The wide rows are aggregated first, each parameter by its own rule only, and the
    dekads are unpivoted after: one row per site and day goes into the hash
    aggregate, not one per parameter.  Equal to ``dekad_aggregate`` of the melted rows.
    """
    rules = rules or {p: default_rule(p) for p in params}
    value = lambda p: f"CASE WHEN NOT isnan(`{p}`) THEN `{p}` END AS `{p}`"
    form = {"sum": "coalesce(sum(`{p}`), 0.0D)", "mean": "avg(`{p}`)", "max": "max(`{p}`)", "min": "min(`{p}`)", "range": "max(`{p}`) - min(`{p}`)"}
    wide = _keyed(daily, [value(p) for p in params], DEKAD_KEY).groupBy(*DEKAD_KEY).agg(*[F.expr(form[rules[p]].format(p=p) + f" AS `{p}`") for p in params])
    return wide.unpivot(DEKAD_KEY, params, "param", "value").filter("value IS NOT NULL").selectExpr(*DEKAD_COLUMNS)


def default_rule(param: str) -> str:
    """The default rule of one parameter's name."""
    import re
    from .rules import DEFAULT_RULES
    return next((rule for pattern, rule, _ in DEFAULT_RULES if re.search(pattern, param.lower())), RULE_MEAN)


def collapse_dekads(dekads: DataFrame) -> DataFrame:
    """A2: mean across duplicates per (site, name, year, param, dekad36)."""
    return (dekads.withColumn("dekad36", dekad36("month", "dekad"))
                  .filter(F.col("site_id").isNotNull() & F.col("name").isNotNull()
                          & F.col("year").isNotNull())
                  .groupBy("site_id", "name", "year", "param", "dekad36")
                  .agg(F.avg("value").alias("value"))
                  .filter(F.col("value").isNotNull()))


def valid_seasons(collapsed: DataFrame) -> DataFrame:
    """(site_id, season_year) where both season_year−1 and season_year have data."""
    sy = collapsed.select("site_id", "year").distinct()
    prev = sy.select("site_id", (F.col("year") + 1).alias("season_year"))
    cur = sy.select("site_id", F.col("year").alias("season_year"))
    return prev.join(cur, ["site_id", "season_year"], "inner")


def pair_seasons(collapsed: DataFrame) -> DataFrame:
    """season = (year−1 as rel_year 1, year as rel_year 2), both years required.

    Each collapsed row is emitted twice (as the first year of the next season
    and the second year of its own), then semi-joined to the valid seasons.
    The first data year of a site is therefore never a season.
    """
    both = F.explode(F.array(
        F.struct((F.col("year") + 1).alias("season_year"), F.lit(1).alias("rel_year")),
        F.struct(F.col("year").alias("season_year"), F.lit(2).alias("rel_year")),
    ))
    rows = (collapsed.select("site_id", "name", "param", "dekad36", "value", both.alias("_p"))
                     .select("site_id", "name", F.col("_p.season_year").cast("int").alias("season_year"),
                             F.col("_p.rel_year").cast("int").alias("rel_year"),
                             F.col("dekad36").cast("int").alias("dekad36"), "param", "value"))
    return rows.join(valid_seasons(collapsed), ["site_id", "season_year"], "left_semi")


def season_table(daily: DataFrame) -> DataFrame:
    """daily → SEASON_OBS (A1 → J6 → A2) with two shuffles and one scan.

    Each dekad row is emitted for its two seasons first; one hash
    repartition on (site_id, season_year) then serves the A2 average (its
    keys contain both columns) and the both-years test (a window on the same
    partitioning), so neither needs another exchange and the input is read
    once.  A group holds at most parameters × 72 rows after A1, so a site
    with a third of the raw rows still spreads over its seasons' partitions.
    Equal to ``pair_seasons(collapse_dekads(dekad_aggregate(daily)))``.
    """
    return seasons_of(dekad_aggregate(daily))


def seasons_of(dekads: DataFrame) -> DataFrame:
    """``season_table`` from dekads that are there already."""
    rows = (dekads
            .selectExpr("site_id", "name", "param", "value", "CAST((month - 1) * 3 + dekad AS INT) AS dekad36",
                        "explode(array(named_struct('season_year', CAST(year + 1 AS INT), 'rel_year', 1), "
                        "named_struct('season_year', CAST(year AS INT), 'rel_year', 2))) AS _p")
            .selectExpr("site_id", "name", "_p.season_year AS season_year", "_p.rel_year AS rel_year",
                        "dekad36", "param", "value"))
    coll = (rows.repartition("site_id", "season_year")
                .groupBy("site_id", "name", "season_year", "rel_year", "param", "dekad36")
                .agg(F.expr("avg(value) AS value")))
    return (coll.selectExpr("*", "min(rel_year) OVER (PARTITION BY site_id, season_year) AS _mn",
                            "max(rel_year) OVER (PARTITION BY site_id, season_year) AS _mx")
                .filter("_mn = 1 AND _mx = 2")
                .select("site_id", "name", "season_year", "rel_year", "dekad36", "param", "value"))


def window_exact(rel="rel_year", dek="dekad36") -> Column:
    if isinstance(rel, str) and isinstance(dek, str):
        return F.expr(f"(`{rel}` = 1 AND `{dek}` BETWEEN {WINDOW_Y1[0]} AND {WINDOW_Y1[1]}) OR "
                      f"(`{rel}` = 2 AND `{dek}` BETWEEN {WINDOW_Y2[0]} AND {WINDOW_Y2[1]})")
    r, d = F.col(rel), F.col(dek)
    return (((r == 1) & d.between(*WINDOW_Y1)) | ((r == 2) & d.between(*WINDOW_Y2)))


def window_substring(rel="rel_year", dek="dekad36") -> Column:
    """The substring form of the window keeps more of year 2: the names of its
    first three dekads are parts of others, and with them every later one."""
    return F.expr(f"(`{rel}` = 1 AND `{dek}` BETWEEN {WINDOW_Y1[0]} AND {WINDOW_Y1[1]}) OR `{rel}` = 2")


def season_window(season: DataFrame, exact: bool = True) -> DataFrame:
    """keep the phenological window (exact) or reproduce the substring test."""
    return season.filter(window_exact() if exact else window_substring())


def union_all(dfs) -> DataFrame:
    """Union of batches whose columns differ (missing columns become NULL)."""
    from functools import reduce
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), list(dfs))


# --- reshapes (export only) ----------------------------------------------------
def melt_params(df: DataFrame, ids, params) -> DataFrame:
    """R2: wide parameters → (ids…, param, value), skipping absent parameters."""
    present = [p for p in params if p in df.columns]
    return df.unpivot(list(ids), present, "param", "value")


def pivot_params(dekads: DataFrame, params) -> DataFrame:
    """One column per parameter for each dekad row (explicit value list)."""
    return dekads.groupBy(*DEKAD_KEY).pivot("param", list(params)).agg(F.first("value"))


def dekad_feature_names(params):
    return [f"{p}_dec{d}" for p in params for d in range(1, 37)]


def pivot_dekads(collapsed: DataFrame, params) -> DataFrame:
    """``<P>_dec<N>`` columns per (site, name, year)."""
    names = dekad_feature_names(params)
    keyed = collapsed.withColumn("_f", F.concat("param", F.lit("_dec"), F.col("dekad36").cast("string")))
    return keyed.groupBy("site_id", "name", "year").pivot("_f", names).agg(F.first("value"))


def season_feature_names(params, exact: bool = True):
    out = []
    for p in params:
        for rel in (1, 2):
            for d in range(1, 37):
                if exact:
                    lo, hi = WINDOW_Y1 if rel == 1 else WINDOW_Y2
                    if not lo <= d <= hi:
                        continue
                out.append(f"{p}_dec{d}_ano{rel}")
    return out


def season_wide(season: DataFrame, params, exact: bool = True) -> DataFrame:
    """``<P>_dec<N>_ano<M>`` columns per (site, season); run after F4."""
    names = season_feature_names(params, exact)
    keyed = season.withColumn("_f", feature_name("param", "dekad36", "rel_year"))
    return (keyed.groupBy("site_id", "name", "season_year")
                 .pivot("_f", names).agg(F.first("value")))
