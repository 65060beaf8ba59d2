"""Production statistics: crosstab → long, variable combination, yearly KPIs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cast_year, clean_number
from ..functions.formatting import br_sql, scaled_sql, sql_str

MOST_CELLS = 62  # years times variables that ``combine_variables`` aggregates side by side
MEASURE_COLS = ["planted_ha", "harvested_ha", "lost_ha", "produced_kg", "value_brl"]


def unpivot_years(crosstab: DataFrame, years, id_cols=("code", "name"),
                  value_name: str = "raw") -> DataFrame:
    """One row per (code, name, year); only year columns that exist.

    Rows without a name (footers) are dropped first (F8).  Blank cells stay as
    NULL rows, as a melt keeps them.
    """
    present = [str(y) for y in years if str(y) in crosstab.columns]
    if not present:
        raise ValueError("the sheet has no column of the wanted years")
    df = crosstab.filter(F.col(id_cols[1]).isNotNull())
    return (df.unpivot(list(id_cols), present, "year", value_name)
              .withColumn("year", cast_year("year")))


def combine_variables(longs: list[tuple[str, DataFrame]], sort: bool = True,
                      missing_as_zero: bool = True) -> DataFrame:
    """Outer combination of per-variable long tables on (code, name, year).

    Not N outer joins: the variables are unioned long and pivoted once with
    an explicit value list (one shuffle on the key).  Cells are cleaned after
    the combination, so combinations missing from a variable become 0 (D5).

    The different years are found first.  Each becomes a column per variable, so that the
    rows of a (code, name) meet in the task that reads them and one row is shuffled, not
    one per year; beyond ``MOST_CELLS`` columns rows are grouped by the year too.
    """
    names = [n for n, _ in longs]
    # cells are cleaned before combining; cells of a repeated key add up, so
    # none is lost; DOUBLE buffers keep the aggregate a fixed-width hash aggregate
    union = reduce(DataFrame.unionByName,
                   [df.select("code", "name", "year", F.lit(n).alias("variable"),
                              clean_number(F.col("raw").cast("string"), False).alias("v"))
                    for n, df in longs])
    years = [r["year"] for r in union.select("year").distinct().limit(MOST_CELLS + 1).collect()]
    if len(years) * len(names) <= MOST_CELLS:
        long = combine_years(union, names, years)
        if missing_as_zero:
            long = long.select("code", "name", "year", *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in names])
        return long.orderBy("code", "name", "year") if sort else long
    # conditional aggregation: one partial+final aggregate (``pivot`` plans two)
    wide = union.groupBy("code", "name", "year").agg(
        *[F.sum(F.when(F.col("variable") == n, F.col("v"))).alias(n) for n in names])
    if missing_as_zero:
        wide = wide.select("code", "name", "year", *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in names])
    return wide.orderBy("code", "name", "year") if sort else wide


def combine_years(union: DataFrame, names: list[str], years: list) -> DataFrame:
    """``union`` (code, name, year, variable, v), which has no other ``years`` → code, name,
    year and a sum per variable, for the keys that occur."""
    kind = union.schema["year"].dataType
    is_year = lambda y: F.col("year").eqNullSafe(F.lit(y).cast(kind))
    # a bit for each year that a (code, name) has, with or without a value
    bits = reduce(lambda c, x: c.when(is_year(x[1]), F.lit(1 << x[0]).cast("long")), enumerate(years), F.when(F.lit(False), F.lit(0).cast("long")))
    cells = [F.sum(F.when(is_year(y) & (F.col("variable") == n), F.col("v"))).alias(f"_{i}_{j}") for i, y in enumerate(years) for j, n in enumerate(names)]
    wide = union.groupBy("code", "name").agg(F.bit_or(bits).alias("_years"), *cells)
    keys = [F.struct((F.col("_years").bitwiseAND(F.lit(1 << i).cast("long")) != 0).alias("_keep"), F.lit(y).cast(kind).alias("year"), *[F.col(f"_{i}_{j}").alias(n) for j, n in enumerate(names)])
            for i, y in enumerate(years)]
    if not keys:
        return union.select("code", "name", "year", *[F.col("v").alias(n) for n in names])  # no rows
    return (wide.select("code", "name", F.explode(F.array(*keys)).alias("_y")).where("_y._keep")
                .select("code", "name", "_y.year", *[F.col("_y")[n].alias(n) for n in names]))


def combine_crosstabs(wides: list[tuple[str, DataFrame]], years, sort: bool = False,
                      missing_as_zero: bool = True) -> DataFrame:
    """J3 for crosstab inputs: combine the sheets on (code, name), then melt.

    Equal to ``combine_variables`` over the melted sheets (a melt emits every
    year column of its sheet, so the outer key sets agree), with one shuffle that
    carries a row per (code, name) and sheet instead of one per year.  Year columns
    a sheet lacks become NULL → 0 like combinations missing from a variable; cells
    of a repeated key add up.
    """
    ys = [str(y) for y in years]
    has_year = {n: {y for y in ys if y in w.columns} for n, w in wides}
    present = [y for y in ys if any(y in s for s in has_year.values())]
    if not present:
        raise ValueError("no sheet has a column of the wanted years")
    # one union, one aggregate: a row keeps its sheet's number and its cells.
    # Grouping lets NULL codes meet, which a join would not
    rows = reduce(DataFrame.unionByName, [
        w.filter(F.col("name").isNotNull()).select(
            "code", "name", F.lit(i).alias("_sheet"),
            *[(clean_number(F.col(f"`{y}`"), False) if y in has_year[n] else F.lit(None).cast("double")).alias(y) for y in present])
        for i, (n, w) in enumerate(wides)])
    sheet = F.col("_sheet")
    cells = [F.sum(F.when(sheet == i, F.col(f"`{y}`"))).alias(f"{n}@{y}")
             for i, (n, _) in enumerate(wides) for y in present if y in has_year[n]]
    wide = rows.groupBy("code", "name").agg(*[F.max(sheet == i).alias(f"_in{i}") for i in range(len(wides))], *cells)
    structs = []
    for y in present:
        # the melted key (code, name, y) exists iff a sheet with column y has the row
        keep = reduce(lambda a, b: a | b, [F.col(f"_in{i}") for i, (n, _) in enumerate(wides) if y in has_year[n]])
        fields = [F.lit(int(y)).alias("year"), keep.alias("_keep")]
        for n, _ in wides:
            v = F.col(f"`{n}@{y}`") if y in has_year[n] else F.lit(None).cast("double")
            fields.append((F.coalesce(v, F.lit(0.0)) if missing_as_zero else v).alias(n))
        structs.append(F.struct(*fields))
    out = (wide.select("code", "name", F.explode(F.array(*structs)).alias("_y"))
               .filter(F.col("_y._keep")).select("code", "name", "_y.year", *[f"_y.{n}" for n, _ in wides]))
    return out.orderBy("code", "name", "year") if sort else out


def with_loss(df: DataFrame) -> DataFrame:
    """P5: lost area and loss % (0 when planted ≤ 0)."""
    return df.selectExpr("*", "planted_ha - harvested_ha AS lost_ha",
                         "CASE WHEN planted_ha > 0 THEN (planted_ha - harvested_ha) / planted_ha * 100 ELSE 0.0D END AS loss_pct")


# fixed values: unit conversion factors (t → kg, thousand currency → currency)
UNIT_SPEC = {"produced_kg": ("produced_t", 1000.0), "value_brl": ("value_kbrl", 1000.0)}


def convert_units(df: DataFrame, spec: dict = UNIT_SPEC) -> DataFrame:
    """Scaled copies of measures; the source columns are dropped."""
    drop = {src for src, _ in spec.values()}
    keep = [f"`{c}`" for c in df.columns if c not in drop]
    return df.selectExpr(*keep, *[f"`{src}` * {float(f)!r}D AS `{new}`" for new, (src, f) in spec.items()])


def dashboard_panel(production: DataFrame) -> DataFrame:
    """Production with the derived columns the analysis reads (P5 + P6)."""
    return convert_units(with_loss(production))


def yearly_totals(panel: DataFrame, measures=MEASURE_COLS) -> DataFrame:
    """A3: sums per year (an all-missing sum is 0, as pandas), chronological."""
    return (panel.groupBy("year")
                 .agg(*[F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in measures])
                 .orderBy("year"))


def weighted_metrics(totals: DataFrame) -> DataFrame:
    """A4: yield = Σproduction / Σharvested; loss % over the totals."""
    return totals.selectExpr("*", "try_divide(produced_kg, harvested_ha) AS yield_kg_ha",
                             "CASE WHEN planted_ha > 0 THEN lost_ha / planted_ha * 100 ELSE 0.0D END AS loss_pct")


def kpi_summary(panel: DataFrame, measures=MEASURE_COLS) -> DataFrame:
    """A5: per-year and consolidated KPIs in one pass (``rollup('year')``).

    The consolidated row has ``year`` NULL; ratios use the sums and are
    missing when the denominator is ≤ 0.
    """
    agg = panel.rollup("year").agg(F.grouping("year").alias("_total"), *[F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in measures])
    return agg.withColumns({
        "yield_kg_ha": F.when(F.col("harvested_ha") > 0, F.col("produced_kg") / F.col("harvested_ha")),
        "loss_pct": F.when(F.col("planted_ha") > 0, F.col("lost_ha") / F.col("planted_ha") * 100),
        "is_total": F.col("_total") == 1,  # a missing year is a group of its own
    }).drop("_total")


# Which measures are compared, the unit of the absolute fallback, and
# whether a zero base shows "∞ %" instead of an absolute change
DELTA_SPEC = [
    ("planted_ha", " ha", False),
    ("lost_ha", " ha", True),
    ("produced_kg", " kg", False),
    ("yield_kg_ha", " kg/ha", False),
]


def kpi_delta(totals: DataFrame) -> DataFrame:
    """Last year vs first year of the weighted yearly totals.

    One row per measure: first/last year and value, the delta kind and the
    formatted delta (pt-BR).  ``loss_pct`` compares in percentage points.
    No row when only one year is present.
    """
    w = weighted_metrics(totals)
    cells = [f"named_struct('measure', '{m}', 'v', CAST({m} AS DOUBLE), 'unit', {sql_str(unit)}, "
             f"'always_pct', {str(always_pct).lower()}, 'pp', false)" for m, unit, always_pct in DELTA_SPEC]
    cells.append("named_struct('measure', 'loss_pct', 'v', CAST(loss_pct AS DOUBLE), 'unit', '', "
                 "'always_pct', false, 'pp', true)")
    long = w.selectExpr("year", f"explode(array({', '.join(cells)})) AS m").selectExpr("year", "m.*")
    g = (long.groupBy("measure", "unit", "always_pct", "pp")
             .agg(F.expr("min(year) AS first_year"), F.expr("max(year) AS last_year"),
                  F.expr("min_by(v, year) AS first_value"), F.expr("max_by(v, year) AS last_value"),
                  F.expr("count(DISTINCT year) AS n_years"))
             .filter("n_years > 1"))
    d = g.selectExpr("*", "last_value - first_value AS diff",
                     "try_divide(last_value - first_value, abs(first_value)) * 100 AS pct",
                     "CASE WHEN pp THEN 'pp' WHEN first_value IS NULL OR last_value IS NULL THEN 'none' "
                     "WHEN first_value = 0 AND last_value = 0 THEN 'zero' "
                     "WHEN first_value = 0 AND always_pct THEN 'inf' WHEN first_value = 0 THEN 'abs' "
                     "ELSE 'pct' END AS delta_kind")
    sign_diff = "CASE WHEN diff > 0 THEN '+ ' ELSE '' END"
    sign_pct = "CASE WHEN pct > 0 THEN '+ ' ELSE '' END"
    text = ("CASE delta_kind "
            f"WHEN 'pp' THEN CASE WHEN first_value IS NULL THEN NULL ELSE {br_sql('diff', 2, sign_diff, chr(39) + ' pp' + chr(39))} END "
            "WHEN 'zero' THEN '= 0' WHEN 'inf' THEN '∞ %' "
            f"WHEN 'abs' THEN {scaled_sql('diff', sign_diff, 'unit')} "
            f"WHEN 'pct' THEN {br_sql('pct', 2, sign_pct, chr(39) + ' %' + chr(39))} END")
    return d.selectExpr("measure", "first_year", "last_year", "first_value", "last_value", "delta_kind",
                        "CASE WHEN delta_kind IN ('pp', 'abs') THEN diff WHEN delta_kind = 'pct' THEN pct END AS delta_value",
                        f"{text} AS delta_text")


def period_label(panel: DataFrame) -> DataFrame:
    """``first–last`` when the selected years are contiguous, else a list.

    The list is built from the distinct years (bounded by the calendar).
    """
    years = panel.select("year").distinct()
    return years.agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.count("year").alias("n_years"),
        F.array_join(F.array_sort(F.collect_list(F.col("year").cast("string"))), ", ").alias("_list"),
    ).select("first_year", "last_year", "n_years",
             (F.col("last_year") - F.col("first_year") + 1 == F.col("n_years")).alias("contiguous"),
             F.when(F.col("n_years") == 1, F.col("first_year").cast("string"))
              .when(F.col("last_year") - F.col("first_year") + 1 == F.col("n_years"),
                    F.concat(F.col("first_year").cast("string"), F.lit("–"), F.col("last_year").cast("string")))
              .otherwise(F.col("_list")).alias("period_label"))
