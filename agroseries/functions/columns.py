"""Pure ``Column`` builders (no actions, no UDFs).

Each function returns an expression that stays inside whole-stage codegen.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# fixed values (must equal the reference for identical results)
# --------------------------------------------------------------------------
MISSING_SENTINEL = -999.0
CODE_WIDTH = 7
LONE_DASH = r"^\s*-\s*$"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
TITLE = r"[Vv]ariável\s*-\s*(.+)"
UNSAFE = r"[^\w\-]"
# correlation strength thresholds (strictly greater than)
STRONG_R = 0.7
MODERATE_R = 0.4


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def q(name: str) -> str:
    """A column name quoted for a SQL expression string."""
    return "`" + name.replace("`", "``") + "`"


# Expressions over plain column names are composed as one SQL string and parsed
# once on the JVM side (``F.expr``): each Column operator built in Python is a
# separate round trip to the JVM, which dominates plan-building time.


# --- P1 / P2: dekad keys ----------------------------------------------------
def dekad_of_day(day) -> Column:
    """Day of month → dekad 1 (1–10), 2 (11–20), 3 (21–end)."""
    d = _c(day)
    return F.when(d <= 10, F.lit(1)).when(d <= 20, F.lit(2)).otherwise(F.lit(3))


DEKAD_OF_DAY_SQL = "CASE WHEN {d} <= 10 THEN 1 WHEN {d} <= 20 THEN 2 ELSE 3 END"


def with_dekad(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Add ``year``, ``month``, ``dekad`` computed from a DATE column."""
    d = q(date_col)
    return df.selectExpr("*", f"year({d}) AS year", f"month({d}) AS month",
                         DEKAD_OF_DAY_SQL.format(d=f"dayofmonth({d})") + " AS dekad")


def dekad36(month, dekad) -> Column:
    """Position of a dekad in the calendar year, 1..36."""
    if isinstance(month, str) and isinstance(dekad, str):
        return F.expr(f"({q(month)} - 1) * 3 + {q(dekad)}")
    return (_c(month) - 1) * 3 + _c(dekad)


# --- P3 / P4: keys ----------------------------------------------------------
def norm_code(c) -> Column:
    """Trim and left-pad with zeros to 7 characters, never truncating.

    ``lpad`` cuts strings longer than the width, so it is applied only when the
    trimmed code is shorter (T7).
    """
    if isinstance(c, str):
        t = f"trim(CAST({q(c)} AS STRING))"
        return F.expr(f"CASE WHEN length({t}) < {CODE_WIDTH} THEN lpad({t}, {CODE_WIDTH}, '0') ELSE {t} END")
    t = F.trim(_c(c).cast("string"))
    return F.when(F.length(t) < CODE_WIDTH, F.lpad(t, CODE_WIDTH, "0")).otherwise(t)


def code_int(c) -> Column:
    """Integer form of a code (first 7 characters after padding)."""
    return F.substring(norm_code(c), 1, CODE_WIDTH).cast("int")


def cast_year(c) -> Column:
    """P4."""
    return _c(c).cast("int")


# --- P10: feature names -------------------------------------------------------


def feature_name(param, dekad, rel_year) -> Column:
    """Wide-column name ``<P>_dec<N>_ano<M>`` built from long keys."""
    if all(isinstance(x, str) for x in (param, dekad, rel_year)):
        return F.expr(f"concat({q(param)}, '_dec', CAST({q(dekad)} AS STRING), '_ano', CAST({q(rel_year)} AS STRING))")
    return F.concat(_c(param), F.lit("_dec"), _c(dekad).cast("string"),
                    F.lit("_ano"), _c(rel_year).cast("string"))


def base_code(c) -> Column:
    """P10: strip the ``_dec…`` suffix: ``AIRMASS_dec1_ano1`` → ``AIRMASS``."""
    return F.regexp_replace(F.trim(_c(c)), "_dec.*$", "")


def parse_feature_name(c) -> Column:
    """P10: struct(param, dekad, rel_year) from ``<P>_dec<N>_ano<M>``.

    ``param`` is everything before the last ``_dec``; the dekad and year
    numbers are the first ``dec<digits>`` / ``ano<digits>`` occurrences.
    """
    s = _c(c)
    return F.struct(
        F.regexp_extract(s, r"^(.*)_dec", 1).alias("param"),
        F.regexp_extract(s, r"dec(\d+)", 1).cast("int").alias("dekad"),
        F.regexp_extract(s, r"ano(\d+)", 1).cast("int").alias("rel_year"),
    )


# --- X1 / X2: dates -----------------------------------------------------------
def date_from_doy(year, doy) -> Column:
    """YEAR + day-of-year → DATE; day 366 of a common year rolls over (T5)."""
    return F.date_add(F.make_date(_c(year), F.lit(1), F.lit(1)), _c(doy).cast("int") - 1)


def iso_date(c) -> Column:
    """X2."""
    return F.to_date(_c(c), "yyyy-MM-dd")


# --- X3: ASCII-safe names --------------------------------------------------------
@lru_cache(maxsize=1)
def ascii_folds() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """The ASCII part of every character's compatibility decomposition (NFKD):
    characters that become one letter, these letters, and the others."""
    one, letters, more = [], [], []
    for point in range(0x80, 0x110000):
        if 0xD800 <= point < 0xE000:
            continue
        c = chr(point)
        part = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(part) == 1 and point < 0x10000:
            one.append(c)
            letters.append(part)
        elif part:
            more.append((c, part))
    return "".join(one), "".join(letters), tuple(more)


def ascii_safe(c) -> Column:
    """NFKD, drop what is not ASCII, other non-word characters → ``_``."""
    one, letters, more = ascii_folds()
    folded = F.translate(_c(c), one, letters)

    def spelled(text, pairs):
        # one literal; a call to the JVM for each pair would take seconds
        steps = F.from_json(F.lit(json.dumps([{"a": a, "b": b} for a, b in pairs])), "array<struct<a:string,b:string>>")
        return F.aggregate(steps, text, lambda t, p: F.replace(t, p["a"], p["b"]))

    # few texts hold a character that becomes several letters: one pass finds them
    near = [x for x in more if ord(x[0]) < 0x10000]
    found = F.length(F.translate(folded, "".join(a for a, _ in near), "")) < F.length(folded)
    full = F.when(found, spelled(folded, near)).otherwise(folded)
    full = F.when(folded.rlike(r"[\x{10000}-\x{10FFFF}]"), spelled(full, [x for x in more if ord(x[0]) >= 0x10000])).otherwise(full)
    full = F.when(_c(c).rlike(r"[^\x00-\x7F]"), F.regexp_replace(full, r"[^\x00-\x7F]", "")).otherwise(_c(c))
    return F.regexp_replace(full, UNSAFE, "_")


# --- X4 / X5 / X6: cleaning ------------------------------------------------------
def sentinel_null(c, sentinel: float = MISSING_SENTINEL) -> Column:
    """X4 + T2: the sentinel and NaN both become NULL."""
    if isinstance(c, str):
        v = f"CAST({q(c)} AS DOUBLE)"
        return F.expr(f"CASE WHEN {v} IS NULL OR isnan({v}) OR {v} = {sentinel!r} THEN CAST(NULL AS DOUBLE) ELSE {v} END")
    v = _c(c).cast("double")
    return F.when(v.isNull() | F.isnan(v) | (v == F.lit(sentinel)), F.lit(None).cast("double")).otherwise(v)


def clean_number(c, missing_as_zero: bool = True) -> Column:
    """A lone dash → 0; anything that is no plain number (``..``, ``NaN``,
    ``1d``, text) → NULL → 0."""
    s = _c(c).cast("string")
    num = F.when(s.rlike(LONE_DASH), F.lit(0.0)).when(s.rlike(NUMBER), F.trim(s).try_cast("double"))
    return F.coalesce(num, F.lit(0.0)) if missing_as_zero else num


def variable_from_title(c) -> Column:
    """Text after ``Variável -`` in a sheet title; the raw text if absent."""
    t = F.trim(_c(c))
    got = F.trim(F.regexp_extract(t, TITLE, 1))
    return F.when(got == "", t).otherwise(got)


# --- X9 / X10 / X11 ---------------------------------------------------------------
def corr_strength(r) -> Column:
    """|r| > 0.7 strong, > 0.4 moderate, else weak."""
    a = F.abs(_c(r))
    return (F.when(a > STRONG_R, F.lit("strong"))
            .when(a > MODERATE_R, F.lit("moderate"))
            .otherwise(F.lit("weak")))


def corr_direction(r) -> Column:
    """R > 0 positive, else negative."""
    return F.when(_c(r) > 0, F.lit("positive")).otherwise(F.lit("negative"))


def corr_sentence(r, feature_label, metric_name) -> Column:
    """Interpretation sentence."""
    verb = F.when(_c(r) > 0, F.lit("an increase")).otherwise(F.lit("a decrease"))
    return F.concat(F.lit("An increase of "), _c(feature_label), F.lit(" is associated with "),
                    verb, F.lit(" of "), short_metric(metric_name), F.lit("."))


def short_metric(c) -> Column:
    """Text before the first ``(``, trimmed."""
    return F.trim(F.split(_c(c), r"\(").getItem(0))


# --- T3 / T4: guarded statistics -----------------------------------------------
def safe_div(a, b) -> Column:
    """T4: x/0 → NULL under ANSI, no exception."""
    return F.try_divide(_c(a), _c(b))


def pair_count(x, y) -> Column:
    """Number of rows where both sides are present (pairwise complete)."""
    if isinstance(x, str) and isinstance(y, str):
        return F.expr(f"count(CASE WHEN {q(x)} IS NOT NULL AND {q(y)} IS NOT NULL THEN 1 END)")
    return F.count(F.when(_c(x).isNotNull() & _c(y).isNotNull(), F.lit(1)))


def pearson(x, y) -> Column:
    """Pairwise-complete Pearson r; NULL when either side is constant.

    ``corr`` raises DIVIDE_BY_ZERO on a constant column under ANSI, so the
    coefficient is assembled from population moments over complete pairs.
    All parts are algebraic aggregates: partial aggregation happens map-side.
    """
    if isinstance(x, str) and isinstance(y, str):
        xs = f"CASE WHEN {q(y)} IS NOT NULL THEN {q(x)} END"
        ys = f"CASE WHEN {q(x)} IS NOT NULL THEN {q(y)} END"
        return F.expr(f"try_divide(covar_pop({xs}, {ys}), stddev_pop({xs}) * stddev_pop({ys}))")
    xs = F.when(_c(y).isNotNull(), _c(x))
    ys = F.when(_c(x).isNotNull(), _c(y))
    return F.try_divide(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys))
