"""pt-BR number formatting as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: scale ladder (threshold, divisor, suffix) for X8
SCALE_LADDER = [(1e9, 1e9, " bi"), (1e6, 1e6, " mi"), (1e4, 1e3, " mil")]
MISSING_TEXT = "-"


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x)


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def br_digits(x, decimals: int) -> Column:
    """``1234.5`` → ``1.234,50``: thousands with dots, decimal comma."""
    return F.translate(F.format_number(_c(x), decimals), ",.", ".,")


def format_br(x, decimals: int = 0, prefix="", suffix="") -> Column:
    """Prefix + pt-BR digits + suffix, trimmed; missing → ``-``."""
    v = _c(x)
    s = F.trim(F.concat(_lit(prefix), br_digits(v, decimals), _lit(suffix)))
    return F.when(v.isNull() | F.isnan(v), F.lit(MISSING_TEXT)).otherwise(s)


def format_scaled(x, prefix="", suffix="") -> Column:
    """``bi`` / ``mi`` / ``mil`` at 1e9 / 1e6 / 1e4 with a ``- `` sign prefix.

    Below 1e4 the signed value is written with no decimals after the sign
    prefix, as the reference does.
    """
    v = _c(x)
    a = F.abs(v)
    sign = F.when(v < 0, F.lit("- ")).otherwise(F.lit(""))
    out = format_br(v, 0, F.concat(sign, _lit(prefix)), suffix)
    for threshold, divisor, unit in reversed(SCALE_LADDER):
        scaled = F.trim(F.concat(sign, _lit(prefix), br_digits(a / divisor, 2), F.lit(unit), _lit(suffix)))
        out = F.when(a >= threshold, scaled).otherwise(out)
    return F.when(v.isNull() | F.isnan(v), F.lit(MISSING_TEXT)).otherwise(out)


# --- the same formats as Spark SQL text (one JVM parse per expression) ---------
def sql_str(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def br_sql(x: str, decimals: int = 0, prefix: str = "''", suffix: str = "''") -> str:
    """X7 as SQL: ``x``/``prefix``/``suffix`` are SQL expressions."""
    digits = f"translate(format_number({x}, {int(decimals)}), ',.', '.,')"
    return f"(CASE WHEN {x} IS NULL OR isnan({x}) THEN '{MISSING_TEXT}' ELSE trim(concat({prefix}, {digits}, {suffix})) END)"


def scaled_sql(x: str, prefix: str = "''", suffix: str = "''") -> str:
    """X8 as SQL."""
    sign = f"(CASE WHEN {x} < 0 THEN '- ' ELSE '' END)"
    a = f"abs({x})"
    out = br_sql(x, 0, f"concat({sign}, {prefix})", suffix)
    for threshold, divisor, unit in reversed(SCALE_LADDER):
        digits = f"translate(format_number({a} / {divisor!r}D, 2), ',.', '.,')"
        scaled = f"trim(concat({sign}, {prefix}, {digits}, '{unit}', {suffix}))"
        out = f"CASE WHEN {a} >= {threshold!r}D THEN {scaled} ELSE {out} END"
    return f"(CASE WHEN {x} IS NULL OR isnan({x}) THEN '{MISSING_TEXT}' ELSE {out} END)"
