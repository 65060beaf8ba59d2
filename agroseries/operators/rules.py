"""Aggregation rules as data: which statistic stands for a parameter's ten days.

A rule table has ``pattern`` (a regular expression on the lower-case name), ``rule``
(sum, mean, max, min, range) and ``precedence`` (least first).  It is matched against
each *different* parameter once and joined to the aggregates by name, so a rule costs
nothing per observation.  A name that several rules want is reported, not guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = ("sum", "mean", "max", "min", "range")
MOST_RULES = 1_000
RULE_SCHEMA = "pattern string, rule string, precedence int"

# --------------------------------------------------------------------------
# fixed values: the default rules; a name that none of them takes is averaged
# --------------------------------------------------------------------------
DEFAULT_RULES = [
    (r"^(?!.*prob).*prec|count", "sum", 1),
    (r"^(?=.*prob).*prec", "mean", 2),
    (r"max", "max", 3),
    (r"min", "min", 4),
    (r"range", "range", 5),
]


class RuleError(ValueError):
    pass


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_RULES, RULE_SCHEMA)


def resolve(params: DataFrame, rules: DataFrame, param: str = "param") -> DataFrame:
    """(param, rule, n_rules, candidates) of every different parameter: the matching
    rule of least precedence, ``mean`` where none matches; ``n_rules`` counts the
    different rules that match, ``candidates`` lists them by precedence.

    The rule table is a setting of at most ``MOST_RULES`` rows (checked); its rows
    become one literal, so matching is a projection over the parameters.
    """
    rows = rules.select("pattern", "rule", "precedence").orderBy("precedence", "pattern", "rule").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise RuleError(f"more than {MOST_RULES} rules")
    unknown = sorted({str(r["rule"]) for r in rows} - set(RULES))
    if unknown:
        raise RuleError(f"unknown rules {unknown}; known: {list(RULES)}")
    if any(r["pattern"] is None or r["precedence"] is None for r in rows):
        raise RuleError("a rule needs a pattern and a precedence")
    import json
    table = F.from_json(F.lit(json.dumps([{"pattern": r["pattern"], "rule": r["rule"]} for r in rows])), "array<struct<pattern:string,rule:string>>")
    names = params.where(F.col(param).isNotNull()).select(F.col(param).alias("param")).distinct()
    # a filter on what is found would be pushed below ``distinct`` to every row; it is not pushed below a generator
    names = names.select(F.explode(F.array("param")).alias("param"))
    fits = F.filter(table, lambda r: F.rlike(F.lower("param"), r["pattern"]))
    found = names.select("param", F.array_distinct(F.transform(fits, lambda r: r["rule"])).alias("candidates"))
    return found.select("param", F.coalesce(F.get("candidates", F.lit(0)), F.lit("mean")).alias("rule"), F.size("candidates").alias("n_rules"), "candidates")


def conflicts(params: DataFrame, rules: DataFrame, param: str = "param") -> DataFrame:
    """The parameters that rules disagree about."""
    return resolve(params, rules, param).where("n_rules > 1")


def expect_unambiguous(params: DataFrame, rules: DataFrame, param: str = "param", sample: int = 5) -> None:
    """Raise when rules disagree about a parameter."""
    bad = conflicts(params, rules, param).orderBy("param").limit(sample).collect()
    if bad:
        raise RuleError("rules disagree: " + ", ".join(f"{r['param']} ({'/'.join(r['candidates'])})" for r in bad))


def value_of(rule: Column, n: Column, total: Column, high: Column, low: Column) -> Column:
    """The statistic that a rule takes from mergeable parts; a sum of nothing is 0."""
    return (F.when(rule == "sum", F.coalesce(total, F.lit(0.0))).when(rule == "max", high).when(rule == "min", low)
             .when(rule == "range", high - low).otherwise(F.try_divide(total, n)))
