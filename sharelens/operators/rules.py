"""Scores and classes from tables: added terms, cut-offs, and ordered rules. The tables are parameters, SQL expressions over columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_terms(df: DataFrame, terms: dict[str, str], name: str, digits: int = 2) -> DataFrame:
    """Adds `name`: the sum of all terms (a null term counts nothing), rounded once."""
    values = [F.coalesce(F.expr(t).cast("double"), F.lit(0.0)) for t in terms.values()]
    return df.withColumn(name, F.round(reduce(Column.__add__, values), digits))


def classes(df: DataFrame, column: str, cuts: Sequence[tuple[float, str]], otherwise: str, name: str) -> DataFrame:
    """Adds `name`: the class of the first cut-off, highest first, that the column reaches."""
    return first_rule(df, [(f"{column} >= {low}", label) for low, label in sorted(cuts, reverse=True)], (otherwise,), (name,))


def first_rule(df: DataFrame, rules: Sequence[tuple[str, ...]], otherwise: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    """rules: condition, then a value for each of `names`. The first rule whose condition holds (null does not) gives them."""
    value = lambda row: F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)])
    chosen = reduce(lambda rest, rule: F.when(F.expr(rule[0]), value(rule[1:])).otherwise(rest), reversed(rules), value(otherwise))
    return df.withColumn("_rule", chosen).select("*", "_rule.*").drop("_rule")
