"""Input contracts: driver-side column checks and constraint checks that return their violations as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

# The columns of the ranking lists.
RANKING_RAW = StructType([StructField("id", IntegerType())] + [StructField(n, StringType()) for n in ("title", "acronym", "source", "rank", "dblp_flag", "for1", "for2", "for3")])


class ContractError(ValueError):
    """An input breaks its contract."""


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    if missing := sorted(set(names) - set(df.columns)):
        raise ContractError(f"missing columns: {missing}")
    return df


def alias_columns(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Adds each column that is absent from the first alias that is there."""
    for name, others in aliases.items():
        found = next((o for o in others if o in df.columns), None)
        if name not in df.columns and found:
            df = df.withColumn(name, F.col(found))
    return df


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    if examples := duplicates(df, *keys).limit(10).collect():
        raise ContractError(f"{keys} repeat: {[tuple(r) for r in examples]}")
    return df


def missing_keys(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Keys of left that right lacks."""
    return left.select(*on).distinct().join(right.select(*on).distinct(), on, "left_anti")


def mismatches(left: DataFrame, right: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Rows whose columns differ from the dimension's; null equals null."""
    r = right.select(*on, *[F.col(c).alias(f"_r_{c}") for c in columns])
    differs = None
    for c in columns:
        d = ~F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        differs = d if differs is None else differs | d
    return left.join(r, on).where(differs).drop(*[f"_r_{c}" for c in columns])


def require_cardinality(df: DataFrame, column: str, want: dict) -> DataFrame:
    """Each value of the column must be there as often as `want` says, and no other; the first differences are named."""
    expected = df.sparkSession.createDataFrame([(k, v) for k, v in want.items()], f"`{column}` {df.schema[column].dataType.simpleString()}, wanted long")
    if wrong := cardinality_differences(df, column, expected).limit(10).collect():
        raise ContractError(f"{column}: {[tuple(r) for r in wrong]} (value, rows, wanted)")
    return df


def cardinality_differences(df: DataFrame, column: str, expected: DataFrame) -> DataFrame:
    """Values whose rows differ from the expected (column, wanted): value, rows, wanted, absent ones as 0."""
    e = expected.select(F.col(column).alias("_value"), "wanted")
    both = df.groupBy(column).agg(F.count("*").alias("rows")).join(e, F.col(column).eqNullSafe(F.col("_value")), "full")
    both = both.select(F.coalesce(column, "_value").alias(column), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("wanted", F.lit(0)).alias("wanted"))
    return both.where("rows <> wanted")


def out_of_range(df: DataFrame, column: Column, low: int, high: int) -> DataFrame:
    """Rows whose value isn't an integer in low..high."""
    number = column.cast("string").try_cast("int")
    return df.where(number.isNull() | ~number.between(low, high))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))
