"""Validation gates in the pass that reads the data: counts of bad rows with a severity, as a report or along with a write."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..schema import ContractError

ERROR, WARNING = "error", "warning"


@dataclass(frozen=True)
class Gate:
    """Rows for which `bad` holds break the gate; a null does not."""

    name: str
    bad: Column
    severity: str = ERROR

    def count(self) -> Column:
        return F.count_if(F.coalesce(self.bad, F.lit(False)))


def _report(totals: DataFrame, severities: dict[str, str]) -> DataFrame:
    """One row of counts -> check, severity, violations, status, in the order of severities."""
    one = lambda n: F.struct(F.lit(n).alias("check"), F.lit(severities[n]).alias("severity"), F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias("violations"))
    rows = totals.select(F.inline(F.array(*map(one, severities))))
    return rows.withColumn("status", F.when(F.col("violations") == 0, "ok").otherwise(F.col("severity")))


@dataclass(frozen=True)
class Side:
    """A table with its key and gates. `unique` adds a gate on repeated keys of that severity, `known` one on keys that the
    other side lacks."""

    name: str
    rows: DataFrame
    keys: tuple[str, ...]
    gates: tuple[Gate, ...] = ()
    unique: str | None = None
    known: str | None = None

    def severities(self) -> dict[str, str]:
        out = {f"{self.name}: {g.name}": g.severity for g in self.gates}
        if self.unique:
            out[f"{self.name}: repeated keys"] = self.unique
        if self.known:
            out[f"{self.name}: unknown keys"] = self.known
        return out

    def per_key(self, names: tuple[str, ...]) -> DataFrame:
        """One row per key with its number of rows and of bad ones, so that all gates, uniqueness and references share a scan."""
        keys = [F.col(k).alias(n) for k, n in zip(self.keys, names)]
        return self.rows.groupBy(*keys).agg(F.count("*").alias("_n"), *[g.count().alias(f"{self.name}: {g.name}") for g in self.gates])

    def totals(self, there: Column, other: Column) -> list[Column]:
        out = [F.sum(F.coalesce(F.col(f"`{self.name}: {g.name}`"), F.lit(0))).alias(f"{self.name}: {g.name}") for g in self.gates]
        if self.unique:
            out.append(F.count_if(there > 1).alias(f"{self.name}: repeated keys"))
        if self.known:
            out.append(F.count_if(there.isNotNull() & other.isNull()).alias(f"{self.name}: unknown keys"))
        return out


def check(side: Side) -> DataFrame:
    """check, severity, violations and status of the gates of one table."""
    names = tuple(f"_k{i}" for i in range(len(side.keys)))
    totals = side.per_key(names).agg(*side.totals(F.col("_n"), F.lit(None).cast("long")))
    return _report(totals, side.severities())


def check_both(left: Side, right: Side) -> DataFrame:
    """The gates of two tables whose keys refer to each other: each is scanned once, grouped by key, and they meet by key. A null key
    refers to nothing and is unknown to the other."""
    names = tuple(f"_k{i}" for i in range(len(left.keys)))
    a = left.per_key(names).withColumnRenamed("_n", "_a")
    b = right.per_key(names).withColumnRenamed("_n", "_b")
    both = a.join(b, list(names), "full_outer")
    totals = both.agg(*left.totals(F.col("_a"), F.col("_b")), *right.totals(F.col("_b"), F.col("_a")))
    return _report(totals, left.severities() | right.severities())


def gated_write(df: DataFrame, path: str, *gates: Gate) -> dict[str, int]:
    """Writes df as Parquet at `path` if no gate of severity error is broken, and returns all counts. The counts are observed by the
    write itself, so data are read once; what fails is deleted and an earlier table at `path` stays."""
    spark = df.sparkSession
    seen = Observation(f"gates-{uuid.uuid4().hex}")
    part = f"{path}.part-{uuid.uuid4().hex}"
    to, tmp = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, part))
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.observe(seen, F.count("*").alias("rows"), *[g.count().alias(g.name) for g in gates]).write.parquet(part)
    counts = {k: int(v) for k, v in seen.get.items()}
    broken = [f"{g.name}: {counts[g.name]} rows" for g in gates if g.severity == ERROR and counts[g.name]]
    if broken:
        fs.delete(tmp, True)
        raise ContractError(f"{path}: " + "; ".join(broken))
    fs.delete(to, True)
    if not fs.rename(tmp, to):
        raise ContractError(f"{part} could not be moved to {path}")
    return counts
