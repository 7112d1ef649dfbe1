"""Gates along with reads and writes, and the bucketed cache."""

import os

import pytest
from pyspark.sql import functions as F

from sharelens.operators import gates
from sharelens.schema import ContractError
from sharelens.sources import cache


def test_reports(spark):
    a = spark.createDataFrame([(1, 5), (1, None), (2, -1), (3, 0), (None, 7)], "k int, x int")
    b = spark.createDataFrame([(1, "u"), (4, "v"), (4, "v"), (None, "w")], "id int, y string")
    left = gates.Side("a", a, ("k",), (gates.Gate("negative", F.col("x") < 0), gates.Gate("zero", F.col("x") == 0, gates.WARNING)), unique=gates.ERROR, known=gates.ERROR)
    right = gates.Side("b", b, ("id",), (gates.Gate("odd", F.col("y") == "none"),), unique=gates.WARNING, known=gates.WARNING)
    got = {r["check"]: (r.violations, r.status) for r in gates.check_both(left, right).collect()}
    assert got == {
        "a: negative": (1, "error"), "a: zero": (1, "warning"), "a: repeated keys": (1, "error"), "a: unknown keys": (3, "error"),
        "b: odd": (0, "ok"), "b: repeated keys": (1, "warning"), "b: unknown keys": (2, "warning"),
    }
    assert {r["check"]: r.violations for r in gates.check(gates.Side("a", a, ("k",), left.gates, unique=gates.ERROR)).collect()} == {"a: negative": 1, "a: zero": 1, "a: repeated keys": 1}
    assert [r.violations for r in gates.check(gates.Side("a", a.limit(0), ("k",), left.gates)).collect()] == [0, 0]


def test_each_table_is_scanned_once(spark, tmp_path):
    for name in ("a", "b"):
        spark.range(10).withColumnRenamed("id", "k").write.parquet(str(tmp_path / name))
    sides = [gates.Side(n, spark.read.parquet(str(tmp_path / n)), ("k",), (gates.Gate("low", F.col("k") < 3), gates.Gate("high", F.col("k") > 8)), gates.ERROR, gates.ERROR) for n in ("a", "b")]
    plan = gates.check_both(*sides)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2


def test_gated_write(spark, tmp_path):
    path = str(tmp_path / "t")
    gate = gates.Gate("large", F.col("id") > 90), gates.Gate("odd", F.col("id") % 2 == 1, gates.WARNING)
    assert gates.gated_write(spark.range(80), path, *gate) == {"rows": 80, "large": 0, "odd": 40}
    with pytest.raises(ContractError, match="large: 9 rows"):
        gates.gated_write(spark.range(100), path, *gate)
    assert spark.read.parquet(path).count() == 80 and os.listdir(tmp_path) == ["t"]


def files_of(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert cache.read_cache(spark, path) is None
    first = spark.range(200).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(1).alias("n"), F.lit(1).alias("seen"))
    assert len(cache.update_cache(first, path, "key", "seen", buckets=16)) == 16
    before = files_of(path)
    new = spark.createDataFrame([("k3", 7, 2), ("k4", 8, 0), ("new", 9, 2), ("k3", 6, 1)], "key string, n int, seen int")
    touched = cache.update_cache(new, path, "key", "seen", buckets=16)
    assert len(touched) <= 3 and len(before - files_of(path)) == len(touched)
    rows = {r.key: r.n for r in cache.read_cache(spark, path).collect()}
    assert len(rows) == 201 and (rows["k3"], rows["k4"], rows["new"], rows["k5"]) == (7, 1, 9, 1)
    assert cache.update_cache(new.limit(0), path, "key", "seen", buckets=16) == []


def test_failures_leave_the_old_or_the_new_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    old = spark.createDataFrame([(f"k{i}", 1, 1) for i in range(20)], "key string, n int, seen int")
    cache.update_cache(old, path, "key", "seen", buckets=4)
    broken = spark.range(20).select(F.concat(F.lit("k"), "id").alias("key"), F.when(F.col("id") < 15, 2).otherwise(F.raise_error(F.lit("lost"))).cast("int").alias("n"), F.lit(2).alias("seen"))
    with pytest.raises(Exception, match="lost"):
        cache.update_cache(broken, path, "key", "seen", buckets=4)
    assert {r.n for r in cache.read_cache(spark, path).collect()} == {1}
    finish = cache._finish
    calls = []
    monkeypatch.setattr(cache, "_finish", lambda s, p: finish(s, p) if not calls.append(1) and len(calls) == 1 else None)  # the writer dies after its marker
    cache.update_cache(old.withColumn("n", F.lit(3)).withColumn("seen", F.lit(2)), path, "key", "seen", buckets=4)
    monkeypatch.setattr(cache, "_finish", finish)
    assert os.path.exists(f"{path}/_commit")
    assert {r.n for r in cache.read_cache(spark, path).collect()} == {3} and not os.path.exists(f"{path}/_commit")
