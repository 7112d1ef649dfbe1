"""Order statistics of groups against plain computations; a group is spread over tasks."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from sharelens.operators import order_stats


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(7)
    data = [(i, r.choice(["hot"] * 6 + ["a", "b", None]), r.choice([None, 1.5, 2.0, *[float(x) for x in range(60)]])) for i in range(3000)]
    data += [(5000, "lone", 3.0), (5001, "none", None)]
    return data, spark.createDataFrame(data, "id long, g string, x double").repartition(5)


def groups(data):
    out = {}
    for _, g, x in data:
        out.setdefault(g, []).append(x)
    return out


def test_percentiles(rows):
    data, df = rows
    own = {g: [x for x in xs if x is not None] for g, xs in groups(data).items()}
    want = []
    for i, g, x in data:
        less, ties = sum(y < x for y in own[g]) if x is not None else 0, sum(y == x for y in own[g]) if x is not None else 0
        want.append((i, g, x, None if x is None else (less + 1 + (ties - 1) / 2) / len(own[g])))
    assert sorted(map(tuple, order_stats.percentiles(df, ["g"], "x").collect())) == sorted(want)


def test_medians_and_scores(rows):
    data, df = rows
    got = {r.g: r.median for r in order_stats.medians(df, ["g"], "x").collect()}
    assert got == {g: statistics.median(v) for g, xs in groups(data).items() if (v := [x for x in xs if x is not None])}
    z = {r.id: r.z for r in order_stats.standardised(df, ["g"], F.coalesce("x", F.lit(0.0))).collect()}
    for i, g, x in data[::97] + data[-2:]:
        xs = [y or 0.0 for y in groups(data)[g]]
        assert z[i] is None if len(xs) == 1 else z[i] == pytest.approx(((x or 0.0) - statistics.mean(xs)) / statistics.stdev(xs))


def test_one_group_runs_in_several_tasks(spark):
    df = spark.range(20_000).select(F.lit("all").alias("g"), (F.col("id") * 7 % 20_000).alias("x"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ranks = order_stats.value_ranks(df, ["g"], "x").withColumn("task", F.spark_partition_id())
        rows = ranks.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert all(r.before == r.x and r.total == 20_000 and r.n == 1 for r in rows) and len(rows) == 20_000
    assert len({r.task for r in rows}) > 1
