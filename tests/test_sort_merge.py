"""As-of and interval lookups against plain searches, and their plans."""

import random

import pytest

from sharelens.operators import history, matching


def nodes(df, name):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(name in line for line in plan.splitlines())


@pytest.fixture(scope="module")
def still(spark):
    """Plans as they are before adaptive execution."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("parts", [1, 4])
def test_as_of(spark, still, parts):
    r = random.Random(1)
    versions = {(v, y): r.choice(["A", "A*"]) for v in "abc" for y in r.sample(range(1900, 2900, 2), 300)}
    papers = [(i, r.choice(["a", "a", "a", "b", "c", "none", None]), r.choice([None, *range(1890, 2910)]) if i % 50 else 1) for i in range(800)]
    h = spark.createDataFrame([(v, y, lv) for (v, y), lv in versions.items()] + [(None, 2000, "A")], "venue string, core_year int, level string")
    df = history.as_of(spark.createDataFrame(papers, "paper_id long, venue string, year int"), h, parts)
    assert df.columns == ["paper_id", "venue", "year", "hist_level", "hist_year", "fallback"]
    want = []
    for i, v, y in papers:
        own = sorted(t for x, t in versions if x == v) if y is not None else []
        hit = max([t for t in own if t <= y], default=own[0] if own else None) if own else None
        want.append((i, v, y, versions.get((v, hit)), hit, hit is None or hit > y))
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert nodes(df, "Exchange") == 1 and nodes(df, "Join") == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_positions_at_a_year(spark, still, parts):
    """A thousand positions of one author, overlapping, open, without country, and with equal starts."""
    r = random.Random(2)
    positions = [(r.choice([1, 1, 1, 2, 3]), s, r.choice([None, s + r.randrange(0, 40), s]), r.choice(["ES", "FR", "DE", None])) for s in (r.randrange(1000, 2500) for _ in range(1500))]
    papers = [(i, r.choice([1, 1, 2, 3, 4, None]), r.choice([None, *range(950, 2600, 7)])) for i in range(600)]
    df = matching.profile_lookup(spark.createDataFrame(papers, "paper_id int, author long, year int"), spark.createDataFrame(positions, "author long, start int, end int, country string"), parts)
    want = []
    for i, a, y in papers:
        own = [(s, e, c) for x, s, e, c in positions if x == a and c is not None]
        if not own:
            continue
        kind = lambda p: 2 if y is None else 0 if p[0] <= y <= (p[1] or 10**9) else 1 if p[0] <= y else 2
        best = min(own, key=lambda p: (kind(p), -p[0], p[2]))
        want.append((i, a, best[2], kind(best)))
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert dict(df.dtypes)["paper_id"] == "int" and dict(df.dtypes)["author"] == "bigint"
    assert nodes(df, "Exchange") == 1 and nodes(df, "Join") == 0
