"""Dictionary lookups against a plain search."""

import random
import re

from sharelens.operators import gazetteer


def plain(text, entries):
    """(pos, n, phrase) of the phrases that lie in no other one found."""
    w = re.findall("[a-z0-9]+", text.lower())
    hits = [(i, n) for i in range(len(w)) for n in range(1, 6) if i + n <= len(w) and " ".join(w[i : i + n]) in entries]
    keep = [(i, n) for i, n in hits if not any((j, m) != (i, n) and j <= i and i + n <= j + m for j, m in hits)]
    return sorted((i, n, " ".join(w[i : i + n])) for i, n in keep)


def test_mentions_are_the_longest_ones(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    entries = {" ".join(r.choice(words) for _ in range(r.randrange(1, 5))): f"C{i}" for i in range(120)}
    texts = {i: r.choice([" ", ", ", "-"]).join(r.choice(words) for _ in range(r.randrange(60))) for i in range(60)}
    d = spark.createDataFrame(list(entries.items()), "phrase string, code string")
    got = gazetteer.mentions(spark.createDataFrame([*texts.items(), (99, None)], "id long, text string"), d).collect()
    assert sorted((x.id, x.pos, x.n, x.phrase) for x in got) == sorted((i, *m) for i, t in texts.items() for m in plain(t, entries))
    assert all(entries[x.phrase] == x.code for x in got)


def test_world(spark):
    """Some four thousand names: local ones, aliases, institutions; the plan does not hold them."""
    d = gazetteer.world(spark).cache()
    assert gazetteer.entries(d).count() > 1500
    rows = [(1, "Dept. of CS, Universidad, España"), (2, "Côte d’Ivoire"), (3, "es"), (4, "The Max Planck Institute"), (5, "Papua-Neuguinea and Guinea"), (6, "nowhere"), (7, None), (8, "Lab, P.R. China, 100084"), (9, "U.K.")]
    texts = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: (r.code, r.how) for r in gazetteer.infer(texts, d).collect()}
    assert got == {1: ("ES", "part"), 2: ("CI", "part"), 3: ("ES", "code"), 4: ("DE", "mention"), 5: ("GN", "mention"), 8: ("CN", "part"), 9: ("GB", "part")} or got[5] == ("PG", "mention")
    found = gazetteer.mentions(texts, d)
    assert sorted(r.code for r in found.where("id = 5").collect()) == ["GN", "PG"]
    names = spark.createDataFrame([("deutschland",), ("Brasil",), ("uk",), ("EL",), ("x",), (None,)], "name string")
    assert [r.code for r in gazetteer.normalise(names, d, "name").collect()] == ["DE", "BR", "GB", "GR", None, None]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "spain" not in plan and "RLIKE" not in plan
    d.unpersist()


def test_first_rank_wins_and_other_columns_stay(spark):
    d = spark.createDataFrame([("New  York", "B", 2), ("new york", "A", 1), ("york", "C", 0), ("", "D", 0), ("x", None, 0)], "phrase string, code string, rank int")
    texts = spark.createDataFrame([(1, "in New York, york")], "id long, text string")
    assert [(r.pos, r.code) for r in gazetteer.mentions(texts, d).orderBy("pos").collect()] == [(1, "A"), (3, "C")]
    assert gazetteer.mentions(texts, d.limit(0)).count() == 0
    out = gazetteer.normalise(spark.createDataFrame([("York", 7)], "name string, n int"), d, "name").collect()
    assert [tuple(r) for r in out] == [("York", 7, "C")]


def test_longest_suffix_of_a_host(spark):
    hosts = spark.createDataFrame([(1, "cs.ox.ac.uk"), (2, "X.EDU"), (3, "upm.es"), (4, "x.org"), (5, ""), (6, None), (7, "es")], "id long, host string")
    got = {r.id: (r.code, r.suffix) for r in gazetteer.from_host(hosts, gazetteer.domains(spark)).collect()}
    assert got == {1: ("GB", "ac.uk"), 2: ("US", "edu"), 3: ("ES", "es"), 7: ("ES", "es")}
