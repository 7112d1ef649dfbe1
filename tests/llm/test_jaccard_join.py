import random
import re

import pytest

from sharelens.llm import jaccard_join


def brute(rows):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    first = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        if k is not None:
            first[r] = min(first.get(r, k), k)
    return sorted(((k, len(s), first.get(find(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, copies):
    r = random.Random(seed)
    say = lambda n: " ".join(f"{r.choice(['Über', 'the', 'A', 'x'])}{r.randrange(400)}" for _ in range(n))
    common = say(12)
    texts = [say(r.randrange(0, 120)) + r.choice(["", " " + common]) for _ in range(60)]
    for _ in range(copies):
        words = r.choice(texts[:8]).split()
        for _ in range(r.randrange(0, 5)):
            if words:
                words[r.randrange(len(words))] = f"edit{r.randrange(1000)}"
        texts.append(" ".join(words))
    return texts + ["a b", "A  B", "a b c", None, "", " \t", "one", "one two three four five", "one two three four FIVE"]


@pytest.mark.parametrize("seed,copies,dense,block", [(1, 120, 48, 256), (2, 200, 4, 16), (3, 150, 1, 8)])
def test_against_brute_force(spark, seed, copies, dense, block):
    rows = list(enumerate(corpus(seed, copies)))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS c").repartition(6)
    assert sorted(map(tuple, jaccard_join.join(df, dense, block).collect()), key=str) == brute(rows)


def test_dense_ngrams_reach_the_workers(spark):
    """With a limit of one document per n-gram all candidates come from stars, and blocks find what round one leaves apart."""
    docs, _, edges = jaccard_join.links(spark.createDataFrame(list(enumerate(corpus(3, 150))), "doc_id long, text string"), 1, 8)
    texts = docs.select("_rk", "text")
    rows, levels = jaccard_join.frequencies(texts, 1)
    pairs, stars = jaccard_join.candidates(texts, rows, levels, 1)
    assert pairs.count() == 0 and stars.count() > 100 and edges.count() > 20


def test_work_does_not_depend_on_partitions(spark):
    rows = list(enumerate(corpus(5, 200)))
    seen = []
    for n in (1, 4, 64):
        texts = spark.createDataFrame(rows, "_rk long, text string").na.fill("").repartition(n)
        sets, levels = jaccard_join.frequencies(texts, 4)
        pairs, stars = jaccard_join.candidates(texts, sets, levels, 4)
        seen.append((sorted(map(tuple, levels.collect())), sorted(map(tuple, sets.collect())), pairs.count(), stars.count()))
    assert seen[0][:2] == seen[1][:2] == seen[2][:2]
    assert all(abs(x[k] - seen[0][k]) <= 0.2 * seen[0][k] for x in seen for k in (2, 3))


@pytest.mark.parametrize("templated", [False, True])
def test_fragments_are_even(templated):
    """Prefixes are the low quarter of each document's order; their fragments hold equal shares all the same."""
    import numpy as np

    from sharelens.llm import common

    r = random.Random(4)
    frame = " ".join(f"frame{i}" for i in range(60)) if templated else ""
    texts = [(" ".join(f"w{r.randrange(10**6)}" for _ in range(r.randrange(20, 300))) + " " + frame).encode() for _ in range(300)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    tokens, bounds = jaccard_join.shingles(data, offsets)
    found = np.concatenate([tokens[a : a + (b - a) // 4 + 1] for a, b in zip(bounds, bounds[1:])])
    found = np.unique(found)
    spread = np.bincount(jaccard_join.fragment(found, np.zeros(len(found), int), 8), minlength=8)
    assert spread.max() < 1.2 * spread.mean() and len(spread) == 8
    assert (jaccard_join.fragment(found, np.ones(len(found), int), 8) >= 8).all()
    assert common.mix(found).dtype == np.uint64


def test_one_document_of_each_class_makes_pairs(spark):
    rows = list(enumerate(corpus(6, 40) * 6))
    texts = spark.createDataFrame(rows, "_rk long, text string").na.fill("").repartition(5)
    sets, levels = jaccard_join.frequencies(texts, 48)
    heads = {r[0] for r in sets.where("n > 0").groupBy("c1", "c2").agg({"_rk": "min"}).select("min(_rk)").collect()}
    pairs, _ = jaccard_join.candidates(texts, sets, levels, 48)
    found = {x for r in pairs.collect() for x in (r.a, r.b)}
    assert len(found & heads) > 0.9 * len(found)  # the bitmap lets a few others through
    df = texts.withColumnRenamed("_rk", "doc_id")
    assert sorted(map(tuple, jaccard_join.join(df).collect()), key=str) == brute([(k, t or "") for k, t in rows])


def thue_morse(k):
    a = "ab"
    for _ in range(k):
        a += a.translate(str.maketrans("ab", "ba"))
    return a


def test_words_that_collide_modulo_powers_of_two(spark):
    w = thue_morse(9)
    other = w.translate(str.maketrans("ab", "ba"))
    r = random.Random(9)
    body = [f"x{r.randrange(10**6)}" for _ in range(30)]
    rows = [(1, " ".join([w] * 5)), (2, " ".join([other] * 5)), (3, w), (4, other), (5, " ".join(x if i % 3 else w for i, x in enumerate(body))), (6, " ".join(x if i % 3 else other for i, x in enumerate(body)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.component_id for r in jaccard_join.join(df).orderBy("doc_id").collect()] == [1, 2, 3, 4, 5, 6]


def test_very_long_texts(spark):
    r = random.Random(2)
    words = [f"w{r.randrange(5000)}" for _ in range(200_000)]
    near = [w if i % 3000 else "edit" for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, "\n".join(near)), (3, "y" * 2_000_000), (4, "y" * 2_000_000), (5, "y" * 1_999_999), (6, " ".join(words[:150_000]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.join(df).collect())) == brute(rows)


def test_repeated_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(5, t), (5, t), (None, t), (None, "other words that stand alone here"), (7, t + " end"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.join(df).collect()), key=str) == brute(rows)
    assert jaccard_join.join(df.limit(0)).count() == 0


def test_a_task_sums_pairs_over_its_fragments():
    """A pair that shares n-grams in many fragments of a task is one row, not one a fragment."""
    import numpy as np
    import pyarrow as pa

    docs = np.array([[11, 12, 13], [1, 2, 3], [40, 41, 42]], np.int64).tobytes()  # class, key, size

    def rows():
        for f in range(30):
            token = np.array([f, f, 1000 + f, 1000 + f, 1000 + f], np.int64)
            grams = token.tobytes() + np.array([0, 1, 0, 1, 2], np.uint16).tobytes() + np.array([f, f + 1, f, f, f], np.uint32).tobytes()
            yield pa.RecordBatch.from_pydict({"frag": [f], "docs": [docs], "grams": [grams]})

    found = pa.Table.from_batches(list(jaccard_join._pairer(48)(rows()))).to_pylist()
    got = sorted((r["a"], r["b"], r["na"], r["nb"], r["ia"], r["ib"], r["shared"]) for r in found if not r["dense"])
    assert got == [(1, 2, 40, 41, 29, 30, 60), (1, 3, 40, 42, 29, 29, 30), (2, 3, 41, 42, 29, 29, 30)]
    stars = pa.Table.from_batches(list(jaccard_join._pairer(2)(rows()))).to_pylist()
    assert sum(r["dense"] for r in stars) == 90 and [r["shared"] for r in stars if not r["dense"]] == [30]


def test_sums_that_wait_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "WAITING", 5)
    rows = list(enumerate(corpus(1, 120)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted(map(tuple, jaccard_join.join(df).collect()), key=str) == brute(rows)


def test_components_end_once_edges_are_stars(spark, monkeypatch):
    from sharelens.llm import jaccard_join

    written, write = [], jaccard_join.materialize
    monkeypatch.setattr(jaccard_join, "materialize", lambda df: written.append(1) or write(df))
    stars = [(1, 5), (5, 1), (1, 7), (2, 9), (3, 3)]
    out = jaccard_join.components(spark.createDataFrame(stars, "a long, b long"))
    assert sorted(map(tuple, out.collect())) == [(5, 1), (7, 1), (9, 2)] and len(written) == 1
    # a path, a ring, a bridge between stars
    edges = [(i, i + 1) for i in range(10, 20)] + [(30 + i, 30 + (i + 1) % 6) for i in range(6)] + [(40, 41), (40, 42), (43, 44), (43, 45), (45, 42)]
    got = {tuple(r) for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 10) for i in range(11, 21)} | {(i, 30) for i in range(31, 36)} | {(i, 40) for i in range(41, 46)}
