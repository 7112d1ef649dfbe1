"""Product codes by filtering Lloyd rounds, held against plain Lloyd rounds."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sharelens.llm import code_compression as cc

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """(vec_id, code, error, label_error) of every usable row and the digest, by whole distance matrices."""
    kept = [(i, np.floor(np.array(v, np.float32).astype(float) * cc.SCALE).astype(np.int64), y) for i, v, y in rows if v and None not in v and np.isfinite(v).all()]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    x = np.array([r[1] for r in kept]).reshape(len(kept), cc.PARTS, -1)
    books = x[: cc.ENTRIES].transpose(1, 0, 2).copy()

    def nearest():
        d = np.array([[((x[:, p] - c) ** 2).sum(axis=1) for c in books[p]] for p in range(cc.PARTS)])
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(cc.ROUNDS):
        code = nearest()[0]
        for p in range(cc.PARTS):
            for e in set(code[p].tolist()):
                books[p, e] = x[code[p] == e, p].sum(axis=0) // (code[p] == e).sum()
    code, d = nearest()
    error, total = d.sum(axis=0), Counter()
    for (_, _, y), e in zip(kept, error):
        total[y] += int(e)
    out = [(i, bytes(code[:, k].astype(np.uint8)).hex(), int(error[k]), total[y]) for k, (i, _, y) in enumerate(kept)]
    return out, hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def result(df):
    rows = df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert len({r[4] for r in rows}) <= 1
    return sorted((tuple(r[:4]) for r in rows), key=str), rows[0][4] if rows else None


def test_codes_equal_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(cc, "BLOCK", 150)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 0.3, (40, 8))
    rows = [(i, [float(x) for x in np.float32(centres[rng.integers(40)] + rng.normal(0, 0.01 if i % 2 else 0.2, 8))], int(rng.integers(5)) if i % 7 else None) for i in range(900)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(400)]  # one vector holds a third
    rows += [(5, rows[5][1], 2), (None, rows[6][1], None), (None, [9.5] * 8, 3), (7, rows[7][1], 0)]
    rows += [(2000, None, 1), (2001, [None] + [0.0] * 7, 1), (2002, [float("nan")] + [0.0] * 7, 1), (2003, [float("inf")] * 8, 1), (2004, [], 1)]
    want, digest = plain(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("code", F.lit("clash")).withColumn("v", F.lit(1))
    got = cc.compress(df)
    assert result(got) == (sorted(want, key=str), digest)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    monkeypatch.setattr(cc, "LABELS", 0)  # sums joined instead of broadcast
    assert result(cc.compress(df)) == (sorted(want, key=str), digest)


def test_few_rows_other_lengths_and_empty_tables(spark):
    rows = [(3, [0.5, 0.5, -0.25, 1.0], 1), (1, [0.0, -0.0001, 0.1, 2.0], None), (3, [0.5, 0.5, -0.25, 1.0], 1)]
    want, digest = plain(rows)
    assert result(cc.compress(spark.createDataFrame([*rows, (9, [1.0] * 8, 1), (8, [1.0] * 3, 1)], SCHEMA))) == (sorted(want, key=str), digest)
    for none in ([], [(1, None, 1), (2, [], 2)]):
        assert cc.compress(spark.createDataFrame(none, SCHEMA)).collect() == []


def test_large_components(spark):
    """Beyond what products of doubles hold exactly, integers are used; beyond a long there is an error."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 40_000, 8)], 1) for i in range(300)]
    want, digest = plain(rows)
    assert result(cc.compress(spark.createDataFrame(rows, SCHEMA))) == (sorted(want, key=str), digest)
    with pytest.raises(ValueError, match="exceed a long"):
        cc.compress(spark.createDataFrame([(1, [1e30] * 4, 1)], SCHEMA))


def test_subtrees_are_assigned_whole():
    """Far clusters: nearly all points are settled by the cached sums of few nodes."""
    rng = np.random.default_rng(5)
    x = (rng.integers(0, 16, (4000, 1)) * 10_000 + rng.integers(-50, 50, (4000, 4))).astype(np.int64)
    tree = cc.Tree.build(x)
    book = cc.Codebook((np.arange(16)[:, None] * 10_000 + np.zeros((1, 4))).astype(np.int64), 1 << 18)
    code, whole = tree.nearest(book)
    d = ((tree.points[:, None, :] - book.entries[None]) ** 2).sum(axis=2)
    assert (code == d.argmin(axis=1)).all()
    nodes = np.concatenate([n for n, _ in whole])
    assert (tree.end[nodes] - tree.start[nodes]).sum() > 3500 and len(nodes) < 200
    assert (tree.sums[nodes] == np.array([tree.points[tree.start[n] : tree.end[n]].sum(axis=0) for n in nodes])).all()


def test_a_round_takes_few_jobs_however_many_partitions(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(0, 1, 8)], 1) for i in range(300)], SCHEMA)
    books = rng.integers(-1024, 1024, (cc.PARTS, 16, 2))
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    blocks = cc.materialize(cc.trees(cc.usable(rows), 8))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "30")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.sparkContext.setJobGroup("rounds", "rounds")
        cc.rounds(blocks, books, 1 << 14, 2)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds")) <= 2 * 4
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)
