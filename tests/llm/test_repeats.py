import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sharelens.llm import repeats, substring_dedup, suffix_dedup


def brute_bytes(texts, size):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + size] for r in raws for i in range(len(r) - size + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - size + 1):
            if seen[r[i : i + size]] > 1:
                gone[i : i + size] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(texts, size):
    docs = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(d[i : i + size]) for d in docs for i in range(len(d) - size + 1))
    out = []
    for d in docs:
        gone = [False] * len(d)
        for i in range(len(d) - size + 1):
            if seen[tuple(d[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        kept = b" ".join(w for w, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = ["of", "the", "naïve", "日本", "a", "ab", "abc", "x" * 30, *(f"w{i}" for i in range(60))]
    say = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    shared = [say(r.randrange(20, 120)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [say(r.randrange(0, 60)) for _ in range(3)]
        if r.random() < 0.6:
            parts.insert(r.randrange(4), r.choice(shared))
        if r.random() < 0.2:
            words = r.choice(shared).split()
            words[r.randrange(len(words))] = "changed"
            parts.append(" ".join(words))
        texts.append(r.choice([" ", "\n", " \t "]).join(parts))
    return texts + texts[:3] + [None, "", " ", "z" * 900, "ab" * 700, "the " * 300, "z" * 300, "u v " * 30, shared[0] * 2]


@pytest.fixture(params=[1, 2])
def table(request, spark):
    texts = corpus(request.param)
    rows = list(enumerate(texts))
    return texts, spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS spans", "2 AS key").repartition(5)


def test_suffix_array_is_in_order():
    r = random.Random(4)
    for alphabet in ("ab", "abcdefgh", "a"):
        data = "".join(r.choice(alphabet) for _ in range(1500)) + "".join(["abcab" * 30, "zz", "aaaa" * 20])
        order = suffix_dedup.suffix_array(np.frombuffer(data.encode(), np.uint8))
        assert sorted(order.tolist()) == list(range(len(data)))
        cut = [data[i : i + 32 * suffix_dedup.ROUNDS] for i in order]
        assert all(a <= b for a, b in zip(cut, cut[1:]))
        a, b = order[:-1], order[1:]
        got = suffix_dedup.common_prefixes(np.frombuffer(data.encode(), np.uint8), a, b, suffix_dedup.block_ranks(np.frombuffer(data.encode(), np.uint8)), 200)
        for x, y, n in zip(a, b, got):
            want = 0
            while want < 200 and max(x, y) + want < len(data) and data[x + want] == data[y + want]:
                want += 1
            assert n == want


@pytest.mark.parametrize("hot", [repeats.HOT, 3])
def test_bytes_against_brute_force(table, hot):
    texts, df = table
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.dedup(df, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute_bytes(texts, suffix_dedup.SIZE)


@pytest.mark.parametrize("hot", [repeats.HOT, 3])
def test_words_against_brute_force(table, hot):
    texts, df = table
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.dedup(df, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute_words(texts, substring_dedup.SIZE)


def test_texts_larger_than_slices_and_pools(spark):
    r = random.Random(8)
    long = " ".join(f"w{r.randrange(10**7)}" for _ in range(250_000))
    passage = " ".join(f"p{r.randrange(10**7)}" for _ in range(60))
    a, b = 300_007, 2_000_001
    rows = [(0, long), (1, "\x01" + long[a:b] + "\x02")] + [(i, f"{i * 7919 % 10007:05d}q{passage}{i * 104729 % 10007:05d}") for i in range(2, 6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert len(long) > 2 * repeats.SLICE and 6000 * 350 > 2 * repeats.POOL
    got = {r.doc_id: r for r in suffix_dedup.dedup(df).collect()}
    assert (got[0].n_removed, got[0].n_spans, got[1].n_removed, got[1].n_spans) == (b - a, 1, b - a, 1)
    some = [0, 1, *range(2, 6000)]
    want = brute_bytes([t for i, t in rows if i > 1], suffix_dedup.SIZE)
    assert [tuple(got[i])[1:] for i in some[2:]] == want
    got = {r.doc_id: r for r in substring_dedup.dedup(df).collect()}
    inside = long[a:b].split()[1:-1]
    assert got[0].n_removed == got[1].n_removed == len(inside)
    assert [tuple(got[i])[1:] for i in some[2:]] == brute_words([t for i, t in rows if i > 1], substring_dedup.SIZE)


def test_words_that_collide_modulo_powers_of_two(spark):
    w = "ab"
    for _ in range(9):
        w += w.translate(str.maketrans("ab", "ba"))
    other = w.translate(str.maketrans("ab", "ba"))
    body = [f"u{i}" for i in range(34)]
    rows = [(1, " ".join([*body[:17], w, *body[17:]])), (2, " ".join([*body[:17], other, *body[17:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.dedup(df).collect()] == [0, 0]


def test_repeated_ids_rows_and_empty_tables(spark):
    t = "q" * 10 + "".join(chr(97 + i % 7) + str(i) for i in range(200))
    words = " ".join(f"u{i}" for i in range(50))  # 189 bytes, no window of 200
    rows = [(1, t), (1, t), (None, words), (None, words), (None, "z" + t + "z"), (2, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_bytes", F.lit(-1)).withColumn("kept_sha256", F.lit("clash"))
    for hot in (5000, 1):
        got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(df, hot=hot).collect()), key=str)
        assert got == [(1, len(t), len(t)), (1, len(t), len(t)), (2, 5, 0), (None, 189, 0), (None, 189, 0), (None, len(t) + 2, len(t))]
    got = sorted((tuple(r) for r in substring_dedup.dedup(df).collect()), key=str)
    assert [(r[0], r[1], r[2]) for r in got if r[0] is None] == [(None, 1, 0), (None, 50, 50), (None, 50, 50)]
    empty = df.limit(0)
    assert suffix_dedup.dedup(empty).count() == 0
    assert substring_dedup.dedup(empty).count() == 0


def test_texts(spark):
    words = " ".join(f"u{i}" for i in range(40))
    df = spark.createDataFrame([(1, words + " a b"), (2, "c " + words)], "doc_id long, text string")
    got = {r.doc_id: (r.kept, r.removed) for r in substring_dedup.dedup(df, texts=True).collect()}
    assert got == {1: ("a b", [[0, 40]]), 2: ("c", [[1, 41]])}


@pytest.mark.parametrize("module", [suffix_dedup, substring_dedup])
def test_the_method_decides_on_split_keys_too(spark, module):
    """Above the limit as below it, what the operator's method calls a repeat is one: nothing else decides."""
    text = " ".join(f"w{i}" for i in range(120))
    docs = spark.createDataFrame([(i, f"{i} {text} {i}x") for i in range(6)], "doc_id long, text string").repartition(6, "doc_id")
    never = lambda bodies, windows, copies: [np.zeros(w, bool) for w in windows]
    for hot in (repeats.HOT, 2):
        for solve, n in ((module.repeated, 6), (never, 0)):
            _, spans = repeats.find(docs, module._units, module._body, module._windows, solve, module.GRAM, module.SIZE, hot)
            parts = docs.select(F.spark_partition_id().alias("p")).distinct().count()
            assert spans.count() == n or parts < 6  # copies within one slice are told by their bytes


def test_windows_are_decided_by_overlapping_blocks():
    """Ranks of blocks tell of every two suffixes whether their first bytes agree, as a comparison of all bytes does."""
    r = random.Random(7)
    base = bytes(r.choice(b"ab\x00") for _ in range(260))
    data = b"".join(base[: r.randrange(150, 260)] + bytes([r.randrange(3)]) for _ in range(40))
    array = np.frombuffer(data, np.uint8)
    for block in (32, 64, 128):
        rank = suffix_dedup.block_ranks(array, block)
        order = suffix_dedup.suffix_array(array, rank, block)
        assert sorted(order.tolist()) == list(range(len(data)))
        cut = [data[i : i + 32 * suffix_dedup.ROUNDS] for i in order]
        assert all(a <= b for a, b in zip(cut, cut[1:]))
        order = order[order <= len(data) - 200]
        a, b = order[:-1], order[1:]
        want = [data[x : x + 200] == data[y : y + 200] for x, y in zip(a, b)]
        assert suffix_dedup.agree(a, b, rank, 200, block).tolist() == want and 0 < sum(want) < len(want)
