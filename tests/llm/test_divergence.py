"""The divergence audit against a plain computation with Python's integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sharelens.llm import common, divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def terms_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain(rows):
    count, docs, groups = Counter(), Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = terms_of(text)
        for w in words:
            count[lang, source, w] += 1
        for w in set(words):
            docs[lang, w] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), n in docs.items() if x == lang and n >= 3]
        own = sorted(s for x, s in groups if x == lang)

        def p(n, kept=kept):
            total = sum(n.values())
            return {w: 1 + 10**9 * (n[w] + 1) // (total + len(kept)) for w in kept}

        of = {s: Counter({w: count[lang, s, w] for w in kept}) for s in own}
        q = p(sum(of.values(), Counter()))
        prob = {s: p(of[s]) for s in own}
        for s in own:
            lists = {"pair": [(sum((prob[s][w] - prob[o][w]) ** 2 // prob[o][w] for w in kept), o) for o in own if o != s]}
            lists["term"] = [((prob[s][w] - q[w]) ** 2 // q[w], w) for w in kept if of[s][w] > 0 and prob[s][w] > q[w]]
            for part, items in lists.items():
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(items, 1) if part == "pair" or k <= 200]
    return sorted(out)


def sample(n=150):
    r = random.Random(8)
    rows = []
    for i in range(n):
        words = [r.choice(["the", "The", "été", "Ärger", "x'y", "a1b", "数据", "\U0001f600b"]) if r.random() < 0.3 else f"w{'abcdefghij'[r.randrange(10)]}{'klmnop'[r.randrange(6)]}" for _ in range(r.randrange(60))]
        rows.append((i, r.choice([" ", "\n", "\x00", ", "]).join(words), r.choice(["en", "en", "fr", None]), r.choice(["s0", "s0", "s0", "s1", "s2", "Ünï", None])))
    return rows + [(None, None, "de", "alone"), (7, "", "de", None), (7, rows[7][1], rows[7][2], rows[7][3]), (7, rows[7][1], rows[7][2], rows[7][3]), (8, "wx wx", "xx", "one")]


def result(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in df.collect())


def test_audit(spark, monkeypatch):
    rows = sample()
    want = plain(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("term", F.lit("clash")).withColumn("n", F.lit(1)).repartition(3)
    assert result(divergence.audit(df)) == want
    monkeypatch.setattr(divergence, "TERMS", 7)  # many tiles
    monkeypatch.setattr(divergence, "SOURCES", 2)
    monkeypatch.setattr(divergence, "LANGS", 0)
    monkeypatch.setattr(divergence, "COUNTED", 500)
    assert result(divergence.audit(df)) == want


def test_top_terms_and_ties(spark):
    """More than 200 terms above the language's level, many of them equal."""
    one = " ".join("v" + "abcdefghijklmnopqrst"[i // 20] + "abcdefghijklmnopqrst"[i % 20] for i in range(300))
    rows = [(i, one, "en", "a") for i in range(3)] + [(i, "zz zz", "en", "b") for i in range(4)]
    want = plain(rows)
    assert sum(r[2] == "term" and r[1] == "a" for r in want) == 200
    assert result(divergence.audit(spark.createDataFrame(rows, SCHEMA))) == want


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_pieces_are_cut_between_terms(monkeypatch):
    r = random.Random(1)
    for size in (1, 3, 8, 50):
        monkeypatch.setattr(common, "PIECE", size)
        for _ in range(50):
            text = "".join(r.choice("abé .Z") for _ in range(r.randrange(80)))
            got = [w.decode() for piece in common.word_pieces(memoryview(text.encode()), divergence.FOLD) for w in piece]
            assert got == terms_of(text)


def test_counters_are_passed_on_when_full_and_meet_by_part(monkeypatch):
    batch = pa.record_batch({"lang": ["en", "en", "de"], "source": ["a", "a", "b"], "text": ["x y x", "x", "x"]})
    monkeypatch.setattr(divergence, "HELD", 0)
    rows = pa.Table.from_batches(list(divergence._counter(3)([batch, batch]))).sort_by("part")
    assert set(rows.column("part").to_pylist()) <= {0, 1, 2}
    out = [r for b in divergence._adder(3)(rows.to_batches(max_chunksize=2)) for r in b.to_pylist()]
    got = {(r["lang"], r["source"], r["term"]): (r["n"], r["lang_n"], r["first"]) for r in out}
    assert got == {("en", "a", None): (0, 0, False), ("de", "b", None): (0, 0, False), ("en", "a", "x"): (6, 6, True)} and len(out) == 3


def test_probabilities_are_exact():
    r = random.Random(2)
    for _ in range(200):
        total = r.randrange(1, 9 * 10**15)
        n = r.randrange(total)
        assert divergence.probability(np.array([n]), np.array([total]))[0] == 1 + 10**9 * (n + 1) // total
