"""License scans against a plain comparison of every block with every template."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sharelens.llm import common, license_scan

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def plain(text, found=license_scan.FOUND, label=license_scan.LABEL):
    text = text or ""
    own = words(text)
    places, base = [], set()
    for phrase, name in license_scan.PHRASES.items():
        p = phrase.split()
        here = [i for i in range(len(own)) if own[i : i + len(p)] == p]
        places += here
        base |= {name} if here else set()
    labels, score = set(base), float(bool(base))
    for part in re.split(r"\n[\x20\x09-\x0D]*\n", text):
        for block in [part, *part.split("\n")]:
            for name, template in license_scan.TEMPLATES:
                t = set(words(template))
                n = len(t & set(words(block)))
                if n >= math.ceil(found * len(t) - 1e-9):
                    score = max(score, n / len(t))
                    labels |= {name} if n / len(t) >= label else set()
    return len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def sample():
    r = random.Random(11)
    pool = [w for _, t in license_scan.TEMPLATES for w in t.split()]
    out = []
    for _ in range(300):
        lines = []
        for _ in range(r.randrange(6)):
            _, t = r.choice(license_scan.TEMPLATES)
            kind = r.random()
            line = [w for w in t.split() if r.random() < 0.9] if kind < 0.3 else [r.choice(pool) for _ in range(r.randrange(12))] if kind < 0.6 else [f"x{r.randrange(50)}" for _ in range(20)]
            if kind < 0.1:
                line = [" ".join(line[:5]), "\n", " ".join(line[5:])]
            lines.append(r.choice([" ", " ", "-", ", "]).join(line))
        out.append(r.choice(["\n", "\n\n", "\n \t\n"]).join(lines))
    return out + [
        None, "", " \n\n ", "GNU\nGENERAL, public--license!", "mit license mit license", "mit", "MIT LICENSE", "cc by", "CC-BY-NC 4.0 cc by-sa", "éapache license", "apache\x00license",
        "gnu gnu general public license general public license", "Licensed under CC BY-NC 4.0.", "x " * 30_000 + "mit license\n" + "y" * 3_000_000,
    ]


def test_scan(spark):
    texts = sample()
    rows = list(enumerate(texts)) + [(3, texts[0]), (3, texts[0]), (None, "apache license"), (None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("labels", F.lit("clash")).withColumn("word", F.lit(1)).repartition(3)
    got = license_scan.scan(df)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, *plain(t)) for i, t in rows), key=str)
    assert license_scan.scan(df.where("false")).collect() == []
    low = license_scan.scan(df, found=0.2, label=0.4)
    assert sorted(map(tuple, low.collect()), key=str) == sorted(((i, *plain(t, 0.2, 0.4)) for i, t in rows), key=str)


def test_filters_drop_only_what_cannot_meet():
    """The join equals a full comparison for any order of the words."""
    r = random.Random(5)
    vocabulary = [b"w%d" % i for i in range(30)]
    for _ in range(300):
        sets = [("t", frozenset(r.sample(vocabulary, r.randrange(1, 12)))) for _ in range(5)]
        rank = {w: r.randrange(3) * 100 + i for i, w in enumerate(vocabulary)}
        found = r.choice([0.3, 0.5, 0.75, 1.0])
        index = license_scan.Index(sets, {w: rank[w] for _, t in sets for w in t}, found)
        block = set(r.sample(vocabulary, r.randrange(0, 20))) | {b"other"}
        want = {(k, len(t & block) / len(t)) for k, (_, t) in enumerate(sets) if len(t & block) >= math.ceil(found * len(t) - 1e-9)}
        assert set(index.meets(block)) == want


def test_pieces(monkeypatch):
    """Phrases over the cuts between pieces are found once."""
    phrases = [p.encode().split() for p in license_scan.PHRASES]
    text = b"gnu general public license mit license apache license cc by cc by mit license gnu general public license"
    own = text.split()
    want = [[i for i in range(len(own)) if own[i : i + len(p)] == p] for p in phrases]
    for size in (1, 4, 7, 20, 1000):
        monkeypatch.setattr(common, "PIECE", size)
        assert license_scan.places(common.word_pieces(memoryview(text), license_scan.FOLD), phrases) == (len(own), want)


def test_bad_parameters(spark):
    df = spark.createDataFrame([(1, "a")], SCHEMA)
    with pytest.raises(ValueError, match="found"):
        license_scan.scan(df, found=0.9, label=0.5)
    with pytest.raises(ValueError, match="empty"):
        license_scan.scan(df, templates=[("x", "--")])
