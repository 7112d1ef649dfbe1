"""Exact dedup, fingerprints, mixing, URL filter, toxicity and the pipeline on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sharelens.llm import exact_dedup, fingerprints, mixing, toxicity, url_filter


def frame(spark, rows, schema="doc_id long, text string, lang string, source string"):
    return spark.createDataFrame(rows, schema)


def texts(seed, n):
    r = random.Random(seed)
    say = lambda k: " ".join(f"w{r.randrange(300)}" for _ in range(k))
    out = ["\n".join(say(r.randrange(1, 30)) for _ in range(r.randrange(1, 6))) for _ in range(n)]
    return out + [out[0], out[1].replace(" ", "  "), None, "", "", " "]


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_perfect_hash_is_minimal_and_exact():
    keys = np.random.default_rng(1).integers(0, 1 << 63, (5000, 4), dtype=np.uint64)
    for n in (1, 2, 3, 50, 5000):
        h = exact_dedup.PerfectHash(keys[:n])
        assert sorted(h.slot_of.tolist()) == list(range(n))
        assert (h.find(keys[:n]) == h.slot_of).all()


def test_exact_dedup(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(texts(2, 40))] + [(3, "same", "en", "s"), (3, "same", "en", "s"), (None, "same", "en", "s"), (None, "alone", "en", "s")]
    got = sorted(map(tuple, exact_dedup.dedup(frame(spark, rows).withColumn("digest", F.lit(1))).collect()), key=str)
    size, first = Counter(), {}
    for i, t, *_ in rows:
        size[normal(t)] += 1
        if i is not None:
            first[normal(t)] = min(first.get(normal(t), i), i)
    want = [(i, first.get(normal(t)), size[normal(t)], i == first.get(normal(t)), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t, *_ in rows]
    assert got == sorted(want, key=str)
    assert exact_dedup.dedup(frame(spark, [])).count() == 0


def test_exact_dedup_against_history(spark):
    old = frame(spark, [(1, "a b", "", ""), (2, "c", "", "")])
    new = frame(spark, [(10, "a  b", "", ""), (11, "new", "", ""), (12, "new", "", "")])
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(new, old).collect()}
    assert got == {10: (1, 2, False), 11: (11, 2, True), 12: (11, 2, False)}


def test_exact_dedup_history_edges(spark):
    long = "word " * 400_000
    old = frame(spark, [(5, "a", "", ""), (2, "a", "", ""), (None, "n", "", ""), (4, None, "", ""), (6, long, "", "")])
    new = frame(spark, [(2, "a", "", ""), (None, "a", "", ""), (9, "n", "", ""), (9, "n", "", ""), (None, "", "", ""), (7, long + " ", "", ""), (7, "alone", "", "")])
    got = sorted([tuple(r)[:4] for r in exact_dedup.dedup(new, old).collect()], key=str)
    want = [(2, 2, 4, False), (None, 2, 4, False), (9, None, 3, False), (9, None, 3, False), (None, 4, 2, False), (7, 6, 2, False), (7, 7, 1, True)]
    assert got == sorted(want, key=str)


def test_index_holds_all_distinct_digests_of_the_earlier_half(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(exact_dedup, "build_index", lambda history, shards, f=exact_dedup.build_index: (seen.append(history.count()), f(history, shards))[1])
    rows = [(i, f"text {i % 30}" if i % 2 else f"own {i}", "en", "s") for i in range(200)]
    out = exact_dedup.dedup(frame(spark, rows)).collect()
    assert seen == [len({t for i, t, *_ in rows[:100]})] and sum(r.kept for r in out) == len({t for _, t, *_ in rows})


def test_fingerprints_against_exact_likeness(spark):
    """The estimate against 2<a,b> / (<a,a> + <b,b>) of the multisets of word runs; long texts included."""
    r = random.Random(12)
    say = lambda k: " ".join(f"w{r.randrange(40 if k % 2 else 4000)}" for _ in range(k))
    docs = [(i, "\n".join(say(r.randrange(5, 40)) for _ in range(r.randrange(1, 8)))) for i in range(80)] + [(80, say(30_001)), (81, say(30_000))]
    got = {x.doc_id: x for x in fingerprints.compare(spark.createDataFrame(docs, "doc_id long, text string")).collect()}

    def runs(text):
        out = Counter()
        for p in text.split("\n"):
            w = re.findall(r"\S{1,24}", p)
            out.update(tuple(w[i : i + 3]) for i in range(len(w)))
        return out

    errors = []
    for k, (i, t) in enumerate(docs):
        nxt = docs[(k + 1) % len(docs)][1]
        q = len(t) // 4
        for other, value in ((t[: len(t) - q] + nxt[:q], got[i].near_edited), (nxt, got[i].near_next)):
            a, b = runs(t), runs(other)
            exact = 2 * sum(a[x] * b[x] for x in a) / (sum(x * x for x in a.values()) + sum(x * x for x in b.values()))
            errors.append(abs(min(1, exact) - value))
    assert np.mean(errors) < 0.08 and max(errors) < 0.4


def test_fingerprints(spark):
    docs = [(i * 3, t) for i, t in enumerate(texts(3, 150))]
    got = {r.doc_id: r for r in fingerprints.compare(spark.createDataFrame(docs, "doc_id long, text string").withColumn("bucket", F.lit(0))).collect()}
    assert len(got) == len(docs)
    by_text = {}
    for k, (i, t) in enumerate(docs):
        t, nxt = t or "", docs[(k + 1) % len(docs)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if t == nxt:
            assert r.near_next == 1
    assert len(set(by_text.values())) == len(by_text)
    long = [r for r in got.values() if r.n_chars > 300]
    assert np.mean([r.near_edited for r in long]) > 0.6 > 0.2 > np.mean([r.near_next for r in long if r.near_next < 1])


def test_fingerprints_are_homomorphic(spark):
    rows = [(1, "a b c\nd e f g"), (2, "d e f g\na b c"), (3, "a b c"), (4, "d e f g"), (5, "a b c\n\nd e f g")]
    v = {r.doc_id: r.vec for r in fingerprints.of_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert v[1] == v[2] != v[5]
    df = spark.createDataFrame([(v[1], v[3], v[4])], "a array<long>, b array<long>, c array<long>")
    r = df.select(fingerprints.add(F.col("b"), F.col("c")).alias("sum"), fingerprints.remove(F.col("a"), F.col("b")).alias("rest")).first()
    assert r["sum"] == v[1] and r["rest"] == v[4]


def test_fingerprint_edges(spark):
    rows = [(7, "x y z\nq"), (7, "x y z\nq"), (None, "n"), (None, None)]
    assert fingerprints.compare(spark.createDataFrame(rows, "doc_id long, text string")).count() == 4
    assert fingerprints.compare(spark.createDataFrame(rows[:1], "doc_id long, text string")).first().near_next == 1
    assert fingerprints.compare(spark.createDataFrame(rows[2:], "doc_id long, text string")).count() == 2
    assert fingerprints.compare(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("mix", [mixing.Mix(), mixing.Mix(percent=60, epochs=1), mixing.Mix(percent=500, epochs=3)])
def test_mixing_against_sql(spark, monkeypatch, mix):
    monkeypatch.setattr(mixing, "CELL_ROWS", 4)
    r = random.Random(9)
    rows = [(i, t, r.choice(["en", "en", "de", None]), r.choice(["src0"] * 6 + [f"src{k}" for k in range(9)] + ["x", None])) for i, t in enumerate(texts(5, 200))]
    rows += [(None, "a b c", "en", "src0"), (4, "a b", "en", "src0"), (4, "a b", "en", "src0")]
    docs = frame(spark, rows)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    want = con.sql(mixing.sql(mix)).fetchall()
    got = [tuple(x) for x in mixing.assign(docs, mix).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert mixing.assign(docs.limit(0), mix).count() == 0
    taken = sum(x[4] * x[6] for x in got)
    total = sum(x[4] for x in got)
    assert taken <= min(total * mix.percent // 100, total * mix.epochs)


def test_mixing_of_very_long_texts_and_rows_without_ids(spark):
    mix = mixing.Mix(percent=50, epochs=1)
    rows = [(1, "w " * 1_000_000, "en", "src0"), (2, "a b", "en", "src0")] + [(None, f"t{i} x", None, None) for i in range(40)]
    got = mixing.assign(frame(spark, rows), mix).collect()
    assert {r.doc_id: r.n_tokens for r in got if r.doc_id} == {1: 1_000_000, 2: 2}
    con = duckdb.connect()
    con.register("documents", frame(spark, rows).toPandas().astype({"doc_id": "Int64"}))
    assert sorted(map(tuple, got), key=str) == sorted(con.sql(mixing.sql(mix)).fetchall(), key=str)
    assert 0 < sum(r.copies for r in got if r.doc_id is None) <= 40


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("web", "en", "a", 10, 1), ("web", "en", "b", 1000, 1), ("press", "en", "c", 1000, 1)], "domain string, lang string, source string, tokens long, docs long")
    mix = mixing.Mix(domains={"web": 1, "press": 1}, sources={"a": 9}, percent=50, epochs=1)
    got = {x["source"]: x["budget"] for x in mixing.budgets(leaves, mix).collect()}
    assert got == {"a": 10, "b": 492, "c": 502}


def test_url_filter(spark):
    urls = ["http://a.example.net/en/1", "http://net/", "http://example.net", "HTTP://X.Example.COM/de/?q", "http://fooexample.com/de/", "https://www.a.org/fr/x", None, "", "no scheme", "http://e.org?utm_source=feed", "http://blog.b.example.com/en/7.html", "http://u.net:80/", "x" * 50_000 + "://net/"]
    rows = list(enumerate(urls)) + [(1, "http://net/"), (None, "http://net/")]
    got = sorted(map(tuple, url_filter.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit(1))).collect()), key=str)

    def want(url):
        url = url or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fit = [(len(h + p), h + p, v) for h, p, v in url_filter.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fit:
            return host, path, max(fit)[1], max(fit)[2]
        hit = {v for p, _, v in url_filter.PATTERN_RULES if re.search(p, url)}
        return host, path, None, "allow" if "allow" in hit or not hit else "block"

    assert got == sorted(((i, *want(u)) for i, u in rows), key=str)
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_filter_is_the_same_for_any_split(spark, tmp_path):
    rows = [(i % 50, f"http://h{i % 7}.example.net/en/{i}.html?utm_source=x" if i % 3 else f"http://a.org/fr/{i}") for i in range(400)]
    spark.createDataFrame(rows, "page_id long, url string").repartition(5).write.parquet(f"{tmp_path}/pages")
    out, least = [], spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (least, "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        judged = url_filter.judge(spark.read.parquet(f"{tmp_path}/pages"))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k" if size == least else least)  # the result is read with another split
        out.append(sorted(map(tuple, judged.collect()), key=str))
        spark.conf.set("spark.sql.files.maxPartitionBytes", least)
    assert out[0] == out[1] and len(out[0]) == 400


def test_toxicity_layers_against_naive_convolution():
    """Embeddings, filters and pooling word by word; texts without words, of one word and next to others."""
    raws = [b"", b"one", b"Some WORDS are here, and \xc3\x9cber 3 more", b"  ", b"x y"]
    data, offsets = np.frombuffer(b"".join(raws), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raws])])
    model = toxicity.Model(3)
    for w in toxicity.WIDTHS:
        model.bias[w] = np.random.default_rng(w).normal(0, 1, toxicity.FILTERS).astype(np.float32)
    got = model.logits(*toxicity.features(data, offsets))
    for raw, z in zip(raws, got):
        words, _ = toxicity.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        e = [sum(model.table[k] for k in word) / len(word) for word in words]
        pooled = []
        for w in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                values = []
                for i in range(len(e) + 1):  # the last place is the blank after the text
                    value = float(model.bias[w][f])
                    for k in range(w):
                        if i + k < len(e):
                            value += float(e[i + k] @ model.filters[w][k][:, f])
                    values.append(value)
                pooled.append(max(0.0, max(values)))
        assert z == pytest.approx(float(np.dot(pooled, model.out) + model.base), abs=1e-4)


def test_toxicity_with_clashing_columns(spark):
    rows = [(i, "vile x" if i % 3 == 0 else f"good y{i}", "en", "s", i, True) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long, rejected boolean").withColumnRenamed("source", "pre.dicted")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    out = toxicity.scored(docs, labels, tuple(c for c in docs.columns if c != "doc_id")).where("NOT _llm_rejected")
    assert {r.doc_id for r in out.collect()} == {i for i in range(300) if i % 3} and {"score", "pre.dicted", "rejected"} <= set(out.columns)


def test_toxicity_held_out(spark):
    r = random.Random(8)
    clean = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(1600):
        toxic = i % 5 == 0
        words = [r.choice(clean) for _ in range(r.randrange(3, 60))]
        if toxic:
            words.insert(r.randrange(len(words)), "vile" + r.choice(["st", "ly", "", "ness", "x"]) + r.choice(["", "!", "."]))
        rows.append((i, " ".join(words), r.choice(["en", "de"]), "s"))
        labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (3, None, None)]
    docs = frame(spark, rows + [(9001, None, None, None), (9002, "", "en", "s"), (None, "w1", "en", "s"), (9003, "w1 " * 60_000, "en", "s")])
    out = toxicity.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == 1604 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in out)
    held = [x for x in out if x.held_out and x.doc_id < 1600]
    assert 300 < len(held) < 500
    wrong = sum(x.predicted != (x.doc_id % 5 == 0) for x in held)
    assert wrong / len(held) < 0.03
    empty = {x.score for x in out if x.doc_id in (9001, 9002)}
    assert len(empty) == 1
    none = toxicity.classify(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {x.score for x in none.collect()} == {0.0}
    assert toxicity.classify(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_toxicity_thresholds_at_the_real_share(spark, monkeypatch):
    """2,400 clean and 800 toxic rows, of which the sample takes 60 and 30: the cuts are those of all other rows at their real share."""
    monkeypatch.setattr(toxicity, "SAMPLE", 30)
    r = random.Random(18)
    rows, labels = [], []
    for i in range(3200):
        toxic = i % 4 == 0
        words = [f"w{r.randrange(200)}" for _ in range(r.randrange(3, 30))]
        if r.random() < (0.8 if toxic else 0.1):
            words.insert(r.randrange(len(words)), r.choice(["vile", "foul", "nasty"]))
        rows.append((i, " ".join(words) + (" w1" * 5000 if i % 97 == 0 else ""), ["en", "en", "de", "xx"][r.randrange(4)] if i % 50 else None, "s"))
        labels.append((i, 1, int(toxic)))
    docs, labelled = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model, fitted = toxicity.fit(docs, labelled)
    assert len(fitted) <= 90
    scored = toxicity.logits(docs, model).collect()
    usable = [x for x in scored if zlib.crc32(str(x.doc_id).encode()) % 4 != toxicity.HELD_OUT]
    total, free = Counter(), Counter()
    for x in usable:
        total[x._llm_lang, x.doc_id % 4 == 0] += 1
        free[x._llm_lang, x.doc_id % 4 == 0] += x.doc_id not in fitted
    counts = toxicity.histogram(spark.createDataFrame(scored, "doc_id long, _llm_lang string, _llm_z double"), labelled, fitted).collect()
    got = {k: sum(c.weight for c in counts if (c.lang, c.toxic == 1) == k) for k in total}
    assert got == pytest.approx(dict(total)) and {k: sum(c.rows for c in counts if (c.lang, c.toxic == 1) == k) for k in total} == dict(free)

    def f1_cut(xs):
        weigh = lambda x: total[x._llm_lang, x.doc_id % 4 == 0] / free[x._llm_lang, x.doc_id % 4 == 0]
        every = sum(weigh(x) for x in xs if x.doc_id % 4 == 0)
        best, hits, n = 0, 0, 0
        for x in sorted(xs, key=lambda x: -x._llm_z):
            n, hits = n + weigh(x), hits + weigh(x) * (x.doc_id % 4 == 0)
            best = max(best, 2 * hits / (n + every))
        return best, lambda cut: 2 * sum(weigh(x) for x in xs if x._llm_z >= cut and x.doc_id % 4 == 0) / (sum(weigh(x) for x in xs if x._llm_z >= cut) + every)

    toxicity.calibrate(model, spark.createDataFrame(scored, "doc_id long, _llm_lang string, _llm_z double"), labelled, fitted)
    logit = lambda p: float(np.log(p / (1 - p)))
    assert set(model.thresholds) == {"en", "de", "xx"}
    for lang, threshold in [(None, toxicity.THRESHOLD), *model.thresholds.items()]:
        best, f1 = f1_cut([x for x in usable if x.doc_id not in fitted and lang in (None, x._llm_lang)])
        assert f1(logit(threshold) - model.shift) > best - 0.01
