"""Functions, gates, sources, runner and streaming on small fixtures."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from sharelens.functions import countries, text
from sharelens.functions.ratios import clip, percent3, ratio, ratio6
from sharelens.operators import audit, consolidate, facts, history, indicators, matching, robustness
from sharelens.params import WindowSpec
from sharelens.schema import ContractError, alias_columns, duplicates, mismatches, missing_keys, out_of_range, overlap, require_cardinality, require_columns, require_unique
from sharelens.sources import api, files
from sharelens.sources.stages import Runner, Skip, Stage
from sharelens.streaming import evidence


def col(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x")).alias("y")).collect()]


def test_dois(spark):
    raw = ["https://doi.org/10.1/Ab", "http://dx.doi.org/10.1/c.", "doi: 10.1/D", " 10.1/e ", "", None, "."]
    assert col(spark, raw, text.doi) == ["10.1/ab", "10.1/c", "10.1/d", "10.1/e", None, None, None]
    assert col(spark, raw[:1], lambda x: text.doi(x, True)) == ["10.1/Ab"]


def test_titles_and_similarity(spark):
    assert col(spark, ["Éa  ñu: x_1!", "", None], text.title_ascii) == ["ea nu x 1", "", None]
    assert col(spark, ["Éa  ñu: x_1!"], text.title_unicode) == ["ea nu x_1"]
    df = spark.createDataFrame([(["a", "b", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(text.set_similarity(F.col("a"), F.col("b"))).collect()] == [0.5, None]
    assert col(spark, ["with data bases x"], text.useful_tokens) == [["data", "bases"]]


def test_text_functions(spark):
    assert col(spark, ["uk", " es ", "NA", "ESP", "", None], text.country_code) == ["GB", "ES", "NA", None, None, None]
    assert col(spark, ["a* ", "A-star", "A", "B", "A*+A"], text.level) == ["A*", "A*", "A", None, "A*+A"]
    assert col(spark, [" a  b ", "nan", "", None], text.squeeze) == ["a b", None, None, None]
    assert col(spark, ["M&uuml;ller &amp; &quot;x&quot;&nbsp;y"], text.entities) == ['Müller & "x" y']
    assert col(spark, ["http://a; b|https://c x"], text.links) == [["http://a", "https://c"]]
    assert col(spark, ["https://WWW.a.org:80/x", "nothing"], text.host) == ["www.a.org", ""]
    assert col(spark, ["x.a.org", "ba.org", "a.org"], lambda h: text.host_allowed(h, ("a.org",))) == [True, False, True]
    pairs = spark.createDataFrame([("http://h.org/a/b", "c"), ("http://h.org", "c"), ("http://h.org/a/b", "/c"), ("http://h.org/a", "http://z")], "a string, b string")
    assert [r[0] for r in pairs.select(text.absolute(F.col("a"), F.col("b"))).collect()] == ["http://h.org/a/c", "http://h.org/c", "http://h.org/c", "http://z"]
    assert col(spark, ["Sí", "1", "no", None], text.truth) == [True, True, False, False]
    assert col(spark, ["Big Workshop Companion"], lambda x: text.hits(x, ("companion", "workshop", "z"))) == ["companion;workshop"]
    assert col(spark, ['{"k": {"value": "v"}, "j": "w"}'], lambda x: F.array(text.content(text.parsed(x), "k"), text.content(text.parsed(x), "j"))) == [["v", "w"]]
    assert col(spark, [["http://x", "https://arxiv.org/abs/1234.5678v2", "https://doi.org/10.1/a"]], lambda x: F.array(text.first_doi(x), text.first_arxiv(x)), "array<string>") == [["https://doi.org/10.1/a", "1234.5678"]]
    both = spark.createDataFrame([("accept (oral)", ""), ("Rejected, was accept", "V"), (None, "V"), (None, None)], "d string, v string")
    assert [r[0] for r in both.select(text.accepted(F.col("d"), F.col("v"))).collect()] == [True, False, True, False]
    keys = spark.createDataFrame([("conf/cade", "x ijcar y"), ("conf/cade", "z"), ("conf/x", "ijcar")], "p string, t string")
    assert [r[0] for r in keys.select(text.route(F.col("p"), F.col("t"), "conf/cade", {"IJCAR": ("ijcar",)}, "CADE")).collect()] == ["IJCAR", "CADE", None]


def test_countries(spark):
    raw = ["Dept, Univ, Germany", "es", "Indiana University", "x", "SPAIN", None]
    assert col(spark, raw, countries.infer) == ["DE", "ES", "IN", None, "ES", None]
    assert col(spark, raw, lambda x: countries.infer(x, strict=True)) == ["DE", "ES", None, None, "ES", None]


def test_ratios(spark):
    df = spark.createDataFrame([(1, 3), (1, 0), (None, 2)], "a int, b int")
    assert [tuple(r) for r in df.select(ratio6("a", "b"), percent3("a", "b")).collect()] == [(0.333333, 33.333), (None, None), (None, None)]
    assert [r[0] for r in df.select(clip(F.col("b"), 1, 2)).collect()] == [2, 1, 2]


def test_windows(spark):
    w = WindowSpec(((2001, 2005), (2006, 2010)))
    assert col(spark, [2000, 2001, 2005, 2006, 2011, None], w.of, "int") == [None, "2001-2005", "2001-2005", "2006-2010", None, None]


def test_gates(spark):
    df = spark.createDataFrame([(1, "a", "2001"), (1, "b", "x"), (2, None, "1999")], "k int, v string, y string")
    with pytest.raises(ContractError):
        require_columns(df, "k", "z")
    with pytest.raises(ContractError):
        require_unique(df, "k")
    with pytest.raises(ContractError):
        require_cardinality(df, "k", {1: 1})
    assert require_cardinality(df, "k", {1: 2, 2: 1}) is df
    assert duplicates(df, "k").count() == 1
    assert out_of_range(df, F.col("y"), 2000, 2005).count() == 2
    assert overlap(df, spark.createDataFrame([(2,)], "k int"), "k").count() == 1
    dim = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert [r.v for r in mismatches(df, dim, ["k"], ["v"]).collect()] == ["b"]
    assert missing_keys(df, dim.where("k = 1"), ["k"]).collect()[0].k == 2
    assert "venue" in alias_columns(df, {"venue": ("v",)}).columns


@pytest.fixture
def corpus(spark):
    papers = spark.createDataFrame([(1, 2001, "a", "V1"), (2, 2001, "a", "V1"), (3, 2002, "b", "V2"), (4, 2002, None, "V3")], "paper_id long, year int, win string, venue string").withColumn("area", F.col("win"))
    pc = spark.createDataFrame([(1, "F", True, True), (1, "B", True, False), (1, "X", False, False), (2, "B", True, False), (3, "X", False, False)], "paper_id long, country string, is_bloc boolean, is_focal boolean")
    return papers, pc


def test_fact_and_invariants(spark, corpus):
    papers, pc = corpus
    f = facts.paper_fact(papers, pc)
    m = {r.win: r for r in facts.basic_metrics(f, "win").collect()}
    assert (m["a"].total, m["a"].resolved, m["a"].bloc, m["a"].focal, m["a"].share_bloc) == (2, 2, 2, 1, 0.5)
    assert (m["b"].bloc, m["b"].share_bloc, m[None].resolved, m[None].share_world) == (0, None, 0, None)
    full = pc.join(papers, "paper_id")
    got = {(r.country): (r.complete, r.fractional) for r in indicators.fractional(full, "win").collect()}
    assert got == {"F": (1, 0.333333), "B": (2, 1.333333)}
    parts = robustness.shift_share(robustness.segments(f, "area"), "a", "b", "area")
    s = robustness.shift_share_summary(parts).first()
    assert abs(s.composition + s.performance + s.interaction - (s.share1 - s.share0)) < 1e-8
    assert {r.partner: r.papers for r in indicators.partners(f, "F", "win").collect()} == {"B": 1, "X": 1}


def test_ranks_share_the_minimum(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", 3), ("d", None)], "k string, v int")
    assert {r.k: r.r for r in df.select("k", indicators.rank_min("v").alias("r")).collect()} == {"a": 1, "b": 1, "c": 3, "d": None}


def test_trends(spark):
    w = WindowSpec(((1, 1), (2, 2), (3, 3)))
    rows = [(c, f"{i + 1}-{i + 1}", s / 100) for c, v in {"up": (10, 10, 11), "down": (11, 5, 10), "mixed": (10, 12, 10.5), "stable": (10, 10.9, 10.99)}.items() for i, s in enumerate(v)]
    out = indicators.trends(spark.createDataFrame(rows, "country string, win string, share double"), w)
    assert all(r.trend == r.country for r in out.collect())


def test_percentiles_and_z(spark):
    rows = [(1, "v", 1, 1.0), (2, "v", 1, 1.0), (3, "v", 1, 5.0), (4, "u", 1, 2.0), (5, "v", 1, None)]
    out = {r.paper_id: r for r in indicators.impact_scores(spark.createDataFrame(rows, "paper_id int, venue string, year int, c double"), "c").collect()}
    assert out[4].z is None and out[4].percentile == 1.0 and out[5].percentile is None
    assert out[1].percentile == out[2].percentile


def test_as_of(spark):
    h = spark.createDataFrame([("v", 2005, "A"), ("v", 2010, "A*"), ("w", 2010, "A")], "venue string, core_year int, level string")
    p = spark.createDataFrame([(1, "v", 2004), (2, "v", 2005), (3, "v", 2009), (4, "v", 2030), (5, "x", 2009), (6, "w", 2010)], "paper_id int, venue string, year int")
    got = {r.paper_id: (r.hist_level, r.hist_year, r.fallback) for r in history.as_of(p, h).collect()}
    assert got == {1: ("A", 2005, True), 2: ("A", 2005, False), 3: ("A", 2005, False), 4: ("A*", 2010, False), 5: (None, None, True), 6: ("A", 2010, False)}


def test_inference_truth_table(spark):
    rows, want = [], {}
    for b in ("A*", "A", "-"):
        for a in ("A*", "A", "-"):
            v = f"{b}{a}"
            rows += [(v, 2010, "A*+A")] + [(v, y, x) for y, x in ((2008, b), (2013, a)) if x != "-"]
            want[v] = "-" if b == a == "-" else "A*" if "-" not in (a, b) and "A*" in (a, b) else "A"
    out = history.infer_undifferentiated(spark.createDataFrame(rows, "venue string, core_year int, level string"), 2010, 2008, 2013)
    assert {r.venue: r.level_inferred for r in out.collect()} == want


def test_expansion_status(spark):
    rows = [("n", "a", False, False), ("n", "b", True, True), ("g", "a", True, False), ("g", "b", False, False), ("z", "a", False, False), ("z", "b", False, False), ("o", "b", True, False)]
    f = spark.createDataFrame(rows, "venue string, win string, has_bloc boolean, has_focal boolean").withColumn("resolved", F.lit(True))
    assert {r.venue: r.status for r in robustness.expansion(f, "a", "b").collect()} == {"n": "new", "g": "gone", "z": "both", "o": "new"}


def test_bootstrap_is_seeded(spark):
    rows = [("w", f"v{i}", y, i % 3, 1 + i % 4, 5) for i in range(20) for y in (1, 2)]
    c = spark.createDataFrame(rows, "win string, venue string, year int, focal long, bloc long, articles long")
    a, b = (robustness.bootstrap(c, "win", 200).collect() for _ in range(2))
    assert a == b and a[0].low < a[0].share < a[0].high


def test_matching(spark):
    p = spark.createDataFrame([(1, "en", "a b c d e f g"), (2, "en", "q"), (3, "de", "a b c d e f g"), (4, "en", "")], "paper_id long, lang string, title string")
    w = spark.createDataFrame([(9, "en", "a b c d e f g"), (8, "en", "a b c d e f h"), (7, "en", "a b c d e f g"), (6, "en", "")], "work_id long, lang string, title string")
    assert [tuple(r) for r in matching.exact_match(p, w, ["lang"]).collect()] == [(1, 7)]
    assert [tuple(r) for r in matching.fuzzy_match(p, w, ["lang"], 0.85).collect()] == [(1, 7, 1.0)]
    assert [tuple(r)[:2] for r in matching.fuzzy_match(p, w.where("work_id = 8"), ["lang"], 0.85).collect()] == [(1, 8)]
    src = spark.createDataFrame([("v", "a b", "a b c", "journal", 1), ("v", "a b", "a b d", "conference", 2), ("v", "a b", "z", "conference", 3)], "venue string, want string, title string, type string, source_id int")
    assert matching.best_source(src).first().source_id == 2
    rec = spark.createDataFrame([("conf/a/x",), ("conf/b/y",)], "key string")
    assert matching.prefix_filter(rec, "key", spark.createDataFrame([("conf/a",)], "prefix string")).count() == 1


def test_title_search_is_not_broadcast(spark, tmp_path):
    """Titles computed from a small file are many times its size: the estimate is below the threshold, what a broadcast would hold is above it."""
    spark.range(4000).write.parquet(f"{tmp_path}/t")
    papers = spark.read.parquet(f"{tmp_path}/t").selectExpr("id AS paper_id", "repeat(concat('t', id, ' '), 50) AS title", "2000 AS year")
    hits = papers.selectExpr("paper_id", "stack(4, 1, 10 * paper_id, 'none of it', year, 2, 10 * paper_id + 1, title, year + 1, 3, 10 * paper_id + 2, title, year, 6, 10 * paper_id + 3, title, year) AS (place, work_id, title, year)")
    estimate, real = int(papers._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()), papers.selectExpr("sum(length(title))").first()[0]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(2 * estimate))
        found = matching.title_search(papers, hits)
        rows = found.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert real > 2 * estimate and "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(map(tuple, rows)) == [(i, 10 * i + 1, 1.0) for i in range(4000)]


def test_consolidation(spark):
    rows = [(1, "ES", "B", "m2", 2), (1, "ES", "A", "m1", 1), (1, "ES", "A", "m1", 1), (1, "ES", "C", "nan", 3)]
    r = consolidate.consolidate(spark.createDataFrame(rows, "paper_id int, country string, source string, method string, priority int")).first()
    assert (r.sources, r.methods, r.n_sources, r.best_priority) == ("A|B|C", "m1|m2", 3, 1)


def test_surrogate_keys(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k")).repartition(7)
    got = audit.surrogate_keys(df, ["k"]).orderBy("k").collect()
    assert [r.key for r in got] == [f"P{i:07d}" for i in range(1, 501)]
    assert audit.text_report(df.where("k < 2"), "<%d>", "k", order=("k",)) == "<0>\n<1>"


DUMP = """<?xml version="1.0"?><dblp><inproceedings key="conf/a/1"><author>M&uuml;ller</author><author>B</author><title>On <i>x</i> things</title><year>2001</year><booktitle>A</booktitle><ee>https://arxiv.org/abs/1.2v3</ee><ee>https://doi.org/10.1/Z</ee></inproceedings>
<article key="j/1"><author>C &amp; D</author><title>T</title><year>bad</year><journal>J</journal></article></dblp>"""


def test_dump(spark, tmp_path):
    (tmp_path / "d.xml").write_bytes(DUMP.replace("B<", "é<").encode("iso-8859-1"))
    rows = {r.dblp_key: r for r in files.read_dump(spark, str(tmp_path / "d.xml")).collect()}
    r = rows["conf/a/1"]
    assert (r.authors, r.title, r.year, r.doi, r.arxiv_id) == ("Müller; é", "On x things", 2001, "10.1/z", "1.2")
    assert (rows["j/1"].booktitle, rows["j/1"].year, rows["j/1"].authors) == ("J", None, "C & D")


def test_compressed_dump(spark, tmp_path):
    import gzip

    more = '<book key="b/1"><author>X</author><title>B</title></book>\n<proceedings key="conf/a/2001"><title>P</title><year>2001</year></proceedings>\n'
    body = DUMP.replace("B<", "é<").replace("<article", more + "<article").encode("iso-8859-1")
    (tmp_path / "d.xml").write_bytes(body)
    with gzip.open(tmp_path / "d.xml.gz", "wb") as f:
        f.write(body)
    plain, packed = (sorted(map(tuple, files.read_dump(spark, str(tmp_path / n)).drop("links").collect())) for n in ("d.xml", "d.xml.gz"))
    assert plain == packed and [r[0] for r in plain] == ["conf/a/1", "j/1"] and plain[0][2] == "Müller; é"


FORMS = """<?xml version="1.0"?>
<!DOCTYPE dblp><dblp>
<article key="k/1" mdate="2020-01-02"><title>One</title></article><article mdate='x' key='k/2'><title>Two</title></article>
<article
key="k/3"
>
<title>Thr&eacute;e <sub>3</sub></title></article>
<articles key="no"><title>other</title></articles>
<inproceedings key = 'a key="b"'><title>Four</title><url>x?key="z"</url></inproceedings><www key="w"><author>X</author></www>
<article key='k/5' note=">"><title>Five</title></article><article/>
<article key="k/6"><title>never ends</title>
<article key="k/7"><title>Seven</year></article>
<inproceedings key="k/8"><title>Eight</title></inproceedings>
</dblp>
"""


def test_records_in_any_form_wherever_files_are_split(spark, tmp_path):
    import gzip

    body = FORMS.replace("One", "Öne").encode("iso-8859-1")
    (tmp_path / "d.xml").write_bytes(body)
    with gzip.open(tmp_path / "d.xml.gz", "wb") as f:
        f.write(body)
    want = [("a key=\"b\"", "Four", False), ("k/1", "Öne", False), ("k/2", "Two", False), ("k/3", "Thrée 3", False), ("k/5", "Five", False), ("k/8", "Eight", False), (None, None, False), (None, None, True), (None, None, True)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("128m", "400b", "97b", "31b", "7b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            for name in ("d.xml", "d.xml.gz"):
                got = files.read_dump(spark, str(tmp_path / name)).select("dblp_key", "title", "bad").collect()
                assert sorted(map(tuple, got), key=str) == sorted(want, key=str), (size, name)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
        rows = files.read_elements(spark, str(tmp_path / "d.xml"), ("article", "inproceedings"), "iso-8859-1", longest=60)
        assert rows.where("bad").count() > 3 and "Öne" not in "".join(r.xml for r in rows.where("not bad").collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_late_accent_tells_the_encoding(spark, tmp_path):
    lines = "".join(f"{i};{'Universität Zürich' if i == 900 else 'University'};x{i}\n" for i in range(1000))
    for encoding in ("iso-8859-1", "utf-8"):
        (tmp_path / f"{encoding}.csv").write_bytes(("id;name;code\n" + lines).encode(encoding))
        df = files.read_csv_flex(spark, str(tmp_path / f"{encoding}.csv"))
        assert df.count() == 1000 and df.where("id = 900").first().name == "Universität Zürich"


def test_sniffing_reads_the_head_only(spark, tmp_path):
    (tmp_path / "big.csv").write_text("id;name;code\n" + "".join(f"{i};n{i};c{i}\n" for i in range(50_000)))
    assert len(files.head(spark, str(tmp_path / "big.csv"), 100)) == 100
    assert files.read_csv_flex(spark, str(tmp_path / "big.csv")).count() == 50_000


def test_paper_fact_shuffles_once_by_paper(spark):
    papers = spark.range(100).selectExpr("id AS paper_id", "id % 3 AS venue")
    rows = spark.range(400).selectExpr("id % 90 AS paper_id", "concat('C', id % 7) AS country", "id % 7 < 3 AS is_bloc", "id % 7 = 1 AS is_focal")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = facts.paper_fact(papers, rows)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 2  # one of each side, both by paper


def test_logit_of_cells_is_the_one_of_rows(spark):
    import numpy as np

    r = np.random.default_rng(5)
    g, h = r.integers(0, 3, 900), r.integers(0, 2, 900)
    y = r.random(900) < 1 / (1 + np.exp(-(0.3 + 0.8 * (g == 1) - 0.5 * (g == 2) - 0.7 * h)))
    df = spark.createDataFrame([("abc"[a], float(b), bool(c)) for a, b, c in zip(g, h, y)], "g string, h double, resolved boolean")
    got = {x.term: (x.coefficient, x.std_error) for x in robustness.logit(robustness.missingness_cells(df, "g", "h"), "share ~ g + h", weight="n").collect()}
    x = np.stack([g == 1, g == 2, h, np.ones(900)], axis=1).astype(float)
    beta = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        info = x.T @ (x * (p * (1 - p))[:, None])
        beta += np.linalg.solve(info, x.T @ (y - p))
    error = np.sqrt(np.diag(np.linalg.inv(info)))
    names = {k: next(t for t in got if t.endswith(k)) for k in ("b", "c", "h", "intercept")}
    assert [got[names[k]] for k in names] == [pytest.approx(x, rel=1e-4) for x in zip(beta, error)]


def test_bootstrap_blocks(spark):
    cl = spark.createDataFrame([("w", f"v{i}", 2000, i % 5, 5 + i % 7, 10) for i in range(40)], "win string, venue string, year int, focal long, bloc long, articles long")
    one = robustness.bootstrap(cl, "win", replicates=230).first()
    assert one.clusters == 40 and one.low < one.share < one.high and one.sd > 0
    assert robustness.bootstrap(cl.repartition(7), "win", replicates=230).first() == one


def test_titles_of_any_script(spark):
    import unicodedata

    same = [("Зимний", "зимнии"), ("ΐδιος", "ιδιος"), ("한국어", unicodedata.normalize("NFD", "한국어")), ("Ngữ pháp", "ngu phap"), ("Café", "cafe\u0301"), ("ÅNGSTRÖM", "angstrom")]
    df = spark.createDataFrame(same + [("a", "b"), ("и", "ы")], "a string, b string")
    assert [r[0] for r in df.select(text.same_title(F.col("a")) == text.same_title(F.col("b"))).collect()] == [True] * len(same) + [False, False]
    left, right = df.select(text.same_title(F.col("a")).alias("t"), "a"), df.select(text.same_title(F.col("b")).alias("t"), "b")
    assert left.join(right, "t").count() == len(same) and left.select("t").union(right.select("t")).distinct().count() == len(same) + 4


def test_first_words_hold_what_is_asked_for(spark):
    import random

    r = random.Random(6)
    texts = ["".join(r.choice("abé1 .,\n\u0301ß漢-") for _ in range(r.randrange(200))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    cut = lambda c: F.slice(text.tokens(text.title_ascii(c)), 1, 5)
    rows = df.select(cut(F.col("t")).alias("a"), cut(text.first_words(F.col("t"), 5)).alias("b"), (F.length(text.first_words(F.col("t"), 5)) < F.length("t")).alias("c")).collect()
    assert all(x.a == x.b for x in rows) and sum(x.c for x in rows) > 50


def test_whole_entity_table(spark):
    assert col(spark, ["&NotEqualTilde;&lang;&nope; R&D &amp;lt;", "no entity", None], text.entities) == ["≂̸⟨&nope; R&D &lt;", "no entity", None]
    assert len(text.html_names()) > 2000


def test_nothing_is_left_out_in_silence(spark, tmp_path):
    endless = api.paged(lambda i, y, c: (["1"], "next"), pages=3)
    with pytest.raises(api.TooManyPages):
        endless(["s|2001"])
    with pytest.raises(ValueError, match="more than 5 lines"):
        audit.text_report(spark.range(6).withColumnRenamed("id", "k"), "%d", "k", order=("k",), most=5)
    page = "".join(f"<a href='/pdf/{i}'>x</a>" for i in range(30))
    rows = spark.createDataFrame([(page, "http://a.org/x")], "p string, u string")
    assert rows.select(F.size(text.pdf_links(F.col("p"), F.col("u"), ("a.org",)))).first()[0] == 30


def test_least_priority(spark):
    rows = [(1, "x", 2), (1, "y", 1), (1, "z", 1), (1, "z", 1), (2, "x", 3), (3, None, 1)]
    got = matching.best_priority(spark.createDataFrame(rows, "k int, v string, p int"), "k", "p", "v").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 1, "y"), (1, 1, "z"), (2, 3, "x"), (3, 1, None)]


def test_a_note_is_parsed_once(spark):
    notes = spark.createDataFrame([('{"id": "n", "content": {"title": {"value": "T"}, "authorids": ["~a", "~b"]}}',), ("not json",)], "value string")
    df = files.read_notes(notes)
    assert [(r.note_id, r.title, r.authors) for r in df.collect()] == [("n", "T", ["~a", "~b"])]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_many_files_by_their_footers(spark, tmp_path):
    base = str(tmp_path / "m")
    spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).repartition(120).write.parquet(f"{base}/a")
    spark.range(50).select(F.col("id").alias("k")).repartition(30).write.parquet(f"{base}/b")
    spark.range(60).select(F.lit("x").alias("w"), F.col("id").alias("v"), F.col("id").alias("k")).repartition(20).write.parquet(f"{base}/c")
    paths = files.parquet_files(spark, base)
    df = files.read_matching(spark, paths, {"k", "v"})
    assert len(paths) > 150 and df.count() == 360 and df.where("w = 'x'").count() == 60
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2


def test_links_in_either_quotes(spark):
    page = "<a class='v' href='/a'>2001 x</a> <A HREF = \"/b\">vol 1999</A> <a href='/c'>no year</a>"
    got = files.volume_links(spark.createDataFrame([(page,)], "html string")).collect()
    assert [(r.href, r.year) for r in got] == [("/a", 2001), ("/b", 1999)]


def test_draws_are_poisson_and_depend_on_their_key_alone(spark):
    df = spark.range(40_000).select("id", robustness.draw(F.lit("seed"), F.col("id").cast("string")).alias("n"))
    share = {r.n: r["count"] / 40_000 for r in df.groupBy("n").count().collect()}
    want = {0: 0.3679, 1: 0.3679, 2: 0.1839, 3: 0.0613, 4: 0.0153}
    assert all(abs(share[k] - p) < 0.01 for k, p in want.items()) and max(share) < 12
    assert sorted(df.repartition(7).collect()) == sorted(df.collect())


def test_fitted_totals_are_the_observed_ones(spark):
    rows = [("abc"[i % 3], "xy"[i % 2], (i * 7 % 11) / 11, 1.0 + i % 4) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, h string, share double, n double")
    out = {r.term: r for r in robustness.logit_totals(df, "share ~ g + h", weight="n").collect()}
    assert set(out) == {"g_b", "g_c", "h_y", "intercept"}
    assert all(r.fitted == pytest.approx(r.observed, abs=1e-6) for r in out.values())
    assert out["g_b"].observed == pytest.approx(sum(n * s for g, _, s, n in rows if g == "b"))


def test_a_hundred_thresholds_scan_once(spark):
    rows = [(f"v{i % 7}", f"w{i % 3}", i % 5 != 0 or i % 7 == 1, i % 4 == 0, ["X"] * (i % 4 == 0) + ["Y"] * (i % 8 == 0)) for i in range(700)]
    f = spark.createDataFrame([(v, w, r, b and r, c if r else None) for v, w, r, b, c in rows], "venue string, win string, resolved boolean, has_bloc boolean, bloc_countries array<string>")
    countries = spark.createDataFrame([("X",), ("Y",), ("Z",)], "country string")
    cuts = tuple(k / 100 for k in range(1, 101))
    out = robustness.threshold_sensitivity(f, cuts, countries)
    cells = {}
    for v, w, r, b, c in rows:
        cells.setdefault((v, w), []).append((r, b and r, c if r else []))
    want = {}
    for t in cuts:
        for w in ("w0", "w1", "w2"):
            own = [x for (v, u), xs in cells.items() if u == w and sum(r for r, _, _ in xs) / len(xs) >= t for x in xs]
            if own:
                want |= {(t, w, k): (sum(b for _, b, _ in own), sum(k in c for _, _, c in own)) for k in "XYZ"}
    assert {(r.threshold, r.win, r.country): (r.bloc, r.papers) for r in out.collect()} == want


def test_windows_can_be_strict(spark):
    w = WindowSpec(((1, 2),))
    assert col(spark, [1, 2, 3, None], w.of, "int") == ["1-2", "1-2", None, None]
    with pytest.raises(Exception, match="no window has the year 3"):
        col(spark, [1, 3], lambda y: w.of(y, strict=True), "int")


def test_cardinality(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    assert require_cardinality(df, "k", {"a": 2, "b": 1, None: 1}) is df
    with pytest.raises(ContractError, match="'b', 1, 0"):
        require_cardinality(df, "k", {"a": 2, None: 1})


def test_csv_sources(spark, tmp_path):
    (tmp_path / "r.csv").write_text('1,"Conf, A",AAA,CORE,A*,Yes,46,,\n2,Conf B, BBB ,CORE,A*,Yes,46,,\n3,No acronym,,CORE,A*,,,,\n')
    assert [r.acronym for r in files.read_ranking(spark, str(tmp_path / "r.csv"), "A*").collect()] == ["AAA", "BBB"]
    with pytest.raises(ContractError):
        files.read_ranking(spark, str(tmp_path / "r.csv"), "A")
    (tmp_path / "s.csv").write_bytes("Título;Sigla;Nivel\nInformática;INF;A\nDatos;DAT;B\n".encode("cp1252"))
    df = files.read_csv_flex(spark, str(tmp_path / "s.csv"))
    assert df.columns == ["Título", "Sigla", "Nivel"] and files.guess_venue_column(df) == "Sigla"
    (tmp_path / "h.csv").write_text("1,Conf A,AAA,CORE2008\n2,Conf B,BBB,ERA2010\n")
    assert files.looks_headerless(files.read_csv_flex(spark, str(tmp_path / "h.csv")))


def test_documents(spark):
    work = json.dumps({"id": "w", "doi": "https://doi.org/10.1/A", "authorships": [{"author": {"id": "a"}, "institutions": [{"display_name": "I", "country_code": "es"}]}, {"institutions": []}]})
    got = files.work_countries(spark.createDataFrame([(work,), ("bad",)], "value string")).collect()
    assert [tuple(r) for r in got] == [("10.1/a", 1, "I", "ES")]
    item = json.dumps({"DOI": "10.1/B", "author": [{"affiliation": [{"name": "U, Spain"}]}]})
    assert [tuple(r) for r in files.crossref_affiliations(spark.createDataFrame([(item,)], "value string")).collect()] == [("10.1/b", "U, Spain", "ES")]
    vol = "<v:vol><v:paper><v:title>Front Matter</v:title></v:paper><paper><title>T</title><affiliation>X, Italy</affiliation><affiliation>es</affiliation></paper></v:vol>"
    assert [tuple(r) for r in files.volume_titles(spark.createDataFrame([(vol,)], "xml string")).collect()] == [("T", ["ES", "IT"], 2)]
    page = '<a class="x" href="/v/1"><b>Volume 1, 2019</b></a><a href="/x">none</a>'
    assert [tuple(r) for r in files.volume_links(spark.createDataFrame([(page,)], "html string")).collect()] == [("/v/1", "Volume 1, 2019", 2019)]


def test_cache_and_api(spark, tmp_path):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 1)], "k string, v string, t int")
    new = spark.createDataFrame([("a", None, 2)], "k string, v string, t int")
    assert {r.k: r.v for r in files.upsert(old, new, "k", "t").collect()} == {"a": None, "b": "y"}
    keys = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "doi string")
    got = {r.key: (r.body, r.status) for r in api.fetch(keys, "doi", lambda ks: {k: k.upper() for k in ks if k == "a"}).collect()}
    assert got == {"a": ("A", "found"), "b": (None, "absent")}

    def broken(ks):
        raise OSError

    assert {r.status for r in api.fetch(keys, "doi", broken, retries=2, pause=0).collect()} == {"failed"}
    pages = {None: (["1"], "c"), "c": (["2"], None)}
    assert api.paged(lambda i, y, c: pages[c])(["s|2001"]) == {"s|2001": "[1,2]"}
    p1, p2 = str(tmp_path / "1"), str(tmp_path / "2")
    old.write.parquet(p1)
    keys.write.parquet(p2)
    assert files.read_matching(spark, [p1, p2], {"k", "v"}).count() == 2
    assert files.read_matching(spark, [p2], {"k"}) is None
    assert files.optional(spark, str(tmp_path / "no"), old) is old


def test_runner(spark, tmp_path):
    def skip(frames):
        raise Skip("absent")

    stages = [Stage("one", lambda f: spark.range(3)), Stage("two", lambda f: f["one"].where("id > 0"), ("one",)), Stage("none", skip), Stage("after", lambda f: f["none"], ("none",)), Stage("bad", lambda f: spark.sql("SELECT nothing"), optional=True)]
    out = {r.name: r.status for r in Runner(spark, str(tmp_path), stages).run().collect()}
    assert out == {"one": "OK", "two": "OK", "none": "SKIPPED", "after": "SKIPPED", "bad": "OPTIONAL_FAILED"}
    again = {r.name: r.status for r in Runner(spark, str(tmp_path), stages[:2]).run().collect()}
    assert again == {"one": "CACHED", "two": "CACHED"}


def test_streaming(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(1, t, "a", 1.0), (1, t, "a", 1.0), (2, t, "b", 2.0)]
    src = str(tmp_path / "in")
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    df.write.parquet(src)
    s = evidence.counts(evidence.deduplicated(evidence.read(spark, src, df.schema)))
    q = s.writeStream.format("memory").queryName("ev").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert {(r.event_type, r.rows) for r in spark.table("ev").collect()} == {("a", 1), ("b", 1)}


def test_profiles(spark):
    p = spark.createDataFrame([(1, "x", 2005), (2, "x", 1990), (3, "y", 2020)], "paper_id int, author string, year int")
    h = spark.createDataFrame([("x", 2000, 2006, "ES"), ("x", 2004, None, None), ("x", 2001, 2003, "DE"), ("y", 2000, 2001, "FR")], "author string, start int, end int, country string")
    assert {r.paper_id: (r.country, r.kind) for r in matching.profile_lookup(p, h).collect()} == {1: ("ES", 0), 2: ("DE", 2), 3: ("FR", 1)}


def test_ratio_of_strings_is_an_error_only_for_text(spark):
    assert spark.range(1).select(ratio(F.lit(1), F.lit(4))).first()[0] == 0.25
