"""The pipeline's stages against brute force on a small table."""

import random
import re
import zlib

import corpus_pipeline as pipe
from sharelens.llm import exact_dedup, jaccard_join, mixing


def test_stages(spark, tmp_path):
    vocabulary = [f"word{i}" for i in range(300)]
    say = lambda k, n: " ".join(random.Random(k).choices(vocabulary, k=60)[:n])
    rows = []
    for i in range(1200):
        text = say(i, 30)
        if i % 4 == 0:
            text = "vilest " + text
        rows.append((i, text, "en" if i % 3 else "de", f"src{i % 5}", len(text)))
    rows += [(2000, say(1, 30), "en", "src1", 1), (2001, say(1, 30).replace(" ", "\n"), "en", "src1", 1), (2002, say(2, 29), "en", "src2", 1), (2003, None, None, None, None), (2004, "", "en", "src0", 0)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(1200)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in pipe.STAGES:
        out = stage(spark, docs, d)
        if name != "BPE":
            assert out.columns == docs.columns
            out.write.parquet(f"{d}/{name}")
            docs = spark.read.parquet(f"{d}/{name}")
            kept.append({r.doc_id: r.text for r in docs.collect()})
    held = {i for i in range(1200) if zlib.crc32(str(i).encode()) % 4 == 2}
    clean = {r[0] for r in rows if not (r[1] or "").startswith("vile")}
    assert len(clean - set(kept[0])) <= 9 and len({i for i in set(kept[0]) - clean}) <= 9 and held
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for i, t in sorted(kept[0].items()):
        first.setdefault(norm(t), i)
    assert set(kept[1]) == set(first.values())
    assert {2000, 2001} & set(kept[1]) == set() and 1 in kept[1]
    assert 2002 not in kept[2] and 2 in kept[2] and set(kept[1]) - set(kept[2]) == {2002}
    assert set(kept[3]) <= set(kept[2]) and len(kept[3]) > 0.6 * len(kept[2])
    final = pipe.run(spark, d)
    assert {r.doc_id for r in final.collect()} == set(kept[3])
    assert final.columns[:4] == ["doc_id", "lang", "source", "n_tokens"]
    assert exact_dedup and jaccard_join and mixing


def test_dedups_keep_one_row_of_each_group(spark):
    say = lambda k, n=60: " ".join(random.Random(k).choices([f"word{i}" for i in range(300)], k=60)[:n])
    rows = [
        *[(1, say(1))] * 3,  # repeated rows
        (2, say(2)), (3, say(2)), (3, say(3)), (3, say(4)),  # id 3: one row is a copy of 2, the others stand alone
        (None, say(5)), (None, say(5)), (None, say(6)), (None, say(1)), (None, say(7)), (7, say(7)),
        (8, say(8)), (None, say(8, 58)), (9, say(8, 59)), (9, say(9)), (None, say(10)), (None, say(10, 59)),
        (20, None), (20, None), (None, ""),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    once = pipe.drop_copies(spark, docs, "")
    assert once.columns == docs.columns
    exact = [(1, say(1)), (2, say(2)), (3, say(3)), (3, say(4)), (None, say(5)), (None, say(6)), (7, say(7)), (8, say(8)), (None, say(8, 58)), (9, say(8, 59)), (9, say(9)), (None, say(10)), (None, say(10, 59)), (20, "")]
    assert sorted(((r.doc_id, r.text or "") for r in once.collect()), key=str) == sorted(exact, key=str)
    got = [(r.doc_id, r.text or "") for r in pipe.drop_near_copies(spark, once, "").collect()]
    near = [x for x in exact if x[1] not in (say(8, 58), say(8, 59), say(10), say(10, 59))]
    assert sorted((x for x in got if x[1] not in (say(10), say(10, 59))), key=str) == sorted(near, key=str) and len(got) == len(near) + 1
    # empty texts link with nothing, so the join alone keeps them
    alone = [(r.doc_id, r.text or "") for r in pipe.drop_near_copies(spark, docs, "").collect()]
    assert sorted((x for x in alone if x[1] and x[1] not in (say(10), say(10, 59))), key=str) == sorted((x for x in near if x[1]), key=str) and len(alone) == len(near) + 3
    assert pipe.drop_copies(spark, docs.limit(0), "").count() == 0


def test_stages_with_clashing_columns_nulls_and_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    words = lambda k: " ".join(random.Random(k).choices([f"word{i}" for i in range(300)], k=40))
    rows = [(i if i % 9 else None, ("vilest " if i % 4 == 0 else "") + words(i), "en", None if i % 7 == 0 else f"src{i % 3}", i, 0.5, True, "x", i, i) for i in range(240)] + [(5, words(5), "en", "s", 1, 0.5, False, "y", 1, 2)] * 2 + [(None, None, None, None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, rejected boolean, tokens string, bucket int, digest long"
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    for name, table in (("full", rows), ("none", [])):
        docs = spark.createDataFrame(table, schema)
        for k, (_, stage) in enumerate(pipe.STAGES):
            out = stage(spark, docs, d)
            if k < len(pipe.STAGES) - 1:
                assert out.columns == docs.columns
            out.write.parquet(f"{d}/{name}-{k}")
            before, docs = docs, spark.read.parquet(f"{d}/{name}-{k}")
            assert docs.count() <= before.count() and (docs.count() > 50 or name == "none")
    assert docs.count() == 0


def test_the_drivers_jvm_gives_back_between_stages(spark):
    """What the JVM of the driver no longer uses is collected where work tables are deleted."""
    from sharelens.llm import common

    kept = common.materialize(spark.range(3))
    ref = spark.sparkContext._jvm.java.lang.ref.WeakReference(bytearray(b"unused"))
    common.discard_since(common.tables(), kept)
    assert ref.refersTo(None)
    common.discard(kept)
