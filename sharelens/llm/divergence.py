"""Divergence audit of sources: how far each source's words are from its siblings' and its language's.

Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased. One pass over the texts counts terms per language and
source, and the documents that hold them; partial counts of a task are summed before the shuffle and dealt over parts by language
and term, a row per part and group, so that each part of some COUNTED bytes of text knows its terms' documents and keeps those of
at least MIN_DOCS. Kept terms are dealt over blocks of about TERMS terms, sources over blocks of SOURCES: a
tile is a dense numpy int64 matrix of the groups of two source blocks by the terms of one term block. Each tile broadcasts all
pairs of its rows, group by group, and gives a partial pair matrix and each group's TOP best terms; partial matrices are summed
and lists merged per task before they are shuffled. All arithmetic is exact in integers (int64; totals up to 9 * 10^15 words).

Defined cases: null text, lang and source are ''; an empty or null text has no terms and counts as a document of its group, which
occurs in the result; a language without kept terms gives pairs of value 0 and no terms; a text of any length is
counted in pieces cut between terms; doc_id and other columns are not read, so null and repeated ids and
repeated rows each count as documents; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import configure, lean, materialize, text_buffer, word_pieces

MIN_DOCS, TOP, SCALE = 3, 200, 1_000_000_000

#: Counters a task holds before it passes them on, terms and sources of a block, and languages up to which their totals are
#: broadcast (some 100 bytes each).
HELD, TERMS, SOURCES, LANGS = 300_000, 1024, 64, 20_000

#: Bytes of text per part of the counting.
COUNTED = 16_000_000

#: A-Z to lower case, everything that is in no term to a space.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def _counter(parts: int):
    """Texts -> per part of the terms and group: terms, occurrences and documents that hold them, end to end. Part 0 names every group."""

    def run(batches):
        import pyarrow as pa

        held: dict[tuple, tuple[Counter, Counter]] = {}

        def out():
            rows = []
            for (lang, source), (terms, docs) in held.items():
                salt = zlib.crc32(lang.encode())
                dealt: dict[int, list[bytes]] = {0: []}
                for t in terms:
                    dealt.setdefault(zlib.crc32(t, salt) % parts, []).append(t)
                for p, own in dealt.items():
                    numbers = np.array([[terms[t] for t in own], [docs[t] for t in own]], np.int64)
                    rows.append((p, lang, source, b" ".join(own), numbers.tobytes()))
            held.clear()
            for i in range(0, len(rows), 5_000):
                columns = zip(*rows[i : i + 5_000])
                kinds = (pa.int32(), pa.string(), pa.string(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "lang", "source", "terms", "numbers"])

        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            data = memoryview(data)
            for i, key in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())):
                terms, docs = held.setdefault(key, (Counter(), Counter()))
                seen = set()
                for words in word_pieces(data[offsets[i] : offsets[i + 1]], FOLD):
                    terms.update(words)
                    seen.update(words)
                docs.update(seen)
            if sum(len(t) for t, _ in held.values()) > HELD:
                yield from out()
        yield from out()

    return run


def _adder(least: int):
    """Rows sorted by part -> the kept terms of each part: lang, source, term, n, lang_n and whether this is the term's first row; and a
    row with null term for every group."""

    def run(batches):
        import pyarrow as pa

        names = ["lang", "source", "term", "n", "lang_n", "first"]
        held: dict[str, dict[str, dict[bytes, list[int]]]] = {}

        def flush(part):
            for lang, sources in held.items():
                docs, total = Counter(), Counter()
                for own in sources.values():
                    for t, (n, d) in own.items():
                        docs[t] += d
                        total[t] += n
                new = {t for t, d in docs.items() if d >= least}
                for source, own in sources.items():
                    kept = [t for t in own if docs[t] >= least]
                    firsts = [t in new and not new.discard(t) for t in kept]
                    group = [None] if part == 0 else []
                    columns = [[lang] * (len(kept) + len(group)), [source] * (len(kept) + len(group)), group + kept, [0] * len(group) + [own[t][0] for t in kept], [0] * len(group) + [total[t] for t in kept], [False] * len(group) + firsts]
                    kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.bool_())
                    arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                    arrays[2] = arrays[2].cast(pa.string())
                    yield pa.RecordBatch.from_arrays(arrays, names)
            held.clear()

        part = None
        for batch in batches:
            for p, lang, source, terms, numbers in zip(batch.column("part").to_pylist(), batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("terms").to_pylist(), batch.column("numbers").to_pylist()):
                if p != part and held:
                    yield from flush(part)
                part = p
                own = held.setdefault(lang, {}).setdefault(source, {})
                ns, ds = np.frombuffer(numbers, np.int64).reshape(2, -1).tolist()
                for t, n, d in zip(terms.split(), ns, ds):
                    if (x := own.get(t)) is None:
                        own[t] = [n, d]
                    else:
                        x[0] += n
                        x[1] += d
        if held:
            yield from flush(part)

    return run


def kept_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences there), lang_n (in the language), first (once per term) of the kept terms, and a row with
    null term for every group."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    texts = docs.select(*columns)
    parts = max(1, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // COUNTED))
    rows = texts.mapInArrow(lean(_counter(parts)), "part int, lang string, source string, terms binary, numbers binary")
    rows = rows.repartition(parts, "part").sortWithinPartitions("part")
    return rows.mapInArrow(lean(_adder(MIN_DOCS)), "lang string, source string, term string, n long, lang_n long, first boolean")


def probability(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exact: three digits of the quotient at a time."""
    whole, rest = np.divmod(count + 1, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def _away(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _tile(rows, groups):
    """rows: source, term, n, lang_n of one tile's terms; groups: lang, gi, gj, source, side, total, lang_total, size of its source
    blocks (side 0: gi, 1: gj) and the kept terms of its term block. Pairs (from gi to gj) and, where gi = gj, each group's best terms."""
    import pyarrow as pa

    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    if not groups.num_rows:
        return schema.empty_table()
    lang, gi, gj, size = (groups.column(c)[0].as_py() for c in ("lang", "gi", "gj", "size"))
    names = groups.column("source").to_pylist()
    side, total = groups.column("side").to_numpy(), groups.column("total").to_numpy()
    at = {s: i for i, s in enumerate(names)}
    terms = rows.column("term").combine_chunks().dictionary_encode()
    column = terms.indices.to_numpy()
    words = terms.dictionary.to_pylist() if rows.num_rows else []
    counts, all_counts = np.zeros((len(names), len(words)), np.int64), np.zeros(len(words), np.int64)
    counts[[at[s] for s in rows.column("source").to_pylist()], column] = rows.column("n").to_numpy()
    all_counts[column] = rows.column("lang_n").to_numpy()
    p = probability(counts, total[:, None])
    never = probability(np.zeros_like(total), total)  # terms of the block that no source of the tile has
    targets = np.flatnonzero(side == 1) if gi != gj else np.arange(len(names))
    out = []
    for i in np.flatnonzero(side == 0):
        value = _away(p[i], p[targets]).sum(axis=1) + (size - len(words)) * _away(never[i], never[targets])
        out += [(names[i], "pair", names[j], int(v)) for j, v in zip(targets, value) if i != j]
    if gi == gj:
        q = probability(all_counts, groups.column("lang_total").to_numpy()[:1])
        order = np.array([w.encode() for w in words], object).argsort(kind="stable")
        for i in range(len(names)):
            ok = order[(counts[i, order] > 0) & (p[i, order] > q[order])]
            value = _away(p[i, ok], q[ok])
            best = np.argsort(-value, kind="stable")[:TOP]  # equal values stay in the order of their bytes
            out += [(names[i], "term", words[t], int(v)) for t, v in zip(ok[best], value[best])]
    columns = list(zip(*out)) or [()] * 4
    return pa.table([pa.array([lang] * len(out), pa.string()), *map(pa.array, columns, [schema.field(k).type for k in range(1, 5)])], schema=schema)


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    configure(docs.sparkSession)
    counts = materialize(kept_counts(docs))
    used = counts.where("term is not null")
    own = used.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count_if("first").alias("v"))
    groups = counts.where("term is null").select("lang", "source").join(own, ["lang", "source"], "left")
    groups = materialize(groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")))
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("n").alias("lang_total"), F.sum("v").alias("v")).where("v > 0")
    langs = langs.select("lang", "v", F.ceil(F.col("sources") / SOURCES).cast("int").alias("gs"), F.ceil(F.col("v") / TERMS).cast("int").alias("ts"), (F.col("lang_total") + F.col("v")).alias("lang_total"))
    langs = materialize(langs)
    if langs.count() <= LANGS:
        langs = F.broadcast(langs)
    block = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("gs") - 1))

    # each source block meets every block of its language: as the first of the pair, and as the second where it is another
    def tiles(df):
        df = df.withColumn("g", block("source", "gs")).withColumn("o", other)
        both = F.array(F.struct(F.col("g").alias("gi"), F.col("o").alias("gj"), F.lit(0).alias("side")), F.struct(F.col("o").alias("gi"), F.col("g").alias("gj"), F.lit(1).alias("side")))
        return df.withColumn("to", F.explode(F.filter(both, lambda t: (t.side == 0) | (t.gi != t.gj)))).withColumns({c: F.col(f"to.{c}") for c in ("gi", "gj", "side")})

    keys = ["lang", "gi", "gj", "t"]
    groups = groups.drop("v")
    rows = tiles(used.join(langs, "lang").withColumn("t", block("term", "ts"))).select(*keys, "source", "term", "n", "lang_n")
    sides = tiles(groups.join(langs, "lang")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("ts") - 1)))
    sizes = used.where("first").join(langs, "lang").groupBy("lang", block("term", "ts").alias("t")).agg(F.count("*").alias("size"))
    sides = sides.join(sizes, ["lang", "t"]).select(*keys, "size", "source", "side", (F.col("n") + F.col("v")).alias("total"), "lang_total")
    parts = rows.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInArrow(_tile, "lang string, source string, part string, item string, value long")
    # a term is in one tile, a pair in one a term block
    sums = materialize(parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source != item")
    pairs = pairs.join(sums.where("part = 'pair'").drop("part"), ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    best = sums.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= TOP)  # lists merge per task first
    return pairs.withColumn("rank", rank).unionByName(best)


def sql() -> str:
    """DuckDB SQL of `audit` on a table `documents`."""
    p = f"(1 + ({SCALE}::HUGEINT * (n + 1)) // total)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS MATERIALIZED (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= {MIN_DOCS}),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w JOIN v USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (SELECT lang, source, coalesce(sum(n), 0) AS own FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
l AS MATERIALIZED (SELECT lang, count(*) AS size, sum(lang_n) + count(*) AS total FROM v GROUP BY lang),
p AS MATERIALIZED (SELECT lang, source, term, n, {p} AS p FROM (
  SELECT lang, source, term, coalesce(n, 0) AS n, own + size AS total FROM g JOIN l USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term))),
q AS MATERIALIZED (SELECT lang, term, {p} AS q FROM (SELECT lang, term, lang_n AS n, total FROM v JOIN l USING (lang))),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
WHERE part = 'pair' OR rank <= {TOP}"""
