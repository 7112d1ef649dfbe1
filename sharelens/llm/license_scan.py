"""License scans: an exact set-similarity join of text blocks with license templates, and license phrases.

A block is a line, or a run of lines between blank ones. Blocks and templates are sets of words; all words of the
templates are ordered by the number of texts that hold them (counted over the whole table), rarest first. A block B meets a template T
where |B and T| >= t * |T|, so with a = ceil(t * |T|):

* prefix filter: B holds one of the first |T| - a + 1 words of T; an index from these words gives the candidates;
* length filter: B has at least a words;
* positional filter: the words that B and T can still share after their first common word, on either side, reach a;

and what is left is counted. The filters lose nothing. Templates are a parameter whose size is checked (WORDS), so the index is
sent to the tasks. Pairs from FOUND on are found, labels need LABEL; `score` is the largest containment found, 1 where a
phrase stands.

Phrases are consecutive words wherever they stand, over line ends and punctuation too.

Defined cases: null and empty texts have no words, no labels ('') and score 0; texts of any length are scanned whole;
null or repeated doc_ids and repeated rows come back as they are; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import configure, lean, text_buffer, word_pieces

# The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notices by label, in the wording that their publishers recommend.
TEMPLATES = (
    ("gpl", "This work is licensed under the GNU General Public License, version"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("apache", "Licensed under the Apache License, Version"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution International License"),
    ("cc-by-nc", "Licensed under CC BY-NC"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial International License"),
    ("cc-by-sa", "Licensed under CC BY-SA"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike International License"),
)

#: Containment from which a pair is found, and from which it labels a text.
FOUND, LABEL = 0.6, 0.85

#: Most words of all templates together, so that what is sent to the tasks stays below a few MB.
WORDS = 100_000

#: A-Z to lower case, what is in no word to a space.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(data: bytes) -> list[bytes]:
    return data.translate(FOLD).split()


@dataclass
class Index:
    """Templates as word sets in the order of `rank`, and the candidates of each prefix word."""

    templates: list[tuple[str, frozenset[bytes]]]
    rank: dict[bytes, int]
    found: float
    need: list[int] = field(init=False)
    place: list[dict[bytes, int]] = field(init=False)
    prefixes: dict[bytes, list[int]] = field(init=False)

    def __post_init__(self):
        self.need, self.place, self.prefixes = [], [], {}
        for k, (_, own) in enumerate(self.templates):
            need = max(1, math.ceil(self.found * len(own) - 1e-9))
            order = sorted(own, key=self.rank.__getitem__)
            self.need.append(need)
            self.place.append({w: i for i, w in enumerate(order)})
            for w in order[: len(own) - need + 1]:
                self.prefixes.setdefault(w, []).append(k)

    def meets(self, block: set[bytes]):
        """(template, containment) of every template that the block meets."""
        hits = self.prefixes.keys() & block
        if not hits:
            return
        own = sorted(self.rank.keys() & block, key=self.rank.__getitem__)
        at = {w: i for i, w in enumerate(own)}
        for k in {k for w in hits for k in self.prefixes[w]}:
            place, need = self.place[k], self.need[k]
            if len(block) < need:  # length
                continue
            # the first common word in the order; words before it are in one of the two alone
            first = min((w for w in hits if w in place), key=self.rank.__getitem__)
            if 1 + min(len(place) - place[first] - 1, len(own) - at[first] - 1) < need:  # position
                continue
            shared = len(place.keys() & block)
            if shared >= need:
                yield k, shared / len(place)


def blocks(data: memoryview):
    """Word sets of the lines, and of the runs of lines without a blank one. Each is held as a set, a line read in pieces."""
    run, lines, at = set(), 0, 0
    whole = data.obj if isinstance(data.obj, bytes) else bytes(data)
    while at <= len(whole):
        end = whole.find(b"\n", at)
        end = len(whole) if end < 0 else end
        own = set()
        for piece in word_pieces(data[at:end], FOLD):
            own.update(piece)
        if own:
            yield own
            run |= own
            lines += 1
        elif not whole[at:end].strip(b" \t\n\x0b\x0c\r"):
            if lines > 1:
                yield run
            run, lines = set(), 0
        at = end + 1
    if lines > 1:
        yield run


def places(pieces, phrases: list[list[bytes]]):
    """(number of words, [places of each phrase]) of a text whose words come in pieces."""
    out, n, rest = [[] for _ in phrases], 0, []
    most = max((len(p) for p in phrases), default=1) - 1
    for piece in pieces:
        joined = rest + piece
        held = set(joined)
        for k, phrase in enumerate(phrases):
            if not held.issuperset(phrase):
                continue
            at, size = -1, len(phrase)
            while True:
                try:
                    at = joined.index(phrase[0], at + 1)
                except ValueError:
                    break
                # a place within the words of the last piece was told there
                if at + size > len(rest) and joined[at : at + size] == phrase:
                    out[k].append(n - len(rest) + at)
        n += len(piece)
        rest = joined[len(joined) - most :] if most and len(joined) > most else joined if most else []
    return n, out


def _texts(batch):
    data, offsets = text_buffer(batch.column("text"))
    data = memoryview(data)
    for a, b in zip(offsets[:-1], offsets[1:]):
        yield memoryview(bytes(data[a:b]))


def frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many texts each word of the vocabulary stands; one row a word comes back."""

    def run(batches):
        import pyarrow as pa

        held = Counter()
        for batch in batches:
            for text in _texts(batch):
                seen = set()
                for piece in word_pieces(text, FOLD):
                    seen.update(vocabulary.intersection(piece))
                held.update(seen)
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])

    counts = docs.mapInArrow(lean(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counts.collect()}


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, found: float = FOUND, label: float = LABEL) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    configure(docs.sparkSession)
    if not 0 < found <= label <= 1:
        raise ValueError("0 < found <= label <= 1")
    sets = [(name, frozenset(words(text.encode()))) for name, text in templates]
    vocabulary = frozenset().union(*(w for _, w in sets))
    if sum(len(w) for _, w in sets) > WORDS or not all(w for _, w in sets):
        raise ValueError(f"templates have 1 to {WORDS} words together, none is empty")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = frequencies(docs, vocabulary)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    index = Index(sets, rank, found)
    sought = [(words(p.encode()), name) for p, name in phrases.items()]

    def one(text: memoryview):
        seen: set[bytes] = set()

        def pieces():
            for piece in word_pieces(text, FOLD):
                seen.update(index.prefixes.keys() & piece)
                yield piece

        n, here = places(pieces(), [p for p, _ in sought])
        at = [x for found_at in here for x in found_at]
        base = {name for (_, name), found_at in zip(sought, here) if found_at}
        labels, best = set(base), float(bool(base))
        if seen:
            for block in blocks(text):
                for k, share in index.meets(block):
                    best = max(best, share)
                    if share >= label:
                        labels.add(sets[k][0])
        return n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best

    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = ["long", "long", "long", "long", "string", "string", "double"]

    def run(batches):
        import pyarrow as pa

        of = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
        for batch in batches:
            columns = list(zip(*map(one, _texts(batch)))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, of[k]) for c, k in zip(columns, kinds))], ["doc_id", *names])

    return docs.mapInArrow(lean(run), ", ".join(["doc_id long", *(f"{n} {k}" for n, k in zip(names, kinds))]))


def sql(found: float = FOUND, label: float = LABEL) -> str:
    """DuckDB SQL of `scan` on a table `documents`, for the default templates and phrases."""
    fold = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    own = ", ".join(f"({k}, {quote(name)}, {[w.decode() for w in sorted(set(words(text.encode())))]})" for k, (name, text) in enumerate(TEMPLATES))
    most = max(len(p.split()) for p in PHRASES)
    nexts = "".join(f", lead(w, {i}) OVER (PARTITION BY k ORDER BY i) AS w{i}" for i in range(1, most))
    cases = " ".join("WHEN " + " AND ".join(f"{'w' if i == 0 else f'w{i}'} = {quote(x)}" for i, x in enumerate(p.split())) + f" THEN {quote(name)}" for p, name in PHRASES.items())
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
ws AS MATERIALIZED (SELECT k, {fold.format('text')} AS ws FROM d),
p AS (SELECT k, min(i) AS first_word, max(i) AS last_word, count(*) AS n_base, string_agg(DISTINCT name, ',' ORDER BY name) AS base_labels, list(DISTINCT name) AS names
      FROM (SELECT k, i, CASE {cases} END AS name FROM (SELECT k, w, i{nexts} FROM (SELECT k, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM ws))) WHERE name IS NOT NULL GROUP BY k),
part AS (SELECT k, row_number() OVER () AS g, part FROM (SELECT k, unnest(regexp_split_to_array(text, '\n[\x20\x09-\x0D]*\n')) AS part FROM d)),
line AS (SELECT k, g, unnest(string_split(part, chr(10))) AS b FROM part),
b AS (SELECT row_number() OVER () AS j, * FROM (SELECT k, b FROM line UNION ALL SELECT k, part FROM part WHERE contains(part, chr(10)))),
bw AS MATERIALIZED (SELECT DISTINCT k, j, w FROM (SELECT k, j, unnest({fold.format('b')}) AS w FROM b)),
t(t, name, own) AS (VALUES {own}),
tw AS (SELECT t, name, len(own) AS size, unnest(own) AS w FROM t),
m AS MATERIALIZED (SELECT k, j, name, count(*) / any_value(size) AS share FROM bw JOIN tw USING (w) GROUP BY k, j, t, name HAVING count(*) >= {found} * any_value(size) - 1e-9),
s AS (SELECT k, max(share) AS share, list(DISTINCT name) FILTER (share >= {label}) AS more FROM m GROUP BY k)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(names, []), coalesce(more, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0) END::DOUBLE AS score
FROM d JOIN ws USING (k) LEFT JOIN p USING (k) LEFT JOIN s USING (k)"""
