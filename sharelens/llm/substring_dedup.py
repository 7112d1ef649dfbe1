"""Substring dedup: removes each word covered by a window of SIZE words that also starts anywhere else.

Candidates come from `repeats`, as in suffix-array dedup but with words as units. In a pool of candidate texts the
method is fixed-block anchors: every text is cut into blocks of BLOCK words that don't overlap, and the blocks'
contents are indexed; every rolling window of BLOCK words of every text probes the index. Since 2 * BLOCK - 1 <= SIZE,
a repeated window of SIZE words always holds a whole block of its own text that its other occurrence hits. Hits
are extended to both sides: the windows of SIZE words around hits are compared word by word, all occurrences of a
block at once rather than in pairs, and touching repeated windows form the maximal exact repeats. Words have numbers within
a pool and blocks numbers of number pairs, so that nothing is decided by a hash.

Words are [^\\x20\\x09-\\x0D]+, unchanged; white space between them doesn't count.

Defined cases: null text has no words; texts under SIZE words stay whole; repeated rows and null or repeated doc_ids
count as documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from . import repeats
from .common import byte_hashes, lean, sequence_hashes, word_bounds

#: Words of a window, of the grams whose least hash is its key, and of a reference block.
SIZE, GRAM, BLOCK = 35, 8, 18


def _units(data, offsets):
    starts, ends, first = word_bounds(data, offsets)
    words = byte_hashes(data, starts, ends)
    return sequence_hashes(words, np.arange(max(0, len(words) - GRAM + 1)), GRAM), first, (starts, ends)


def _body(raw: bytes, cuts, at: int, n: int) -> bytes:
    """The words, joined by one space."""
    return b" ".join(raw[cuts[0][at] : cuts[1][at + n - 1]].split())


def blocks_of(ids: np.ndarray, n: int) -> np.ndarray:
    """A number for the n words from each place on, equal where all of them are: numbers of pairs, then of pairs of these."""
    width, number = 1, np.unique(ids, return_inverse=True)[1].astype(np.int64)
    while width < n:
        step = min(width, n - width)  # the last two may overlap
        pair = (number[: len(number) - step] << 32) | number[step:]
        number = np.unique(pair, return_inverse=True)[1]
        width += step
    return number


def repeated(bodies: list[bytes], windows: list[int], copies: list[int]) -> list[np.ndarray]:
    """Per body, which windows of SIZE words also start elsewhere in the pool, in which each body is once or twice."""
    if not bodies:
        return []
    number: dict[bytes, int] = {}
    texts = [*bodies, *[b for b, n in zip(bodies, copies) if n > 1]]
    ids = np.array([number.setdefault(w, len(number) + 1) for b in texts for w in b.split()], np.int64)
    counts = np.asarray([*windows, *[w for w, n in zip(windows, copies) if n > 1]])
    length = counts + SIZE - 1
    begin = np.cumsum(length) - length
    # index the blocks that don't overlap, probe them with every rolling window of BLOCK words
    content = blocks_of(ids, BLOCK)
    per_body = length // BLOCK
    block = np.repeat(begin - BLOCK * (np.cumsum(per_body) - per_body), per_body) + BLOCK * np.arange(per_body.sum())
    rolling = length - BLOCK + 1
    probe = np.repeat(begin - (np.cumsum(rolling) - rolling), rolling) + np.arange(rolling.sum())
    indexed = np.zeros(content.max() + 1, bool)
    indexed[content[block]] = True
    # a block alone hits itself only: contents at two places or more are hits
    times = np.bincount(content[probe], minlength=len(indexed))
    probe = probe[indexed[content[probe]] & (times[content[probe]] > 1)]
    # extend to both sides: windows of SIZE words that hold a hit, compared by content
    near = np.zeros(len(ids) + 1, np.int64)
    np.add.at(near, np.maximum(probe - (SIZE - BLOCK), 0), 1)
    np.add.at(near, probe + 1, -1)
    start = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    start = start[np.cumsum(near)[start] > 0]
    out = np.zeros(len(ids), bool)
    if len(start):
        window = blocks_of(ids, SIZE)[start]
        out[start[np.bincount(window)[window] > 1]] = True
    return [out[b : b + w] for b, w in zip(begin, windows)]


def _windows(body: bytes):
    words = body.split()
    return (b" ".join(words[i : i + SIZE]) for i in range(len(words) - SIZE + 1))


def dedup(docs: DataFrame, texts: bool = False, hot: int = repeats.HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; with texts also `removed` (array of word spans) and `kept`."""
    keyed, spans = repeats.find(docs, _units, _body, _windows, repeated, GRAM, SIZE, hot)

    def apply(batches):
        import pyarrow as pa

        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("n_words", "n_removed", "kept_sha256", "removed", "kept")}
            for text, own in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                words = text.encode().split()
                gone = repeats.covered(own, len(words))
                kept, last = [], 0
                for a, b in gone:
                    kept += words[last:a]
                    last = b
                kept = b" ".join(kept + words[last:])
                for n, v in zip(out, (len(words), sum(b - a for a, b in gone), hashlib.sha256(kept).hexdigest(), [list(x) for x in gone], kept.decode())):
                    out[n].append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.string()]
            columns = {n: pa.array(v, k) for (n, v), k in zip(out.items(), kinds)}
            names = [*out] if texts else [*out][:3]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[columns[n] for n in names]], ["doc_id", *names])

    rows = keyed.join(spans, "_rk", "left").select(keyed["doc_id"].cast("long").alias("doc_id"), "text", "spans")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return rows.mapInArrow(lean(apply), schema + (", removed array<array<long>>, kept string" if texts else ""))
