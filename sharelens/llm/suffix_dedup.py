"""Suffix-array dedup: removes each byte covered by a string of SIZE bytes that also starts anywhere else.

Candidates come from `repeats`: runs of windows that may be equal meet in one task. A suffix array of the pool decides which
do repeat, sorted in two stages: only suffixes smaller than their successors are sorted directly (by ranks of 128-byte blocks, round by round while ties
remain), all others are induced by one scan over the first-byte buckets; common prefixes of adjacent suffixes
then tell which windows start twice. Both stages are vectorised; a pool has about a MB.

Comparing stops at 32 * ROUNDS bytes: beyond that the order among equal windows doesn't matter.

Defined cases: null text is the empty text; texts under SIZE bytes have no windows and stay whole; repeated rows and
null or repeated doc_ids count as documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from . import repeats
from .common import lean, mix, words_at

#: Bytes of a window, and of the grams whose least hash is its key.
SIZE, GRAM = 200, 48
ROUNDS = 8
#: Bytes whose ranks decide at once in a pool, and grams that are hashed at once.
BLOCK, PART = 128, 1 << 15


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    v = words_at(data)
    n = max(0, len(data) - gram + 1)
    out, room = np.zeros(n, np.uint64), np.empty(PART, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, n, PART):  # parts stay in the processor's cache
            h = out[i : i + PART]
            t = room[: len(h)]
            for k in range(gram // 8):
                h += v[8 * k + i : 8 * k + i + len(h)]
                h *= np.uint64(0x9E3779B97F4A7C15)
                np.right_shift(h, np.uint64(29), out=t)
                h ^= t
            h[:] = mix(h)
    return out


def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys (below 2**bits) in order, and the place of each; place and key are one integer where they fit."""
    width = int(len(key)).bit_length()
    if bits + width > 63:
        order = np.argsort(key, kind="stable")
        return key[order], order
    both = key << width
    both |= np.arange(len(key))
    both.sort()
    order = both & ((1 << width) - 1)
    both >>= width
    return both, order


def _ranks(key: np.ndarray, bits: int) -> np.ndarray:
    """The rank of each key from 0, ties sharing one."""
    s, order = _sorted(key, bits)
    rank = np.zeros(len(s), np.int64)
    np.cumsum(s[1:] != s[:-1], out=rank[1:])
    out = s  # its place is free now
    out[order] = rank
    return out


def block_ranks(data: np.ndarray, block: int = 32) -> np.ndarray:
    """The rank of the `block` bytes from each position on, by doubling from four."""
    rank = _ranks((words_at(data, True) >> np.uint64(32)).view(np.int64), 32)
    width = int(len(data) + 1).bit_length()
    for step in (4 << k for k in range((block // 4).bit_length() - 1)):
        key = rank << width
        key[: max(0, len(rank) - step)] |= rank[step:] + 1
        rank = _ranks(key, 2 * width)
    return rank


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor: by the next byte that differs; the last one isn't."""
    n = len(data)
    sign = np.zeros(n, np.int8)
    sign[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1])
    at = np.where(sign != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(sign, np.int8(-1))[at] > 0


def suffix_array(data: np.ndarray, rank: np.ndarray | None = None, block: int = 32) -> np.ndarray:
    """All suffixes in order of their first 32 * ROUNDS bytes at least; rank: that of the `block` bytes from each position on."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    rank = block_ranks(data, block) if rank is None else rank
    direct = smaller_than_next(data)
    # stage one: sort the suffixes smaller than their successors; ties go on to the next block
    at = np.flatnonzero(direct)
    at = at[_sorted(rank[at], int(n).bit_length())[1]]
    group = _starts(rank[at])
    where = np.arange(len(at))
    for k in range(1, -(-32 * ROUNDS // block)):
        own = group[where]
        tied = np.zeros(len(where), bool)
        same = own[1:] == own[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        where, own = where[tied], own[tied]
        if not len(where):
            break
        nxt = at[where] + block * k
        nxt = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        # only groups whose next blocks differ are sorted
        differ = np.flatnonzero((nxt[1:] != nxt[:-1]) & (own[1:] == own[:-1]))
        mixed = np.zeros(len(at), bool)
        mixed[own[differ]] = True
        some = np.flatnonzero(mixed[own])
        if not len(some):
            continue
        key = (own[some] << 32) | nxt[some]
        order = np.argsort(key, kind="stable")
        place = where[some]
        at[place] = at[place][order]
        key = key[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        group[place] = place[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
    # stage two: scan the buckets of first bytes upward; each suffix found puts its predecessor into its bucket
    bounds = np.searchsorted(data[at], np.arange(257))
    front: list[list[np.ndarray]] = [[] for _ in range(256)]
    if not direct[n - 1]:
        front[data[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        induced = []
        for new in front[c]:
            induced.append(new)
        wave = np.concatenate(induced) if induced else np.zeros(0, np.int64)
        while len(wave):  # runs of one byte: their suffixes follow in the same bucket
            wave = wave[wave > 0] - 1
            wave = wave[(data[wave] == c) & ~direct[wave]]
            induced.append(wave)
        bucket = np.concatenate([*induced, at[bounds[c] : bounds[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        above = data[before] > c
        before = before[above]
        letters = data[before]
        order = np.argsort(letters, kind="stable")
        before, letters = before[order], letters[order]
        cuts = np.flatnonzero(np.diff(letters.astype(np.int16))) + 1
        for part in np.split(before, cuts):
            if len(part):
                front[data[part[0]]].append(part)
    return np.concatenate(out)


def _starts(sorted_keys: np.ndarray) -> np.ndarray:
    """For each element the index of the first that equals it."""
    first = np.ones(len(sorted_keys), bool)
    first[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.maximum.accumulate(np.where(first, np.arange(len(sorted_keys)), 0)) if len(sorted_keys) else np.zeros(0, np.int64)


def common_prefixes(data: np.ndarray, a: np.ndarray, b: np.ndarray, rank: np.ndarray, most: int) -> np.ndarray:
    """Of each two suffixes the length of the common prefix, up to `most`; by blocks of 32, then of 8, then bytes."""
    n, length = len(data), np.zeros(len(a), np.int64)
    alive = np.arange(len(a))
    for step, value in ((32, rank), (8, words_at(data)), (1, data)):
        live = alive
        for _ in range(most // step if step == 32 else 32 // step):
            x, y = a[live] + length[live], b[live] + length[live]
            ok = (x < n) & (y < n) & (length[live] + step <= most)
            live, x, y = live[ok], x[ok], y[ok]
            live = live[value[x] == value[y]]
            if not len(live):
                break
            length[live] += step
    return length


def agree(a: np.ndarray, b: np.ndarray, rank: np.ndarray, size: int, block: int) -> np.ndarray:
    """Whether each two suffixes, of `size` bytes at least, have their first `size` (`block` or more) bytes in common, by the ranks of
    blocks, of which the last two may overlap."""
    live = np.arange(len(a))
    for at in [*range(0, size - block + 1, block), *([size - block] if size % block else [])]:
        live = live[rank[a[live] + at] == rank[b[live] + at]]
    out = np.zeros(len(a), bool)
    out[live] = True
    return out


def repeated(bodies: list[bytes], windows: list[int], copies: list[int]) -> list[np.ndarray]:
    """Per body, which windows of SIZE bytes also start elsewhere in the pool, in which each body is once or twice."""
    if not bodies:
        return []
    data = np.frombuffer(b"".join([*bodies, *[b for b, n in zip(bodies, copies) if n > 1]]), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
    counts = np.asarray([*windows, *[w for w, n in zip(windows, copies) if n > 1]])
    every = np.cumsum(counts + SIZE - 1) - (counts + SIZE - 1)
    at = np.arange(counts.sum()) + np.repeat(every - (np.cumsum(counts) - counts), counts)
    eligible = np.zeros(len(data), bool)
    eligible[at] = True
    rank = block_ranks(data, BLOCK)
    order = suffix_array(data, rank, BLOCK)
    order = order[eligible[order]]
    twice = agree(order[:-1], order[1:], rank, SIZE, BLOCK)
    hit = np.zeros(len(data), bool)
    hit[order[1:][twice]] = True
    hit[order[:-1][twice]] = True
    return [hit[b : b + w] for b, w in zip(begin[:-1], windows)]


def _units(data, offsets):
    return gram_hashes(data), offsets, None


def _body(raw: bytes, cuts, at: int, n: int) -> bytes:
    return raw[at : at + n]


def _windows(body: bytes):
    return (body[i : i + SIZE] for i in range(len(body) - SIZE + 1))


def dedup(docs: DataFrame, texts: bool = False, hot: int = repeats.HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with texts also `removed` (array of byte spans) and `kept` (binary)."""
    keyed, spans = repeats.find(docs, _units, _body, _windows, repeated, GRAM, SIZE, hot)

    def apply(batches):
        import pyarrow as pa

        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept")}
            for text, own in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw = text.encode()
                gone = repeats.covered(own, len(raw))
                kept, last = [], 0
                for a, b in gone:
                    kept.append(raw[last:a])
                    last = b
                kept = b"".join([*kept, raw[last:]])
                for n, v in zip(out, (len(raw), sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept).hexdigest(), [list(x) for x in gone], kept)):
                    out[n].append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.binary()]
            columns = {n: pa.array(v, k) for (n, v), k in zip(out.items(), kinds)}
            names = [*out] if texts else [*out][:4]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[columns[n] for n in names]], ["doc_id", *names])

    rows = keyed.join(spans, "_rk", "left").select(keyed["doc_id"].cast("long").alias("doc_id"), "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return rows.mapInArrow(lean(apply), schema + (", removed array<array<long>>, kept binary" if texts else ""))
