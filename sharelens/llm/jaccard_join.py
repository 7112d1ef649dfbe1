"""N-gram Jaccard join by vertical partitioning, exact.

A document is the set of its five-word shingles. The n-grams have one global order: those held by few documents first,
frequent ones after them by their number of documents. The order is cut into fragments, and every document's prefix (the
first n - ceil(t n) + 1 n-grams, of which linked documents share at least one) is dealt over the fragments it falls
into. Each fragment counts the partial overlaps of its pairs on its own; sums per pair over all fragments bound the
overlap (a task takes several fragments and sums over them first), and pairs that can't reach the threshold go. Of those that are left, whole sets are dealt over fragments of
the n-grams again, each fragment counts its part of every pair's overlap, and the sum per pair decides.

Two rounds keep the work near the number of documents, not of pairs. In the first each document is compared with one
candidate (the least), so groups of near copies become components; in the second only candidate pairs of different
components are. An n-gram held by more than `dense` documents in their prefixes makes no pairs but a star: its members meet
the star's least in round one. What round one leaves apart is compared in blocks: candidates tied by stars form a
cluster, its largest component is not compared with itself, and each pair of blocks that can hold links is one task,
whose overlaps are summed over slices of the n-grams. Limits only choose between the ways; no pair is dropped.

Document frequencies are counted over all rows and do not depend on how rows are dealt: each task sends the 40-bit
cells of its n-grams with their counts, and cells with more than `dense` documents get a level in a table of 2**SLOT_BITS
bytes. Where the table is full, more n-grams share slots; the order then decides less work, never the result.

Equal sets are one class, told by 128 bits: sums of two hashes of its n-grams, and for sets of one n-gram a digest of its
words. Sets of one or two n-grams link with equal ones only. Overlaps are counted on 55-bit n-gram hashes, mixed at each
step.

Defined cases: null text and text without words have the empty set (n_shingles 0) and link with nothing, so
component_id is their own doc_id; texts under five words are one shingle; a null doc_id takes part and is only
reported where no other id is in the component; repeated rows each come back; very long texts are sets like any other,
one at a time in memory; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_hashes, configure, discard, give_back, keyed, lean, materialize, mix, sequence_hashes, slices, table_of, text_buffer, word_bounds

N, TOKEN_BITS, CELL_BITS, SLOT_BITS = 5, 55, 40, 23
#: Documents up to which a shared n-gram makes pairs, documents a block, compared documents a task.
DENSE, BLOCK, PARTNERS = 48, 256, 128
#: Prefix n-grams per fragment, n-grams that a task counts at once, bytes of text per part of the counting, n-grams per slice of a
#: matrix product, and fragments of the final overlaps.
FRAGMENT, FLUSH, COUNTED, PRODUCT, VERTICAL = 600_000, 1_000_000, 16_000_000, 4096, 4
#: n-grams of a fragment that are paired at once, pairs that wait to be summed, and n-grams of a block of compared documents.
PIECE, MET, HELD = 100_000, 200_000, 4_000_000
#: Fragments that a task takes one after the other, tasks at least, and pairs whose sums over a task's fragments wait (56 bytes each).
TOGETHER, TASKS, WAITING = 8, 16, 500_000
SLICE = 1 << 20


def shingles(data: np.ndarray, offsets: np.ndarray, classes: bool = False):
    """The sets of all texts (512 at most) end to end, each ascending, and each set's first element (len + 1); with classes also
    two 64-bit hashes of each set."""
    data = data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    starts, ends, first = word_bounds(data, offsets)
    words = byte_hashes(data, starts, ends)
    counts = np.diff(first)
    n = np.where(counts >= N, counts - N + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), n)
    at = np.arange(len(doc)) + np.repeat(first[:-1] - (np.cumsum(n) - n), n)
    h = sequence_hashes(words, at, np.minimum(counts, N)[doc])
    key = np.sort((doc.astype(np.uint64) << np.uint64(TOKEN_BITS)) | (h >> np.uint64(64 - TOKEN_BITS)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    bounds = np.append(np.searchsorted(key, np.arange(len(counts), dtype=np.uint64) << np.uint64(TOKEN_BITS)), len(key))
    tokens = key & np.uint64((1 << TOKEN_BITS) - 1)
    if not classes:
        return tokens, bounds
    ids = []
    with np.errstate(over="ignore"):
        for salt in (np.uint64(0x51 << 56), np.uint64(0xA7 << 56)):
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens + salt), dtype=np.uint64)])
            ids.append(mix(total[bounds[1:]] - total[bounds[:-1]] + salt).view(np.int64))
    for d in np.flatnonzero(np.diff(bounds) == 1):  # one n-gram: its words tell the class
        at = range(first[d], first[d] + min(N, counts[d]))
        digest = hashlib.blake2b(b" ".join(data[starts[k] : ends[k]].tobytes() for k in at), digest_size=16).digest()
        ids[0][d], ids[1][d] = np.frombuffer(digest, np.int64)
    return tokens, bounds, *ids


def _batches(batches, *columns, classes: bool = False):
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        others = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        for i, j in slices(offsets, SLICE):
            for a in range(i, j, 512):
                b = min(j, a + 512)
                yield (*shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], classes), *[o[a:b] for o in others])


def _once(c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
    """Marks one of the rows of each class."""
    order = np.lexsort((c2, c1))
    out = np.ones(len(c1), bool)
    out[order[1:]] = (c1[order][1:] != c1[order][:-1]) | (c2[order][1:] != c2[order][:-1])
    return out


def _describer(part_bits: int):
    """Per document its set's size and class; per part of the cells the cells of one and of several documents with counts."""
    low = CELL_BITS - part_bits

    def counted(held):
        cells, n = np.unique(np.concatenate(held) >> np.uint64(TOKEN_BITS - CELL_BITS), return_counts=True)
        cuts = np.searchsorted(cells, np.arange((1 << part_bits) + 1, dtype=np.uint64) << np.uint64(low))
        cells = (cells & np.uint64((1 << low) - 1)).astype(np.uint32)
        ones, many = [], []
        parts = np.flatnonzero(np.diff(cuts))
        for p in parts:
            own, k = cells[cuts[p] : cuts[p + 1]], n[cuts[p] : cuts[p + 1]]
            ones.append(own[k == 1].tobytes())
            many.append(np.stack([own[k > 1], k[k > 1].astype(np.uint32)]).tobytes())
        return parts, ones, many

    def run(batches):
        import pyarrow as pa

        names, held, n = ["_rk", "n", "c1", "c2", "part", "ones", "many"], [], 0

        def flush():
            parts, ones, many = counted(held)
            none = pa.nulls(len(parts), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(parts.astype(np.int32)), pa.array(ones, pa.binary()), pa.array(many, pa.binary())], names)

        for tokens, bounds, c1, c2, rk in _batches(batches, "_rk", classes=True):
            size, blobs = np.diff(bounds), pa.nulls(len(rk), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(rk), pa.array(size), pa.array(c1), pa.array(c2), pa.nulls(len(rk), pa.int32()), blobs, blobs], names)
            held.append(tokens)
            n += len(tokens)
            if n >= FLUSH:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return run


def _leveller(part_bits: int, dense: int):
    """Counts sorted by part -> slot and level of the cells with more than `dense` documents."""

    def flush(part, ones, many):
        import pyarrow as pa

        pairs = np.concatenate([np.frombuffer(b, np.uint32).reshape(2, -1).astype(np.uint64) for b in many], axis=1)
        keys = np.concatenate([(np.frombuffer(b"".join(ones), np.uint32).astype(np.uint64) << np.uint64(32)) | np.uint64(1), (pairs[0] << np.uint64(32)) | pairs[1]])
        keys = np.sort(keys)
        cell = keys >> np.uint64(32)
        at = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
        total = np.add.reduceat(keys & np.uint64(0xFFFFFFFF), at) if len(at) else np.zeros(0, np.uint64)
        often = total > dense
        cell = cell[at][often] | np.uint64(part << (CELL_BITS - part_bits))
        level = np.minimum(1 + np.floor(np.log2(total[often] / dense)), 15).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(slots(cell).astype(np.int32)), pa.array(level)], ["slot", "level"])

    def run(batches):
        part, ones, many = None, [], []
        for batch in batches:
            for p, a, b in zip(batch.column("part").to_pylist(), batch.column("ones"), batch.column("many")):
                if p != part and part is not None:
                    yield flush(part, ones, many)
                    ones, many = [], []
                part = p
                ones.append(a.as_buffer().to_pybytes())
                many.append(b.as_buffer().to_pybytes())
        if part is not None:
            yield flush(part, ones, many)

    return run


def slots(cells: np.ndarray) -> np.ndarray:
    return (mix(cells + np.uint64(1)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def fragment(token: np.ndarray, level: np.ndarray, fragments: int) -> np.ndarray:
    """Fragment of each n-gram: rare ones have the first `fragments`, frequent ones the rest. Each part of the order is dealt by
    a second hash: a prefix is the first quarter of a document's order, so cuts of equal width would hold most of them in few."""
    return np.where(level == 0, mix(token) % np.uint64(fragments), np.uint64(fragments) + mix(token) % np.uint64(fragments)).astype(np.int64)


def _prefixer(levels, heads, fragments: int):
    """Prefix n-grams by fragment: bytes of the documents (class, key, size) and of the n-grams with their document and place.
    Documents whose cell isn't in the bitmap of the classes' heads are left out."""

    def run(batches):
        import pyarrow as pa

        level = np.frombuffer(levels.value, np.uint8)
        for tokens, bounds, c1, c2, rk in _batches(_within(batches, heads), "_rk", classes=True):
            n = np.diff(bounds)
            once = _once(c1, c2) & (n > 2)  # equal sets of this slice go on as one; sets of one or two link with equal ones only
            if not once.any():
                continue
            doc = np.repeat(np.arange(len(n), dtype=np.uint16), n)
            order = level[slots(tokens >> np.uint64(TOKEN_BITS - CELL_BITS))]
            by = np.argsort(doc * np.uint16(16) + order, kind="stable")  # within a document by level, then n-gram
            length = np.where(once, n - (3 * n + 3) // 4 + 1, 0)
            place = np.arange(len(doc)) - np.repeat(bounds[:-1], n)
            by, place = by[place < np.repeat(length, n)], place[place < np.repeat(length, n)]
            token, d, order = tokens[by], doc[by], order[by]
            frag = fragment(token, order, fragments)
            by = np.argsort(frag, kind="stable")
            frag, token, d, place = frag[by], token[by], d[by], place[by].astype(np.uint32)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(frag)) + 1, [len(frag)]])
            rows, docs, grams = [], [], []
            for a, b in zip(cuts, cuts[1:]):
                own, at = np.unique(d[a:b], return_inverse=True)
                docs.append(np.stack([c1[own], rk[own], n[own]]).astype(np.int64).tobytes())
                grams.append(token[a:b].tobytes() + at.astype(np.uint16).tobytes() + place[a:b].tobytes())
                rows.append(frag[a])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(docs, pa.binary()), pa.array(grams, pa.binary())], ["frag", "docs", "grams"])

    return run


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    """Rows a, b, na, nb, place in a, place in b, shared: one per pair, with its last places and all it shares."""
    pairs = np.concatenate(parts) if parts else np.zeros((0, 7), np.int64)
    if not len(pairs):
        return pairs
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1)
    at = np.flatnonzero(new)
    return np.concatenate([pairs[at, :4], np.maximum.reduceat(pairs[:, 4:6], at, axis=0), np.add.reduceat(pairs[:, 6:], at, axis=0)], axis=1)


def _counts(rows: np.ndarray, dense: int):
    """rows: n-gram, class, key, size, place. Pairs of keys with their partial overlap, and rows of dense n-grams."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[keep]
    new = np.ones(len(rows), bool)
    new[1:] = rows[1:, 0] != rows[:-1, 0]
    size = np.diff(np.append(np.flatnonzero(new), len(rows)))
    mine = size[np.cumsum(new) - 1] if len(rows) else size
    often = rows[mine > dense][:, [0, 2, 3]]
    rows = rows[(mine > 1) & (mine <= dense)]
    token, c, n, place = rows[:, 0], rows[:, 2], rows[:, 3], rows[:, 4]
    pairs, waiting = [], 0
    for step in range(1, min(dense, len(rows))):
        at = np.flatnonzero(token[step:] == token[:-step])
        if not len(at):
            break
        at = at[4 * np.minimum(n[at], n[at + step]) >= 3 * np.maximum(n[at], n[at + step])]
        swap = c[at] > c[at + step]
        a, b = np.where(swap, at + step, at), np.where(swap, at, at + step)
        pairs.append(np.stack([c[a], c[b], n[a], n[b], place[a], place[b], np.ones(len(a), np.int64)], axis=1))
        waiting += len(a)
        if waiting > MET:
            pairs, waiting = [_summed(pairs)], 0
    return _summed(pairs), often


PAIRS = "dense boolean, a long, b long, na long, nb long, ia long, ib long, shared long"


def _pairer(dense: int):
    """Rows sorted by fragment -> partial counts per pair, summed over the task's fragments, and rows of dense n-grams (a: n-gram,
    b: key, nb: size)."""

    def counts(held):
        m = sum(len(x[0]) for x in held)
        pieces, pairs, often = max(1, -(-m // PIECE)), [], []
        for piece in range(pieces):  # n-grams of a part of the hash's range at a time
            rows = []
            for token, d, place, docs in held:
                own = np.flatnonzero(mix(token.view(np.uint64)) % np.uint64(pieces) == piece)
                rows.append(np.stack([token[own], docs[0][d[own]], docs[1][d[own]], docs[2][d[own]], place[own]], axis=1))
            p, o = _counts(np.concatenate(rows), dense)
            pairs.append(p)
            often.append(o)
        return _summed(pairs), np.concatenate(often)

    def rows_of(x, is_dense):
        import pyarrow as pa

        names = [c.split()[0] for c in PAIRS.split(", ")]
        for i in range(0, len(x), 50_000):
            p = x[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), is_dense)), *[pa.array(np.ascontiguousarray(p[:, k])) for k in range(7)]], names)

    def run(batches):
        held, frag, met = [], None, []

        def flush():
            pairs, often = counts(held)
            z = np.zeros(len(often), np.int64)
            yield from rows_of(np.stack([often[:, 0], often[:, 1], z, often[:, 2], z, z, z], axis=1), True)
            met.append(pairs)
            if sum(map(len, met)) > WAITING:
                met[:] = [_summed(met)]
                if len(met[0]) > WAITING // 2:  # sums of many pairs go on as they are
                    yield from rows_of(met.pop(), False)

        for batch in batches:
            for f, docs, grams in zip(batch.column("frag").to_pylist(), batch.column("docs"), batch.column("grams")):
                if f != frag and held:
                    yield from flush()
                    held = []
                frag = f
                raw = grams.as_buffer().to_pybytes()
                m = len(raw) // 14
                docs = np.frombuffer(docs.as_buffer().to_pybytes(), np.int64).reshape(3, -1)
                held.append((np.frombuffer(raw, np.int64, m), np.frombuffer(raw, np.uint16, m, 8 * m), np.frombuffer(raw, np.uint32, m, 10 * m), docs))
        if held:
            yield from flush()
        yield from rows_of(_summed(met), False)

    return run


def _within(batches, shared):
    """The rows whose cell is in the bitmap."""
    import pyarrow as pa

    bitmap = np.frombuffer(shared.value, np.uint8)
    for batch in batches:
        cell = batch.column("cell").to_numpy(zero_copy_only=False)
        yield batch.filter(pa.array((bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1))


def marked(texts: DataFrame, keys: DataFrame):
    """texts with `cell`, a hash of _rk, and the bitmap of the cells of `keys` (distinct _rk), broadcast: 16 bits a document within
    2**20 and 2**27 bits (16 MB). It lets all of them through, and others where cells meet."""
    bits = 1 << min(27, max(20, (16 * max(1, keys.count()) - 1).bit_length()))
    cell = F.pmod(F.xxhash64("_rk"), F.lit(bits)).cast("int")
    bitmap = table_of(keys.select(cell.alias("place"), F.lit(1).alias("value")).distinct(), bits, bool)
    return texts.withColumn("cell", cell), texts.sparkSession.sparkContext.broadcast(bitmap)


def _sets(shared, parts: int):
    """The sets of the documents whose cell is in the bitmap, all wanted ones and a few more, cut into `parts` fragments."""

    def run(batches):
        import pyarrow as pa

        edges = np.array([(k << TOKEN_BITS) // parts for k in range(parts + 1)], np.uint64)
        for batch in _within(batches, shared):
            for tokens, bounds, rk in _batches([batch], "_rk"):
                keys, frag, out = [], [], []
                for k, a, b in zip(rk.tolist(), bounds, bounds[1:]):
                    own = tokens[a:b]
                    at = np.searchsorted(own, edges)
                    for f in range(parts):
                        if at[f + 1] > at[f]:
                            keys.append(k)
                            frag.append(f)
                            out.append(own[at[f] : at[f + 1]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(frag, pa.int32()), pa.array(out, pa.binary())], ["_rk", "frag", "tokens"])

    return run


def sets_of(texts: DataFrame, wanted: DataFrame, parts: int = 1) -> DataFrame:
    """wanted (with _rk), frag and tokens, without a shuffle of texts: what the bitmap lets through too much falls out in the join
    on _rk. Beyond some 10 million wanted documents the bitmap fills, and in the end every document's set goes through the join."""
    texts, shared = marked(texts, wanted.select("_rk").distinct())
    found = texts.mapInArrow(lean(_sets(shared, parts)), "_rk long, frag int, tokens binary")
    return wanted.join(found, "_rk")


def _partial(batches):
    """Rows sorted by task, fragment and role, the task's own document first -> partial overlaps with each of its partners."""
    import pyarrow as pa

    own, owner, now = np.zeros(0, np.uint64), None, None
    for batch in batches:
        a, b, n = [], [], []
        columns = (batch.column(c).to_pylist() for c in ("a", "part", "frag", "_rk"))
        for task_a, part, frag, rk, tokens in zip(*columns, batch.column("tokens")):
            tokens = np.frombuffer(tokens.as_buffer().to_pybytes(), np.uint64)
            if (task_a, part, frag) != now:
                now, owner = (task_a, part, frag), None
            if rk == task_a:
                owner, own = rk, tokens
            elif owner is not None:  # else the owner has no n-gram in this fragment
                at = np.searchsorted(own, tokens)
                a.append(task_a)
                b.append(rk)
                n.append(int((own[np.minimum(at, len(own) - 1)] == tokens).sum()))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "shared"])


def verify(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The linked ones of pairs (a, b, na, nb; distinct). Each a's set goes once to every PARTNERS of its partners; overlaps are
    counted per fragment of the n-grams and summed per pair."""
    pairs = pairs.withColumn("_slot", F.pmod(F.xxhash64("b"), F.lit(1 << 20)))
    if pairs.isEmpty():
        return materialize(pairs.select("a", "b"))
    tasks = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
    partners = materialize(pairs.join(tasks, "a").select("a", "b", "na", "nb", F.pmod("_slot", "parts").cast("int").alias("part")))
    owners = tasks.select("a", F.col("a").alias("_rk"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    wanted = materialize(owners.select("a", "_rk", "part", "role").union(partners.select("a", F.col("b").alias("_rk"), "part", F.lit(1))))
    rows = sets_of(texts, wanted, VERTICAL).withColumn("_task", F.xxhash64("a", "part", "frag"))
    rows = rows.repartition("_task").sortWithinPartitions("_task", "a", "part", "frag", "role").select("a", "part", "frag", "_rk", "tokens")
    counted = rows.mapInArrow(lean(_partial), "a long, b long, shared long").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    linked = counted.join(partners, ["a", "b"]).where(7 * F.col("shared") >= 3 * (F.col("na") + F.col("nb"))).select("a", "b")
    out = materialize(linked)
    discard(partners, wanted)
    return out


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each left set shares with each right one: products over slices of the n-grams that both sides have."""
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)
    for i in range(0, len(common), PRODUCT):
        part = common[i : i + PRODUCT]
        sides = []
        for sets in (left, right):
            m = np.zeros((len(sets), len(part)), np.float32)
            for k, s in enumerate(sets):
                s = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")]
                at = np.searchsorted(part, s)
                m[k, at[part[np.minimum(at, len(part) - 1)] == s]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _forest(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between two lists of places in sets (one list with itself: all its pairs)."""
    size = np.array([len(x) for x in sets])
    both = overlaps([sets[i] for i in left], [sets[j] for j in right])
    linked = 7 * both >= 3 * (size[left][:, None] + size[right][None, :])
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    edges = []
    for x, y in zip(*np.nonzero(linked)):
        i, j = int(left[x]), int(right[y])
        a, b = find(i), find(j)
        if a != b:
            root[a] = b
            edges.append((i, j))
    return edges


def _compare(batches):
    """Rows sorted by task (a pair of blocks of one cluster) -> edges of a spanning forest of the task's links."""
    import pyarrow as pa

    def flush(held):
        sets, mine = [h[1] for h in held], np.array([h[2] for h in held])
        left, right = np.flatnonzero(mine != 1), np.flatnonzero(mine != 0)
        return [(held[i][0], held[j][0]) for i, j in _forest(sets, left, right)] if len(left) and len(right) else []

    def out(edges):
        return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])

    held, task, edges = [], None, []
    for batch in batches:
        for t, c, side, tokens in zip(batch.column("task").to_pylist(), batch.column("_rk").to_pylist(), batch.column("side").to_pylist(), batch.column("tokens")):
            if t != task and held:
                edges += flush(held)
                held = []
            task = t
            held.append((c, np.frombuffer(tokens.as_buffer().to_pybytes(), np.uint64), side))
        if len(edges) > 10_000:
            yield out(edges)
            edges = []
    yield out(edges + (flush(held) if held else []))


def tasks(members: DataFrame, block: int) -> DataFrame:
    """members: cluster, _rk, n, main. Deals each cluster into blocks of similar set size (bands of a factor 4/3: linked sets are in
    one band or in adjacent ones), members of the main component apart from the rest, and each member to the pairs of blocks it
    takes part in, but for pairs of main blocks. side: 0 and 1 for the two blocks of a pair, 2 where a block is compared
    with itself."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3))).cast("int")
    members = members.withColumn("band", band)
    size = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(HELD / F.pow(F.lit(4 / 3), F.col("band") + 1))))  # bounded in documents and in n-grams
    blocks = members.groupBy("cluster", "band").agg(*[F.ceil(F.count_if(cond) / size).cast("int").alias(name) for name, cond in (("rest", ~F.col("main")), ("mains", F.col("main")))])
    near = blocks.select("cluster", F.explode(F.array(*[F.struct((F.col("band") + d).alias("band"), F.lit(d).alias("d"), "rest", "mains") for d in (-1, 0, 1)])).alias("x")).select("cluster", "x.*")
    near = near.groupBy("cluster", "band").agg(*[F.coalesce(F.max(F.when(F.col("d") == -d, F.col(k))), F.lit(0)).alias(f"{k}{i}") for i, d in enumerate((-1, 0, 1)) for k in ("rest", "mains")])
    m = members.join(near, ["cluster", "band"])
    # blocks of the rest have numbers from 0, main ones from -1 down
    h = F.when(F.col("main"), -1 - F.pmod(F.xxhash64("_rk"), F.col("mains1"))).otherwise(F.pmod(F.xxhash64("_rk"), F.col("rest1"))).cast("int")
    m = m.withColumn("h", h)

    def numbers(i):
        upto = lambda k: F.when(F.col(k) > 0, F.sequence(F.lit(0), F.col(k) - 1)).otherwise(F.array().cast("array<int>"))
        mains = F.when(F.col("main"), F.array().cast("array<int>")).otherwise(F.transform(upto(f"mains{i}"), lambda k: -1 - k))
        return F.concat(upto(f"rest{i}"), mains)

    pair = lambda b1, h1, b2, h2, side: F.struct(F.struct(b1.alias("b1"), h1.alias("h1"), b2.alias("b2"), h2.alias("h2")).alias("t"), side.alias("side"))
    b, h = F.col("band"), F.col("h")
    side = lambda o: F.when(o == h, 2).when(h < o, 0).otherwise(1)
    places = F.concat(
        F.transform(numbers(1), lambda o: pair(b, F.least(h, o), b, F.greatest(h, o), side(o))),
        F.transform(numbers(2), lambda o: pair(b, h, b + 1, o, F.lit(0))),
        F.transform(numbers(0), lambda o: pair(b - 1, o, b, h, F.lit(1))),
    )
    return m.select("cluster", "_rk", F.explode(places).alias("p")).select("_rk", F.xxhash64("cluster", "p.t").alias("task"), F.col("p.side").alias("side"))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component), by alternating large and small stars: every node's larger
    neighbours go to its smallest neighbour, then all its smaller ones do. Each round is written to the shared folder and the
    one before it deleted; two jobs a round, so that the driver holds little of their plans. It ends when the edges are stars: every
    node that has a smaller one has one such edge, and none of these leads to a node that has a smaller one itself."""
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not ends.agg(F.count_if(F.expr("up > 1 OR up = 1 AND down = 1"))).first()[0]:
            out = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._work_path = edges._work_path
            return out
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # not more rows than edges; the distinct below settles those that come twice
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", "m").union(small.where("v <> m").select(F.col("v").alias("u"), "m")).select("u", F.col("m").alias("v")).where("u <> v").distinct()
        before, edges = edges, materialize(small)
        discard(before)


def frequencies(texts: DataFrame, dense: int) -> tuple[DataFrame, DataFrame]:
    """The documents' sets (_rk, n, c1, c2), and slot and level of the frequent n-grams. Both depend on the rows alone."""
    chars = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    part_bits = max(8, int(chars // COUNTED).bit_length())
    described = materialize(texts.mapInArrow(lean(_describer(part_bits)), "_rk long, n long, c1 long, c2 long, part int, ones binary, many binary"))
    counts = described.where("part IS NOT NULL").select("part", "ones", "many")
    found = counts.repartition("part").sortWithinPartitions("part").mapInArrow(lean(_leveller(part_bits, dense)), "slot int, level int")
    levels = materialize(found.groupBy(F.col("slot").alias("place")).agg(F.max("level").alias("value")))
    rows = materialize(described.where("part IS NULL").select("_rk", "n", "c1", "c2"))
    discard(described)
    return rows, levels


def candidates(texts: DataFrame, rows: DataFrame, levels: DataFrame, dense: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b, na, nb; a < b), and the stars: gram, _rk, n."""
    total = rows.agg(F.sum("n")).first()[0] or 0
    shared = texts.sparkSession.sparkContext.broadcast(table_of(levels, 1 << SLOT_BITS))
    fragments = max(8, int(total) // (4 * FRAGMENT))
    # one document of each class goes on; the others join it at the end
    texts, heads = marked(texts, rows.where("n > 2").groupBy("c1", "c2").agg(F.min("_rk").alias("_rk")).select("_rk"))
    prefixes = texts.mapInArrow(lean(_prefixer(shared, heads, fragments)), "frag long, docs binary, grams binary")
    dealt = prefixes.repartition(max(TASKS, 2 * fragments // TOGETHER), "frag")
    counted = materialize(dealt.sortWithinPartitions("frag").mapInArrow(lean(_pairer(dense)), PAIRS))
    shared.destroy()
    heads.destroy()
    # partial overlaps summed per pair: up to the last shared place all other n-grams of a set are misses, so the overlap is at
    # most the set's size without them (pairs that share a dense n-gram as well meet in its cluster)
    pairs = counted.where("not dense").groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"), F.max("ia").alias("ia"), F.max("ib").alias("ib"))
    most = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) - 1 + F.col("shared")
    # and what isn't shared within a prefix lies beyond the end of one of the two
    rest = F.greatest(F.expr("(3 * na + 3) div 4"), F.expr("(3 * nb + 3) div 4")) - 1
    most = F.least(most, F.col("shared") + rest)
    pairs = materialize(pairs.where(7 * most >= 3 * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb"))
    stars = materialize(counted.where("dense").select(F.col("a").alias("gram"), F.col("b").alias("_rk"), F.col("nb").alias("n")))
    discard(counted)
    return pairs, stars


def links(docs: DataFrame, dense: int = DENSE, block: int = BLOCK):
    """The keyed documents, their sets (_rk, n, c1, c2) and edges between documents that connect every component's classes."""
    configure(docs.sparkSession)
    docs = keyed(docs)
    texts = docs.select("_rk", "text")
    rows, levels = frequencies(texts, dense)
    pairs, stars = candidates(texts, rows, levels, dense)
    discard(levels)
    give_back(docs.sparkSession)
    # round one: everyone with its least candidate; of a dense n-gram and size band that is the least member
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3))).cast("int")
    hubs = stars.groupBy("gram", band.alias("band")).agg(F.min(F.struct("_rk", "n")).alias("hub"))
    near = stars.withColumn("band", band).join(hubs, ["gram", "band"]).select(F.col("hub._rk").alias("a"), F.col("_rk").alias("b"), F.col("hub.n").alias("na"), F.col("n").alias("nb")).where("a < b AND 4 * least(na, nb) >= 3 * greatest(na, nb)")
    first = pairs.union(near).groupBy("b", "nb").agg(F.min(F.struct("a", "na")).alias("x")).select("x.a", "b", "x.na", "nb")
    first = materialize(first)
    edges = verify(texts, first)
    roots = components(edges)
    label = lambda df, side: df.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"_{side}")), side, "left").withColumn(f"_{side}", F.coalesce(f"_{side}", side))
    apart = materialize(label(label(pairs, "a"), "b").where("_a <> _b").select("a", "b", "na", "nb").join(first.select("a", "b"), ["a", "b"], "left_anti"))
    give_back(docs.sparkSession)
    more = verify(texts, apart)
    give_back(docs.sparkSession)
    # what dense n-grams tie together, without the pairs inside its largest component
    ties = stars.join(stars.groupBy("gram").agg(F.min("_rk").alias("a")), "gram").select("a", F.col("_rk").alias("b"))
    tied = components(ties)
    cluster = tied.select(F.col("node").alias("_rk"), F.col("root").alias("cluster"))
    cluster = cluster.union(tied.select("root", "root").distinct())
    members = stars.groupBy("_rk").agg(F.first("n").alias("n")).join(cluster, "_rk")
    members = materialize(members.join(roots.withColumnRenamed("node", "_rk"), "_rk", "left").withColumn("label", F.coalesce("root", "_rk")).drop("root"))
    largest = members.groupBy("cluster", "label").count().groupBy("cluster").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    dealt = materialize(tasks(members.join(largest, "cluster").withColumn("main", F.col("main") == F.col("label")), block))
    if not dealt.isEmpty():
        compared = sets_of(texts, dealt).repartition("task").sortWithinPartitions("task").select("task", "_rk", "side", "tokens").mapInArrow(lean(_compare), "a long, b long")
        edges, before = materialize(edges.union(compared)), edges
        discard(before)
    out = materialize(edges.union(more))
    discard(pairs, stars, first, edges, roots, apart, more, tied, members, dealt)
    give_back(docs.sparkSession)
    return docs, rows, out


def join(docs: DataFrame, dense: int = DENSE, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id of each document."""
    docs, rows, edges = links(docs, dense, block)
    heads = rows.where("n > 0").groupBy("c1", "c2").agg(F.min("_rk").alias("head"))
    # edges between documents become edges between their classes
    head_of = rows.join(edges.select(F.col("a").alias("_rk")).union(edges.select("b")).distinct(), "_rk").join(heads, ["c1", "c2"]).select("_rk", "head")
    ends = edges.join(head_of.withColumnsRenamed({"_rk": "a", "head": "_a"}), "a").join(head_of.withColumnsRenamed({"_rk": "b", "head": "_b"}), "b")
    roots = components(ends.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    give_back(docs.sparkSession)
    rows = rows.join(docs.select("_rk", F.col("doc_id").cast("long").alias("doc_id")), "_rk")
    classes = rows.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("first"), F.min("_rk").alias("head"))
    classes = classes.join(roots.withColumnRenamed("node", "head"), "head", "left").withColumn("root", F.coalesce("root", "head"))
    firsts = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = classes.join(firsts, "root").select("c1", "c2", "component_id")
    out = rows.where("n > 0").join(classes, ["c1", "c2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.union(rows.where("n = 0").select("doc_id", "n", F.col("doc_id")))
