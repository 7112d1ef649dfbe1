"""What the two repeat finders share: bringing equal windows of all documents together.

A window is `size` consecutive units (bytes or words) of one document. Its key is the least hash of the grams in it,
a function of its content alone, so equal windows have equal keys wherever they lie. Consecutive windows with one key
form a run (about one per `size` / 2 units); runs with a key that occurs once can't hold a repeat.

`find`:
1. keys: all texts are scanned for the keys of their runs, which are counted: sorted 64-bit keys in parts, one row per part
   and FLUSH keys of a task. Keys of several runs, and of a run that may repeat itself, set a bit each in a bitmap.
2. runs: texts are scanned again, and the bytes of the runs whose key has its bit set go on. Of runs with equal
   bytes in one slice of input one goes on with weight 2, and the others are repeats: a passage that a third of all
   documents share is one row a slice.
3. solve: runs of one key meet in one task, in pools bounded in bytes; the operator's own method finds the repeated windows
   in a pool, by content. Equal runs of a pool enter it twice, for all of them.
4. split: a key of more than `hot` runs would not fit a pool: runs at the edge of a shared passage have one key and other bytes in
   every document. Such keys are dealt window by window instead: equal windows are counted by their bytes, with partial sums,
   and each distinct one goes into a pool, once or twice, where the operator's own method decides as for any other run. No
   task holds a key.
Spans of all steps are merged per document and applied to the input.

The bitmap has 16 bits a repeated key within 2**20 and 2**BITMAP bits (16 MB). Beyond some 8 million repeated keys it fills, and
runs that don't repeat pass as well, in the end all; results are the same, the shuffle is larger.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import configure, discard, keyed, lean, materialize, slices, table_of, text_buffer

#: Bytes of text scanned at once, bytes of runs solved at once, most windows in a run.
SLICE, POOL, LONGEST = 1 << 20, 1 << 20, 512
#: Keys that a task counts at once, bytes of text per part of the counting, and bits of the largest bitmap (as a power).
FLUSH, COUNTED, BITMAP = 2_000_000, 128_000_000, 27
#: Runs of a key (some 200 to 350 bytes each) from which on it is split.
HOT = 5_000

RUNS = "key long, _rk long, at long, weight int, units long, body binary"


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values, by blocks scanned from both sides."""
    n = len(values)
    if n < width:
        return np.zeros(0, values.dtype)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def runs_of(grams: np.ndarray, gram: int, size: int, first: np.ndarray):
    """grams: hash of the `gram` units from each unit on (garbage across documents); first: each document's first unit
    (len + 1). Returns of each run: document, first unit, windows, key, and whether equal windows may be in the run
    itself. A window's least gram is by the upper half of its hash, of equal ones the leftmost."""
    places = np.arange(len(grams), dtype=np.uint64)
    left = (least((grams & np.uint64(0xFFFFFFFF00000000)) | places, size - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lengths = np.diff(first)
    starts = np.maximum(lengths - size + 1, 0)
    doc = np.repeat(np.arange(len(lengths)), starts)
    at = np.arange(len(doc)) + np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(starts)[:-1]]), starts)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(bool)
    left = left[at]
    k = grams[left]
    begins = np.ones(len(at), bool)
    begins[1:] = (k[1:] != k[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(begins)
    length = np.diff(np.append(begin, len(at)))
    if (length > LONGEST).any():  # long runs (periodic text) in parts
        parts = -(-length // LONGEST)
        inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        length = np.minimum(np.repeat(length, parts) - inside * LONGEST, LONGEST)
        begin = np.repeat(begin, parts) + inside * LONGEST
    # equal windows of one run have their least gram at the same distance, so at different places
    loop = left[begin] != left[begin + length - 1]
    return doc[begin], at[begin], length, k[begin], loop


def _scan(batches, units: Callable, gram: int, size: int):
    """Of each slice of the texts: bytes, units' places (None where units are bytes), first units, keys of rows, and the runs."""
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        rk = batch.column("_rk").to_numpy(zero_copy_only=False)
        for i, j in slices(offsets, SLICE):
            own, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            grams, first, cuts = units(own, bounds)
            yield own, cuts, first, rk[i:j], runs_of(grams, gram, size, first)


def _keys(units: Callable, gram: int, size: int, part_bits: int):
    """The keys of runs, sorted, by part; those of several runs (or of one that may repeat itself) twice."""

    def run(batches):
        import pyarrow as pa

        def flush(held):
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            keys = np.repeat(keys, np.minimum(n, 2))
            part = (keys & np.uint64((1 << part_bits) - 1)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, keys = part[order], keys[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
            return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), pa.array([keys[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], ["part", "keys"])

        held, n = [], 0
        for _, _, _, _, (_, _, _, key, loop) in _scan(batches, units, gram, size):
            held += [key, key[loop]]
            n += len(key)
            if n >= FLUSH:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return run


def _repeated(batches):
    """Keys sorted by part -> those that occur twice."""
    import pyarrow as pa

    def flush(held):
        keys = np.sort(np.frombuffer(b"".join(held), np.uint64))
        twice = np.unique(keys[1:][keys[1:] == keys[:-1]]).view(np.int64)
        for i in range(0, len(twice), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(twice[i : i + 100_000])], ["key"])

    held, part = [], None
    for batch in batches:
        for p, keys in zip(batch.column("part").to_pylist(), batch.column("keys")):
            if p != part and held:
                yield from flush(held)
                held = []
            part = p
            held.append(keys.as_buffer().to_pybytes())
    if held:
        yield from flush(held)


def _cutter(shared, units: Callable, gram: int, size: int, body: Callable):
    """Runs whose key is in the bitmap, with their bytes; weight 0: a span that is known to repeat."""

    def run(batches):
        import pyarrow as pa

        bitmap = np.frombuffer(shared.value, np.uint8)
        mask = np.uint64(8 * len(bitmap) - 1)
        for own, cuts, first, rk, (doc, at, windows, key, loop) in _scan(batches, units, gram, size):
            place = (key >> np.uint64(8) & mask).astype(np.int64)
            some = np.flatnonzero((bitmap[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1)
            if not len(some):
                continue
            raw, seen = own.tobytes(), {}
            keys, row, where, weight, bodies = key[some].view(np.int64).tolist(), rk[doc[some]].tolist(), (at[some] - first[doc[some]]).tolist(), [1] * len(some), []
            units_of = (windows[some] + size - 1).tolist()
            for i, (a, n) in enumerate(zip(at[some].tolist(), units_of)):
                b = body(raw, cuts, a, n)
                j = seen.setdefault(b, i)
                if j != i:
                    weight[j], weight[i], b = 2, 0, b""
                bodies.append(b)
            more = [i for i, w in enumerate(weight) if w == 2]  # their own spans repeat as well
            keys, row, where, units_of, bodies = ([*x, *[x[i] for i in more]] for x in (keys, row, where, units_of, bodies))
            bodies[len(weight) :] = [b""] * len(more)
            weight += [0] * len(more)
            for i in range(0, len(keys), 2_000):
                columns = [pa.array(x[i : i + 2_000], t) for x, t in ((keys, pa.int64()), (row, pa.int64()), (where, pa.int64()), (weight, pa.int32()), (units_of, pa.int64()), (bodies, pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "_rk", "at", "weight", "units", "body"])

    return run


def _solver(solve: Callable, size: int, bodies: bool = False):
    """Runs sorted by key -> spans, or with `bodies` the contents that hold a repeat. solve(bodies, windows, copies) gives per body a bool array: windows that also start
    elsewhere in the pool; copies says how often (1 or 2) a body is in it."""

    def flush(rows):
        import pyarrow as pa

        place: dict[bytes, int] = {}
        windows, copies = [], []
        for _, _, _, weight, units, body in rows:
            i = place.setdefault(body, len(windows))
            if i == len(windows):
                windows.append(units - size + 1)
                copies.append(weight)
            else:
                copies[i] = 2
        found = solve([*place], windows, copies)
        if bodies:
            return pa.RecordBatch.from_arrays([pa.array([b for b, i in place.items() if found[i].any()], pa.binary())], ["body"])
        spans = []
        for hit in found:
            edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            spans.append(list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())) if hit.any() else [])
        rk, at, units = [], [], []
        for _, row, where, weight, _, body in rows:
            if weight == 1:  # those of weight 2 have theirs from their slice
                for a, b in spans[place[body]]:
                    rk.append(row)
                    at.append(where + a)
                    units.append(b - a + size - 1)
        return pa.RecordBatch.from_arrays([pa.array(rk, pa.int64()), pa.array(at, pa.int64()), pa.array(units, pa.int64())], ["_rk", "at", "units"])

    def run(batches):
        held, group, pool, own = [], [], 0, 0  # group: the rows of the key at hand
        for batch in batches:
            for r in zip(*(batch.column(n).to_pylist() for n in ("key", "_rk", "at", "weight", "units", "body"))):
                if group and r[0] != group[-1][0]:
                    if len(group) > 1 or group[0][3] > 1 or group[0][4] > size:  # a run alone, of one window, can't repeat
                        held += group
                        pool += own
                    group, own = [], 0
                    if pool >= POOL:
                        yield flush(held)
                        held, pool = [], 0
                group.append(r)
                own += len(r[5])
        if held + group:
            yield flush(held + group)

    return run


def _splitter(windows_of: Callable):
    """Runs -> their windows: content, place and weight."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row, where, weight, body in zip(*(batch.column(n).to_pylist() for n in ("_rk", "at", "weight", "body"))):
                own = list(windows_of(body))
                n = len(own)
                columns = [pa.array(own, pa.binary()), pa.array([row] * n, pa.int64()), pa.array(range(where, where + n), pa.int64()), pa.array([weight] * n, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["body", "_rk", "at", "weight"])

    return run


def find(docs: DataFrame, units: Callable, body: Callable, windows_of: Callable, solve: Callable, gram: int, size: int, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """The keyed documents, and for each with repeats its `_rk` and `spans`: array of (at, units), in units.

    units(bytes, offsets) gives gram hashes, the documents' first units and where units lie; body(bytes, that, first unit, units)
    the content of a run; windows_of(content) the contents of its windows."""
    spark = docs.sparkSession
    configure(spark)
    docs = keyed(docs)
    texts = docs.select("_rk", "text")
    chars = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    part_bits = max(6, int(chars // COUNTED).bit_length())
    keys = texts.mapInArrow(lean(_keys(units, gram, size, part_bits)), "part int, keys binary")
    known = materialize(keys.repartition("part").sortWithinPartitions("part").mapInArrow(lean(_repeated), "key long"))
    bits = 1 << min(BITMAP, max(20, (16 * max(1, known.count()) - 1).bit_length()))
    place = F.shiftright("key", 8).bitwiseAND(F.lit(bits - 1)).cast("int")
    shared = spark.sparkContext.broadcast(table_of(known.select(place.alias("place"), F.lit(1).alias("value")).distinct(), bits, bool))
    discard(known)
    runs = materialize(texts.mapInArrow(lean(_cutter(shared, units, gram, size, body)), RUNS))
    found = runs.where("weight > 0")
    often = materialize(found.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key"))  # not more than runs / hot
    solved = found.join(often, "key", "left_anti").select(*found.columns).repartition("key").sortWithinPartitions("key", "_rk", "at").mapInArrow(lean(_solver(solve, size)), "_rk long, at long, units long")
    split = materialize(found.join(often, "key", "left_semi").mapInArrow(lean(_splitter(windows_of)), "body binary, _rk long, at long, weight int"))
    alone = split.groupBy("body").agg(F.least(F.lit(2), F.sum("weight")).cast("int").alias("weight"))
    alone = alone.select(F.xxhash64("body").alias("key"), F.lit(0).cast("long").alias("_rk"), F.lit(0).cast("long").alias("at"), "weight", F.lit(size).cast("long").alias("units"), "body")
    twice = alone.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_solver(solve, size, bodies=True)), "body binary")
    split_spans = split.where("weight = 1").join(twice, "body", "left_semi").select("_rk", "at", F.lit(size).cast("long").alias("units"))
    spans = runs.where("weight = 0").select("_rk", "at", "units").union(solved).union(split_spans)
    spans = materialize(spans.groupBy("_rk").agg(F.collect_list(F.struct("at", "units")).alias("spans")))
    discard(runs, often, split)
    return docs, spans


def covered(spans, n: int) -> list[tuple[int, int]]:
    """Spans (at, units) merged where they overlap or touch, as [start, end)."""
    out: list[list[int]] = []
    for a, b in sorted((s["at"], s["at"] + s["units"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, n)) for a, b in out]
