"""Shared helpers: session settings, work tables in the shared folder, row keys, Arrow text access."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: dict[str, SparkSession] = {}

#: Rows and bytes per Arrow batch: a batch stays at a few MB; a longer text is a batch alone.
ARROW_ROWS, ARROW_BYTES = 512, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only where that is unset (tests) a folder of our own is set, and only if
    the master is local: elsewhere a temporary folder would be another one on each machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        else:
            base = tempfile.mkdtemp(prefix="sharelens-")
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def configure(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def lean(run: Callable) -> Callable:
    """run, and at its end what it has freed goes back to the system: Python workers are used again and would keep it."""

    def wrapped(batches):
        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        give_back()

    return wrapped


def give_back(spark: SparkSession | None = None) -> None:
    """What this process has freed goes back to the system; with `spark` its JVM collects its garbage first, so that shuffle files,
    broadcasts and plans of tables that are no longer used go as well, and gives back too."""
    if spark is not None:
        jvm = spark.sparkContext._jvm
        jvm.System.gc()
        with contextlib.suppress(Exception):  # only some JVMs have the command
            types = spark.sparkContext._gateway.new_array(jvm.Class, 4)
            for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
                types[i] = jvm.Class.forName(name)
            own = spark.sparkContext._gateway.new_array(jvm.Object, 4)
            own[0], own[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
            jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), own)
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def cleanup() -> None:
    """Deletes the work tables of this process; runs at exit."""
    while _MADE:
        path, spark = _MADE.popitem()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session has ended; the shared folder's owner clears it
            return


def materialize(df: DataFrame) -> DataFrame:
    """Writes `df` as a table in the shared folder and reads it back: lineage is cut, any executor may be lost."""
    spark = df.sparkSession
    if not _MADE:
        atexit.register(cleanup)
    path = f"{shared_dir(spark)}/sharelens-{uuid.uuid4().hex}"
    _MADE[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes work tables that nothing reads any more."""
    for t in tables:
        _delete(_MADE.pop(t._work_path), t._work_path)


def tables() -> set[str]:
    """The work tables there are."""
    return set(_MADE)


def discard_since(before: set[str], *keep: DataFrame) -> None:
    """Deletes the work tables made since, but for `keep`."""
    for path in set(_MADE) - before - {t._work_path for t in keep}:
        _delete(_MADE.pop(path), path)
    give_back(keep[0].sparkSession if keep else None)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def keyed(df: DataFrame, columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """`columns` of `df`, null text as '', and `_rk` of `numbered`."""
    return numbered(df.select(*columns).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))))


def numbered(df: DataFrame) -> DataFrame:
    """`df` and `_rk`: a long that is unique per row.

    It is the doc_id where that is unique and never null (one cheap pass over that column); else
    rows are numbered and written once with their numbers, so null and repeated ids and repeated rows stay apart."""
    ids = df.groupBy("doc_id").count().agg(F.max("count"), F.count_if(F.col("doc_id").isNull())).first()
    if (ids[0] or 0) <= 1 and not ids[1]:
        return df.withColumn("_rk", F.col("doc_id").cast("long"))
    return materialize(df.withColumn("_rk", F.monotonically_increasing_id()))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column end to end, and the len + 1 offsets into them."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Bytes of a text whose words are listed at once.
PIECE = 1 << 20


def word_pieces(data: memoryview, fold: bytes):
    """The words of one text as lists, about PIECE bytes at a time. `fold` maps each byte to that of a word or to a space."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + PIECE, n)
        piece = bytes(data[at:end]).translate(fold)
        cut = piece.rfind(b" ")
        while cut < 0 and end < n:  # one word longer than a piece
            more = bytes(data[end : end + PIECE]).translate(fold)
            end += len(more)
            cut = len(piece) + more.rfind(b" ") if b" " in more else -1
            piece += more
        if end < n:
            end = at + cut + 1
            piece = piece[: cut + 1]
        yield piece.split()
        at = end


def slices(offsets: np.ndarray, most: int):
    """(first, last + 1) ranges of rows with about `most` bytes each; a longer text is a range alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums and minima of its results behave like random ones."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: Steps of eight bytes that a hash takes one by one; longer ranges are folded by pairs.
STEPS = 64
_STEP, _LEFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PARTIAL = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def words_at(data: np.ndarray, big: bool = False) -> np.ndarray:
    """The eight bytes from each position on as one integer; zeros follow the end."""
    n = len(data)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = data
    out = np.empty(n + 8, np.uint64)
    for o in range(8):
        m = (n + 8 - o + 7) // 8
        out[o::8] = np.frombuffer(padded, ">u8" if big else "<u8", min(m, (n + 16 - o) // 8), o)[: len(out[o::8])]
    return out[:n]


def _fold(x: np.ndarray) -> np.uint64:
    """One hash of an array of integers: neighbours are mixed by pairs, level by level."""
    while len(x) > 1:
        x = np.append(x, np.uint64(0)) if len(x) % 2 else x
        x = mix(mix(x[::2] * _LEFT + _STEP) + x[1::2])
    return x[0]


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes data[start:end] of each range, mixed anew at every step of eight bytes."""
    length = np.asarray(ends) - starts
    with np.errstate(over="ignore"):
        h = mix(length.astype(np.uint64) + _STEP)
        if not len(h):
            return h
        words, live = words_at(data), np.arange(len(h))
        for k in range(min(STEPS, -(-int(length.max()) // 8))):
            live = live[length[live] > 8 * k]
            h[live] = mix(h[live] ^ (words[starts[live] + 8 * k] & _PARTIAL[np.minimum(length[live] - 8 * k, 8)])) + _LEFT
        for i in np.flatnonzero(length > 8 * STEPS):
            rest = words[starts[i] + 8 * STEPS : ends[i] : 8].copy()
            rest[-1] &= _PARTIAL[(length[i] - 1) % 8 + 1]
            h[i] = mix(h[i] ^ _fold(rest))
        return h


def sequence_hashes(values: np.ndarray, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of the `size` values from each place on, mixed anew at every value; for short sequences."""
    with np.errstate(over="ignore"):
        h = mix(values[at] + _STEP)
        one = np.isscalar(size)
        for k in range(1, int(size if one else size.max() if len(size) else 1)):
            if one or (size > k).all():
                h = mix(h ^ values[at + k]) + _LEFT
            else:
                ok = size > k
                h[ok] = mix(h[ok] ^ values[at[ok] + k]) + _LEFT
        return h


#: Places per range of a table that the cluster builds.
RANGE = 1 << 16


def _filled(kind):
    """Places sorted by range with a value each -> one array of RANGE values of `kind` per range; bool as bits."""

    def run(batches):
        import pyarrow as pa

        held, part, parts, out = np.zeros(RANGE, kind), None, [], []
        pack = (lambda: np.packbits(held).tobytes()) if kind is bool else (lambda: held.tobytes())
        for batch in batches:
            p, at, value = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("part", "at", "value"))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(p)) + 1, [len(p)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if part is not None and p[a] != part:
                    parts.append(part)
                    out.append(pack())
                    held[:] = 0
                part = p[a]
                held[at[a:b]] = value[a:b].astype(kind)
        if part is not None:
            parts.append(part)
            out.append(pack())
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(out, pa.binary())], ["part", "bytes"])

    return run


def table_of(places: DataFrame, size: int, kind=np.uint8) -> bytes:
    """places: place (0 to size - 1) and value, distinct places. The table of all values, built by ranges on the cluster: size
    bytes, or bits where kind is bool. Its size is a parameter, not a count of rows."""
    width = RANGE // 8 if kind is bool else RANGE
    out = bytearray(max(1, size // RANGE) * width)
    ranges = places.select(F.shiftright("place", 16).cast("int").alias("part"), (F.col("place") % RANGE).cast("int").alias("at"), F.col("value").cast("int").alias("value"))
    for r in ranges.repartition("part").sortWithinPartitions("part").mapInArrow(lean(_filled(kind)), "part int, bytes binary").collect():
        out[r["part"] * width : (r["part"] + 1) * width] = r["bytes"]
    return bytes(out)


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of all texts, and each text's first word (len + 1)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)
