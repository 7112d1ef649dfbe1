"""Vector code compression: product codes from codebooks trained by filtering Lloyd rounds.

Components become integers floor(1024 * x), and each vector is cut into PARTS equal consecutive parts. Every partition cuts its
vectors into blocks and builds, per part position, a kd-tree over the block's parts: nodes hold a bounding box and the cached
componentwise sum and count of their points. `trees` writes them once; each round reads them, walks down level by level with the
candidates of each node, drops an entry that is farther than the entry nearest to the box's middle from every
corner of the box, and gives a whole subtree to the last entry left. Only leaves with several candidates are decided
point by point. Partial sums of a task are one row per part and entry, so a round shuffles a fixed amount per task, and the driver
holds the codebooks alone (PARTS * ENTRIES rows). Everything is exact integer arithmetic.

Defined cases: a null vector, or one with null, NaN or infinite components, is dropped; so is one whose length is not that of
most usable vectors (a positive multiple of PARTS; of lengths equally frequent the smallest counts). A null vec_id is kept and
comes after all others when the first codebook is taken, equal ids by their components; repeated rows each come back; with fewer
than ENTRIES rows there are as many entries as rows. An empty table gives no rows. Null labels are one label; other columns
are ignored. A component whose integer reaches 2^28 raises an error, since `error` is a long.
"""

from __future__ import annotations

import hashlib
import io
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import configure, lean, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024

#: Vectors of one block, points of one leaf, and labels up to which their sums are broadcast (16 bytes each).
BLOCK, LEAF, LABELS = 4096, 16, 100_000

#: Largest component (exclusive), and the one up to which products in float64 are exact for parts of up to 128 components.
LARGEST, EXACT = 1 << 28, 1 << 22


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and v, the integer components, of rows that count."""
    x = F.col("embedding").cast("array<double>")
    ok = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x")).where(ok & (F.size("x") > 0) & (F.size("x") % PARTS == 0))
    return kept.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * SCALE)).alias("v"), F.array_max(F.transform("x", F.abs)).alias("most"))


@dataclass
class Tree:
    """A kd-tree over (n, d) integer points. Points lie in tree order; nodes level by level, children of `left` are left and
    left + 1, leaves have -1."""

    order: np.ndarray  # the place of each point in the block
    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray
    left: np.ndarray

    @classmethod
    def build(cls, x: np.ndarray) -> Tree:
        order = np.arange(len(x))
        starts, ends, lows, highs, sums, left = [0], [len(x)], [], [], [], []
        k = 0
        while k < len(starts):
            a, b = starts[k], ends[k]
            own = x[order[a:b]]
            low, high = own.min(axis=0), own.max(axis=0)
            lows.append(low)
            highs.append(high)
            sums.append(own.sum(axis=0, dtype=np.int64))
            axis = int(np.argmax(high - low))
            if b - a > LEAF and high[axis] > low[axis]:
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, axis], half, kind="introselect")]
                left.append(len(starts))
                starts += [a, a + half]
                ends += [a + half, b]
            else:
                left.append(-1)
            k += 1
        return cls(order.astype(np.int32), x[order], np.array(starts, np.int32), np.array(ends, np.int32), np.array(lows), np.array(highs), np.array(sums), np.array(left, np.int32))

    def nearest(self, book: Codebook) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The entry of each point (in tree order), and the (nodes, entries) that were assigned whole."""
        code = np.full(len(self.points), -1, np.int32)
        whole = []
        nodes = np.zeros(1, np.int64)
        held = np.ones((1, len(book.entries)), bool)
        while len(nodes):
            held, best = book.filter(self.low[nodes], self.high[nodes], held)
            single = held.sum(axis=1) == 1
            whole.append((nodes[single], best[single]))
            for node, entry in zip(nodes[single], best[single]):
                code[self.start[node] : self.end[node]] = entry
            leaf = ~single & (self.left[nodes] < 0)
            if leaf.any():
                spans = [np.arange(self.start[n], self.end[n]) for n in nodes[leaf]]
                at = np.concatenate(spans)
                among = np.repeat(held[leaf], [len(s) for s in spans], axis=0)
                code[at] = book.among(self.points[at], among)
            inner = ~single & ~leaf
            below = self.left[nodes[inner]].astype(np.int64)
            nodes = np.concatenate([below, below + 1])
            held = np.concatenate([held[inner], held[inner]])
        return code, whole


class Codebook:
    """The entries of one part position, (k, d) int64, with what the filter needs."""

    def __init__(self, entries: np.ndarray, largest: int):
        kind = np.float64 if largest <= EXACT and entries.shape[1] <= 128 else np.int64
        self.kind, self.entries = kind, entries.astype(np.int64)
        self.c = entries.astype(kind)
        self.square = (self.c * self.c).sum(axis=1)
        self.top = np.inf if kind is np.float64 else np.iinfo(np.int64).max
        self.apart: dict[int, np.ndarray] = {}

    def _apart(self, z: int) -> np.ndarray:
        """|c - c[z]| by component, (d, k); kept for as long as the codebook."""
        if z not in self.apart:
            self.apart[z] = np.abs(self.c - self.c[z]).T.copy()
        return self.apart[z]

    def filter(self, low: np.ndarray, high: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidates left for each box, and the entry nearest to its middle. With s = low + high and w = high - low, entry c is
        nowhere in the box nearer than z where |c|^2 - |z|^2 - s(c - z) - w|c - z| > 0; equality goes by the index."""
        low, high = low.astype(self.kind), high.astype(self.kind)
        near = np.where(held, self.square - (low + high) @ self.c.T, self.top)
        best = near.argmin(axis=1)
        wide = high - low
        out = np.empty_like(held)
        for z in np.unique(best):
            mine = best == z
            # in int64 a dropped entry's `near` must not wrap, so it is compared only where it is held
            ahead = np.where(held[mine], near[mine], near[mine][:, [z]]) - near[mine][:, [z]] - wide[mine] @ self._apart(z)
            gone = (ahead > 0) | ((ahead == 0) & (np.arange(held.shape[1]) > z))
            out[mine] = held[mine] & ~gone
        return out, best

    def among(self, x: np.ndarray, held: np.ndarray) -> np.ndarray:
        """The nearest held entry of each point; ties go to the lower index."""
        return np.where(held, self.square - 2 * (x.astype(self.kind) @ self.c.T), self.top).argmin(axis=1)


def _pack(vec_ids: list, labels: list, v: np.ndarray) -> bytes:
    """One block: ids, labels and the trees of all part positions."""
    kind = np.int16 if np.abs(v).max(initial=0) < 1 << 15 else np.int32
    held = {"has_id": [x is not None for x in vec_ids], "id": [x or 0 for x in vec_ids], "has_label": [x is not None for x in labels], "label": [x or 0 for x in labels]}
    held = {k: np.array(x, bool if k.startswith("has") else np.int64) for k, x in held.items()}
    for p, part in enumerate(np.split(v, PARTS, axis=1)):
        for k, x in vars(Tree.build(part)).items():
            held[f"{p}_{k}"] = x.astype(kind) if k in ("points", "low", "high") else x
    out = io.BytesIO()
    np.savez(out, **held)
    return out.getvalue()


def _unpack(block: bytes):
    held = np.load(io.BytesIO(block))
    names = Tree.__dataclass_fields__
    return held, [Tree(*(held[f"{p}_{k}"] for k in names)) for p in range(PARTS)]


def trees(rows: DataFrame, size: int) -> DataFrame:
    """rows: vec_id, label, v of `size` components. One row per block of a partition: its trees."""
    most = max(LEAF, min(BLOCK, (1 << 22) // size))

    def run(batches):
        import pyarrow as pa

        ids, labels, parts, n = [], [], [], 0

        def block():
            return pa.RecordBatch.from_arrays([pa.array([_pack(ids, labels, np.concatenate(parts))], pa.binary())], ["block"])

        for batch in batches:
            for at in range(0, batch.num_rows, most):
                piece = batch.slice(at, most)
                if n and n + piece.num_rows > most:
                    yield block()
                    ids, labels, parts, n = [], [], [], 0
                ids += piece.column("vec_id").to_pylist()
                labels += piece.column("label").to_pylist()
                parts.append(piece.column("v").flatten().to_numpy().reshape(-1, size))
                n += piece.num_rows
        if n:
            yield block()

    return rows.select("vec_id", "label", "v").mapInArrow(lean(run), "block binary")


def _lloyd(books: np.ndarray, largest: int):
    """Blocks -> per part and entry the sum and count of its points in this task."""
    parts, k, d = books.shape

    def run(batches):
        import pyarrow as pa

        held = [Codebook(b, largest) for b in books]
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            for block in batch.column("block"):
                for p, tree in enumerate(_unpack(block.as_py())[1]):
                    code, whole = tree.nearest(held[p])
                    alone = np.ones(len(code), bool)
                    for nodes, entries in whole:  # whole subtrees by their cached sums
                        np.add.at(sums[p], entries, tree.sums[nodes])
                        np.add.at(counts[p], entries, tree.end[nodes] - tree.start[nodes])
                        for node in nodes:
                            alone[tree.start[node] : tree.end[node]] = False
                    np.add.at(sums[p], code[alone], tree.points[alone].astype(np.int64))
                    counts[p] += np.bincount(code[alone], minlength=k)
        p, e = np.nonzero(counts)
        flat = pa.array(sums[p, e].reshape(-1), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e], pa.int64()), pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * d, flat)], ["part", "entry", "n", "sums"])

    return run


def rounds(blocks: DataFrame, books: np.ndarray, largest: int, n: int = ROUNDS) -> np.ndarray:
    """books: (part, entry, component), after n rounds over the blocks."""
    for _ in range(n):
        parts = blocks.mapInArrow(lean(_lloyd(books, largest)), "part int, entry int, n long, sums array<long>")
        # one row per part and entry comes to the driver, PARTS * ENTRIES of them at most, in one job (an iterator takes one for each partition)
        total = parts.select("part", "entry", "n", F.posexplode("sums").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        books = books.copy()
        for r in total.groupBy("part", "entry").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "x"))).alias("sums")).collect():
            books[r["part"], r["entry"]] = [c["x"] // r["n"] for c in r["sums"]]
    return books


def assign(blocks: DataFrame, books: np.ndarray, largest: int) -> DataFrame:
    """vec_id, label, code and error of every vector."""

    def run(batches):
        import pyarrow as pa

        held = [Codebook(b, largest) for b in books]
        for batch in batches:
            for block in batch.column("block"):
                data, found = _unpack(block.as_py())
                n = len(data["id"])
                codes, error = np.zeros((n, PARTS), np.uint8), np.zeros(n, np.int64)
                for p, tree in enumerate(found):
                    code, _ = tree.nearest(held[p])
                    away = tree.points.astype(np.int64) - held[p].entries[code]
                    codes[tree.order, p] = code
                    error[tree.order] += (away * away).sum(axis=1)
                text = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays([
                    pa.array(data["id"], pa.int64(), mask=~data["has_id"]), pa.array(data["label"], pa.int64(), mask=~data["has_label"]),
                    pa.array([text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)], pa.string()), pa.array(error),
                ], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(lean(run), "vec_id long, label long, code string, error long")


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error, the error summed over equal labels. Few labels (counted) are broadcast; with many of them the sums
    are joined by label, and adaptive execution splits a label that holds much of the rows."""
    sums = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"))
    small = sums.count() <= LABELS
    return coded.join(F.broadcast(sums) if small else sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of every usable vector."""
    spark = vectors.sparkSession
    configure(spark)
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), F.max("most").alias("most"))
    top = sizes.agg(F.max_by(F.struct("size", "most"), F.struct("n", -F.col("size")))).first()[0]
    if top is None:
        return spark.createDataFrame([], "vec_id long, label long, code string, error long, label_error long, codebooks_sha256 string")
    size, largest = top["size"], int(top["most"] * SCALE) + 1
    if largest >= LARGEST:
        raise ValueError(f"components reach {top['most']}: squared distances exceed a long")
    rows = rows.where(F.size("v") == size)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(ENTRIES).collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), PARTS, size // PARTS).transpose(1, 0, 2)
    blocks = materialize(trees(rows, size))
    books = rounds(blocks, books, largest)
    coded = materialize(assign(blocks, books, largest))
    return with_label_error(coded).withColumn("codebooks_sha256", F.lit(digest(books)))


def sql() -> str:
    """DuckDB SQL of `compress` on a table `embeddings` of vectors of one length."""
    near = """
a{r} AS MATERIALIZED (SELECT k, p, v, min_by(e, d * 256 + e) AS e, min(d) AS d FROM (
  SELECT x.k, x.p, x.v, b.e, list_sum(list_transform(list_zip(x.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM parts x JOIN b{r} b ON x.p = b.p) GROUP BY ALL)"""
    move = """
b{s} AS MATERIALIZED (SELECT p, e, coalesce(m, c) AS c FROM b{r} LEFT JOIN (
  SELECT p, e, list(floor_div ORDER BY i) AS m FROM (
    SELECT p, e, i, (sum(x) - (((sum(x) % count(*)) + count(*)) % count(*))) // count(*) AS floor_div
    FROM (SELECT p, e, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{r}) GROUP BY p, e, i) GROUP BY p, e) USING (p, e))"""
    steps = "".join(near.format(r=r) + "," + (move.format(r=r, s=r + 1) + "," if r < ROUNDS else "") for r in range(ROUNDS + 1))
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS k, * FROM (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
parts AS MATERIALIZED (SELECT k, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS v FROM kept, range({PARTS}) t(p)),
b0 AS MATERIALIZED (SELECT p, k AS e, v AS c FROM parts WHERE k < {ENTRIES}),{steps}
out AS (SELECT k, string_agg(printf('%02x', e::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY k)
SELECT vec_id, label::BIGINT AS label, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) FROM (SELECT p, e, unnest(c) AS x, unnest(range(len(c))) AS i FROM b{ROUNDS})) AS codebooks_sha256
FROM kept JOIN out USING (k)"""
