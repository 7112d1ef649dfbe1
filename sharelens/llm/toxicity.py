"""Toxicity: a convolutional text classifier trained in numpy.

Words (runs of letters and digits, lower case) are hashed four times, whole and by their first 4, 5 and 6 bytes,
into one embedding table; a word's embedding is the mean of the four. Filters of widths 1, 2 and 3 run over the
words, the maximum over the whole text of each filter goes through a rectifier to one logistic output.
Training is plain numpy (only the positions of the maxima get gradients; Adagrad). Labels come from rows whose
crc32(doc_id) mod 4 is not HELD_OUT alone. Scores depend on the text alone.

Only the fit uses a sample: SAMPLE toxic and twice as many clean labelled rows at most, texts up to SAMPLE_CHARS, none of
the fifth of the labels that is set aside. The thresholds come from all labelled rows outside the held-out part: one
shift of the logit, so that score >= THRESHOLD is the best cut over all (weighted against the model's own by the number of rows),
and one threshold per language for `rejected` (its best cut, weighted against the common one). Their logits (whole texts) are counted on the cluster per language, class and BINS bins; rows the model was
fitted on are left to the others of their language and class, which get their weight, so that the share of toxic rows
is the real one at every size (a language's class of which all rows are fitted counts with those). The model (about
4 MB, fixed size) is broadcast.

Defined cases: null text is the empty text and gets a score like any other; without labels of both classes all
scores are the share of toxic labels (0 without labels); a null doc_id is not held out and never a label; repeated
rows each come back, labels repeated with a document count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_hashes, configure, lean, materialize, slices, text_buffer

HELD_OUT, THRESHOLD = 2, 0.3
SAMPLE, SAMPLE_CHARS = 1_500, 12_000
BUCKETS, DIM, FILTERS, WIDTHS, PREFIXES = 1 << 16, 16, 16, (1, 2, 3), (4, 5, 6)
#: One label in ASIDE is never fitted; bins of the logit between -REACH and REACH that thresholds are told by.
ASIDE, REACH, BINS = 5, 30, 3840
#: Weight of a cut's fallback (the model's own for the common cut, the common one for a language's) in rows of the rarer class.
SHRINK = 20
EPOCHS, RATE, BLANKS = 4, 0.1, max(WIDTHS)

LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z and the two-byte letters U+00C0..U+00DE in lower case."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[latin] += 32
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word its table rows (len x 4), and each text's first word (len + 1)."""
    data = lower(data)
    inside = LETTER[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    rows = [byte_hashes(data, starts, np.minimum(ends, starts + k) if k else ends) + np.uint64(k) for k in (0, *PREFIXES)]
    return (np.stack(rows, axis=1) % np.uint64(BUCKETS)).astype(np.int32), np.searchsorted(starts, offsets)


class Model:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.table = r.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
        self.filters = {w: r.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = r.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.base, self.shift, self.constant = np.float32(0), 0.0, None
        self.thresholds: dict[str, float] = {}

    def convolved(self, words: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """Per width the filters' values at each position: words, then BLANKS, of each text in turn, so that no window sees
        another text."""
        counts = np.diff(first)
        place = np.arange(len(words)) + BLANKS * np.repeat(np.arange(len(counts)), counts)
        e = np.zeros((len(words) + BLANKS * len(counts), DIM), np.float32)
        total = self.table[words[:, 0]]
        for k in range(1, words.shape[1]):
            total += self.table[words[:, k]]
        e[place] = total / words.shape[1]
        out = []
        for w in WIDTHS:
            v = e @ self.filters[w][0]
            for k in range(1, w):
                v[:-k] += e[k:] @ self.filters[w][k]
            v += self.bias[w]
            # the first blank of each text stands for a text without words; the others start no window
            for k in range(1, BLANKS):
                v[first[1:] + BLANKS * np.arange(len(counts)) + k] = -np.inf
            out.append(v)
        return out

    def logits(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        begin = first[:-1] + BLANKS * np.arange(len(first) - 1)
        pooled = np.concatenate([np.maximum.reduceat(v, begin, axis=0) for v in self.convolved(words, first)], axis=1)
        return np.maximum(pooled, 0) @ self.out + self.base

    def train(self, texts: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        self.share = float(labels.mean())
        self.base = np.float32(np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3)))
        squares = {"table": np.full(BUCKETS, 0.1, np.float32), "out": np.full_like(self.out, 0.1), "base": 0.1}
        squares |= {w: np.full_like(self.filters[w], 0.1) for w in WIDTHS} | {-w: np.full_like(self.bias[w], 0.1) for w in WIDTHS}
        for _ in range(EPOCHS):
            for i in r.permutation(len(texts)):
                words = texts[i]
                values = self.convolved(words, np.array([0, len(words)]))
                at = [v.argmax(axis=0) for v in values]
                pooled = np.concatenate([v[a, np.arange(FILTERS)] for v, a in zip(values, at)])
                hidden = np.maximum(pooled, 0)
                z = float(hidden @ self.out + self.base)
                g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]
                if abs(g) < 0.01:
                    continue
                back = g * self.out * (pooled > 0)
                step = g * hidden
                squares["out"] += step**2
                squares["base"] += g**2
                self.out -= RATE * step / np.sqrt(squares["out"])
                self.base -= np.float32(RATE * g / np.sqrt(squares["base"]))
                for n, w in enumerate(WIDTHS):
                    d = back[n * FILTERS : (n + 1) * FILTERS].astype(np.float32)
                    squares[-w] += d**2
                    self.bias[w] -= RATE * d / np.sqrt(squares[-w])
                    for k in range(w):
                        where = at[n] + k
                        ok = np.flatnonzero((where < len(words)) & (d != 0))
                        if not len(ok):
                            continue
                        rows = words[where[ok]]
                        e = self.table[rows].mean(axis=1)
                        pull = self.filters[w][k][:, ok].T * d[ok, None] / rows.shape[1]
                        step = np.zeros((DIM, FILTERS), np.float32)
                        step[:, ok] = e.T * d[ok]
                        squares[w][k] += step**2
                        self.filters[w][k] -= RATE * step / np.sqrt(squares[w][k])
                        flat, grads = rows.ravel(), np.repeat(pull, rows.shape[1], axis=0)
                        np.add.at(squares["table"], flat, (grads**2).mean(axis=1))
                        np.add.at(self.table, flat, -RATE * grads / np.sqrt(squares["table"][flat])[:, None])


def best_cut(bins: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> float:
    """The logit that cuts at the highest F1: a bin's lower edge, or the middle of the empty bins below it."""
    hits, rows = np.zeros(BINS), np.zeros(BINS)
    np.add.at(hits, bins, weights * toxic)
    np.add.at(rows, bins, weights)
    at = np.flatnonzero(rows)[::-1]
    f1 = 2 * np.cumsum(hits[at]) / (np.cumsum(rows[at]) + hits.sum())
    k = int(f1.argmax())
    below = at[k + 1] + 1 if k + 1 < len(at) else at[k] - BINS // (2 * REACH)
    return float((at[k] + below) / 2 * (2 * REACH / BINS) - REACH)


def logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def _shrunk(bins, toxic, weights, rows, other: float) -> float:
    """The best cut and another one, weighted by the rows of the rarer class and SHRINK."""
    rarer = float(min(rows[toxic == 1].sum(), rows[toxic == 0].sum()))
    return (rarer * best_cut(bins, toxic, weights) + SHRINK * other) / (rarer + SHRINK)


def usable(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of the labels outside the held-out part, each once."""
    own = F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != HELD_OUT)
    return labels.where(own).select("doc_id", "toxic").distinct()


def labelled(docs: DataFrame, labels: DataFrame, aside: bool) -> list:
    """The bounded sample: doc_id, text, toxic; chosen by a hash of doc_id, without the part set aside or (not aside) with it."""
    rows = usable(labels)
    if aside:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("aside"), "doc_id"), F.lit(ASIDE)) != 0)
    picked = None
    for value in (0, 1):
        part = rows.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE * (2 if value == 0 else 1))
        picked = part if picked is None else picked.union(part)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(picked), "doc_id").where(F.length("text") <= SAMPLE_CHARS).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(3 * SAMPLE)
    return joined.select("doc_id", "text", "toxic").collect()


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, list]:
    """The model without shift and thresholds, and the doc_ids it was fitted on."""
    for aside in (True, False):  # few labels: all of them
        rows = labelled(docs, labels, aside)
        y = np.array([r["toxic"] for r in rows], np.float64)
        if len(y) and y.min() != y.max():
            break
    model = Model()
    if not len(y) or y.min() == y.max():
        model.constant = float(y.mean()) if len(y) else 0.0
        return model, []
    texts: list[np.ndarray] = []
    for i in range(0, len(rows), 100):  # a few at a time: the driver's memory is small
        raws = [r["text"].encode() for r in rows[i : i + 100]]
        words, first = features(np.frombuffer(b"".join(raws), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raws])]))
        texts += [words[a:b] for a, b in zip(first, first[1:])]
    model.train(texts, y)
    return model, sorted({r["doc_id"] for r in rows})


def logits(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and `keep`, _llm_lang and the logit _llm_z of each row."""
    spark = docs.sparkSession
    configure(spark)
    shared = spark.sparkContext.broadcast(model)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    text = "text" if "text" in keep else "_llm_text"  # a text goes to Python once
    more = [] if "text" in keep else [F.col("text").cast("string").alias("_llm_text")]
    source = docs.select("doc_id", *keep, *more, lang.alias("_llm_lang"))

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(text))
            parts = [np.zeros(0)]
            for i, j in slices(offsets, 1 << 19):
                parts.append(m.logits(*features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])).astype(np.float64))
            columns = [batch.column(c) for c in ("doc_id", *keep, "_llm_lang")] + [pa.array(np.concatenate(parts))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *keep, "_llm_lang", "_llm_z"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_llm_text")
    return source.mapInArrow(lean(run), f"{schema}, _llm_z double")


def histogram(scored: DataFrame, labels: DataFrame, fitted: list) -> DataFrame:
    """Per language, class and bin of the logit: the rows that count, and the weight of all of them together."""
    spark = scored.sparkSession
    labels = usable(labels)
    ids = spark.createDataFrame([(i,) for i in fitted], labels.select("doc_id").schema).withColumn("fitted", F.lit(True))
    labels = labels.join(F.broadcast(ids), "doc_id", "left")
    place = F.floor((F.col("_llm_z") + REACH) * (BINS / (2 * REACH)))
    place = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), place)).cast("int")
    rows = scored.select("doc_id", F.col("_llm_lang").alias("lang"), place.alias("bin")).join(labels, "doc_id")
    counts = rows.groupBy("lang", "toxic", "bin").agg(F.count("*").alias("all"), F.count_if(F.col("fitted").isNull()).alias("free"))
    stratum = Window.partitionBy("lang", "toxic")  # of some BINS rows at most
    counts = counts.withColumn("total", F.sum("all").over(stratum)).withColumn("others", F.sum("free").over(stratum))
    counts = counts.withColumn("rows", F.when(F.col("others") > 0, F.col("free")).otherwise(F.col("all")))
    weight = F.col("rows") * F.col("total") / F.when(F.col("others") > 0, F.col("others")).otherwise(F.col("total"))
    return counts.where("rows > 0").select("lang", "toxic", "bin", "rows", weight.alias("weight"))


def calibrate(model: Model, scored: DataFrame, labels: DataFrame, fitted: list) -> None:
    """Sets the model's shift and its languages' thresholds from the logits of all labelled rows."""
    counts = materialize(histogram(scored, labels, fitted))
    rows = counts.groupBy("bin", "toxic").agg(F.sum("weight").alias("weight"), F.sum("rows").alias("rows")).collect()
    column = lambda name: np.array([r[name] for r in rows])
    bins, toxic, weights, n = (column(c) for c in ("bin", "toxic", "weight", "rows"))
    # few rows: rather where the model itself says THRESHOLD, at the share of toxic rows among all instead of the sample's
    share = weights[toxic == 1].sum() / weights.sum()
    own_cut = logit(THRESHOLD) + logit(model.share) - logit(share)
    common = _shrunk(bins, toxic, weights, n, own_cut)
    model.shift = float(logit(THRESHOLD) - common)

    def own(table):
        import pyarrow as pa

        bins, toxic, n, weights = (table.column(c).to_numpy() for c in ("bin", "toxic", "rows", "weight"))
        cut = _shrunk(bins, toxic, weights, n, common)
        return pa.table({"lang": table.column("lang")[:1], "cut": pa.array([cut], pa.float64())})

    for r in counts.where("lang IS NOT NULL").groupBy("lang").applyInArrow(own, "lang string, cut double").collect():
        model.thresholds[r["lang"]] = float(1 / (1 + np.exp(-(r["cut"] + model.shift))))


def scored(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and `keep`, _llm_score and _llm_rejected (score >= the language's threshold)."""
    model, fitted = fit(docs, labels)
    # functions on Arrow batches need plain column names
    plain = {c: f"_llm_{i}" for i, c in enumerate(keep) if c not in ("text", "lang")}
    docs, back, keep = docs.withColumnsRenamed(plain), keep, tuple(plain.get(c, c) for c in keep)
    if model.constant is not None:
        out, value, cut = docs.select("doc_id", *keep), F.lit(model.constant), F.lit(THRESHOLD)
    else:
        # a narrow result is written, so texts are scored once; with more columns they are scored twice instead of written
        out = logits(docs, model, keep) if keep else materialize(logits(docs, model))
        calibrate(model, logits(docs, model) if keep else out, labels, fitted)
        value = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("_llm_z") + model.shift))))
        cut = F.lit(THRESHOLD)
        if model.thresholds:
            own = F.create_map(*[F.lit(x) for pair in sorted(model.thresholds.items()) for x in pair])
            cut = F.coalesce(F.try_element_at(own, F.col("_llm_lang")), cut)
    out = out.withColumn("_llm_score", value)
    return out.select("doc_id", *[F.col(c).alias(name) for c, name in zip(keep, back)], "_llm_score", (F.col("_llm_score") >= cut).alias("_llm_rejected"))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, predicted (score >= THRESHOLD) and rejected (score >= the language's threshold)."""
    s = F.col("_llm_score")
    return scored(docs, labels).select("doc_id", s.alias("score"), (s >= THRESHOLD).cast("int").alias("predicted"), F.col("_llm_rejected").alias("rejected"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, rejected of each document."""
    out = score(docs, labels)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted", "rejected")
