"""Resolution cascade, exact and set-similarity title joins, interval lookup, best-row selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import set_similarity, tokens


def unresolved(papers: DataFrame, *stages: DataFrame) -> list[DataFrame]:
    """What is left to resolve before the first stage and after each one."""
    out = [papers]
    for s in stages:
        out.append(out[-1].join(s.select("paper_id").distinct(), "paper_id", "left_anti"))
    return out


def best(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def exact_match(papers: DataFrame, works: DataFrame, block: list[str]) -> DataFrame:
    """paper_id, work_id for equal titles within a block; of works with one title the lowest id counts."""
    w = works.where("title <> ''").groupBy(*block, "title").agg(F.min("work_id").alias("work_id"))
    return papers.where("title <> ''").join(w, [*block, "title"]).select("paper_id", "work_id")


def fuzzy_match(papers: DataFrame, works: DataFrame, block: list[str], theta: float, other: bool = False) -> DataFrame:
    """paper_id, work_id, score: the work of the highest |A & B| / max(|A|, |B|) >= theta in the block, ties by lowest id.
    With `other` only works of another title count (what exact matching leaves).

    Prefix filter: with tokens in one order, rarest first, two sets that reach theta share one of each other's first
    n - ceil(theta n) + 1 tokens, so only these are joined. Equal titles are joined once, and no candidate is dropped."""
    sides = {}
    for name, df, ident in (("p", papers, "paper_id"), ("w", works, "work_id")):
        rows = df.where("title <> ''").groupBy(*block, "title").agg(F.min(ident).alias("id"))  # a title's least id stands for it
        sides[name] = rows.withColumn("toks", F.array_distinct(tokens(F.col("title"))))
    df_of = sides["p"].select(*block, F.explode("toks").alias("t")).unionByName(sides["w"].select(*block, F.explode("toks").alias("t")))
    freq = df_of.groupBy(*block, "t").agg(F.count("*").alias("df"))

    def prefix(side: DataFrame) -> DataFrame:
        rows = side.select(*block, "id", F.size("toks").alias("n"), F.explode("toks").alias("t")).join(freq, [*block, "t"])
        own = rows.groupBy(*block, "id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("o"))  # a title's tokens
        keep = F.col("n") - F.ceil(F.round(theta * F.col("n"), 9)) + 1
        return own.select(*block, "id", "n", F.explode(F.slice("o", F.lit(1), keep.cast("int"))).alias("x")).select(*block, "id", "n", F.col("x.t").alias("t"))

    left = prefix(sides["p"])
    right = prefix(sides["w"]).withColumnsRenamed({"id": "w_id", "n": "w_n"})
    size = F.least("n", "w_n") >= theta * F.greatest("n", "w_n")
    # only ids and sizes are joined on tokens; tokens are fetched for the distinct pairs
    pairs = left.join(right, [*block, "t"]).where(size).select(*block, "id", "w_id").distinct()
    w = sides["w"].select(*block, F.col("id").alias("w_id"), F.col("title").alias("w_title"), F.col("toks").alias("w_toks"))
    scored = pairs.join(sides["p"], [*block, "id"]).join(w, [*block, "w_id"])
    if other:
        scored = scored.where(F.col("title") != F.col("w_title"))
    scored = scored.withColumn("score", set_similarity(F.col("toks"), F.col("w_toks"))).where(F.col("score") >= theta)
    scored = best(scored.select(*block, "title", F.col("w_id").alias("work_id"), "score"), [*block, "title"], F.col("score").desc(), F.col("work_id"))
    return papers.join(scored, [*block, "title"]).select("paper_id", "work_id", "score")


def title_search(papers: DataFrame, hits: DataFrame, theta: float = 0.9, most: int = 5, tolerance: int = 1) -> DataFrame:
    """papers: paper_id, title, year; hits: paper_id, place, work_id, title, year as a search returns them. Of the first `most`
    hits within the years the most similar one that reaches theta, ties by place: paper_id, work_id, score.

    Both sides grow with the papers, and the planner's estimate of computed titles can be far below their size: a sort merge, which
    neither it nor adaptive execution turns into a broadcast."""
    h = hits.where(F.col("place") <= most).select("paper_id", "place", "work_id", F.col("title").alias("_title"), F.col("year").alias("_year"))
    rows = papers.select("paper_id", "title", "year").join(h.hint("merge"), "paper_id").where(F.abs(F.col("year") - F.col("_year")) <= tolerance)
    rows = rows.withColumn("score", set_similarity(tokens(F.col("title")), tokens(F.col("_title")))).where(F.col("score") >= theta)
    return best(rows, ["paper_id"], F.col("score").desc(), F.col("place")).select("paper_id", "work_id", "score")


def _positions(batches):
    """Events of each author by time, positions before papers -> the papers with their position's country and kind."""
    import heapq

    import pyarrow as pa

    author, part, active, last, latest = None, None, [], None, None
    for batch in batches:
        out = []
        for a, p, year, side, paper, end, country, latest_start, latest_country in zip(*(batch.column(i).to_pylist() for i in range(9))):
            if (a, p) != (author, part):
                author, part, active, last = a, p, [], None
            if side == 0:
                heapq.heappush(active, (-year, country, end))
                last = min(last, (-year, country)) if last else (-year, country)
                continue
            while active and year is not None and active[0][2] < year:  # years ascend: what has ended does not come back
                heapq.heappop(active)
            if year is not None and active:
                out.append((paper, a, active[0][1], 0))
            elif year is not None and last:
                out.append((paper, a, last[1], 1))
            elif latest_start is not None:
                out.append((paper, a, latest_country, 2))
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int32()))], ["paper_id", "author", "country", "kind"])


def profile_lookup(papers: DataFrame, history: DataFrame, parts: int = 1) -> DataFrame:
    """Country of each author's position at the paper's year: an active one (kind 0), else an earlier one (1), else any (2); latest
    start first, then country; only positions with a country count.

    A sort merge: positions and papers are one list by author and time; open positions wait in a heap by start and leave it
    when they have ended. One exchange and a row per paper, not one per paper and position. `parts` as in
    `history.as_of`."""
    kind = history.schema["author"].dataType
    h = history.where("country IS NOT NULL AND author IS NOT NULL AND start IS NOT NULL")
    salt = F.pmod(F.xxhash64("paper_id"), F.lit(parts)).cast("int")
    nulls = {"_end": F.lit(None).cast("long"), "_country": F.lit(None).cast("string")}
    rows = papers.where("author IS NOT NULL").select(F.col("author").cast("string").alias("_a"), salt.alias("_part"), F.col("year").cast("long").alias("_t"), F.lit(1).alias("_side"), F.col("paper_id").cast("long").alias("_paper")).withColumns(nulls)
    end = F.coalesce(F.col("end").cast("long"), F.lit((1 << 62)))
    events = h.select(F.col("author").cast("string").alias("_a"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"), F.col("start").cast("long").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("_paper"), end.alias("_end"), F.col("country").alias("_country"))
    both = rows.unionByName(events)
    # of an author's positions the one of the latest start stands for all where none has begun
    any_ = F.min(F.when(F.col("_side") == 0, F.struct((-F.col("_t")).alias("s"), F.col("_country").alias("c")))).over(Window.partitionBy("_a", "_part"))
    both = both.withColumn("_any", any_).select("_a", "_part", "_t", "_side", "_paper", "_end", "_country", F.col("_any.s").alias("_s"), F.col("_any.c").alias("_c"))
    found = both.sortWithinPartitions("_a", "_part", "_t", "_side").mapInArrow(_positions, "paper_id long, author string, country string, kind int")
    return found.withColumns({"paper_id": F.col("paper_id").cast(papers.schema["paper_id"].dataType), "author": F.col("author").cast(kind)})


def best_source(candidates: DataFrame, least: float = 0.35) -> DataFrame:
    """The source whose title overlaps most, conferences before journals."""
    score = set_similarity(tokens(F.col("want")), tokens(F.col("title"))) + F.when(F.col("type") == "conference", 0.05).when(F.col("type") == "journal", -0.02).otherwise(0.0)
    rows = candidates.withColumn("score", score).where(F.col("score") >= least)
    return best(rows, ["venue"], F.col("score").desc(), F.col("source_id"))


def prefix_filter(records: DataFrame, key: str, accepted: DataFrame) -> DataFrame:
    """Records whose key's first two segments are accepted."""
    return records.withColumn("prefix", F.substring_index(key, "/", 2)).join(accepted.select("prefix").distinct(), "prefix", "left_semi")


def near_years(papers: DataFrame, tolerance: int = 1) -> DataFrame:
    """Papers once for each year within the tolerance, as `match_year`: a block key for works of neighbouring years."""
    return papers.withColumn("match_year", F.explode(F.sequence(F.col("year") - tolerance, F.col("year") + tolerance)))


def first_source(*frames: DataFrame, key: str) -> DataFrame:
    """Rows of the first frame that has the key, in order of the frames."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("priority", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    least = F.min("priority").over(Window.partitionBy(key))
    return out.withColumn("_least", least).where("priority = _least").drop("_least")


def best_priority(rows: DataFrame, key: str, priority: str, *columns: str) -> DataFrame:
    """key, columns (distinct) and priority of the rows with the least priority of their key. One pass and one shuffle, in which a key's
    distinct values, a bounded set, combine first."""
    values = rows.groupBy(key).agg(F.collect_set(F.struct(priority, *columns)).alias("_s"))
    least = F.array_min(F.transform("_s", lambda x: x[priority]))
    return values.select(key, F.explode(F.filter("_s", lambda x: x[priority] == least)).alias("_x")).select(key, "_x.*")


def main_track(records: DataFrame, accepted: DataFrame, partial: DataFrame, rejected: tuple[str, ...]) -> DataFrame:
    """Records whose booktitle is accepted for their venue without regard to case, or holds one of the venue's configured
    parts, and holds no rejected word. accepted and partial: venue, pattern; dimensions joined by venue."""
    from ..functions.text import has_any

    low = F.lower(F.trim("booktitle"))
    a = accepted.select(F.col("venue"), F.lower(F.trim("pattern")).alias("_b")).distinct().withColumn("_ok", F.lit(True))
    parts = partial.groupBy("venue").agg(F.collect_set(F.lower("pattern")).alias("_parts"))  # a venue's configuration
    rows = records.where(~has_any(F.col("booktitle"), rejected)).withColumn("_b", low)
    rows = rows.join(a, ["venue", "_b"], "left").join(parts, "venue", "left")
    inside = F.coalesce(F.exists("_parts", lambda p: F.contains(F.col("_b"), p)), F.lit(False))
    return rows.where(F.coalesce("_ok", F.lit(False)) | inside).drop("_b", "_ok", "_parts")


def zipped(df: DataFrame, left: str, right: str) -> DataFrame:
    """One row per position of two arrays, with the position from 1; the shorter one is filled with nulls."""
    rows = df.select("*", F.posexplode(F.arrays_zip(F.col(left).alias("l"), F.col(right).alias("r"))).alias("pos", "_z"))
    return rows.withColumns({"pos": F.col("pos") + 1, "left": F.col("_z.l"), "right": F.col("_z.r")}).drop("_z", left, right)


def with_columns_or_empty(df: DataFrame, *names: str) -> DataFrame:
    """Adds each absent column as the empty string."""
    return df.withColumns({n: F.lit("") for n in names if n not in df.columns}) if set(names) - set(df.columns) else df
