"""Mixing sources to target weights by hierarchical budgets.

The tree is domain - language - source; leaves hold documents and their tokens. Weights of siblings give each
child its share of the parent's budget. What a child can't use (its supply times `epochs`) is dealt again
among its siblings, in proportion to their weights, and only what all of them can't use reaches the ancestors'
other children: budgets are filled top down, and a node can take what its whole subtree can. Filling is exact
integer arithmetic: siblings by supply per weight; the first ones, whose supply is below the level, are used up, the
rest share by weight.

A leaf's budget is a prefix of its tokens through seeded epochs: whole epochs first, then the documents in the order
of md5(seed, epoch, doc_id) while their tokens fit. The running sum needs no sort of a leaf: documents fall into cells
by the first digits of the hash, sums per leaf and cell say which cell the prefix ends in, and only that cell is sorted.
A cell has about CELL_ROWS documents up to MOST_CELLS cells a leaf, so a leaf with a third of all rows is spread as well.

Tokens are words [^\\x20\\x09-\\x0D]+ unless a column of counts is named.

Defined cases: null or empty text has no tokens and is in a prefix as its place is reached; null lang or source is a
leaf '' of its own; a row without doc_id is drawn by a digest of its text, so such rows spread over cells as well; repeated rows have equal hashes and are in or out by a
further order of tokens, each counting; children without a weight have weight 1; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CELL_ROWS, MOST_CELLS = 256, 4096
#: Leaves up to which their table (about 100 bytes a row) is broadcast; more are joined.
BROADCAST_LEAVES = 50_000


@dataclass(frozen=True)
class Mix:
    """Weights are integers; a child that isn't named has weight 1. domain_of maps a source to its domain."""

    domains: dict[str, int] = field(default_factory=lambda: {"web": 5, "forum": 3, "press": 2})
    langs: dict[str, int] = field(default_factory=lambda: {"en": 6, "de": 2, "fr": 2, "es": 1})
    sources: dict[str, int] = field(default_factory=lambda: {"src0": 2, "src1": 3})
    domain_names: tuple[str, ...] = ("web", "forum", "press")
    #: The budget as a share (percent) of all tokens, the most epochs of a document, and the seed.
    percent: int = 150
    epochs: int = 4
    seed: str = "mix-1"

    def domain_of(self, source: Column) -> Column:
        """The number at the end of the source's name, modulo the number of domains."""
        digits = F.regexp_extract(source, "([0-9]{1,9})$", 1)
        at = F.when(digits == "", F.lit(0)).otherwise(digits.cast("int")) % len(self.domain_names)
        return F.get(F.array(*map(F.lit, self.domain_names)), at)


def _weight(column: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(column == name, w).otherwise(out)
    return out.cast("decimal(38,0)")


def fill(nodes: DataFrame, parent: list[str], child: str, budget: str) -> DataFrame:
    """nodes: one row per child with parent columns, `child`, `weight`, `supply` and the parent's `budget`. Adds `share`:
    the child's part, at most its supply."""
    order = Window.partitionBy(*parent).orderBy((F.col("supply").cast("double") / F.col("weight").cast("double")), child)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    used = order.rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumns({"_w": F.sum("weight").over(rest).cast("decimal(38,0)"), "_used": F.coalesce(F.sum("supply").over(used), F.lit(0)).cast("decimal(38,0)")})
    full = F.col("supply") * F.col("_w") <= F.col("weight") * (F.col(budget) - F.col("_used"))
    # supplies per weight ascend, so the children that are used up come first
    nodes = nodes.withColumn("_full", full)
    level = Window.partitionBy(*parent)
    left = F.coalesce(F.sum(F.when(F.col("_full"), F.col("supply"))).over(level), F.lit(0)).cast("decimal(38,0)")
    open_w = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(level).cast("decimal(38,0)")
    nodes = nodes.withColumns({"_left": left, "_open": open_w})
    share = F.when(F.col("_full"), F.col("supply")).otherwise(F.expr(f"(weight * ({budget} - _left)) div _open").cast("decimal(38,0)"))
    return nodes.withColumn("share", share.cast("decimal(38,0)")).drop("_w", "_used", "_full", "_left", "_open")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves: domain, lang, source, tokens. Adds `budget`."""
    leaves = leaves.withColumn("supply", (F.col("tokens") * mix.epochs).cast("decimal(38,0)"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("supply").cast("decimal(38,0)").alias("supply"))
    domains = langs.groupBy("domain").agg(F.sum("supply").cast("decimal(38,0)").alias("supply"))
    total = leaves.agg(F.expr(f"(coalesce(sum(tokens), 0) * {mix.percent}) div 100").cast("decimal(38,0)").alias("_total"))
    domains = domains.withColumn("weight", _weight(F.col("domain"), mix.domains)).withColumn("root", F.lit(0)).join(F.broadcast(total))  # one row
    domains = fill(domains, ["root"], "domain", "_total").select("domain", F.col("share").alias("_domain"))
    langs = fill(langs.withColumn("weight", _weight(F.col("lang"), mix.langs)).join(domains, "domain"), ["domain"], "lang", "_domain").select("domain", "lang", F.col("share").alias("_lang"))
    leaves = fill(leaves.withColumn("weight", _weight(F.col("source"), mix.sources)).join(langs, ["domain", "lang"]), ["domain", "lang"], "source", "_lang")
    return leaves.select("domain", "lang", "source", "tokens", "docs", F.col("share").cast("long").alias("budget"))


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def plan(docs: DataFrame, mix: Mix, counts: str | None = None) -> DataFrame:
    """Every row of docs with `_llm_` columns: domain, lang, source, tokens, copies (0 to epochs), budget."""
    text = F.col("text").cast("string")
    keys = docs.select(
        "*",
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("_llm_lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_llm_source"),
        (F.coalesce(F.col(counts).cast("long"), F.lit(0)) if counts else tokens_of(text)).alias("_llm_tokens"),
    ).withColumn("_llm_domain", mix.domain_of(F.col("_llm_source")))
    leaf = ["_llm_domain", "_llm_lang", "_llm_source"]
    plain = [F.col(c).alias(c.removeprefix("_llm_")) for c in leaf]
    leaves = keys.groupBy(*leaf).agg(F.sum("_llm_tokens").alias("tokens"), F.count("*").alias("docs")).select(*plain, "tokens", "docs")
    leaves = materialize(budgets(materialize(leaves), mix))
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(mix.epochs)).cast("int")
    cells = F.least(F.lit(MOST_CELLS), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("docs") / CELL_ROWS)))).cast("int"))
    leaves = leaves.select(*[F.col(c.removeprefix("_llm_")).alias(c) for c in leaf], F.col("budget").alias("_llm_budget"), whole.alias("_llm_whole"), cells.alias("_llm_cells"), (F.col("budget") - whole * F.col("tokens")).alias("_llm_rest"))
    few = leaves.count() <= BROADCAST_LEAVES
    held = F.broadcast if few else (lambda df: df)
    dealt = keys.join(held(leaves), leaf)
    # the epoch after the whole ones is the one whose prefix is taken
    h = F.md5(F.concat_ws(":", F.lit(mix.seed), F.col("_llm_whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))).cast("binary"))
    dealt = dealt.withColumn("_llm_hash", h).withColumn("_llm_cell", (F.conv(F.substring("_llm_hash", 1, 3), 16, 10).cast("int") * F.col("_llm_cells") / 4096).cast("int"))
    sums = dealt.groupBy(*leaf, "_llm_cell", "_llm_rest").agg(F.sum("_llm_tokens").alias("_llm_sum"))
    run = Window.partitionBy(*leaf).orderBy("_llm_cell")
    sums = sums.withColumn("_llm_before", F.sum("_llm_sum").over(run) - F.col("_llm_sum"))
    ends = materialize(sums.where("_llm_before <= _llm_rest AND _llm_before + _llm_sum > _llm_rest").select(*leaf, F.col("_llm_cell").alias("_llm_end"), "_llm_before"))
    dealt = dealt.join(held(ends), leaf, "left")
    # before the last cell all are in, after it none; a leaf whose rest ends in no cell takes all
    inside = F.col("_llm_end").isNull() | (F.col("_llm_cell") < F.col("_llm_end"))
    edge = F.coalesce(F.col("_llm_cell") == F.col("_llm_end"), F.lit(False))
    sure = dealt.where(~edge).withColumn("_llm_in", inside)
    order = Window.partitionBy(*leaf).orderBy("_llm_hash", "_llm_tokens").rowsBetween(Window.unboundedPreceding, 0)
    last = dealt.where(edge).withColumn("_llm_in", F.col("_llm_before") + F.sum("_llm_tokens").over(order) <= F.col("_llm_rest"))
    out = sure.unionByName(last)
    copies = F.least(F.lit(mix.epochs), F.col("_llm_whole") + F.col("_llm_in").cast("int"))
    return out.withColumn("_llm_copies", F.when(F.col("_llm_whole") >= mix.epochs, F.lit(mix.epochs)).otherwise(copies))


def assign(docs: DataFrame, mix: Mix) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, leaf_budget, copies of each row: how often the mix repeats it."""
    rows = plan(docs.select("doc_id", "text", "lang", "source"), mix)
    return rows.select("doc_id", F.col("_llm_domain").alias("domain"), F.col("_llm_lang").alias("lang"), F.col("_llm_source").alias("source"), F.col("_llm_tokens").alias("n_tokens"), F.col("_llm_budget").alias("leaf_budget"), F.col("_llm_copies").alias("copies"))


def select(docs: DataFrame, mix: Mix) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs."""
    rows = plan(docs, mix).where("_llm_copies > 0")
    rows = rows.withColumn("_llm_copy", F.explode(F.sequence(F.lit(1), F.col("_llm_copies")))) if mix.epochs > 1 else rows
    return rows.select(*docs.columns)


def sql(mix: Mix, documents: str = "documents") -> str:
    """The same rows in DuckDB SQL: no cells, one running sum per leaf."""
    case = lambda c, w: "CASE " + " ".join(f"WHEN {c} = '{k}' THEN {v}" for k, v in w.items()) + " ELSE 1 END"
    names = ", ".join(f"'{d}'" for d in mix.domain_names)
    digits = r"regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1)"

    def level(name, source, parent, child, budget):
        return f"""
{name}_o AS (SELECT *, sum(weight) OVER (PARTITION BY {parent} ORDER BY supply::DOUBLE / weight, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w,
  coalesce(sum(supply) OVER (PARTITION BY {parent} ORDER BY supply::DOUBLE / weight, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM {source}),
{name}_f AS (SELECT *, supply * w <= weight * ({budget} - used) AS is_full FROM {name}_o),
{name} AS (SELECT *, CASE WHEN is_full THEN supply ELSE (weight * ({budget} - coalesce(sum(CASE WHEN is_full THEN supply END) OVER (PARTITION BY {parent}), 0)))
  // sum(CASE WHEN NOT is_full THEN weight END) OVER (PARTITION BY {parent}) END AS share FROM {name}_f)"""

    return f"""
WITH k AS (SELECT doc_id, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS drawn_by, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
  list_extract([{names}], (CASE WHEN {digits} = '' THEN 0 ELSE {digits}::INT END) % {len(mix.domain_names)} + 1) AS domain FROM {documents}),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens)::HUGEINT * {mix.epochs} AS supply, {case("source", mix.sources)}::HUGEINT AS weight FROM k GROUP BY ALL),
top AS (SELECT (sum(tokens) * {mix.percent}) // 100 AS total FROM leaf),
dom AS (SELECT domain, 0 AS root, sum(supply) AS supply, {case("domain", mix.domains)}::HUGEINT AS weight, any_value(total) AS total FROM leaf, top GROUP BY domain),
{level("dom_s", "dom", "root", "domain", "total")},
lan AS (SELECT leaf.domain, lang, sum(leaf.supply) AS supply, {case("lang", mix.langs)}::HUGEINT AS weight, any_value(share) AS above FROM leaf JOIN dom_s ON leaf.domain = dom_s.domain GROUP BY leaf.domain, lang),
{level("lan_s", "lan", "domain", "lang", "above")},
lea AS (SELECT leaf.*, lan_s.share AS above FROM leaf JOIN lan_s USING (domain, lang)),
{level("lea_s", "lea", "domain, lang", "source", "above")},
b AS (SELECT domain, lang, source, share::BIGINT AS budget, (CASE WHEN tokens > 0 THEN share // tokens ELSE {mix.epochs} END)::INT AS whole, (share - (CASE WHEN tokens > 0 THEN share // tokens ELSE {mix.epochs} END) * tokens)::BIGINT AS rest FROM lea_s),
h AS (SELECT k.*, budget, whole, rest, md5('{mix.seed}:' || whole || ':' || drawn_by) AS h FROM k JOIN b USING (domain, lang, source)),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM h)
SELECT doc_id, domain, lang, source, n_tokens, budget AS leaf_budget, CASE WHEN whole >= {mix.epochs} THEN {mix.epochs} ELSE whole + CASE WHEN run <= rest THEN 1 ELSE 0 END END::INT AS copies FROM c"""
