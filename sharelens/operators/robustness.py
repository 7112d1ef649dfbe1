"""Thresholds, scenarios, bounds, decompositions, bootstrap and logit. Loops over scenarios are joins with small frames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ratios import ratio
from .indicators import rank_min


def grid(windows: DataFrame, countries: DataFrame) -> DataFrame:
    """Every bloc country in every window present: a few rows each."""
    return windows.crossJoin(countries)  # bounded: countries of the bloc


def threshold_sensitivity(fact: DataFrame, thresholds: tuple[float, ...], countries: DataFrame) -> DataFrame:
    """Bloc shares and ranks over venues whose coverage in a window reaches each threshold.

    One pass over the fact gives each (venue, window) its papers by country; its coverage says how many of the thresholds it
    reaches. Sums by that number are a small table, and a threshold's share is a sum over its upper end, so a hundred thresholds
    cost what five do."""
    cuts = sorted(set(thresholds))
    at = lambda n: F.element_at(F.array(*map(F.lit, cuts)), n)
    # a paper once for each bloc country, and once, with a null country, for itself
    each = F.explode(F.array_append(F.coalesce("bloc_countries", F.array().cast("array<string>")), F.lit(None).cast("string")))
    rows = fact.where("venue IS NOT NULL AND win IS NOT NULL").select("venue", "win", "resolved", "has_bloc", each.alias("country"))
    cells = rows.groupBy("venue", "win", "country").agg(F.count("*").alias("n"), F.count_if("resolved").alias("resolved"), F.count_if("has_bloc").alias("bloc"))
    coverage = F.max(F.when(F.col("country").isNull(), ratio("resolved", "n"))).over(Window.partitionBy("venue", "win"))  # a cell's countries
    reached = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: t <= coverage))
    sums = cells.withColumn("_level", reached).groupBy("win", "country", "_level").agg(F.sum("n").alias("n"), F.sum("bloc").alias("bloc"))
    # thresholds x windows x countries from here on
    steps = sums.select("win", "country").distinct().withColumn("_level", F.explode(F.sequence(F.lit(1), F.lit(len(cuts)))))
    on = steps["win"].eqNullSafe(sums["win"]) & steps["country"].eqNullSafe(sums["country"]) & (steps["_level"] == sums["_level"])
    upper = Window.partitionBy("win", "country").orderBy(F.desc("_level"))
    dense = steps.join(sums, on, "left").select(steps["win"], steps["country"], steps["_level"], F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bloc", F.lit(0)).alias("bloc"))
    dense = dense.select("win", "country", at(F.col("_level")).alias("threshold"), F.sum("n").over(upper).alias("papers"), F.sum("bloc").over(upper).alias("bloc"))
    den = dense.where("country IS NULL AND papers > 0").select("threshold", "win", "bloc")
    out = grid(den, countries).join(dense.where("country IS NOT NULL").drop("bloc"), ["threshold", "win", "country"], "left").fillna(0, ["papers"])
    return out.withColumn("share", ratio("papers", "bloc")).withColumn("rank", rank_min("share", "threshold", "win"))


def scenario_shares(fact: DataFrame, tagged: DataFrame) -> DataFrame:
    """tagged: paper_id, scenario."""
    rows = fact.join(tagged, "paper_id")
    out = rows.groupBy("scenario", "win").agg(F.count("*").alias("papers"), F.count_if("has_bloc").alias("bloc"), F.count_if("has_focal").alias("focal"))
    return out.withColumn("share", ratio("focal", "bloc"))


def maturity(fact: DataFrame, pc: DataFrame, scenarios: list[tuple[str, int, int]], countries: DataFrame) -> DataFrame:
    """Bloc shares over ranges of years."""
    spark = fact.sparkSession
    frame = F.broadcast(spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for n, a, b in scenarios]))))
    within = F.col("year").between(F.col("lo"), F.col("hi"))
    den = fact.join(frame, within).groupBy("scenario").agg(F.count_if("has_bloc").alias("bloc"))
    num = pc.where("is_bloc").join(frame, within).groupBy("scenario", "country").agg(F.count("*").alias("papers"))
    out = grid(den, countries).join(num, ["scenario", "country"], "left").fillna(0, ["papers"])
    return out.withColumn("share", ratio("papers", "bloc")).withColumn("rank", rank_min("share", "scenario"))


def rank_bounds(fact: DataFrame, pc: DataFrame, focal: str, countries: DataFrame) -> DataFrame:
    """Observed; all unresolved papers focal; all of the bloc but not focal."""
    den = fact.groupBy("win").agg(F.count_if("has_bloc").alias("bloc"), F.count_if(~F.col("resolved")).alias("unresolved"))
    num = pc.where("is_bloc").groupBy("win", "country").agg(F.count("*").alias("papers"))
    rows = grid(den, countries).join(num, ["win", "country"], "left").fillna(0, ["papers"])
    rows = rows.withColumn("scenario", F.explode(F.array(*map(F.lit, ("observed", "optimistic", "pessimistic")))))
    extra = F.when((F.col("scenario") == "optimistic") & (F.col("country") == focal), F.col("unresolved")).otherwise(0)
    rows = rows.withColumns({"value": F.col("papers") + extra, "base": F.col("bloc") + F.when(F.col("scenario") == "observed", 0).otherwise(F.col("unresolved"))})
    rows = rows.withColumn("share", ratio("value", "base"))
    return rows.select("scenario", "win", "country", "value", "base", "share", rank_min("share", "scenario", "win").alias("rank"))


def segments(fact: DataFrame, *keys: str) -> DataFrame:
    """Bloc weight and focal share of each segment within its window; null segments are dropped."""
    rows = fact.where("has_bloc")
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    out = rows.groupBy("win", *keys).agg(F.count("*").alias("bloc"), F.count_if("has_focal").alias("focal"))
    return out.withColumns({"q": ratio("focal", "bloc"), "weight": ratio("bloc", F.sum("bloc").over(Window.partitionBy("win")))})


def shift_share(seg: DataFrame, t0: str, t1: str, *keys: str) -> DataFrame:
    """Composition, performance and interaction of each segment; absent segments have weight 0."""
    side = lambda t, n: seg.where(F.col("win") == t).select(*keys, F.col("weight").alias(f"w{n}"), F.col("q").alias(f"q{n}"))
    both = side(t0, 0).join(side(t1, 1), [*keys], "full_outer").fillna(0.0, ["w0", "q0", "w1", "q1"])
    return both.withColumns({
        "composition": F.expr("(w1 - w0) * q0"),
        "performance": F.expr("w0 * (q1 - q0)"),
        "interaction": F.expr("(w1 - w0) * (q1 - q0)"),
    })


def shift_share_summary(parts: DataFrame) -> DataFrame:
    total = lambda e, n: F.round(F.sum(F.expr(e)), 9).alias(n)
    return parts.agg(total("w0 * q0", "share0"), total("w1 * q1", "share1"), total("composition", "composition"), total("performance", "performance"), total("interaction", "interaction"), F.count("*").alias("segments"))


def expansion(fact: DataFrame, t0: str, t1: str) -> DataFrame:
    """Venues by status between two windows; present in both is the default, also with zeros on both sides."""
    rows = fact.where("resolved AND venue IS NOT NULL").where(F.col("win").isin(t0, t1))
    cell = lambda t, flag: F.count_if((F.col("win") == t) & F.col(flag))
    out = rows.groupBy("venue").agg(cell(t0, "has_bloc").alias("bloc0"), cell(t1, "has_bloc").alias("bloc1"), cell(t0, "has_focal").alias("focal0"), cell(t1, "has_focal").alias("focal1"))
    status = F.when((F.col("bloc0") == 0) & (F.col("bloc1") > 0), "new").when((F.col("bloc0") > 0) & (F.col("bloc1") == 0), "gone").otherwise("both")
    return out.withColumns({"status": status, "delta_focal": F.col("focal1") - F.col("focal0"), "delta_bloc": F.col("bloc1") - F.col("bloc0")})


def expansion_summary(detail: DataFrame) -> DataFrame:
    out = detail.groupBy("status").agg(F.count("*").alias("venues"), *[F.sum(c).alias(c) for c in ("bloc0", "bloc1", "focal0", "focal1")])
    whole = Window.partitionBy()  # three statuses
    overall = lambda n: ratio(F.sum(f"focal{n}").over(whole), F.sum(f"bloc{n}").over(whole))
    return out.withColumns({"share0": ratio("focal0", "bloc0"), "share1": ratio("focal1", "bloc1"), "overall0": overall(0), "overall1": overall(1)})


def clusters(fact: DataFrame, *keys: str) -> DataFrame:
    """Sufficient statistics of each (venue, year) cluster."""
    return fact.where("resolved").groupBy(*keys, "venue", "year").agg(F.count_if("has_focal").alias("focal"), F.count_if("has_bloc").alias("bloc"), F.count("*").alias("articles"))


def bootstrap_observed(cl: DataFrame, *keys: str) -> DataFrame:
    out = cl.groupBy(*keys).agg(F.count("*").alias("clusters"), F.sum("articles").alias("articles"), F.sum("focal").alias("focal"), F.sum("bloc").alias("bloc"))
    return out.withColumn("share", ratio("focal", "bloc"))


def poisson_cuts(bits: int = 32) -> list[int]:
    """2**bits times the chance of a Poisson(1) count of at most 0, 1, ...: a uniform integer's count is the number of cuts that
    it reaches."""
    out, term, total = [], math.exp(-1), 0.0
    for k in range(1, 16):
        total += term
        out.append(min(int(total * (1 << bits)), 1 << bits))
        term /= k
    return out


def draw(*parts) -> Column:
    """A Poisson(1) count that is a function of its arguments alone: the first 32 bits of their digest, inverted."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("long")
    out = F.lit(0)
    for cut in poisson_cuts():
        out = out + F.when(u >= cut, 1).otherwise(0)
    return out


def bootstrap(cl: DataFrame, key: str, replicates: int = 500, seed: int = 12345) -> DataFrame:
    """Cluster bootstrap of the ratio: in each replicate a cluster counts as often as a Poisson(1) draw says.

    The draw is a function of seed, group, cluster and replicate, so it is the same wherever and however often a task runs,
    and one aggregation by group and replicate, combined before the shuffle, does it all. Replicate -1 is the observed one."""
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    # clusters are few and each makes many draws: they are spread over all cores first
    spread = cl.select(key, "venue", "year", "focal", "bloc").repartition(cl.sparkSession.sparkContext.defaultParallelism, "venue", "year", key)
    rows = spread.withColumn("_r", F.explode(F.sequence(F.lit(-1), F.lit(replicates - 1))))
    times = F.when(F.col("_r") < 0, 1).otherwise(draw(F.lit(str(seed)), name, F.col("venue").cast("string"), F.col("year").cast("string"), F.col("_r").cast("string")))
    sums = rows.withColumn("_t", times).groupBy(key, "_r").agg(F.count("*").alias("clusters"), F.sum(F.col("focal") * F.col("_t")).alias("focal"), F.sum(F.col("bloc") * F.col("_t")).alias("bloc"))
    sums = sums.withColumn("value", ratio("focal", "bloc"))
    drawn = F.when(F.col("_r") >= 0, F.col("value"))
    return sums.groupBy(key).agg(F.max("clusters").alias("clusters"), F.max(F.when(F.col("_r") < 0, F.col("value"))).alias("share"), F.percentile(drawn, 0.025).alias("low"), F.percentile(drawn, 0.975).alias("high"), F.stddev(drawn).alias("sd"))


def missingness_cells(fact: DataFrame, *factors: str) -> DataFrame:
    """Rows of the fact by factors: how many, and the share that is resolved. A binomial model of them is the one of the rows."""
    return fact.dropna(subset=list(factors)).groupBy(*factors).agg(F.count("*").cast("double").alias("n"), F.avg(F.col("resolved").cast("double")).alias("share"))


def _fitted(rows: DataFrame, formula: str, max_iter: int, weight: str | None):
    """The design of a formula and its binomial model."""
    from pyspark.ml.feature import RFormula
    from pyspark.ml.regression import GeneralizedLinearRegression

    data = RFormula(formula=formula, stringIndexerOrderType="alphabetDesc").fit(rows).transform(rows)  # the first category is the base
    glm = GeneralizedLinearRegression(family="binomial", maxIter=max_iter, tol=1e-10)
    names = [a["name"] for group in data.schema["features"].metadata["ml_attr"]["attrs"].values() for a in sorted(group, key=lambda a: a["idx"])]
    return data, (glm.setWeightCol(weight) if weight else glm).fit(data), [*names, "intercept"]


def logit(rows: DataFrame, formula: str, max_iter: int = 25, weight: str | None = None) -> DataFrame:
    """term, coefficient, standard error, p-value of a binomial model of rows, or of cells with their weights."""
    _, model, names = _fitted(rows, formula, max_iter, weight)
    s = model.summary
    values = [*model.coefficients.toArray().tolist(), model.intercept]
    return rows.sparkSession.createDataFrame([(n, float(v), float(e), float(p)) for n, v, e, p in zip(names, values, s.coefficientStandardErrors, s.pValues)], "term string, coefficient double, std_error double, p_value double")


def logit_totals(rows: DataFrame, formula: str, max_iter: int = 25, weight: str | None = None) -> DataFrame:
    """term, rows, observed and fitted totals of each term of a binomial model: where the likelihood is at its maximum, and only
    there, the fitted total of every term is the observed one."""
    from pyspark.ml.functions import vector_to_array

    data, model, names = _fitted(rows, formula, max_iter, weight)
    terms = F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("term"), F.array_append(vector_to_array("features"), F.lit(1.0)).alias("x")))
    w = F.col(weight) if weight else F.lit(1.0)
    each = model.transform(data).select(w.alias("w"), "label", "prediction", terms.alias("t")).select("w", "label", "prediction", "t.term", "t.x")
    return each.groupBy("term").agg(F.sum(F.col("w") * F.col("x")).alias("rows"), F.sum(F.col("w") * F.col("x") * F.col("label")).alias("observed"), F.sum(F.col("w") * F.col("x") * F.col("prediction")).alias("fitted"))
