"""The analysis roles on the driver's star schema: papers are orders, their venue the customer's segment and nation,
their countries the nations of the suppliers of returned line items."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..params import Params

_SCHEMAS: dict[str, StructType] = {}


@dataclass
class Corpus:
    spark: SparkSession
    path: str
    params: Params = Params()

    def table(self, name: str) -> DataFrame:
        """Schemas are read from the files once per path and process."""
        path = f"{self.path}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    @cached_property
    def papers(self) -> DataFrame:
        """paper_id, year, win, venue, area, level, price: one row per paper."""
        o, c = self.table("orders"), self.table("customer")
        year = F.year("o_orderdate").cast("int")
        if self.params.limit:  # a trial run
            o = o.orderBy("o_orderkey").limit(self.params.limit)
        return o.join(c, o.o_custkey == c.c_custkey).select(
            F.col("o_orderkey").alias("paper_id"),
            year.alias("year"),
            self.params.windows.of(year).alias("win"),
            F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("venue"),
            F.col("c_mktsegment").alias("area"),
            F.when(F.col("c_nationkey") % 3 == 0, "A*").otherwise("A").alias("level"),
            F.col("o_totalprice").alias("price"),
        )

    @cached_property
    def nations(self) -> DataFrame:
        n = self.table("nation")
        return n.select("n_nationkey", F.col("n_name").alias("country"), (F.col("n_regionkey") == self.params.bloc_region).alias("is_bloc"), (F.col("n_name") == self.params.focal).alias("is_focal"))

    def lines(self, *columns: str) -> DataFrame:
        """Line items with their supplier's nation; dimensions are small and planned by size."""
        li, s = self.table("lineitem"), self.table("supplier")
        return li.join(s, li.l_suppkey == s.s_suppkey).join(self.nations, s.s_nationkey == F.col("n_nationkey")).select(F.col("l_orderkey").alias("paper_id"), "country", "is_bloc", "is_focal", *columns)

    @cached_property
    def country_rows(self) -> DataFrame:
        """paper_id, country with flags, as often as a line says so."""
        return self.lines("l_returnflag").where("l_returnflag = 'R'").select("paper_id", "country", "is_bloc", "is_focal")

    @cached_property
    def paper_country(self) -> DataFrame:
        """Distinct paper_id, country with flags."""
        return self.country_rows.distinct()

    @cached_property
    def paper_country_full(self) -> DataFrame:
        return self.paper_country.join(self.papers, "paper_id")

    @cached_property
    def evidence(self) -> DataFrame:
        """One row per line item: source, method, priority and confidence of a country."""
        prio = None
        for s, p in self.params.sources.items():
            prio = F.when(F.col("l_returnflag") == s, p) if prio is None else prio.when(F.col("l_returnflag") == s, p)
        return self.lines("l_returnflag", "l_linestatus", "l_linenumber", "l_discount").select("paper_id", "country", F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("method"), prio.alias("priority"), F.col("l_linenumber").alias("seq"), F.col("l_discount").alias("confidence"))

    @cached_property
    def authors(self) -> DataFrame:
        """paper_id, author_order, country: one row per distinct triple."""
        return self.lines("l_linenumber").select("paper_id", F.col("l_linenumber").alias("author_order"), "country", "is_focal").distinct()

    @cached_property
    def institutions(self) -> DataFrame:
        return self.lines("l_returnflag", "s_name").where("l_returnflag = 'R'").select("paper_id", F.col("s_name").alias("institution"), "country", "is_focal").distinct()

    @cached_property
    def venues(self) -> DataFrame:
        return self.table("customer").select(F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("venue"), F.col("c_mktsegment").alias("area"), F.col("c_nationkey").alias("nk")).distinct()

    @cached_property
    def ranking_raw(self) -> DataFrame:
        """A ranking history with gaps, late starts, absent venues and conflicting rows."""
        years = F.explode(F.array(*map(F.lit, (1994, 1996, 1998, 2000)))).alias("core_year")
        v = self.venues.where("nk % 11 <> 7")
        base = v.select("venue", "nk", years).where("(nk + core_year) % 5 <> 0 AND NOT (nk % 4 = 1 AND core_year < 1998)")
        level = F.when((F.col("nk") + F.floor(F.col("core_year") / 2)) % 3 == 0, "A*").otherwise("A")
        base = base.select("venue", "core_year", level.alias("level"), F.concat(F.lit("file"), "core_year").alias("source_file"), F.concat(F.lit("Conf "), "venue").alias("conference_name"))
        extra = v.where("nk % 6 = 0").select("venue", F.lit(1998).alias("core_year"), F.lit("A*").alias("level"), F.lit("extra1998").alias("source_file"), F.concat(F.lit("Conf "), "venue", F.lit(" b")).alias("conference_name"))
        return base.unionByName(extra)

    @cached_property
    def titles(self) -> DataFrame:
        """doc_id, lang, title: the first twelve normalised tokens of each document, written once."""
        from ..functions import text
        from .stages import table

        words = text.tokens(text.title_ascii(text.first_words(F.coalesce("text", F.lit("")), 12)))
        return table(self.table("documents").select("doc_id", "lang", F.array_join(F.slice(words, 1, 12), " ").alias("title")))
