"""Parameters of an analysis: time windows, focal entity, bloc, thresholds and scenarios."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class WindowSpec:
    """Bins of years, both ends included. Years outside are null, or an error with `strict`."""

    bins: tuple[tuple[int, int], ...]

    @property
    def labels(self) -> list[str]:
        return [f"{a}-{b}" for a, b in self.bins]

    def of(self, year: Column, strict: bool = False) -> Column:
        out = None
        for (a, b), label in zip(self.bins, self.labels):
            out = F.when(year.between(a, b), label) if out is None else out.when(year.between(a, b), label)
        return out.otherwise(F.raise_error(F.concat(F.lit("no window has the year "), F.coalesce(year.cast("string"), F.lit("null"))))) if strict else out

    def order(self, column: str = "win") -> Column:
        return F.array_position(F.array(*map(F.lit, self.labels)), F.col(column))


@dataclass(frozen=True)
class Params:
    # Windows and thresholds of the analyses.
    windows: WindowSpec = WindowSpec(((1995, 1996), (1997, 1998), (1999, 2000), (2001, 2002)))
    focal: str = "NATION_3"
    bloc_region: int = 3
    comparators: tuple[str, ...] = ("NATION_3", "NATION_8", "NATION_13", "NATION_18", "NATION_23")
    thresholds: tuple[float, ...] = (0.30, 0.50, 0.70, 0.80, 0.90)
    sources: dict[str, int] = field(default_factory=lambda: {"A": 1, "N": 2, "R": 3})
    #: Options of single analyses: draws and seed of the bootstrap, the policy for a list without levels, an area left out unless
    #: included, and how many papers (the first by key) a trial run takes.
    replicates: int = 500
    seed: int = 12345
    policy: str = "infer"
    excluded_area: str = "FURNITURE"
    include_excluded: bool = False
    limit: int | None = None
