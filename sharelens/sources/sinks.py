"""Sinks: tables in one format each, and figures where matplotlib is installed."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def write_tables(tables: Mapping[str, DataFrame], folder: str, kind: str = "parquet", single: bool = False) -> dict[str, str]:
    """Each table to folder/name; Spark's commit protocol makes a write all or nothing. `single` is for small reports."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder}/{name}"
        out = (df.coalesce(1) if single else df).write.mode("overwrite")
        (out.option("header", True) if kind == "csv" else out).format(kind).save(paths[name])
    return paths


def figure(df: DataFrame, x: str, y: str, path: str, kind: str = "line", most: int = 200) -> bool:
    """A line or bar figure of a small table, collected at the edge; False without matplotlib, an error beyond `most` points."""
    rows = df.select(x, y).orderBy(x).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a figure of more than {most} points")
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot
    except ImportError:
        return False
    fig, ax = pyplot.subplots()
    (ax.barh if kind == "barh" else ax.plot)([str(r[0]) for r in rows], [r[1] for r in rows])
    ax.set(xlabel=x if kind == "line" else y, ylabel=y if kind == "line" else x)
    fig.savefig(path, bbox_inches="tight")
    pyplot.close(fig)
    return True
