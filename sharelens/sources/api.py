"""A batched key-value source: keys are dealt in batches, each batch one call.

The fetch function is a parameter: offline it reads fixtures, online it calls a service. Calls keep to a rate per task, retries
back off exponentially, and keys without an answer come back with a null body (negative caching). Batches run in as many tasks
as the keys' partitions, so the workers' number is the cluster's."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fetch(keys: DataFrame, column: str, call: Callable[[list[str]], dict[str, str]], batch: int = 100, retries: int = 5, longest: float = 180.0, pause: float = 1.0, rate: float | None = None, one_by_one: bool = False, errors: tuple[type[Exception], ...] = (OSError, ValueError)) -> DataFrame:
    """key, body, status of each distinct key. rate: calls a second and task at most; one_by_one: a batch that fails for good is
    asked for again key by key; errors: what is tried again, anything else ends the job."""

    def run(batches):
        import pyarrow as pa

        last = [0.0]

        def asked(part):
            for attempt in range(retries):
                if rate:
                    time.sleep(max(0.0, last[0] + 1 / rate - time.monotonic()))
                    last[0] = time.monotonic()
                try:
                    return call(part)
                except errors:
                    time.sleep(min(longest, pause * 2**attempt))
            return None

        for b in batches:
            names = b.column(0).to_pylist()
            bodies, status = [], []
            for i in range(0, len(names), batch):
                part = names[i : i + batch]
                got = asked(part)
                answers = {k: got for k in part}
                if got is None and one_by_one:
                    answers = {k: asked([k]) for k in part}
                bodies += [(answers[k] or {}).get(k) for k in part]
                status += ["failed" if answers[k] is None else "found" if k in answers[k] else "absent" for k in part]
            yield pa.RecordBatch.from_pydict({"key": pa.array(names, pa.string()), "body": pa.array(bodies, pa.string()), "status": pa.array(status, pa.string())})

    distinct = keys.select(F.col(column).cast("string").alias("key")).where("key IS NOT NULL").distinct()
    return distinct.mapInArrow(run, "key string, body string, status string")


class TooManyPages(Exception):
    """A source that goes on after the pages asked for."""


def paged(source: Callable[[str, int, str | None], tuple[list[str], str | None]], pages: int = 20):
    """A call over (source, year) keys "id|year" that follows cursors and joins the pages as one JSON array. A source with more than
    `pages` pages is an error that is not tried again: nothing is left out in silence."""

    def call(keys: list[str]) -> dict[str, str]:
        out = {}
        for k in keys:
            ident, year = k.rsplit("|", 1)
            rows, cursor = [], None
            for _ in range(pages):
                got, cursor = source(ident, int(year), cursor)
                rows += got
                if not cursor:
                    break
            else:
                raise TooManyPages(f"{k} has more than {pages} pages")
            if rows:
                out[k] = "[" + ",".join(rows) + "]"
        return out

    return call
