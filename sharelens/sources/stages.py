"""Written stages, manifests and the runner."""

from __future__ import annotations

import atexit
import json
import tempfile
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession


def written(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder named by spark.checkpoint.dir; lineage is cut. Set only where it is unset."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def table(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: what several branches of a plan read, columns pruned."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only where it is unset and the master is local, a folder of our own."""
    base, held = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext._jsc.sc().getCheckpointDir()
    if not base and held.isDefined():
        base = held.get()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="sharelens-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_FOLDERS: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession) -> str:
    """A new folder's path in the shared folder; deleted when the process ends."""
    if not _FOLDERS:
        atexit.register(_clear)
    _FOLDERS.append((spark, f"{shared_folder(spark)}/sharelens-{uuid.uuid4().hex}"))
    return _FOLDERS[-1][1]


def _clear() -> None:
    while _FOLDERS:
        spark, path = _FOLDERS.pop()
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session has ended; the shared folder's owner clears it
            return


@dataclass
class StageResult:
    name: str
    status: str
    seconds: float
    reason: str = ""


@dataclass
class Stage:
    """run(frames) returns a DataFrame; needs are names of earlier stages; optional stages may fail."""

    name: str
    run: Callable[[dict[str, DataFrame]], DataFrame | None]
    needs: tuple[str, ...] = ()
    optional: bool = False


class Skip(Exception):
    """Raised by a stage whose optional input is absent."""


@dataclass
class Runner:
    spark: SparkSession
    out: str
    stages: list[Stage]
    results: list[StageResult] = field(default_factory=list)

    def run(self, force: bool = False) -> DataFrame:
        """Runs stages in order, each written as Parquet with a manifest row; finished ones are read back unless forced."""
        frames: dict[str, DataFrame] = {}
        done = {} if force else self._finished()
        for s in self.stages:
            began, path = time.time(), f"{self.out}/{s.name}"
            missing = [n for n in s.needs if n not in frames]
            status, reason = "OK", ""
            try:
                if missing:
                    raise Skip(f"needs {missing}")
                if s.name in done:
                    status = "CACHED"
                else:
                    df = s.run(frames)
                    if df is None:
                        raise Skip("no input")
                    df.write.mode("overwrite").parquet(path)
                frames[s.name] = self.spark.read.parquet(path)
            except Skip as e:
                status, reason = "SKIPPED", str(e)
            except Exception as e:  # noqa: BLE001 - an optional stage may fail for any reason
                if not s.optional:
                    raise
                status, reason = "OPTIONAL_FAILED", str(e).splitlines()[0][:300]
            self.results.append(StageResult(s.name, status, round(time.time() - began, 3), reason))
        summary = self.spark.createDataFrame([asdict(r) for r in self.results], "name string, status string, seconds double, reason string")
        summary.coalesce(1).write.mode("overwrite").json(f"{self.out}/_summary-{uuid.uuid4().hex}")
        self.spark.createDataFrame([(json.dumps([r.name for r in self.results if r.status in ("OK", "CACHED")]),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.out}/_manifest")
        return summary

    def _finished(self) -> dict[str, bool]:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.out}/_manifest")
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return {}
        text = self.spark.read.text(f"{self.out}/_manifest").first()
        return dict.fromkeys(json.loads(text["value"]), True) if text else {}
