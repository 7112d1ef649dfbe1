"""Sinks, command line, and the library without its optional subpackage."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

from sharelens.__main__ import main
from sharelens.operators import matching
from sharelens.sources import sinks

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_sinks(spark, tmp_path):
    df = spark.range(3).select("id", (F.col("id") * 2).alias("v"))
    paths = sinks.write_tables({"a": df, "b": df}, str(tmp_path), "csv", single=True)
    assert spark.read.option("header", True).csv(paths["b"]).count() == 3
    assert sinks.figure(df, "id", "v", str(tmp_path / "f.png")) in (True, False)


def test_command_line_lists_queries(capsys):
    assert main(["--list"]) == 0
    assert "basic_metrics_window" in capsys.readouterr().out.split()


def test_options_of_analyses(spark, tmp_path, capsys):
    """A trial run on few papers, other windows, and an area that is kept."""
    out = str(tmp_path / "o")
    path = "/root/testdata/sf0.001"
    assert main(["paper_counts_by_year", "--path", path, "--out", out, "--papers", "50"]) == 0
    assert spark.read.parquet(f"{out}/paper_counts_by_year").agg({"papers": "sum"}).first()[0] == 50
    assert main(["basic_metrics_excluded_area", "--path", path, "--out", out, "--windows", "1995-1998,1999-2002", "--include-excluded"]) == 0
    rows = spark.read.parquet(f"{out}/basic_metrics_excluded_area").collect()
    assert {r.win for r in rows} == {"1995-1998", "1999-2002"} and sum(r.total for r in rows) == spark.read.parquet(f"{path}/orders.parquet").count()
    assert main(["bootstrap_ci", "--path", path, "--out", out, "--draws", "40", "--seed", "1"]) == 0
    a = {r.win: r.sd for r in spark.read.parquet(f"{out}/bootstrap_ci").collect()}
    assert main(["bootstrap_ci", "--path", path, "--out", out, "--draws", "40", "--seed", "2"]) == 0
    assert a != {r.win: r.sd for r in spark.read.parquet(f"{out}/bootstrap_ci").collect()}
    capsys.readouterr()


def test_download_goes_on_where_it_stopped(tmp_path):
    import http.server
    import threading

    from sharelens.sources.download import download

    body, asked = bytes(range(256)) * 40, []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            start = int((self.headers.get("Range") or "bytes=0-")[6:-1])
            asked.append(start)
            self.send_response(206 if start else 200)
            self.send_header("Content-Length", str(len(body) - start))
            self.end_headers()
            self.wfile.write(body[start : 4000 if len(asked) == 1 else None])  # the first answer breaks off

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, path = f"http://127.0.0.1:{server.server_port}/dump", str(tmp_path / "dump")
    try:
        download(url, path)
    except OSError:
        pass
    assert not os.path.exists(path) and 0 < os.path.getsize(path + ".part") <= 4000
    assert download(url, path) == len(body) == download(url, path)
    assert open(path, "rb").read() == body and not os.path.exists(path + ".part") and len(asked) == 2 and asked[1] > 0
    server.shutdown()


def test_first_source_and_zip(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    assert {(r.k, r.v, r.priority) for r in matching.first_source(a, b, key="k").collect()} == {(1, "x", 0), (2, "z", 1)}
    z = spark.createDataFrame([(1, ["a", "b"], ["c"])], "k int, l array<string>, r array<string>")
    assert [tuple(r) for r in matching.zipped(z, "l", "r").collect()] == [(1, 1, "a", "c"), (1, 2, "b", None)]
    assert matching.with_columns_or_empty(a, "v", "url").columns == ["k", "v", "url"]


def test_the_rest_works_without_the_optional_part():
    code = """
import sys
class Block:
    def find_spec(self, name, *a):
        if name.startswith('sharelens.llm') or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
assert len(e.queries()) > 90 and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": ROOT})
