"""python -m sharelens --list | QUERY... --path DIR [--out DIR] [--format F] [--force] [--optional QUERY] [--limit N] [--cpus N]

Options of single analyses: --draws, --seed, --policy, --include-excluded, --windows, and --papers N for a trial run on the first N papers.

Several queries, or --force, run as stages with a manifest: what an earlier run has written is read back unless forced."""

from __future__ import annotations

import argparse

from .params import Params, WindowSpec
from .plans import catalogue
from .session import session
from .sources.sinks import write_tables
from .sources.stages import Runner, Stage


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sharelens", description="Runs a query of the catalogue.")
    p.add_argument("query", nargs="*")
    p.add_argument("--force", action="store_true", help="run stages again that are in the manifest")
    p.add_argument("--optional", action="append", default=[], metavar="QUERY", help="a stage that may fail")
    p.add_argument("--list", action="store_true", help="names of all queries")
    p.add_argument("--path", help="folder of the tables")
    p.add_argument("--out", help="folder for the result; without it rows are shown")
    p.add_argument("--format", default="parquet", choices=("parquet", "csv", "json"))
    p.add_argument("--limit", type=int, default=20, help="rows shown")
    p.add_argument("--cpus", default="*")
    p.add_argument("--draws", type=int, default=Params.replicates, help="replicates of the bootstrap")
    p.add_argument("--seed", type=int, default=Params.seed, help="seed of the bootstrap")
    p.add_argument("--policy", choices=("infer", "all_a"), default=Params.policy, help="levels of a list without levels")
    p.add_argument("--include-excluded", action="store_true", help="keep the area that is left out by default")
    p.add_argument("--windows", metavar="A-B,...", help="other windows of years")
    p.add_argument("--papers", type=int, metavar="N", help="a trial run on the first N papers")
    args = p.parse_args(argv)
    if args.list or not args.query:
        print("\n".join(sorted(catalogue.queries())))
        return 0
    known = catalogue.queries()
    if not {*args.query, *args.optional} <= set(known) or not args.path:
        p.error("known queries and --path are needed")
    if (len(args.query) > 1 or args.force or args.optional) and not args.out:
        p.error("stages need --out")
    windows = WindowSpec(tuple(tuple(map(int, w.split("-"))) for w in args.windows.split(","))) if args.windows else Params.windows
    params = Params(windows=windows, replicates=args.draws, seed=args.seed, policy=args.policy, include_excluded=args.include_excluded, limit=args.papers)
    spark = session(args.cpus)
    if len(args.query) > 1 or args.force or args.optional:
        stages = [Stage(n, lambda frames, n=n: catalogue.run(n, spark, args.path, params), optional=n in args.optional) for n in dict.fromkeys([*args.query, *args.optional])]
        Runner(spark, args.out, stages).run(args.force).show(len(stages), truncate=False)
        return 0
    df = catalogue.run(args.query[0], spark, args.path, params)
    if args.out:
        print(write_tables({args.query[0]: df}, args.out, args.format)[args.query[0]])
    else:
        df.show(args.limit, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
