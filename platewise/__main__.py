"""Command line: ``python -m platewise list`` and ``python -m platewise run NAME FOLDER [--out PATH] [--format FORMAT]``."""

from __future__ import annotations

import argparse

from platewise.plans import registry


def main(argv: list[str] | None = None, spark=None) -> int:
    """List the core's queries, or run one and print its first rows or write it whole."""
    parser = argparse.ArgumentParser(prog="platewise")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("name", choices=sorted(registry.queries()))
    run.add_argument("folder")
    run.add_argument("--out")
    run.add_argument("--format", choices=("parquet", "json", "csv", "markdown"), default="parquet")
    args = parser.parse_args(argv)
    if args.command == "list":
        for name, query in sorted(registry.queries().items()):
            print(name, "-", (query.__doc__ or "").strip().split("\n")[0])
        return 0
    from platewise import runtime, session
    from platewise.sources import formats

    df = registry.queries()[args.name](spark or session.build(), args.folder)
    if not args.out:
        df.show(truncate=False)
    elif args.format == "markdown":
        with open(args.out, "w", encoding="utf-8") as out:
            out.write(formats.markdown(args.name, df))
    else:
        {"parquet": formats.write_parquet, "json": formats.write_json, "csv": formats.write_csv}[args.format](df, args.out)
    runtime.free_all(df.sparkSession)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
