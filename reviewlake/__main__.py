"""Command line (E10): list queries, run one, write its rows, or print the funnel and the dataset card.

python -m reviewlake list
python -m reviewlake run QUERY --data FOLDER [--out PATH] [--format parquet|csv|json] [--limit N]
python -m reviewlake show QUERY --data FOLDER [--limit N]
python -m reviewlake explain QUERY --data FOLDER
"""

from __future__ import annotations

import argparse
import sys

from reviewlake import catalog
from reviewlake.session import build_session


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="reviewlake", description="Queries over review and document corpora.")
    out.add_argument("command", choices=["list", "run", "show", "explain"])
    out.add_argument("query", nargs="?")
    out.add_argument("--data", help="folder of the tables")
    out.add_argument("--out", help="where the rows go (run)")
    out.add_argument("--format", choices=["parquet", "csv", "json"], default="parquet")
    out.add_argument("--limit", type=int, help="rows at most")
    out.add_argument("--master", help="Spark master, if no session is configured")
    return out


def main(argv: list[str] | None = None) -> int:
    options = parser().parse_args(argv)
    queries = catalog.queries()
    if options.command == "list":
        print("\n".join(sorted(queries)))
        return 0
    if options.query not in queries or not options.data or options.command == "run" and not options.out:
        print("give a listed query, --data, and for run --out", file=sys.stderr)
        return 2
    rows = queries[options.query](build_session(master=options.master), options.data)
    rows = rows if options.limit is None else rows.limit(options.limit)
    if options.command == "explain":
        rows.explain("formatted")
    elif options.command == "show":
        rows.show(options.limit or 20, truncate=False)
    else:
        rows.write.mode("overwrite").format(options.format).options(**({"header": "true"} if options.format == "csv" else {})).save(options.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
