"""Command line: list the registered queries or run one over a table folder.

    python -m textmill list
    python -m textmill run chunk_counts /root/testdata/sf0.01 [--out DIR] [--master local[8]]

Without ``--out`` the first rows are shown; with it the whole result is
written as parquet.
"""

from __future__ import annotations

import argparse

from .plans.queries import QUERIES
from .session import get_spark


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="textmill")
    sub = p.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="names of the registered queries")
    r = sub.add_parser("run", help="run one query")
    r.add_argument("query", choices=sorted(QUERIES))
    r.add_argument("sf_dir", help="folder with the parquet tables")
    r.add_argument("--out", help="write the result as parquet here")
    r.add_argument("--master", default=None, help="Spark master (default: the session's)")
    r.add_argument("--show", type=int, default=20, help="rows to show without --out")
    args = p.parse_args(argv)
    if args.cmd == "list":
        print("\n".join(sorted(QUERIES)))
        return
    spark = get_spark(args.master)
    df = QUERIES[args.query](spark, args.sf_dir)
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
        print(f"wrote {args.out}")
    else:
        df.show(args.show, truncate=80)


if __name__ == "__main__":
    main()
