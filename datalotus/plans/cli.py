"""Command line: profile, run (clean and profile), clean, dataset."""

from __future__ import annotations

import argparse
import re
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from datalotus.operators import clean
from datalotus.plans import profile as P
from datalotus.session import ship
from datalotus.sources import files

TARGETS = ("target", "label", "class", "y", "outcome", "churn", "default", "survived")


def guess_target(columns: list[str]) -> str | None:
    low = {c.lower(): c for c in columns}
    exact = next((low[t] for t in TARGETS if t in low), None)
    return exact or next((c for c in columns if re.search(rf"(?i)(^|_)({'|'.join(TARGETS)})($|_)", c)), None)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="datalotus")
    parser.add_argument("command", choices=("profile", "run", "clean", "dataset"))
    parser.add_argument("path")
    parser.add_argument("--output", "-o")
    parser.add_argument("--format", default="auto")
    parser.add_argument("--sample", type=int)
    parser.add_argument("--lang", default="en", choices=("en", "th"))
    parser.add_argument("--target")
    args = parser.parse_args(argv)
    if not Path(args.path).exists():
        print(f"no such path: {args.path}", file=sys.stderr)
        return 2
    spark = ship(SparkSession.builder.getOrCreate())
    if args.command == "dataset":
        print(P.profile_dataset(spark, args.path)["diagram"])
        return 0
    df = files.read_data(spark, args.path, args.format)
    if not df.columns or df.isEmpty():
        print("the table is empty or can't be read", file=sys.stderr)
        return 1
    df = files.sample_rows(df, args.sample) if args.sample else df
    if args.command == "clean":
        done, audit = clean.clean(df)
        audit.show(truncate=False)
        files.write_data(done, args.output or f"{args.path}.clean", "csv")
        return 0
    result = P.profile(df, clean_first=args.command == "run", target=args.target or guess_target(df.columns), lang=args.lang)
    (result.to_html if (args.output or "").endswith(".html") else result.to_json)(args.output)
    print(result.story["headline"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
