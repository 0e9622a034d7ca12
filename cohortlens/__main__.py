"""Run the whole report: ``python -m cohortlens --tables DIR --out DIR``.

Reads the five tables, writes cohort, exposures and the four report tables as
parquet, and prints the tables in their text form.
"""

from __future__ import annotations

import argparse

from . import plans
from .session import build_session
from .sources import clear_run, load_tables, standin_tables


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="cohortlens", description="Build the cohort report.")
    parser.add_argument("--tables", required=True, help="folder with the five tables as parquet")
    parser.add_argument("--out", required=True, help="folder for the frozen results")
    parser.add_argument("--top", type=int, default=5, help="number of drugs in the last table")
    parser.add_argument("--master", help="Spark master, when not given by spark-submit")
    parser.add_argument(
        "--stand-in", action="store_true", help="derive the five tables from the order test data"
    )
    args = parser.parse_args(argv)
    spark = build_session("cohort-report", args.master)
    read = standin_tables if args.stand_in else load_tables
    frozen = plans.freeze_report(spark, read(spark, args.tables), args.out, k=args.top)
    for table in plans.present_report(frozen).values():
        titles = plans.titles_of(table)
        print(titles.title)
        table.show(max(1, table.count()), truncate=False)
        if titles.note:
            print(titles.note)
    clear_run(spark)


if __name__ == "__main__":
    main()
