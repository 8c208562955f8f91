"""For spark-submit: `snapshot` stores the registry roster, `batch` matches one batch."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from rosterloom.plans.batch import build_registry_snapshot, run_batch


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="rosterloom")
    commands = parser.add_subparsers(dest="command", required=True)
    snapshot = commands.add_parser("snapshot", help="read the registry files and store the snapshot")
    snapshot.add_argument("--files", required=True, help="folder of registry CSV files")
    snapshot.add_argument("--snapshot", required=True, help="where to store it")
    batch = commands.add_parser("batch", help="match a folder of uploads and write all results")
    batch.add_argument("--files", required=True, help="folder of uploaded CSV files")
    batch.add_argument("--snapshot", required=True)
    batch.add_argument("--out", required=True, help="folder for the results")
    batch.add_argument("--batch", required=True, help="name of the batch")
    batch.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    batch.add_argument("--linked", action="store_true", help="write the linked pairs, with address similarity")
    batch.add_argument("--enrollment", help="official enrolment table to check the uploads against")
    batch.add_argument("--enrollment-format", choices=("parquet", "csv"), default="parquet")
    for command in (snapshot, batch):
        command.add_argument("--encoding", default="UTF-8")
        command.add_argument("--single-line", action="store_true",
                             help="no line breaks within cells; spares a pass over the files")
        command.add_argument("--spell-bytes", action="store_true", help="write bytes that are not of the encoding as <xx>")
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName(f"rosterloom-{args.command}").getOrCreate()
    reading = {"encoding": args.encoding, "multiline": not args.single_line,
               "bad_bytes": "spell" if args.spell_bytes else "replace"}
    if args.command == "snapshot":
        build_registry_snapshot(spark, args.files, args.snapshot, **reading)
    else:
        run_batch(spark, args.snapshot, args.files, args.out, args.batch, form=args.format, linked=args.linked,
                  enrollment=args.enrollment, enrollment_form=args.enrollment_format, **reading)


if __name__ == "__main__":
    main()
