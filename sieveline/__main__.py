"""The command line. Prints counts, never contents; the exit code is 0 only if all inputs are accounted for.

    python -m sieveline run --config FILE [--source-id ID] [--batch-size N] [--resume] [--registry FOLDER]
    python -m sieveline calibrate --labels FILE --out FILE [--method identity|sigmoid|isotonic]
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from . import config
from .operators import calibration
from .plans.registry import Registry
from .plans.service import JobService, Request
from .sources import files


def report(service: JobService, job: dict) -> int:
    """Prints a job; rows only of a single one."""
    print(f"job_id={job['job_id']} status={job['status']} run_id={job['run_id']}")
    if job["exception"]:
        print(f"exception: {job['exception']}")
        return 1
    result = service.result(job)
    if result is None:
        return 1
    r = result.reconcile
    print(f"reconcile: input={r['input_count']} flagged={r['flagged']} not_flagged={r['not_flagged']} unable_to_process={r['unable_to_process']} reconciled={r['reconciled']}")
    if job["job_type"] == "single":
        for row in result.rows(service.spark)["item_summary"].orderBy("source_id").collect():
            print(f"{row['source_id']} | {row['flag_status']} | cats={row['sensitivity_categories']} | reason={row['reason_summary']}")
    print(f"outputs: {result.folder}")
    return 0 if r["reconciled"] else 1


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    cfg = config.load(args.config)
    service = JobService(spark, cfg, Registry(spark, args.registry))
    if args.source_id:
        request = Request("single", cfg.config_version, (args.source_id,))
    else:
        request = Request("batch", cfg.config_version, None, args.batch_size, args.resume)
    return report(service, service.run_now(request))


def calibrate(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = calibration.fit(files.labels(spark, args.labels), args.method, args.min_positives, args.max_holdout_error)
    with open(args.out, "w", encoding="utf-8") as f:
        f.write(calibration.artefact(rows, args.version) + "\n")
    print(f"wrote {args.out} (version={args.version})")
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sieveline")
    commands = parser.add_subparsers(required=True)
    p = commands.add_parser("run")
    p.add_argument("--config", required=True)
    p.add_argument("--source-id")
    p.add_argument("--batch-size", type=int, default=100_000)
    p.add_argument("--resume", action="store_true")
    p.add_argument("--registry", default=os.environ.get("SIEVELINE_REGISTRY", "registry"))
    p.set_defaults(command=run)
    p = commands.add_parser("calibrate")
    p.add_argument("--labels", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--method", default="identity", choices=calibration.METHODS)
    p.add_argument("--version", default="cal-0")
    p.add_argument("--min-positives", type=int, default=100)
    p.add_argument("--max-holdout-error", type=float, default=5.0)
    p.set_defaults(command=calibrate)
    args = parser.parse_args(argv)
    return args.command(spark or SparkSession.builder.appName("sieveline").getOrCreate(), args)


if __name__ == "__main__":
    raise SystemExit(main())
