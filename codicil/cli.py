"""Command line: convert files, or print what their headers say.

Every positional argument is an input. Exit status: 0 clean, 1 failed, 3 converted
with complaints (by which it hides a failure of another file; --strict-exit gives 1 then).
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from codicil.operators import report
from codicil.plans import convert, outputs
from codicil.sources import files, sink

# Fixed values of the interface: names a mode goes by.
MODE_NAMES = {"none": "none", "off": "none", "plain": "none", "ofb": "ofb", "3des-ofb": "ofb", "cfb": "cfb64", "cfb64": "cfb64", "3des-cfb64": "cfb64"}


class UsageError(ValueError):
    """Arguments that don't make sense."""


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise UsageError(message)


def _mode(text: str) -> str:
    if text.lower() not in MODE_NAMES:
        raise argparse.ArgumentTypeError(f"`{text}` is not none, ofb or cfb64")
    return MODE_NAMES[text.lower()]


def _jobs(text: str) -> int:
    if not text.isdigit() or int(text) < 1:
        raise argparse.ArgumentTypeError(f"`{text}` is not a positive integer")
    return int(text)


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="codicil", description="Recover the documents inside sealed containers.", allow_abbrev=False)
    p.add_argument("inputs", nargs="*", metavar="FILE")
    p.add_argument("-o", "--output", help="output file of one input, or a directory that exists")
    p.add_argument("-j", "--jobs", type=_jobs, help="tasks at a time (default: the CPUs, at most the files)")
    p.add_argument("-f", "--force", action="store_true", help="overwrite outputs")
    p.add_argument("-v", "--verbose", action="count", default=0, help="report each layer; twice: each section")
    p.add_argument("-q", "--quiet", action="store_true", help="errors and warnings only")
    p.add_argument("--dump-meta", action="store_true", help="print the container's structure; convert nothing")
    p.add_argument("--no-verify", action="store_true", help="leave the self-check out")
    p.add_argument("--force-mode", type=_mode, metavar="MODE", help="none, ofb or cfb64, whatever the file says")
    p.add_argument("--bounds", choices=["keyword", "length"], default="keyword", help="find payloads by keywords alone, or by declared lengths and what inflates too")
    p.add_argument("--strict-exit", action="store_true", help="exit with 1 if any file failed")
    p.add_argument("-V", "--version", action="version", version="codicil 0.1")
    return p


def parse(argv: list[str]) -> argparse.Namespace:
    args = parser().parse_args(argv)
    if not args.inputs:
        raise UsageError("no input files")
    if args.quiet and args.verbose:
        raise UsageError("--quiet and --verbose exclude each other")
    return args


def _session(args: argparse.Namespace) -> SparkSession:
    jobs = min(args.jobs or os.cpu_count() or 1, len(args.inputs)) or 1
    spark = SparkSession.builder.master(f"local[{jobs}]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.sql.files.openCostInBytes", "1m").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    return spark


def _say(text: str, error: bool = False) -> None:
    print(text, end="" if text.endswith("\n") else "\n", file=sys.stderr if error else sys.stdout, flush=True)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parse(sys.argv[1:] if argv is None else argv)
    except UsageError as e:
        _say(f"codicil: {e}", True)
        return report.FAILED
    spark = spark or _session(args)
    paths = {os.path.abspath(p): p for p in args.inputs}
    there = [p for p in paths if os.path.isfile(p)]
    codes = [report.OK]
    for p in paths.keys() - set(there):
        _say(f"codicil: {paths[p]}: no such file", True)
        codes.append(report.FAILED)
    found = files.read(spark, there).withColumn("path", outputs.normal(F.col("path"))) if there else None
    if args.dump_meta:
        for r in report.metadata_dump(convert.inspect(found)).toLocalIterator() if found is not None else ():
            _say(r["dump"] if r["code"] == report.OK else f"codicil: {r['path']}: {r['error']['message']}", r["code"] != report.OK)
            codes.append(r["code"])
        return max(codes)
    directory = args.output is not None and os.path.isdir(args.output)
    target = os.path.abspath(args.output) if args.output is not None else None
    planned = outputs.plan(spark.createDataFrame([(p,) for p in paths], "path string"), target, directory)
    try:
        outputs.refuse_unsafe(planned, args.output, directory or args.output is None)
    except outputs.PlanError as e:
        _say(f"codicil: {e}", True)
        return report.FAILED
    if found is None:
        return max(codes)
    folders = {r[0] for r in planned.select(F.regexp_extract("output", "^(.*)/", 1)).distinct().toLocalIterator()}
    listing = [(os.path.join(f, name),) for f in folders if os.path.isdir(f or "/") for name in os.listdir(f or "/")]
    there_already = outputs.existing(planned, spark.createDataFrame(listing, "path string"))
    if not args.force:
        for r in there_already.toLocalIterator():
            _say(f"codicil: {paths[r['path']]}: {r['output']} exists already; --force overwrites", True)
            codes.append(report.FAILED)
    todo = planned if args.force else planned.join(there_already.select("path"), "path", "left_anti")
    done = files.with_size_errors(convert.convert(found, args.force_mode, not args.no_verify, bounds=args.bounds)).join(F.broadcast(todo), "path").persist()
    sink.write_documents(done, True)
    rows = done.select("path", "output", "code", "error", "complaints", F.when(F.col("error").isNull(), report.summary(F.col("path"), F.col("output"))).alias("summary"), F.when(F.col("error").isNull(), report.detail(max(1, args.verbose))).alias("detail"))
    for r in rows.toLocalIterator():
        codes.append(r["code"])
        if r["error"]:
            _say(f"codicil: {r['path']}: {r['error']['message']}", True)
            continue
        if not args.quiet:
            _say(r["summary"] + (r["detail"] if args.verbose else ""))
        if r["complaints"]:
            _say(f"codicil: {r['path']}: the output is INCOMPLETE:\n" + "".join(f"  warning: {c}\n" for c in r["complaints"]) + f"  {r['output']} was written all the same", True)
    done.unpersist()
    return report.FAILED if args.strict_exit and report.FAILED in codes else max(codes)


if __name__ == "__main__":
    sys.exit(main())
